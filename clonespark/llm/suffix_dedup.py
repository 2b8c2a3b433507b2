"""Suffix-array dedup by a run-length index: bytes that an earlier document has.

A byte is removed if a string of ``length`` bytes that covers it also starts in a
document with a smaller id.  Every such string (a *window*) is judged on the input.

Method
------
1. The *anchor* of a window is the string of about half its length inside it
   with the least hash.  Equal windows have equal anchors, so only windows whose
   anchor two documents have can repeat.  Neighbouring windows of one anchor make
   a *segment* of fewer than twice ``length`` bytes.
2. Documents are dealt to blocks, in a table that is bucketed by block and so
   never shuffled again.  A block sends its distinct anchors, a few bytes each, to
   buckets by hash; a bucket answers with bits: which of them two documents have.
3. A block sends its distinct segments with such anchors, each with the least id
   that has it, to buckets of the same kind.  An anchor that is crowded in some block
   would bring too many different segments to one bucket, so its windows are sent
   one by one, each to the bucket of its own hash.
4. In a bucket, copies of a segment have its windows; a segment of which no other one
   has a window, as their hashes tell, has no further match.  Of the other segments the bucket
   builds the run-length Burrows-Wheeler transform, with
   text places sampled at the ends of runs, and with the least id of every interval of
   rows that share ``length`` bytes.  They are streamed through it from right
   to left: a row follows its run, or jumps to the better one of the two next ends of
   runs of the wanted byte, which the common prefix with the sampled places decides.
   That gives each place's longest match and a row that has it; a match of ``length`` or more
   whose interval has a smaller id marks the window.
5. A block gets a bit for each window and removes what they cover.

Work grows with the bytes: every window meets its equals in one bucket, and no block
meets another.  Nothing is left out: hashes choose where strings meet, bytes decide.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from clonespark.llm.common import NO_ID, bytes_of, cut, free_name, give_back, others, text_of
from clonespark.staging import scratch

try:
    import zstandard
except ImportError:  # rows are sent as they are
    zstandard = None

#: Bytes of a block's texts, for up to a terabyte in all; they grow with the root of the input up to 16 times that.
BLOCK = 16 << 20
#: Bytes of a block for each of its buckets.
SHARE = 14000
#: Anchors of a bucket at most, on average.
MOST = 1 << 24
#: Segments of one anchor in one block from which its windows are dealt one by one.
CROWD = 64

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
#: Bits of a place in a piece, which stand below those of its hash.
_LOW = 17
_PIECE = 1 << 16
#: Bytes of the strings that an index has a table of.
SEED = 5
_HASH_BITS = 64 - _LOW
_BYTES = np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64)
_WORDS = np.random.default_rng(12).integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)


# ---- anchors and segments


def anchor_length(length: int) -> int:
    return length // 2 - 1


@dataclass(frozen=True)
class Plan:
    """What all tasks of one run agree on: ``bits`` of an anchor's hash, enough that few of
    all anchors meet another by chance (that costs work, never a byte), and ``buckets``."""

    length: int
    buckets: int
    bits: int

    def bucket_of(self, hashes: np.ndarray) -> np.ndarray:
        """Buckets are ranges of hashes, so that sorted hashes have sorted buckets."""
        return (hashes.astype(np.float64) / float(1 << self.bits) * self.buckets).astype(np.int64).clip(0, self.buckets - 1)

    @property
    def planes(self) -> int:
        """Bytes of a hash that tell it within its bucket."""
        return max(1, -(-(self.bits - int(math.log2(self.buckets)) + 1) // 8))


def squeezed(*parts: np.ndarray) -> bytes:
    b = b"".join(np.ascontiguousarray(p).tobytes() for p in parts)
    return zstandard.ZstdCompressor(level=1).compress(b) if zstandard else b


def stretched(b: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b) if zstandard else b, np.uint8)


@dataclass
class Segments:
    """Runs of neighbouring windows that share an anchor."""

    hashes: np.ndarray
    starts: np.ndarray  # in the block's bytes
    windows: np.ndarray
    docs: np.ndarray

    def where(self, keep: np.ndarray) -> Segments:
        return Segments(self.hashes[keep], self.starts[keep], self.windows[keep], self.docs[keep])


def _rolled(piece: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all strings of ``k`` bytes."""
    powers, n, out, done = _BYTES[piece], 1, None, 0
    while True:
        if k & n:  # strings of n bytes stand before those that are done
            out = powers[: len(piece) - n + 1] if out is None else powers[: len(out) - n] * np.uint64(pow(_BASE, done, 1 << 64)) + out[n:]
            done += n
        if 2 * n > k:
            break
        powers = powers[:-n] * np.uint64(pow(_BASE, n, 1 << 64)) + powers[n:]
        n *= 2
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


def segments_of(data: np.ndarray, at: np.ndarray, length: int, bits: int = _HASH_BITS) -> Segments:
    """Segments of all texts, with ``bits`` of their anchors' hashes; text i is ``data[at[i]:at[i + 1]]``."""
    k = anchor_length(length)
    width = length - k + 1
    inside = np.zeros(len(data) + 1, np.int8)
    whole = np.flatnonzero(np.diff(at) >= length)
    inside[at[whole]] = 1
    inside[at[whole + 1] - length + 1] = -1
    inside = np.cumsum(inside, dtype=np.int8)[:-1].astype(bool)
    found = []
    for lo in range(0, len(data) - length + 1, _PIECE):
        hi = min(lo + _PIECE, len(data) - length + 1)
        if not inside[lo:hi].any():
            continue
        least = _rolled(data[lo : hi + length - 1], k)
        least &= np.uint64(_MASK << _LOW & _MASK)
        least |= np.arange(len(least), dtype=np.uint64)
        n = 1
        while 2 * n <= width:
            least = np.minimum(least[:-n], least[n:])
            n *= 2
        if n < width:
            least = np.minimum(least[: len(least) - width + n], least[width - n :])
        ok = inside[lo:hi]
        change = np.ones(hi - lo + 1, bool)
        np.not_equal(least[1:], least[:-1], out=change[1:-1])
        first = np.flatnonzero(ok & (change[:-1] | ~np.concatenate([[False], ok[:-1]])))
        last = np.flatnonzero(ok & (change[1:] | ~np.concatenate([ok[1:], [False]])))
        found.append((_spread(least[first] >> np.uint64(_LOW)) >> np.uint64(64 - bits), first + lo, last - first + 1))
    if not found:
        none = np.zeros(0, np.int64)
        return Segments(none.astype(np.uint64), none, none, none)
    hashes, starts, windows = (np.concatenate(x) for x in zip(*found, strict=True))
    return Segments(hashes, starts, windows, np.searchsorted(at, starts, side="right") - 1)


def _spread(hashes: np.ndarray) -> np.ndarray:
    """Least hashes are small ones; these are even."""
    out = hashes * np.uint64(_BASE)
    out ^= out >> np.uint64(32)
    return out * np.uint64(0xD6E8FEB86659FD93)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that sorts, first places of equal keys in it)."""
    order = np.argsort(keys, kind="stable")
    held = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _planes(values: np.ndarray, n: int) -> bytes:
    """The last ``n`` bytes of each hash, first bytes first: sorted ones compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :n][:, ::-1].T).tobytes()


def _from_planes(b: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(b) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(b, np.uint8).reshape(n, -1).T[:, ::-1]
    return out.view(np.uint64).ravel()


# ---- the index of a bucket


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in order of their keys and then of themselves, dense rank of each place)."""
    n = len(keys)
    bits = max(1, (n - 1).bit_length())
    if n and int(keys.max()).bit_length() + bits < 63:
        held = np.sort(keys << bits | np.arange(n))
        order = held & ((1 << bits) - 1)
        held >>= bits
    else:
        order = np.argsort(keys, kind="stable")
        held = keys[order]
    ranks = np.empty(n, np.int64)
    ranks[order] = np.cumsum(np.concatenate([[0], held[1:] != held[:-1]])) if n else 0
    return order, ranks


class RunLengthIndex:
    """Run-length Burrows-Wheeler transform of many short texts.

    Each text ends in a terminator of its own, ordered by the text's number; a match
    never goes beyond it.  Kept are the runs' bytes, first rows and what they are
    mapped to, the text places of the first and last row of each run, where each string
    of five bytes begins, and for intervals of rows that share ``length`` bytes their first row and least id.
    """

    def __init__(self, rows: np.ndarray, sizes: np.ndarray, ids: np.ndarray, length: int) -> None:
        """``rows``: texts, bytes one higher and zeros behind the end, at least one; ``ids``: what intervals have the least of."""
        self.length = length
        here = np.arange(rows.shape[1])[None, :] <= sizes[:, None]
        text = rows[here]
        self.row_of = np.repeat(np.arange(len(rows)), sizes + 1)
        first = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.text, self.left = text, left = text, sizes[self.row_of] - (np.arange(len(text)) - first[self.row_of])
        order, same = self._sorted(text, left, int(sizes.max()))
        before = text[order - 1]  # of the first place: the terminator of the last text
        starts = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        ends = np.concatenate([starts[1:], [len(before)]])
        self.heads, self.starts, self.ends = before[starts], starts, ends
        self.run_of = np.repeat(np.arange(len(starts), dtype=np.int32), ends - starts)  # quicker than a search
        self.first_place, self.last_place = order[starts], order[ends - 1]
        by_byte = np.argsort(self.heads, kind="stable")
        mapped = np.empty(len(starts), np.int64)
        sizes_of = (ends - starts)[by_byte]
        mapped[by_byte] = np.cumsum(sizes_of) - sizes_of
        self.mapped = mapped
        self.by_byte = by_byte  # runs of each byte, in order
        self.span = np.searchsorted(self.heads[by_byte], np.arange(257))
        self.keys = self.heads[by_byte].astype(np.int64) * len(starts) + by_byte
        self.intervals = np.flatnonzero(np.concatenate([[True], ~same]))
        self.least = np.minimum.reduceat(ids[self.row_of[order]], self.intervals)

    def _sorted(self, text: np.ndarray, left: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in order, by prefix doubling from five bytes, and which share ``length`` bytes with the one before."""

        def ahead(values: np.ndarray, n: int) -> np.ndarray:
            out = np.zeros_like(values)
            out[: max(0, len(values) - n)] = values[n:]
            return np.where(left >= n, out, 0)

        key = text.astype(np.int64)
        last = ahead(key, 4)
        key = key << 8 | ahead(key, 1)
        key = (key << 16 | ahead(key, 2)) << 8 | last
        n, shared, self.steps = SEED, None, []
        order, ranks = ranked(key)
        self.seed_rows = np.flatnonzero(np.diff(key[order], prepend=-1))
        self.seeds = key[order[self.seed_rows]]
        while True:
            self.steps.append((n, ranks.astype(np.int32)))
            if shared is None and 2 * n >= self.length:
                shared = np.where(left >= self.length, ranks * len(text) + ahead(ranks, self.length - n), -1)
            order, ranks = ranked(ranks * (int(ranks.max()) + 1) + ahead(ranks, n))
            n *= 2
            if n > longest and shared is not None:
                break
        self.seed_places = order[self.seed_rows]
        keys = shared[order]
        return order, (keys[1:] == keys[:-1]) & (keys[1:] >= 0)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at two text places share."""
        a, b = a.copy(), b.copy()
        out, most = np.zeros(len(a), np.int64), np.minimum(self.left[a], self.left[b])
        for n, ranks in reversed(self.steps):
            equal = (ranks[a] == ranks[b]) & (out + n <= most)
            ahead = equal * n
            out += ahead
            a += ahead
            b += ahead
        going = np.flatnonzero(out < most)
        while len(going):
            going = going[self.text[a[going]] == self.text[b[going]]]
            out[going] += 1
            going = going[out[going] < most[going]]
            a[going] += 1
            b[going] += 1
        return out

    def stream(self, rows: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Matching statistics of many texts at once, from their last bytes to their first.

        ``sizes`` must fall.  Gives for each distance from the end, but for the first ones if they are
        known from a table, the number of texts that are that long, their columns, and there the length of the longest match and a row that has it.
        """
        row, long_, place = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.full(len(rows), self.first_place[0])
        flat, width, begin = rows.ravel(), rows.shape[1], 1
        if len(sizes) and sizes[-1] >= SEED:  # if all texts' last bytes are known, the first steps are a look into the table
            key = np.zeros(len(rows), np.int64)
            for back in range(SEED, 0, -1):
                key = key << 8 | flat[np.arange(len(rows)) * width + sizes - back]
            nth = np.minimum(np.searchsorted(self.seeds, key), len(self.seeds) - 1)
            if (self.seeds[nth] == key).all():
                row, place, begin = self.seed_rows[nth], self.seed_places[nth], SEED + 1
                long_ += SEED
        for back in range(begin, int(sizes[0]) + 1 if len(sizes) else 0):
            m = int(np.searchsorted(-sizes, -back, side="right"))
            column = sizes[:m] - back
            byte = flat[np.arange(m) * width + column]
            run = self.run_of[row[:m]].astype(np.int64)
            off = np.flatnonzero(self.heads[run] != byte)
            if len(off):
                row[off], place[off], long_[off], run[off] = self._jumped(byte[off], run[off], place[off], long_[off])
            found = run >= 0
            row[:m] = np.where(found, self.mapped[run] + row[:m] - self.starts[run], 0)
            place[:m] = np.where(found, place[:m] - 1, self.first_place[0])
            long_[:m] = np.where(found, long_[:m] + 1, 0)
            yield m, column, long_[:m], row[:m]

    def _jumped(self, byte: np.ndarray, run: np.ndarray, place: np.ndarray, long_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """To the nearest run of the byte above or below, whichever keeps more of the match; run -1: no text has the byte."""
        runs = len(self.starts)
        nth = np.searchsorted(self.keys, byte.astype(np.int64) * runs + run)
        above = np.where(nth > self.span[byte], nth - 1, -1)
        below = np.where(nth < self.span[byte.astype(np.int64) + 1], nth, -1)
        up, down = self.by_byte[np.maximum(above, 0)], self.by_byte[np.minimum(np.maximum(below, 0), runs - 1)]
        keeps = [np.where(has >= 0, np.minimum(self.common(place, to), long_), -1) for has, to in ((above, self.last_place[up]), (below, self.first_place[down]))]
        higher = keeps[0] >= keeps[1]
        none = (above < 0) & (below < 0)
        to = np.where(higher, up, down)
        return (
            np.where(higher, self.ends[up] - 1, self.starts[down]),
            np.where(higher, self.last_place[up], self.first_place[down]),
            np.maximum(np.where(higher, keeps[0], keeps[1]), 0),
            np.where(none, -1, to),
        )


def padded(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Strings as rows: bytes one higher, zeros behind the end."""
    held = np.concatenate([data, np.zeros(width, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(held, width)[starts]
    out += np.uint8(1)
    out *= np.arange(width) < sizes[:, None]
    return out


def distinct(rows: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one place of each different row, number of each row's).  Sorted by ``keys``, then by
    hash; equal hashes are compared, so that two rows may be told apart but are never confused."""
    words = np.ascontiguousarray(rows).view(np.uint64)
    hashes = np.zeros(len(words), np.uint64)
    for column, factor in zip(words.T, _WORDS, strict=False):
        mixed = (column ^ column >> np.uint64(29)) * factor
        hashes += mixed ^ mixed >> np.uint64(32)
    order = np.lexsort((hashes, *reversed(keys)))
    held = words[order]
    new = np.concatenate([[True], (held[1:] != held[:-1]).any(axis=1)]) if len(order) else np.zeros(0, bool)
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def width_of(length: int) -> int:
    """Columns of a row: the longest segment and a zero, in words of eight."""
    return -(-(2 * length - anchor_length(length) + 1) // 8) * 8


def sharing(rows: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """Of each text whether a window of it may be elsewhere, too: equal windows have equal hashes.  ``rows`` as for the index."""
    out = np.zeros(len(rows), bool)
    bits, width, hashes = np.uint64(max(1, len(rows).bit_length())), rows.shape[1], []
    windows = sizes - length + 1
    for lo in range(0, len(rows), max(1, _PIECE // width)):
        some = slice(lo, lo + max(1, _PIECE // width))
        nth = np.repeat(np.arange(len(rows[some])), windows[some])
        held = _rolled(rows[some].ravel(), length)[nth * width + _upto(windows[some])]
        hashes.append(held >> bits << bits | (nth + lo).astype(np.uint64))
    if hashes:
        held = np.sort(np.concatenate(hashes))
        same = held[1:] >> bits == held[:-1] >> bits
        nth = (held & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        out[nth[1:][same]] = out[nth[:-1][same]] = True
    return out


def marked(rows: np.ndarray, sizes: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """[text, window]: whether a text of a smaller id has the window."""
    out = np.zeros((len(rows), rows.shape[1]), bool)
    if not len(rows):
        return out
    order = np.argsort(-sizes, kind="stable")
    rows, sizes, ids = rows[order], sizes[order], ids[order]
    index = RunLengthIndex(rows, sizes, ids, length)
    for m, column, long_, row in index.stream(rows, sizes):
        enough = np.flatnonzero(long_ >= length)
        if len(enough):
            least = index.least[np.searchsorted(index.intervals, row[enough], side="right") - 1]
            hit = enough[least < ids[enough]]
            out[order[hit], column[hit]] = True
    return out


# ---- tasks


def _block(table: pa.Table, text: str = "__text") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of rows, ids, bytes, ends) of a block's documents."""
    order = np.argsort(table["__seq"].to_numpy(), kind="stable")
    texts = table[text].combine_chunks()
    texts = texts.take(pa.array(order))
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    return order, table["__id"].to_numpy()[order], *bytes_of(texts)


def _anchors(table: pa.Table, plan: Plan) -> pa.Table:
    """A block's distinct anchors, a row for each bucket: hashes, and whether each has several documents (1) or is crowded (2)."""
    block = table["__block"][0].as_py()
    _, ids, data, at = _block(table)
    seg = segments_of(data, at, plan.length, plan.bits)
    order, first = grouped(seg.hashes)
    found = seg.hashes[order[first]]
    ids = ids[seg.docs[order]]
    flags = np.zeros(len(first), np.uint8)
    if len(first):
        flags[np.minimum.reduceat(ids, first) < np.maximum.reduceat(ids, first)] = 1
        flags[np.diff(np.append(first, len(order))) >= CROWD] |= 2
    bucket, begins = np.unique(plan.bucket_of(found), return_index=True)
    ends = np.append(begins[1:], len(found))[: len(begins)]
    give_back()
    return pa.table(
        {
            "bucket": pa.array(bucket, pa.int64()),
            "block": pa.array(np.full(len(bucket), block), pa.int64()),
            "hashes": pa.array([_planes(found[a:b], plan.planes) for a, b in zip(begins, ends, strict=True)], pa.binary()),
            "flags": pa.array([flags[a:b].tobytes() for a, b in zip(begins, ends, strict=True)], pa.binary()),
        }
    )


def _repeated(table: pa.Table, plan: Plan) -> pa.Table:
    """For each block's anchors of this bucket: bits of those that two documents have, then of those that are crowded."""
    hashes = [_from_planes(b, plan.planes) for b in table["hashes"].to_pylist()]
    flags = np.concatenate([np.frombuffer(b, np.uint8) for b in table["flags"].to_pylist()])
    order, first = grouped(np.concatenate(hashes))
    counts = np.diff(np.append(first, len(order)))
    both = np.bitwise_or.reduceat(flags[order], first)
    answer = np.empty(len(order), np.uint8)
    answer[order] = np.repeat((counts > 1) | both & 1 | both & 2, counts)
    ends = np.cumsum([len(h) for h in hashes])
    parts = np.split(answer, ends[:-1])
    return pa.table(
        {
            "block": table["block"].combine_chunks(),
            "bucket": table["bucket"].combine_chunks(),
            "answer": pa.array([np.packbits(np.stack([p & 1, p >> 1 & 1]), axis=1).tobytes() for p in parts], pa.binary()),
            "n": pa.array([len(p) for p in parts], pa.int64()),
        }
    )


_SENT = "bucket long, block long, kind int, n long, data binary"
_SENT_TYPES = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("n", pa.int64()), ("data", pa.binary())])


def _segments(docs: pa.Table, answers: pa.Table, plan: Plan) -> pa.Table:
    """A block's distinct segments that may repeat, a row for each bucket (kind 0), and where each stands in the block (kind 1)."""
    length = plan.length
    if not docs.num_rows or not answers.num_rows:
        return _SENT_TYPES.empty_table()
    block = docs["__block"][0].as_py()
    _, ids, data, at = _block(docs)
    seg = segments_of(data, at, length, plan.bits)
    order, first = grouped(seg.hashes)
    by_bucket = np.argsort(answers["bucket"].to_numpy())
    told = answers["answer"].take(pa.array(by_bucket)).to_pylist()
    bits = [np.unpackbits(np.frombuffer(b, np.uint8).reshape(2, -1), axis=1, count=n) for b, n in zip(told, answers["n"].to_numpy()[by_bucket].tolist(), strict=True)]
    flags = np.empty((2, len(seg.hashes)), np.uint8)
    flags[:, order] = np.repeat(np.concatenate(bits, axis=1), np.diff(np.append(first, len(order))), axis=1)
    crowded = seg.where((flags[0] & flags[1]).astype(bool))
    seg = seg.where((flags[0] & ~flags[1] & 1).astype(bool))
    # windows of crowded anchors go alone, by their own hash
    starts = np.repeat(crowded.starts, crowded.windows) + _upto(crowded.windows)
    alone = Segments(_hash_of(data, starts, length) >> np.uint64(64 - plan.bits), starts, np.ones(len(starts), np.int64), np.repeat(crowded.docs, crowded.windows))
    seg = Segments(*(np.concatenate([getattr(seg, f), getattr(alone, f)]) for f in ("hashes", "starts", "windows", "docs")))
    if not len(seg.starts):
        return _SENT_TYPES.empty_table()
    seg = seg.where(np.argsort(seg.starts, kind="stable"))
    bucket, sizes = plan.bucket_of(seg.hashes), seg.windows + length - 1
    rows = padded(data, seg.starts, sizes, width_of(length))
    one, number = distinct(rows, bucket)
    least = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(least, number, ids[seg.docs])
    sizes, bucket = sizes[one], bucket[one]
    rows = rows[one]
    text, ends = rows[rows > 0] - np.uint8(1), np.concatenate([[0], np.cumsum(sizes)])
    found, begins = np.unique(bucket, return_index=True)
    spans = list(zip(found.tolist(), begins.tolist(), np.append(begins[1:], len(one)).tolist(), strict=True))
    out = [(b, block, 0, y - x, squeezed(sizes[x:y].astype(np.uint32), least[x:y], text[ends[x] : ends[y]])) for b, x, y in spans]
    out.append((-1, block, 1, len(number), squeezed(np.diff(seg.starts, prepend=0).astype(np.uint64), number.astype(np.uint64), seg.windows.astype(np.uint32))))
    give_back()
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SENT_TYPES, strict=True)], schema=_SENT_TYPES)


def _sent(n: int, b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, least ids, bytes) of ``n`` segments."""
    held = stretched(b)
    return held[: 4 * n].view(np.uint32).astype(np.int64), np.frombuffer(held[4 * n : 12 * n].tobytes(), np.int64), held[12 * n :]


def _upto(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. below each count, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _hash_of(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A hash of the window at each start."""
    out = np.zeros(len(starts), np.uint64)
    for i in range(length):
        out = out * np.uint64(_BASE) + _BYTES[data[starts + i]]
    out ^= out >> np.uint64(31)
    return out * np.uint64(0xD6E8FEB86659FD93)


def _judged(table: pa.Table, length: int) -> pa.Table:
    """For each block's segments of this bucket: their windows, and a bit for each that a smaller id has."""
    parts = [_sent(n, b) for n, b in zip(table["n"].to_pylist(), table["data"].to_pylist(), strict=True)]
    each, ids, data = (np.concatenate(x) for x in zip(*parts, strict=True))
    rows = padded(data, np.cumsum(each) - each, each, width_of(length))
    one, number = distinct(rows)
    least = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(least, number, ids)
    rows, sizes = rows[one], each[one]
    twice = np.flatnonzero(sharing(rows, sizes, length))
    marks = np.zeros(rows.shape, bool)
    marks[twice] = marked(rows[twice], sizes[twice], least[twice], length)
    marks = marks[number]
    marks[ids > least[number]] = True
    windows = each - length + 1
    chosen = marks[np.arange(marks.shape[1]) < windows[:, None]]
    at, told = 0, []
    for sizes, _, _ in parts:
        n = int((sizes - length + 1).sum())
        told.append(squeezed((sizes - length + 1).astype(np.uint32), np.packbits(chosen[at : at + n])))
        at += n
    return pa.table([table["bucket"].combine_chunks(), table["block"].combine_chunks(), table["kind"].combine_chunks(), table["n"].combine_chunks(), pa.array(told, pa.binary())], schema=_SENT_TYPES)


def _covered(told: pa.Table, ids: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Of each byte of a block whether it is removed."""
    delta = np.zeros(at[-1] + 1, np.int8)
    kinds = told["kind"].to_numpy() if told.num_rows else np.zeros(0)
    if (kinds == 1).any():
        place, n = int(np.flatnonzero(kinds == 1)[0]), told["n"].to_numpy()
        held = stretched(told["data"][place].as_py())
        m = int(n[place])
        starts, number = np.cumsum(held[: 8 * m].view(np.uint64).astype(np.int64)), held[8 * m : 16 * m].view(np.uint64).astype(np.int64)
        windows = held[16 * m :].view(np.uint32).astype(np.int64)
        counts, bits = [], []
        answers = np.flatnonzero(kinds == 0)
        for i in answers[np.argsort(told["bucket"].to_numpy()[answers])].tolist():
            held = stretched(told["data"][i].as_py())
            counts.append(held[: 4 * n[i]].view(np.uint32).astype(np.int64))
            bits.append(np.unpackbits(held[4 * n[i] :], count=int(counts[-1].sum())))
        each, marks = np.concatenate(counts), np.concatenate(bits).astype(bool)
        begins = np.cumsum(each) - each
        own = ids[np.searchsorted(at, starts, side="right") - 1]
        least = np.full(len(begins), np.iinfo(np.int64).max)
        np.minimum.at(least, number, own)
        nth = _upto(windows)
        hit = marks[np.repeat(begins[number], windows) + nth] | np.repeat(own > least[number], windows)
        hits = (np.repeat(starts, windows) + nth)[hit]
        apart = np.flatnonzero(np.diff(hits) > length)  # stretches of windows that meet
        if len(hits):
            delta[hits[np.append(0, apart + 1)]] = 1
            delta[hits[np.append(apart, len(hits) - 1)] + length] = -1
    return np.cumsum(delta[:-1], dtype=np.int8).view(bool)


def _removed(docs: pa.Table, told: pa.Table, length: int, text: str, own: list[str], schema: pa.Schema) -> pa.Table:
    """A block's documents without what is covered."""
    order, ids, data, at = _block(docs, text)
    gone = _covered(told, ids, at, length)
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    starts = at[:-1][np.diff(at) > 0]
    begins[starts] = gone[starts]
    n = np.diff(at)
    removed, spans = np.zeros((2, len(n)), np.int64)
    if len(starts):
        removed[n > 0], spans[n > 0] = (np.add.reduceat(x, starts, dtype=np.int64) for x in (gone, begins))
    kept = data[~gone].tobytes()
    ends = np.concatenate([[0], np.cumsum(n - removed)]).tolist()
    columns = [docs[c].take(pa.array(order)) for c in own]
    columns += [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([kept[a:b] for a, b in zip(ends, ends[1:], strict=False)], pa.binary())]
    give_back()
    return pa.table(columns, schema=schema)


# ---- the operator


def dedup_substrings(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every byte that a string of ``length`` bytes covers which also starts in a document with a smaller id.

    Returns the columns of ``docs`` and n_bytes, n_removed, n_spans (maximal removed
    runs) and kept (binary: the remaining bytes, which need not be whole code points);
    columns of those names are replaced, whatever their case.

    Null text: empty.  Null id: smaller than all others.  Rows of one id are no
    smaller documents to each other, whatever their texts; equal rows get equal results.
    Texts below ``length`` bytes lose nothing.  Matches never cross documents.  An
    empty table gives an empty result.  ``length`` is 8 or more.

    The documents are kept in a table of the shared folder, bucketed by block, which
    ``clean`` deletes with the others.
    """
    if length < 8:
        raise ValueError("length must be 8 or more")
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    own = others(docs, "n_bytes", "n_removed", "n_spans", "kept")
    if text_col.lower() not in {c.lower() for c in own} or id_col.lower() not in {c.lower() for c in own}:
        raise ValueError("the columns of id and text can't have the names of results")
    safe = [free_name(docs, f"__own{i}") for i in range(len(own))]
    text = safe[[c.lower() for c in own].index(text_col.lower())]
    n_bytes = docs.agg(F.sum(F.octet_length(text_of(text_col)))).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block_bytes = int(BLOCK * min(16.0, max(1.0, math.sqrt(n_bytes / 1e12))))
    blocks = max(partitions, -(-n_bytes // block_bytes))
    buckets = max(partitions, min(block_bytes, n_bytes // blocks) // SHARE, n_bytes // 14 // MOST)
    tasks = min(blocks, 20_000)
    keyed = docs.select(
        *[F.col(c).alias(s) for c, s in zip(own, safe, strict=True)],
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("__id"),
    ).withColumn("__block", F.pmod(F.xxhash64("__id", text_of(text)), F.lit(blocks)))
    name = f"clonespark_blocks_{uuid.uuid4().hex}"
    keyed = keyed.repartition(tasks, "__block").withColumn("__seq", F.monotonically_increasing_id())
    keyed.write.bucketBy(tasks, "__block").sortBy("__block").option("compression", "zstd").option("path", scratch(spark, "blocks")).saveAsTable(name)
    texts = spark.table(name)
    narrow = texts.select("__block", "__seq", "__id", F.col(text).alias("__text"))

    plan = Plan(length, buckets, min(_HASH_BITS, max(16, n_bytes.bit_length() + 5)))
    anchors = narrow.groupBy("__block").applyInArrow(lambda t: _anchors(t, plan), "bucket long, block long, hashes binary, flags binary")
    answers = anchors.groupBy("bucket").applyInArrow(lambda t: _repeated(t, plan), "block long, bucket long, answer binary, n long")
    sent = cut(narrow.groupBy("__block").cogroup(answers.groupBy("block")).applyInArrow(lambda d, a: _segments(d, a, plan), _SENT), "segments")
    judged = sent.where("kind = 0").groupBy("bucket").applyInArrow(lambda t: _judged(t, length), _SENT)
    told = judged.unionByName(sent.where("kind = 1"))
    results = [StructField(n, LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [StructField("kept", BinaryType())]
    schema = StructType([StructField(s, docs.schema[c].dataType) for c, s in zip(own, safe, strict=True)] + results)
    shape = to_arrow_schema(schema)
    out = texts.groupBy("__block").cogroup(told.groupBy("block")).applyInArrow(lambda d, t: _removed(d, t, length, text, safe, shape), schema)
    return out.select(*[F.col(s).alias(c) for c, s in zip(own, safe, strict=True)], "n_bytes", "n_removed", "n_spans", "kept")
