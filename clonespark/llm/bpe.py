"""Byte-level BPE by corpus-level merge replay, and decoding.

A task collects the distinct matches ("words") of the splitting pattern in a
block of texts.  An inverted index leads from the rank of a mergeable pair to
all its places in those words; ranks are replayed in order, each merge at all
its places at once, and only the two touched neighbours get new entries.  A
merge that makes a pair of lower rank puts that rank next.  So every word sees
its pairs merged lowest rank first, leftmost first, as in plain BPE.  A block is
the corpus of one replay; the README has the figures of one replay for all.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clonespark.llm.common import hold, mapped, others, text_of

#: White space as Unicode's property has it; the property of a Python pattern has four controls more.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Merges:
    """Mergeable pairs of ids, replayed in the order of the ids that they make."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        made = {a << 32 | b: r for (a, b), r in pairs.items()}
        self.keys = np.array(sorted(made), np.int64)
        self.merged = np.array([made[k] for k in self.keys.tolist()], np.int64)

    def of_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What pairs of ids make, -1 for those that can't merge."""
        keys = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.merged[at], -1)

    def replay(self, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """The little-endian 32-bit ids of each word, as :meth:`replay_all` makes them."""
        counts, out = self.replay_all(ids, lengths)
        flat, stops = out.astype("<i4").tobytes(), (4 * np.cumsum(counts)).tolist()
        return [flat[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def replay_all(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all of them, from the words' ``lengths`` first ids, which change in place."""
        ends = np.cumsum(lengths)
        n = len(ids)
        if not n:
            return np.zeros(len(lengths), np.int64), ids
        last = np.zeros(n, bool)
        last[ends[lengths > 0] - 1] = True
        right, left = np.arange(1, n + 1), np.arange(-1, n - 1)
        right[last] = -1
        left[np.append(0, np.flatnonzero(last)[:-1] + 1)] = -1
        # the rank of the pair that starts at a place, and the index from ranks to places
        pair = np.full(n, -1)
        inner = np.flatnonzero(~last)
        pair[inner] = self.of_pairs(ids[inner], ids[inner + 1])
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray) -> None:
            r = pair[at]
            at = at[r >= 0]
            if not len(at):
                return
            at = at[np.argsort(pair[at], kind="stable")]
            r = pair[at]
            bounds = np.flatnonzero(r[1:] != r[:-1]) + 1
            for rank, some in zip(r[np.append(0, bounds)].tolist(), np.split(at, bounds) if len(bounds) else [at], strict=True):
                if rank in places:
                    places[rank].append(some)
                else:
                    places[rank] = [some]
                    heapq.heappush(heap, rank)

        enter(inner)
        while heap:
            r = heapq.heappop(heap)
            some = places.pop(r)
            at = some[0] if len(some) == 1 else np.unique(np.concatenate(some))
            at = at[pair[at] == r]
            j = right[at]
            if len(at) > 1 and (j[:-1] == at[1:]).any():  # a run of one id: pairs overlap, the left one goes first
                keep, gone = [], -1
                for p, q in zip(at.tolist(), j.tolist(), strict=True):
                    if p != gone:
                        keep.append(p)
                        gone = q
                at = np.array(keep)
                j = right[at]
            if not len(at):
                continue
            k = right[j]
            ids[at], ids[j], pair[j], pair[at] = r, -1, -1, -1
            right[at] = k
            after = k >= 0
            on = at[after]
            left[k[after]] = on
            pair[on] = self.of_pairs(ids[on], ids[right[on]])
            h = left[at]  # as it is now: a left neighbour may have merged as well
            h = h[h >= 0]
            pair[h] = self.of_pairs(ids[h], ids[right[h]])
            enter(np.concatenate([on, h]))
        stops = np.concatenate([[0], np.cumsum(ids >= 0)])[ends]
        return np.diff(stops, prepend=0), ids[ids >= 0]


class Ranks(Merges):
    """The ranks of a file of lines "base64-of-token rank"."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = [b""] * (max(self.rank.values(), default=-1) + 1)
        for token, i in self.rank.items():
            self.token[i] = token
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for token, r in self.rank.items():
            for cut in range(1, len(token)):
                a, b = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = r
        super().__init__(pairs)

    def of_words(self, words: list[bytes]) -> list[bytes]:
        return self.replay(self.byte[np.frombuffer(b"".join(words), np.uint8)], np.array([len(w) for w in words], np.int64))


class Encoder:
    def __init__(self, path: str, pattern: str, keep: int = 400_000):
        import regex

        self.ranks, self.keep, self.known = ranks(path), keep, {}
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self.known) > self.keep:
            self.known = {}
        one: dict[str, str] = {}  # a string for each distinct word, not for each match
        words = [list(map(one.setdefault, w, w)) for w in map(self.pattern.findall, texts)]
        new = [w for w in one if w not in self.known]
        for word, ids in zip(new, self.ranks.of_words([w.encode() for w in new]), strict=True):
            self.known[word] = ids
        get = self.known.__getitem__
        return [b"".join(map(get, w)) for w in words]


@lru_cache(2)
def ranks(path: str) -> Ranks:
    return Ranks(path)


def encoder(path: str, pattern: str) -> Encoder:
    return hold(("words", path, pattern), lambda: Encoder(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 8_000_000) -> DataFrame:
    """(doc_id, ids array<int>) of the whole texts, by the ranks of ``path``.

    Null and empty texts have no ids.  A null doc_id stays null; repeated rows
    give repeated rows; other columns are not read; an empty table gives none.
    A task replays blocks of ``block_chars`` characters (or one longer text).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(doc_ids, texts):
            found = encoder(path, pattern).encode(texts)
            flat = np.frombuffer(b"".join(found), "<i4")
            offsets = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "ids"])

        for batch in batches:
            doc_ids, texts, size = [], [], 0
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                doc_ids.append(i.as_py())
                texts.append(text := text.as_py())
                size += len(text)
                if size >= block_chars:
                    yield out(doc_ids, texts)
                    doc_ids, texts, size = [], [], 0
            if texts:
                yield out(doc_ids, texts)

    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")), run, "doc_id long, ids array<int>")


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes of its ids in place of them; null ids: null.

    A column named ``out_col`` is replaced.  An id outside the ranks is an error.
    """
    beside = others(df, ids_col, out_col)
    schema = T.StructType([*(df.schema[c] for c in beside), T.StructField(out_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = ranks(path).token
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids = part.column(len(beside))
                flat, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy().tolist()
                texts = [b"".join(map(token.__getitem__, flat[a:b].tolist())) if valid else None for a, b, valid in zip(ends, ends[1:], ids.is_valid().to_pylist(), strict=False)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(beside)], pa.array(texts, pa.binary())], names=[*beside, out_col])

    return mapped(df.select(*beside, ids_col), run, schema)
