"""Fill-in-middle: texts cut in three at code points and put in another order.

A finite automaton over bytes, held as two tables, reads every text once.  Its
states know how many bytes of a UTF-8 code point are still to come and how much
of a sentinel has been seen; each transition tells what it completes: a code
point, and with it perhaps a sentinel.  Those are counted in pieces of
``PIECE`` bytes, which run side by side: a state depends on the three bytes
before it alone, so a piece starts from those.  A second pass goes only over
the pieces in which a cut lies, as their counts tell, and finds its byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from clonespark.llm.common import bytes_of, free_name, mapped, others, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Bytes that run one after the other.
PIECE = 128
#: Bytes of texts that are worked on at once.
SLICE = 4 << 20

#: States: between code points; after ``<``; after ``<`` and a sentinel's letter; one, two, three bytes to come.
GROUND, OPEN, LETTER, ONE, TWO, THREE = range(6)
#: What a transition completes: a code point, and a sentinel with it.
UNIT, SENTINEL = 1, 1 << 16


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, what is completed) at ``state << 8 | byte``."""
    to, done = np.zeros((6, 256), np.uint8), np.zeros((6, 256), np.int32)
    done[:, :0x80] = UNIT
    to[:, 0xC2:0xE0], to[:, 0xE0:0xF0], to[:, 0xF0:0xF5] = ONE, TWO, THREE
    to[:, ord("<")] = OPEN
    for letter in (PREFIX, SUFFIX, MIDDLE):
        to[OPEN, ord(letter[1])] = LETTER
    done[LETTER, ord(">")] = UNIT | SENTINEL
    to[TWO, 0x80:0xC0], to[THREE, 0x80:0xC0] = ONE, TWO
    done[ONE, 0x80:0xC0] = UNIT
    return to.ravel(), done.ravel()


TO, DONE = automaton()


@dataclass
class Scanned:
    """Counts of each text, and of each piece what the second pass needs."""

    units: np.ndarray
    sentinels: np.ndarray
    first: np.ndarray  # each text's first piece; one end more
    starts: np.ndarray  # of each piece in the bytes
    sizes: np.ndarray
    states: np.ndarray  # at each piece's start
    before: np.ndarray  # code points of all pieces before


def scan(data: np.ndarray, at: np.ndarray) -> Scanned:
    """One pass of the automaton over all texts; text i is ``data[at[i]:at[i + 1]]``."""
    lengths = np.diff(at)
    pieces = -(-lengths // PIECE)
    first = np.concatenate([[0], np.cumsum(pieces)])
    nth = np.arange(first[-1]) - np.repeat(first[:-1], pieces)
    starts = np.repeat(at[:-1], pieces) + nth * PIECE
    sizes = np.minimum(PIECE, np.repeat(lengths, pieces) - nth * PIECE)
    states = np.zeros(len(starts), np.uint8)
    later = np.flatnonzero(nth)
    for back in (3, 2, 1):
        states[later] = TO[states[later].astype(np.int32) << 8 | data[starts[later] - back]]
    counts = np.zeros(len(starts), np.int32)
    order = np.argsort(-sizes, kind="stable")
    place, now, told = starts[order], states[order].astype(np.int32), counts[order]
    still = np.searchsorted(-sizes[order], -np.arange(PIECE), side="left")  # pieces that have a byte at each step
    for step, m in enumerate(still):
        key = now[:m] << 8 | data[place[:m] + step]
        told[:m] += DONE[key]
        now[:m] = TO[key]
    counts[order] = told
    units, hits = counts & (SENTINEL - 1), counts // SENTINEL
    before = np.concatenate([[0], np.cumsum(units)])
    sums = np.concatenate([[0], np.cumsum(hits)])
    return Scanned(np.diff(before[first]), np.diff(sums[first]), first, starts, sizes, states, before)


def cuts(data: np.ndarray, at: np.ndarray, seen: Scanned, texts: np.ndarray, units: np.ndarray) -> np.ndarray:
    """The byte after that many code points of each text, from the text's start."""
    goal = seen.before[seen.first[texts]] + units
    piece = np.minimum(np.searchsorted(seen.before, goal, side="left") - 1, len(seen.starts) - 1)
    found = np.zeros(len(texts), np.int64)
    open_ = np.flatnonzero(units > 0)
    piece, left = piece[open_], (goal - seen.before[piece])[open_]
    state, place, size = seen.states[piece].astype(np.int32), seen.starts[piece], seen.sizes[piece]
    for step in range(PIECE):
        if not len(open_):
            break
        key = state << 8 | data[place + np.minimum(step, size - 1)]
        left = left - (DONE[key] & UNIT)
        state = TO[key].astype(np.int32)
        ends = left == 0
        found[open_[ends]] = place[ends] + step + 1 - at[texts[open_[ends]]]
        go = ~ends
        open_, left, state, place, size = open_[go], left[go], state[go], place[go], size[go]
    return found


def fill_in_middle(docs: DataFrame, rate: int = 90, spm: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut texts at two places that the id's hash tells, and write the parts in
    another order behind sentinels.

    Of 100 hashes ``rate`` are to be changed, ``spm`` of 100 of those to suffix,
    prefix, middle and the others to prefix, suffix, middle.  A text that is empty
    or contains a sentinel stays plain.  Returns the columns of ``docs``, and after
    them n (code points), form (``plain``, ``psm``, ``spm``), prefix_chars,
    middle_chars (null if plain) and output (text); columns of those names are
    replaced, whatever their case.

    Null text: empty.  Null id: hashed as an empty one.  Rows with equal id and text get equal
    results; order and ties play no part.  An empty table gives an empty result.  A
    text of any length is read whole, in pieces of 128 bytes.
    """
    own = others(docs, "n", "form", "prefix_chars", "middle_chars", "output")
    if not {text_col.lower(), id_col.lower()} <= {c.lower() for c in own}:
        raise ValueError("the columns of id and text can't have the names of results")
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    keys = free_name(docs, "keys")
    hashed = docs.select(*own, F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]).alias(keys))
    schema = StructType(
        [docs.schema[c] for c in own]
        + [StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("output", StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = [c.lower() for c in own].index(text_col.lower())
        for batch in batches:
            for a, b in slices(np.diff(bytes_of(batch.column(place))[1]), SLICE):
                part = batch.slice(a, b - a)
                h = part.column(len(own)).flatten().to_numpy().reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *_transformed(part.column(place), h, rate, spm)], names=[f.name for f in schema])

    return mapped(hashed, run, schema)


def _transformed(texts: pa.Array, h: np.ndarray, rate: int, spm: int) -> list[pa.Array]:
    data, at = bytes_of(texts)
    seen = scan(data, at)
    n = seen.units
    plain = (n == 0) | (seen.sentinels > 0) | (h[:, 2] % 100 >= rate)
    ways = np.where(plain, 0, np.where(h[:, 3] % 100 < spm, 2, 1))
    x, y = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    low, high = np.minimum(x, y), np.maximum(x, y)
    rows = np.flatnonzero(~plain)
    ends = cuts(data, at, seen, np.concatenate([rows, rows]), np.concatenate([low[rows], high[rows]])).reshape(2, -1)
    whole, out = data.tobytes(), []
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    nth = 0
    for i, way in enumerate(ways.tolist()):
        a, b = int(at[i]), int(at[i + 1])
        if way:
            c, d = a + int(ends[0, nth]), a + int(ends[1, nth])
            nth += 1
            parts = (p, whole[a:c], s, whole[d:b], m, whole[c:d]) if way == 1 else (s, whole[d:b], p, whole[a:c], m, whole[c:d])
            out.append(b"".join(parts))
        else:
            out.append(whole[a:b])
    chars = [pa.array(v, pa.int64(), mask=plain) for v in (low, high - low)]
    return [pa.array(n, pa.int64()), pa.array(np.array(["plain", "psm", "spm"], object)[ways], pa.string()), *chars, pa.array(out, pa.binary()).cast(pa.string())]


def restored(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The exact text, from the output and its form alone: a changed text holds
    no sentinel of its own, and no part of a sentinel can be one."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, "<[PSM]>", -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
