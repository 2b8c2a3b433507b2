"""Filter interaction audit: what each filter removes in every order of five.

Every document has a mask of the filters that it fails.  A table, computed once,
holds for each of 32 masks and 120 orders the step at which the document falls
(its first failing filter's place), so a document's fate in all orders is one row
of the table.  Tasks look masks up, count removals by part, order and step with
``np.bincount``, and give a line for each; those partial counts are summed.

Equal texts are found by hash and narrow rows: the least id of each text comes
from one aggregate, and is joined by hash and id together, so that a text which a
third of all rows have is no hot key.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clonespark.llm.common import cut, mapped

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
MARKS = re.compile(rb"[#$%&*|]")
SPACE = re.compile(rb"[\x20\x09-\x0D]")

#: Rows that are looked up at once: each makes 120 numbers.
ROWS = 4096
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20


def first_failures() -> np.ndarray:
    """[mask, order]: the step, from 1, at which a document of that mask falls; 0: never."""
    table = np.zeros((1 << len(FILTERS), len(ORDERS)), np.int64)
    for o, order in enumerate(ORDERS):
        for step in range(len(order), 0, -1):
            fails = np.arange(len(table)) >> FILTERS.index(order[step - 1]) & 1
            table[:, o] = np.where(fails, step, table[:, o])
    return table


def words_of(text: bytes) -> tuple[int, int]:
    """Numbers of words and of distinct words; at most ``PIECE`` and a word are split at once."""
    n, seen, at = 0, set(), 0
    while at < len(text):
        gap = SPACE.search(text, at + PIECE) if at + PIECE < len(text) else None
        to = gap.start() if gap else len(text)
        words = text[at:to].split()
        n += len(words)
        seen.update(words)
        at = to
    return n, len(seen)


def failing(text: str) -> int:
    """The mask of A to D that a text fails; bit 0 is A."""
    b = text.encode()
    n, distinct = words_of(b)
    capitals = len(b) - len(b.translate(None, CAPITALS))
    return (n < 200) | (100 * distinct < 50 * n) << 1 | (100 * capitals > 3 * len(text)) << 2 | (MARKS.search(b) is not None) << 3


def audit(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of each part, order and step: 600 rows a part, zeros included.

    Filters: A under 200 words; B distinct words under half; C capitals over 3 %
    of the code points; D one of ``#$%&*|``; E the text of a smaller id, wherever in
    the table and whether removed or not.  Words are what white space of ASCII
    separates.  Columns: part, filter_order, step, kept (after the step), removed (at
    it), redundant (failing its filter, removed earlier), unique_fails (failing its
    filter only), good_lost, toxic_lost (removed at it with that label), shapley
    (removed by its filter, summed over all orders).

    Null text: empty.  Null part: the empty string.  Null id: no id is smaller or
    larger, and no label is found.  Rows of one id and one text aren't copies of each
    other.  Several labels of one id: the highest.  Other columns are left out.  An
    empty table has no part and gives no row.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    rows = cut(mapped(texts, _features, "id long, part string, digest binary, mask int"), "audit-rows")
    least = rows.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    copied = F.when(F.col("id").isNotNull() & F.col("first").isNull(), 16).otherwise(0)
    known = rows.join(least, ["digest", "id"], "left").join(marks, "id", "left").select(
        "part", (F.col("mask") + copied).cast("int").alias("mask"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic")
    )
    names = ("removed", "redundant", "good_lost", "toxic_lost", "unique_fails", "total")
    partial = mapped(known, _removals, "part string, place int, step int, " + ", ".join(f"{n} long" for n in names))
    summed = partial.groupBy("part", "place", "step").agg(*[F.sum(n).alias(n) for n in names])
    order = F.element_at(F.array(*[F.lit(o) for o in ORDERS]), F.col("place") + 1)
    by_order = Window.partitionBy("part", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by_filter = Window.partitionBy("part", "filter")
    named = summed.withColumn("filter_order", order).withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    return named.select(
        "part", "filter_order", "step", (F.col("total") - F.sum("removed").over(by_order)).alias("kept"), "removed", "redundant", "unique_fails", "good_lost", "toxic_lost",
        F.sum("removed").over(by_filter).alias("shapley"),
    )


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, masks = [], []
        for text in batch.column(2):
            t = text.as_py() or ""
            digests.append(hashlib.sha256(t.encode()).digest())
            masks.append(failing(t))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(masks, pa.int32())], names=["id", "part", "digest", "mask"])


def _removals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of this task's rows, a line for each part, order and step."""
    table = first_failures()
    n_orders, n_steps = len(ORDERS), len(FILTERS)
    at = np.arange(n_orders) * (n_steps + 1)
    letters = np.array([[FILTERS.index(f) for f in o] for o in ORDERS])
    parts: dict[str, np.ndarray] = {}  # [all, good, toxic; order, step] and behind them the counts of masks
    size = n_orders * (n_steps + 1)
    for batch in batches:
        names = batch.column(0).dictionary_encode()
        codes, mask = names.indices.to_numpy(), batch.column(1).to_numpy()
        labels = [np.ones(len(mask), bool), *(batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in (2, 3))]
        for code, name in enumerate(names.dictionary.to_pylist()):
            own = np.flatnonzero(codes == code)
            counts = parts.setdefault(name, np.zeros(3 * size + len(table), np.int64))
            counts[3 * size :] += np.bincount(mask[own], minlength=len(table))
            for lo in range(0, len(own), ROWS):
                some = own[lo : lo + ROWS]
                for k, label in enumerate(labels):
                    chosen = some[label[some]]
                    counts[k * size : (k + 1) * size] += np.bincount((table[mask[chosen]] + at).ravel(), minlength=size)
    for name, counts in parts.items():
        removed, good, toxic = (counts[k * size : (k + 1) * size].reshape(n_orders, -1)[:, 1:] for k in range(3))
        masks = counts[3 * size :]
        fails = np.array([masks[np.arange(len(table)) >> f & 1 == 1].sum() for f in range(n_steps)])
        only = np.array([masks[1 << f] for f in range(n_steps)])
        cells = (removed, fails[letters] - removed, good, toxic, only[letters], np.full(letters.shape, masks.sum()))
        place, step = np.divmod(np.arange(letters.size, dtype=np.int32), np.int32(n_steps))
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * letters.size, pa.string()), pa.array(place), pa.array(step + 1, pa.int32()), *(pa.array(c.ravel(), pa.int64()) for c in cells)],
            names=["part", "place", "step", "removed", "redundant", "good_lost", "toxic_lost", "unique_fails", "total"],
        )
