"""Error correction of CDR3s by abundance, for each sample and length.

Unique CDR3s fall into bands by count: roots, leaves and the rest.  A leaf that
is within reach of one root is an error of it if the root's budget holds; of
none, a CDR3 of its own; of several, dropped.  The rest are kept if their
quality is good and no leaf or root is near.

Sequences within d mismatches agree on at least one of d + 1 parts, so
neighbours are found by an equi-join on (sample, length, part, bases), with as
many parts as the root's own reach asks for.  A part takes every (d + 1)-th
base, so that none consists of the germline's constant ends alone.  Sequences
are compared as packed numbers within the join; only neighbours leave it, each
once.

Where parts would be too short to tell sequences apart, nearly all pairs would
meet, and more than once.  There blocks of both sides meet instead, and a task
compares all pairs of two blocks as arrays of bits; blocks are of bounded size,
and only neighbours become rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonespark.functions.dna import expected_copies, hamming, largest_parent, phred_errors, share_of
from clonespark.staging import cut

#: Bases at either end that errors aren't looked for in; mismatches to a root and to a neighbour at most; lengths kept.
ENDS, TO_ROOT, TO_NEAR = 3, 7, 3
SHORTEST, LONGEST = 21, 105
GROUP = ["sample_id", "len"]


def unique_cdr3(reads: DataFrame) -> DataFrame:
    """(sample_id, len, cdr3, qual, cnt): counts, and the best sign at each place up to the shortest quality."""
    kept = reads.where(F.length("cdr3").between(SHORTEST, LONGEST)).select("sample_id", "cdr3", F.coalesce("cdr3_qual", F.lit("")).alias("q"))
    # a number for each place: one row a CDR3 is shuffled, whatever its reads
    signs = [F.max(F.ascii(F.substring("q", i + 1, 1)).cast("byte")).alias(f"s{i}") for i in range(LONGEST)]
    out = kept.groupBy("sample_id", "cdr3").agg(F.count("*").alias("cnt"), F.min(F.length("q")).alias("shortest"), *signs)
    best = F.left(F.concat(*[F.char(F.coalesce(f"s{i}", F.lit(0)).cast("long")) for i in range(LONGEST)]), F.least("shortest", F.lit(LONGEST)))
    return out.select("sample_id", F.length("cdr3").alias("len"), "cdr3", best.alias("qual"), "cnt")


def bands(uniq: DataFrame, rates: DataFrame) -> DataFrame:
    """``uniq`` with p, top (T), low (u) and the bands ``maybe``, ``leaf``, ``root``, which may overlap."""
    largest = uniq.groupBy(*GROUP).agg(F.max("cnt").alias("most")).join(rates.select("sample_id", F.col("error_rate").alias("p")), "sample_id")
    n = F.col("len") - 2 * ENDS
    ways = n * 3

    def bound(count: Column) -> Column:
        return share_of(expected_copies(F.col("p"), n, F.floor(largest_parent(F.col("p"), n, count)), 1), ways)

    limits = largest.withColumn("top", F.floor(bound(F.col("most")))).withColumn("low", bound(F.col("top"))).select(*GROUP, "p", "top", "low")
    cnt = F.col("cnt")
    return (
        uniq.join(limits, GROUP)
        .withColumn("maybe", cnt <= F.col("low"))
        .withColumn("leaf", (cnt > F.col("low")) & (cnt < F.col("top")))
        .withColumn("root", cnt >= F.col("top"))
    )


#: Bases in one number, 3 bits each; numbers for the longest sequence's inner bases.
PACKED = 21
NUMBERS = -(-(LONGEST - 2 * ENDS) // PACKED)
ONES = int("1" * PACKED, 8)


def packed(seq: str) -> Column:
    """The inner bases as numbers; letters beside A, C, G, T and N count as equal."""
    digits = F.regexp_replace(F.translate(F.col(seq), "ACGTN", "01234"), "[^0-4]", "5")
    inner = F.substring(digits, F.lit(ENDS + 1), F.length(seq) - 2 * ENDS)
    return F.array(*[F.coalesce(F.conv(F.nullif(F.substring(inner, F.lit(1 + PACKED * i), F.lit(PACKED)), F.lit("")), 8, 10).cast("long"), F.lit(0)) for i in range(NUMBERS)])


def mismatches(x: str, y: str) -> Column:
    """Places at which two packed sequences differ."""
    out = F.lit(0)
    for i in range(NUMBERS):
        differ = F.col(x)[i].bitwiseXOR(F.col(y)[i])
        out = out + F.bit_count(differ.bitwiseOR(F.shiftright(differ, 1)).bitwiseOR(F.shiftright(differ, 2)).bitwiseAND(F.lit(ONES)))
    return out


#: Bases of a part at least, for an equi-join; sequences of a block; pairs that a task compares at once, and neighbours in a batch at least.
PART, BLOCK, CELLS, BATCH = 6, 4096, 1 << 15, 1 << 16


def neighbours(left: DataFrame, right: DataFrame, most: int | None = None) -> DataFrame:
    """Pairs (sample_id, len, a, b, d) within ``most`` mismatches, ENDS left out.

    ``left`` and ``right``: (sample_id, len, a) and (sample_id, len, b), distinct, read several times;
    without ``most``, ``right`` has a column ``most`` for each of its rows.
    """
    right = right.select(*GROUP, "b", (F.col("most") if most is None else F.lit(most)).cast("int").alias("most"))
    wide = F.col("len") - 2 * ENDS < PART * (F.col("most") + 1)
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    counts = right.groupBy(*GROUP).agg(F.count_if(wide).alias("wide"), F.count_if(~wide).alias("narrow")).join(left.groupBy(*GROUP).agg(F.count("*").alias("n")), GROUP)
    sizes = cut(counts.select(*GROUP, "narrow", blocks("n").alias("x_blocks"), blocks("wide").alias("y_blocks")), "sizes")
    told = sizes.agg(F.sum("narrow").alias("narrow"), F.sum(F.col("x_blocks").cast("long") * F.col("y_blocks")).alias("met")).first()
    if not told["met"]:
        return _by_parts(left, right)
    met = _by_blocks(left, right.where(wide), sizes.where("y_blocks > 0"), told["met"])
    return met.unionByName(_by_parts(left, right.where(~wide))) if told["narrow"] else met


def _by_blocks(left: DataFrame, right: DataFrame, sizes: DataFrame, met: int) -> DataFrame:
    """``neighbours`` by comparing all pairs; ``sizes``: (sample_id, len, x_blocks, y_blocks), ``met``: pairs of blocks."""
    own = lambda df, name, n: df.join(sizes.select(*GROUP, "x_blocks", "y_blocks"), GROUP).withColumn("block", F.pmod(F.xxhash64(name), F.col(n)).cast("int"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = own(left.select(*GROUP, "a"), "a", "x_blocks").groupBy(*GROUP, F.col("block").alias("x_block"), "y_blocks").agg(F.collect_list("a").alias("xs"))
    y = own(right, "b", "y_blocks").groupBy(*GROUP, F.col("block").alias("y_block"), "x_blocks").agg(F.collect_list("b").alias("ys"), F.collect_list("most").alias("mosts"))
    x, y = x.withColumn("y_block", each("y_blocks")).drop("y_blocks"), y.withColumn("x_block", each("x_blocks")).drop("x_blocks")
    # the work of a pair of blocks is large, however few its bytes: the number of tasks is given, a few pairs in each
    keys = [*GROUP, "x_block", "y_block"]
    tasks = min(met, max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-met // 8)))
    pairs = x.repartition(tasks, *keys).join(y.repartition(tasks, *keys).hint("merge"), keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sample, length = (batch.column(k)[i] for k in (0, 1))
                xs, ys, mosts = (batch.column(k)[i].values for k in (2, 3, 4))
                for a, b, d in _compared(xs.to_pylist(), ys.to_pylist(), mosts.to_numpy().astype(np.uint8)):
                    columns = [pa.repeat(sample, len(d)), pa.repeat(length, len(d)), xs.take(pa.array(a)), ys.take(pa.array(b)), pa.array(d.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=["sample_id", "len", "a", "b", "d"])

    return pairs.select(*GROUP, "xs", "ys", "mosts").mapInArrow(run, "sample_id string, len int, a string, b string, d int")


def _compared(xs: list[str], ys: list[str], mosts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place in ``xs``, place in ``ys``, mismatches) of the pairs of one length within ``mosts`` of ``ys``, some at a time."""
    length = len(xs[0])
    letters = np.array(xs + ys, f"U{length}").view(np.uint32).reshape(-1, length)[:, ENDS : length - ENDS]
    kinds = np.unique(letters)
    letters = np.searchsorted(kinds, letters)
    size = 4 if letters.shape[1] <= 32 else 8
    # a letter's bits are apart: places differ where one of them does
    planes = []
    for bit in range(max(1, (len(kinds) - 1).bit_length())):
        packed = np.packbits(letters >> bit & 1, axis=1)
        planes.append(np.pad(packed, ((0, 0), (0, -packed.shape[1] % size))).view(f"u{size}"))
    found: list[tuple[np.ndarray, ...]] = []
    waiting, step = 0, max(1, CELLS // len(ys))
    for i in range(0, len(xs), step):
        wrong = np.uint8(0)
        for word in range(planes[0].shape[1]):
            differ = 0
            for p in planes:
                differ = differ | (p[i : min(i + step, len(xs)), word, None] ^ p[len(xs) :, word])
            wrong = wrong + np.bitwise_count(differ)
        at = np.flatnonzero(wrong <= mosts)
        if len(at):
            a, b = np.divmod(at, len(ys))
            found.append((a + i, b, wrong.ravel()[at]))
            waiting += len(at)
        if waiting >= BATCH:
            yield tuple(np.concatenate(c) for c in zip(*found, strict=True))
            found, waiting = [], 0
    if waiting:
        yield tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _by_parts(left: DataFrame, right: DataFrame) -> DataFrame:
    """``neighbours`` by a join on equal parts; ``right`` has its ``most``."""
    inner = F.col("len") - 2 * ENDS

    def parts(seq: str) -> Column:
        n = F.col("most") + 1
        bases = lambda i: F.array_join(F.transform(F.sequence(i + ENDS + 1, F.greatest(inner + ENDS, i + ENDS + 1), n), lambda k: F.substring(F.col(seq), k, F.lit(1))), "")
        return F.transform(F.sequence(F.lit(0), F.col("most")), bases)

    # each sequence of the left with the parts that some row of its group asks for
    x = left.select(*GROUP, "a").join(right.select(*GROUP, "most").distinct(), GROUP).withColumn("x", packed("a")).withColumn("xs", parts("a"))
    y = right.withColumn("y", packed("b")).withColumn("ys", parts("b"))
    x, y = x.select("*", F.posexplode("xs").alias("part", "bases")), y.select("*", F.posexplode("ys").alias("part", "bases"))
    first = F.array_position(F.zip_with("xs", "ys", lambda u, v: u == v), F.lit(True)) == F.col("part") + 1
    met = x.join(y, [*GROUP, "most", "part", "bases"]).where((mismatches("x", "y") <= F.col("most")) & first)
    return met.select(*GROUP, "a", "b", hamming("a", "b", ENDS).alias("d"), "most").where("d <= most").drop("most")


def root_reach(roots: DataFrame) -> DataFrame:
    """Roots (sample_id, len, cdr3, cnt, p) with ``up``: the largest count of a
    variant with 1 to TO_ROOT errors, and ``budget``: what errors may have taken."""
    n, p = F.col("len") - 2 * ENDS, F.col("p")
    parent = F.floor(largest_parent(p, n, F.col("cnt")))
    up = F.array(*[share_of(expected_copies(p, n, parent, x, 3.291), n * 3**x) for x in range(1, TO_ROOT + 1)])
    return roots.withColumn("up", up).withColumn("budget", parent - F.col("cnt"))


def reach_of(up: Column, cnt: Column) -> Column:
    """Mismatches at which a leaf of ``cnt`` copies may be: the bound nearest to it, the first of equals."""
    gaps = F.transform(up, lambda x: F.abs(x - cnt))
    return F.array_position(gaps, F.array_min(gaps)).cast("int")


def widest_reach(roots: DataFrame, leaves: DataFrame) -> DataFrame:
    """``roots`` with ``most``: the mismatches at which any leaf of the group may be.  Roots of groups without leaves go."""
    counts = leaves.select(*GROUP, "cnt").distinct().groupBy(*GROUP).agg(F.collect_list("cnt").alias("counts"))
    return roots.join(counts, GROUP).withColumn("most", F.array_max(F.transform("counts", lambda c: reach_of(F.col("up"), c)))).drop("counts")


def absorb(attached: DataFrame, key: list[str], name: str = "cdr3") -> DataFrame:
    """``attached`` (key, name, weight, cnt, budget) with ``taken``: leaves in
    descending weight, then count, then name, are taken while the rest of the
    budget holds them; one that doesn't fit is passed over.

    Leaves above the whole budget never fit and stay out of the groups.
    """

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        rest, taken = int(group["budget"].iloc[0]), []
        group = group.sort_values(["weight", "cnt", name], ascending=[False, False, True])
        for n in group["cnt"].tolist():
            taken.append(n <= rest)
            rest -= n if taken[-1] else 0
        return group.assign(taken=taken)

    schema = attached.withColumn("taken", F.lit(True)).schema
    fits = F.col("cnt") <= F.col("budget")
    return attached.where(fits).groupBy(*key).applyInPandas(fold, schema).unionByName(attached.where(~fits).withColumn("taken", F.lit(False)))


def leaf_weights(attached: DataFrame) -> DataFrame:
    """``attached`` (sample_id, len, root, cdr3, qual, cnt) with ``weight``: the
    count times the product over inner places of the summed logarithms of the
    error chances that the root's leaves give that base there.

    The factors are negative, so an odd number of places turns the order, as
    it always has.
    """
    key = [*GROUP, "root"]
    inner = attached.select(*key, "cdr3", F.posexplode(F.slice(F.split("cdr3", ""), F.lit(ENDS + 1), F.col("len") - 2 * ENDS)).alias("at", "base"), "qual")
    sign = F.substring(F.col("qual"), F.col("at") + ENDS + 1, F.lit(1))
    chance = F.when(sign != "", F.log(F.pow(F.lit(10.0), -(F.ascii(sign) - 33) / 10.0))).otherwise(0.0)
    placed = inner.withColumn("chance", chance)
    table = placed.groupBy(*key, "at", "base").agg(F.sum("chance").alias("w"))
    product = placed.join(table, [*key, "at", "base"]).groupBy(*key, "cdr3").agg(F.product("w").alias("product"))
    return attached.join(product, [*key, "cdr3"]).withColumn("weight", F.col("cnt") * F.col("product"))


def near_roots(told: DataFrame) -> DataFrame:
    """(sample_id, len, a, roots, b, budget): for each leaf that has roots in reach how many, and the first."""
    roots, leaves = told.where("root"), told.where("leaf")
    # stored, as lambdas and both joins would compute the bounds again and again
    reach = cut(widest_reach(cut(root_reach(roots.select(*GROUP, "cdr3", "cnt", "p")), "root-reach"), leaves), "reach")
    pairs = neighbours(leaves.select(*GROUP, F.col("cdr3").alias("a")), reach.select(*GROUP, F.col("cdr3").alias("b"), "most"))
    return (
        pairs.join(leaves.select(*GROUP, F.col("cdr3").alias("a"), F.col("cnt").alias("leaf_cnt")), [*GROUP, "a"])
        .join(reach.select(*GROUP, F.col("cdr3").alias("b"), "up", "budget"), [*GROUP, "b"])
        .where(F.col("d") <= reach_of(F.col("up"), F.col("leaf_cnt")))
        .groupBy(*GROUP, "a").agg(F.count("*").alias("roots"), F.min(F.struct("b", "budget")).alias("r"))
        .select(*GROUP, "a", "roots", "r.b", "r.budget")
    )


def rescues(told: DataFrame, rescue_quality: bool = True) -> DataFrame:
    """Those of the lowest band, in groups with a root, that have a good quality and no leaf or root near."""
    has_root = told.groupBy(*GROUP).agg(F.max("root").alias("any")).where("any").select(*GROUP)
    good = told.where("maybe").join(has_root, GROUP, "left_semi")
    good = cut(good.where(phred_errors("qual") < 1) if rescue_quality else good, "good")
    sure = told.where("leaf OR root").select(*GROUP, F.col("cdr3").alias("b"))
    close = neighbours(good.select(*GROUP, F.col("cdr3").alias("a")), sure, TO_NEAR).select(*GROUP, F.col("a").alias("cdr3")).distinct()
    return good.join(close, [*GROUP, "cdr3"], "left_anti")


def correct(uniq: DataFrame, rates: DataFrame, single_cell: bool = False, rescue_quality: bool = True) -> DataFrame:
    """(sample_id, len, cdr3, status, root): the CDR3s that stay.

    status: root, leaf (no root in reach, or past the budget), absorbed (into
    ``root``), rescued, or kept (single cell: more copies than the threshold).
    ``rescue_quality``: rescues need fewer than one expected error.
    """
    told = cut(bands(uniq, rates), "bands")
    none = F.lit(None).cast("string")
    out = lambda df, status, root=none: df.select(*GROUP, "cdr3", F.lit(status).alias("status"), root.alias("root"))
    if single_cell:
        return out(told.where(F.col("cnt") > F.col("top")), "kept")
    near = cut(near_roots(told).withColumnRenamed("a", "cdr3"), "near")
    placed = told.where("leaf").join(near, [*GROUP, "cdr3"], "left")
    free = placed.where("roots IS NULL")
    attached = cut(placed.where("roots = 1").select(*GROUP, F.col("b").alias("root"), "cdr3", "qual", "cnt", "budget"), "attached")
    taken = absorb(leaf_weights(attached).select(*GROUP, "root", "cdr3", "weight", "cnt", "budget"), [*GROUP, "root"])
    settled = taken.select(*GROUP, "cdr3", F.when(F.col("taken"), "absorbed").otherwise("leaf").alias("status"), F.when(F.col("taken"), F.col("root")).alias("root"))
    every = out(told.where("root"), "root").unionByName(out(free, "leaf")).unionByName(settled).unionByName(out(rescues(told, rescue_quality), "rescued"))
    # bands can overlap: an absorbed one is translated by its root, else roots come first
    rank = F.when(F.col("status") == "absorbed", 0).when(F.col("status") == "root", 1).when(F.col("status") == "leaf", 2).otherwise(3)
    best = every.groupBy(*GROUP, "cdr3").agg(F.min(F.struct(rank.alias("rank"), "status", "root")).alias("b"))
    return best.select(*GROUP, "cdr3", F.col("b.status").alias("status"), F.col("b.root").alias("root"))
