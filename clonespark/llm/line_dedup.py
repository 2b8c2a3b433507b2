"""Line dedup: repeated runs of lines, found in a suffix array of line ids.

A document is its sequence of lines.  A *run* is a stretch of neighbouring
lines of one document; it is *repeated* if an earlier place of the corpus has
the same lines, earlier by (doc_id, text hash, line number).  Every line that
lies in a repeated run of ``min_words`` words or more is deleted from the later
copy; the first copy stays whole.

Method
------
1. Line ids are 128 bits of hash.  Only lines that occur twice can be part of a
   repeated run, so neighbouring such lines form segments; segments of fewer
   than ``min_words`` words go.
2. Distributed prefix doubling: ``r[0]`` orders lines, ``r[k+1]`` orders
   suffixes by their first 2**(k+1) lines, from the pairs (r[k] here, r[k] 2**k
   lines on).  Distinct pairs are range-sorted; the order-preserving id of a
   sorted row is the rank, so no single task sees all of them, and a pair that
   a third of the corpus has is one row by then.
3. Suffixes that agree on their first L lines are one interval of the suffix
   array with longest common prefix L or more; the two overlapping ranks
   (r[k] at the start, r[k] at end-2**k), 2**k <= L, name that interval.
4. A maximal repeated run is the union of its shortest stretches of
   ``min_words`` words, taken from each first line forwards and from each last
   line backwards, so only their intervals are asked for, and doubling stops at
   the longest of them: ranks of more lines could decide nothing.

All of it is DataFrame code; rows are line positions, never groups of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clonespark.llm.common import NO_ID, cut, drop, free_name, others, text_of

#: Words are what white space of ASCII separates.
WORD = r"[^\x20\x09-\x0D]+"


def dedup_lines(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Delete later copies of repeated line runs.

    Returns the columns of ``docs`` with the text replaced, and ``n_lines`` and
    ``n_removed`` (int) after them; columns of those names are replaced.

    Null text: stays null, one empty line, none removed.  Empty text: one empty line.
    Null id: ordered before all others.  Rows that agree in id and text are one
    document and get equal results; rows of one id with different texts are
    different documents.  Ties cannot arise: places are distinct.  An empty
    table gives an empty result.
    """
    beside = others(docs, text_col, "n_lines", "n_removed")
    d, t, g, k = (free_name(docs, name) for name in ("d", "t", "gone", "kept"))
    keyed = docs.select(
        *[F.col(c) for c in beside],
        F.col(text_col),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias(d),
        F.xxhash64(text_of(text_col)).alias(t),
    )
    gone = repeated_intervals(keyed.select(F.col(d).alias("d"), F.col(t).alias("t"), text_of(text_col).alias("text")), min_words)
    gone = gone.select(F.col("d").alias(d), F.col("t").alias(t), F.col("gone").alias(g))
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.filter(lines, lambda _, i: ~F.exists(g, lambda x: (i >= x["s"]) & (i < x["e"])))
    n = F.coalesce(F.size(lines), F.lit(1))
    # the rows of texts are many times the intervals: one plan for every size
    out = keyed.join(gone.hint("merge"), [d, t], "left")
    out = out.withColumn(k, F.when(F.col(g).isNotNull(), kept))
    names = {c: F.col(c) for c in beside}
    names[text_col] = F.when(F.col(k).isNotNull(), F.array_join(k, "\n")).otherwise(F.col(text_col)).alias(text_col)
    return out.select(
        *[names[c] for c in docs.columns if c in names],
        F.when(F.col(text_col).isNull(), 1).otherwise(n).cast("int").alias("n_lines"),
        F.when(F.col(k).isNotNull(), n - F.size(k)).otherwise(0).cast("int").alias("n_removed"),
    )


def repeated_intervals(docs: DataFrame, min_words: int) -> DataFrame:
    """(d, t, gone): per document its merged deleted line intervals [s, e)."""
    doc, seg = ["d", "t"], ["d", "t", "seg"]
    lines = cut(
        docs.select("d", "t", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).select(
            "d", "t", "pos",
            F.xxhash64("line").alias("h"),
            F.xxhash64(F.lit("second"), "line").alias("g"),
            F.regexp_count("line", F.lit(WORD)).alias("w"),
        ).distinct(),
        "lines",
    )
    twice = cut(lines.groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1").select("h", "g").sortWithinPartitions("h", "g"), "twice")

    in_doc = Window.partitionBy(*doc).orderBy("pos")
    in_seg = Window.partitionBy(*seg).orderBy("pos")
    active = (
        lines.join(twice, ["h", "g"], "left_semi")
        .withColumn("seg", F.col("pos") - F.row_number().over(in_doc))
        .withColumn("cp", F.coalesce(F.sum("w").over(in_seg.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("all", F.sum("w").over(Window.partitionBy(*seg)))
        .where(F.col("all") >= min_words)
    )
    # distinct lines in order; the id of a sorted row keeps that order
    active = cut(active, "active")
    first = cut(active.select("h", "g").distinct().orderBy("h", "g").withColumn("r0", F.monotonically_increasing_id()), "rank")
    ranks = cut(active.join(first, ["h", "g"]).select(*seg, "pos", "w", "cp", "r0"), "ranks")

    # the shortest stretches of min_words words from each line on and back from each line
    end = ranks.groupBy(*seg).agg((F.max("pos") + 1).alias("pos"), F.sum("w").alias("cp"))
    ends = ranks.select(*seg, "pos", "cp").unionByName(end)
    on = Window.partitionBy(*seg).orderBy(F.desc("cp")).rangeBetween(Window.unboundedPreceding, -min_words)
    back = Window.partitionBy(*seg).orderBy("cp").rangeBetween(Window.unboundedPreceding, -min_words)
    both = F.array(
        F.struct(F.col("pos").alias("s"), F.min("pos").over(on).alias("e")),
        F.struct(F.max("pos").over(back).alias("s"), F.col("pos").alias("e")),
    )
    runs = (
        ends.withColumn("both", both).select(*seg, F.explode("both").alias("x")).select(*seg, "x.s", "x.e").where("s IS NOT NULL AND e IS NOT NULL")
        .withColumn("len", F.col("e") - F.col("s"))
        .withColumn("k", F.floor(F.log2("len") + F.lit(1e-9)).cast("int"))
        .withColumn("s2", F.expr("cast(e - shiftleft(1, k) AS int)"))
    )
    runs = cut(runs, "runs")
    longest = runs.agg(F.max("k")).first()[0] or 0

    for k in range(longest):
        pairs = cut(ranks.withColumn("next", F.coalesce(F.lead(f"r{k}", 2**k).over(in_seg), F.lit(-1))), "pairs")
        order = cut(pairs.select(f"r{k}", "next").distinct().orderBy(f"r{k}", "next").withColumn(f"r{k + 1}", F.monotonically_increasing_id()), "rank")
        ranks = cut(pairs.join(order, [f"r{k}", "next"]).drop("next"), "ranks")
        drop(pairs, order)

    level = F.array(*[F.col(f"r{k}") for k in range(longest + 1)])
    at = ranks.select(*doc, "pos", level.alias("r"))
    named = (
        runs.join(at.withColumnRenamed("pos", "s"), [*doc, "s"]).withColumn("a", F.expr("r[k]")).drop("r")
        .join(at.withColumnRenamed("pos", "s2"), [*doc, "s2"]).withColumn("b", F.expr("r[k]"))
        .select(*doc, "s", "e", "len", "a", "b")
    )
    named = cut(named, "named")
    place = F.struct("d", "t", "s")
    interval = ["len", "a", "b"]
    head = cut(named.groupBy(*interval).agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").drop("last"), "head")
    later = named.join(head, interval).where(place > F.col("first")).select(*doc, "s", "e")

    by_start = Window.partitionBy(*doc).orderBy("s", "e")
    islands = (
        later.withColumn("reach", F.max("e").over(by_start.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("new", F.when(F.col("s") <= F.col("reach"), 0).otherwise(1))
        .withColumn("island", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*doc, "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    )
    return cut(islands.groupBy(*doc).agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("gone")), "gone")
