"""From alignments to reads of a V part, a J part, or both, with a first CDR3 search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonespark.functions.dna import FILLED, cigar_span, hamming, once
from clonespark.functions.motif import Motif
from clonespark.operators.search import find_cdr3

#: A V hit's read goes on by this many bases at least past the segment.
V_OVERHANG = 10
#: Bases before a J hit at least; mismatches allowed beyond the share, for V and J; bases of a segment's end that aren't compared.
J_LEAD, V_ALLOWANCE, J_ALLOWANCE, OPEN_END = 5, 3, 9, 9
KEY = ["sample_id", "file_idx", "qname"]


def with_segments(aln: DataFrame, segments: DataFrame) -> DataFrame:
    """Alignments with their segment's sequence (``ref``) and the first M run in the read (``s``, ``t``)."""
    named = segments.select(F.col("name").alias("rname"), F.col("seq").alias("ref")).dropDuplicates(["rname"])
    # a generator's columns are computed once, however often later steps name them
    told = aln.join(named, "rname").select("*", F.inline(F.array(cigar_span("cigar"))).alias("s", "t"))
    return told.where("s IS NOT NULL")


def misfit() -> Column:
    """Mismatches of read and segment within the M run and beside it, above a third of the bases beside it."""
    lgt = F.col("t") - F.col("s")
    left = F.least("s", "pos") - 1
    right = F.greatest(F.lit(0), F.least(F.length("seq") - F.col("t"), F.length("ref") - OPEN_END - (F.col("pos") + lgt)))
    n = left + lgt + right + 1
    read = F.substring(F.col("seq"), F.col("s") - left, n)
    ref = F.substring(F.col("ref"), F.col("pos") - left, n)
    return hamming(read, ref) - F.floor((n - (lgt + 1)) / 3)


def fits_segment(allowance: int) -> Column:
    """Whether read and segment agree around the M run, up to ``allowance``."""
    return misfit() <= allowance


def _fitting(aln: DataFrame, seq: Column, qual: Column, name: str, allowance: int, motif: Motif | None) -> DataFrame:
    """Reads that fit their segment; with a ``motif`` also ``m``, its match.  Both are told by one Python worker a task, as one step."""
    found = {"over": misfit()} | ({"m": find_cdr3(seq, qual, motif)} if motif else {})
    told = aln.select(*KEY, seq.alias("seq"), qual.alias("qual"), F.col("rname").alias(name), once(**found))
    return told.where(F.col("over") <= allowance).drop("over")


def assign_v(aln: DataFrame, motif: Motif | None = None) -> DataFrame:
    """V reads from the hit's start on.  Dropped: those that don't reach V_OVERHANG
    bases past the segment or don't fit it."""
    past = (F.length("ref") - F.col("pos")) - (F.length("seq") - F.col("s"))
    tail = lambda c: F.substring(F.col(c), F.col("s"), F.length(c))
    return _fitting(aln.where(past <= -V_OVERHANG), tail("seq"), tail("qual"), "v", V_ALLOWANCE, motif)


def assign_j(aln: DataFrame, motif: Motif | None = None) -> DataFrame:
    """J reads up to the segment's end; qualities of the hit are FILLED.
    Dropped: those with fewer than J_LEAD bases before the hit or that don't fit."""
    seq = F.substring(F.col("seq"), F.lit(1), F.least(F.length("seq"), F.col("s") + F.length("ref")))
    qual = F.concat(F.substring(F.col("qual"), F.lit(1), F.col("s") - 1), F.repeat(F.lit(FILLED), F.length("ref") - F.col("pos")))
    return _fitting(aln.where(F.col("s") - 1 >= J_LEAD), seq, qual, "j", J_ALLOWANCE, motif)


def paired(v: DataFrame, j: DataFrame) -> DataFrame:
    """Reads with a hit of both kinds: (sample_id, file_idx, qname, seq, qual, s, v, jseq, jt, j)."""
    return v.select(*KEY, "seq", "qual", "s", F.col("rname").alias("v")).join(j.select(*KEY, F.col("seq").alias("jseq"), F.col("t").alias("jt"), F.col("rname").alias("j")), KEY)


def alone(hits: DataFrame, others: DataFrame) -> DataFrame:
    """Hits of reads that have none among the others."""
    return hits.join(others.select(*KEY), KEY, "left_anti")


def merged(v: DataFrame, j: DataFrame, stats: DataFrame) -> DataFrame:
    """Reads of both hits from V's start to J's stop: on one strand, k bases at least."""
    n = F.col("jt") - F.col("s") + 1
    cut = lambda c: F.substring(F.col(c), F.col("s"), n)
    fits = (F.col("seq") == F.col("jseq")) & (n >= F.col("k"))
    return paired(v, j).join(stats, "sample_id").where(fits).select(*KEY, F.lit("VJ").alias("part"), "v", "j", cut("seq").alias("seq"), cut("qual").alias("qual"), "k")


def classify(v: DataFrame, j: DataFrame, motif: Motif, stats: DataFrame) -> DataFrame:
    """Candidate reads: sample_id, file_idx, qname, part (V, J, VJ), v, j, seq,
    qual, cdr3, cdr3_qual, k.

    ``v`` and ``j``: best hits with their segments.  A read of one hit must be
    longer than k, free of N, and have an anchor in some frame.  A read of both
    needs the same strand, at least k bases from V's start to J's stop, and no N.
    ``stats``: (sample_id, k).
    """
    none = F.lit(None).cast("string")
    # the first pass uses the same inner anchors for every chain
    first = motif.first_pass()
    v_only = assign_v(alone(v, j), first).withColumn("j", none).withColumn("part", F.lit("V"))
    j_only = assign_j(alone(j, v), first).withColumn("v", none).withColumn("part", F.lit("J"))
    single = v_only.unionByName(j_only).join(stats, "sample_id").where(F.length("seq") > F.col("k"))
    both = merged(v, j, stats)
    reads = single.unionByName(both.select("*", once(m=find_cdr3("seq", "qual", first)))).where(~F.col("seq").contains("N"))
    return reads.where("m.able").select(*KEY, "part", "v", "j", "seq", "qual", F.col("m.cdr3").alias("cdr3"), F.col("m.qual").alias("cdr3_qual"), "k")
