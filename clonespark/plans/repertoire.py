"""From reads, or from alignments, to the clonotype table."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from clonespark.operators import align, annotate, classify, correct, extend
from clonespark.plans.catalogue import AUTO_K, Params
from clonespark.sources import io
from clonespark.staging import cut

log = logging.getLogger(__name__)

OUTPUT = ("AAseq", "NNseq", "Prob", "Vregion", "Jregion", "Dregion", "Frequency")


def from_reads(reads: DataFrame, v_segments: DataFrame, j_segments: DataFrame, params: Params, prob: DataFrame | None = None) -> DataFrame:
    """Clonotypes of (sample_id, file_idx, qname, seq, qual); segments are (name, seq)."""
    v = align.align(reads, v_segments, "V", params.min_score)
    j = align.align(reads, j_segments, "J", params.min_score)
    return from_alignments(v, j, v_segments, j_segments, params, prob)


def from_alignments(v: DataFrame, j: DataFrame, v_segments: DataFrame, j_segments: DataFrame, params: Params, prob: DataFrame | None = None) -> DataFrame:
    """Clonotypes of alignments, as :func:`clonespark.sources.io.read_sam` gives them."""
    entry = params.entry()
    v, j = align.best_hit(align.primary(v)), align.best_hit(align.primary(j))
    v, j = cut(v, "v-hits"), cut(j, "j-hits")
    stats = align.sample_stats(v, j, params.default_error_rate)
    chosen = None if params.kmer == AUTO_K else params.kmer
    stats = stats.withColumn("k", align.adaptive_k(F.col("mean_length"), chosen))
    stats = cut(stats, "stats")
    reads = classify.classify(classify.with_segments(v, v_segments), classify.with_segments(j, j_segments), entry.motif, stats.select("sample_id", "k"))
    seen = Observation("first pass")
    reads = cut(reads.observe(seen, F.count("*").alias("reads"), F.count("cdr3").alias("found")), "reads")
    first = seen.get
    log.info("search range: %d reads; found: %d; left: %d", first["reads"], first["found"], first["reads"] - first["found"])
    if log.isEnabledFor(logging.INFO):
        for r in stats.orderBy("sample_id").toLocalIterator():
            log.info("%s: k %d, error rate %s", r["sample_id"], r["k"], r["error_rate"])
    found = None
    # k takes one of four values, or the one that was asked for
    for k in sorted(r["k"] for r in stats.select("k").distinct().limit(8).collect()):
        own = reads.where(F.col("k") == k)
        part = extend.rescue(own, entry.motif, k, params.compat, params.max_length)
        if params.impute:
            part = extend.impute(cut(part, "found"), cut(extend.leaders(own, k), "leaders"), k)
        found = part if found is None else found.unionByName(part)
    return from_cdr3(reads.where("cdr3 IS NOT NULL") if found is None else found, stats, params, prob, first["found"])


def from_cdr3(reads: DataFrame, stats: DataFrame, params: Params, prob: DataFrame | None = None, before: int = 0) -> DataFrame:
    """Clonotypes of reads with their CDR3s; ``stats``: (sample_id, error_rate);
    ``before``: reads that had one before extension, for the log."""
    entry = params.entry()
    seen = Observation("all passes")
    reads = cut(reads.select("sample_id", "v", "j", "cdr3", "cdr3_qual").observe(seen, F.count("*").alias("reads")), "cdr3s")
    log.info("reads with a CDR3: %d; rescued: %d", seen.get["reads"], seen.get["reads"] - before)
    verdict = correct.correct(cut(correct.unique_cdr3(reads), "unique"), stats, params.single_cell, not params.compat)
    out = annotate.clonotypes(reads, verdict, params.corrected_nn)
    table = annotate.probability_table(prob) if prob is not None else {}
    out = out.withColumn("Prob", annotate.end_probability("AAseq", table) if table else F.lit(None).cast("double"))
    if entry.d_genes:
        out = annotate.with_d_gene(out, entry.d_genes)
    return out.select("sample_id", *[c for c in OUTPUT if c in out.columns])


def run(spark: SparkSession, files: list[str], outputs: list[str], params: Params, resources: str, mates: list[str] | None = None, prob_path: str | None = None) -> list[str]:
    """All samples in one job; one result for each output prefix."""
    entry = params.entry()
    v = io.read_fasta_records(spark, f"{resources}/{entry.v_file}")
    j = io.read_fasta_records(spark, f"{resources}/{entry.j_file}")
    prob = io.read_probabilities(spark, prob_path) if prob_path else None
    table = cut(from_reads(io.read_samples(spark, files, outputs, mates), v, j, params, prob), "clonotypes")
    return io.write_samples(table, outputs, params.chain, params.region)
