"""Command line: python -m clonespark.cli -f reads.fastq -o sample --resources DIR."""

from __future__ import annotations

import argparse
import logging
import os

from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession

from clonespark.operators.extend import MAX_LENGTH
from clonespark.plans.catalogue import AUTO_K, Params
from clonespark.plans.repertoire import from_alignments, run
from clonespark.sources import io
from clonespark.staging import clean


# Names and defaults of the options down to --proJ.
def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="clonespark", description="T- and B-cell receptor CDR3s of sequencing reads")
    one = p.add_mutually_exclusive_group()
    one.add_argument("-f", "--file", action="append", default=[], help="reads, a flag for each sample")
    one.add_argument("--f1", action="append", default=[], help="first mates, a flag for each sample")
    p.add_argument("--f2", action="append", default=[], help="second mates")
    p.add_argument("-o", "--output", action="append", required=True, help="output prefix of each sample")
    p.add_argument("-t", "--thread", type=int, default=4, help="local threads, unless a master is set")
    p.add_argument("-k", "--kmer", type=int, default=AUTO_K)
    p.add_argument("--chain", default="TRB", choices=["TRB", "TRA", "IGH", "IGL", "TRD", "TRG"])
    p.add_argument("-r", "--region", default="CDR3", choices=["CDR1", "CDR2", "CDR3"])
    p.add_argument("--species", default="hs", choices=["hs", "ms", "pig"])
    p.add_argument("--bowt", type=int, default=8, help="accepted and not needed: alignment uses all tasks")
    p.add_argument("--bowsc", type=int, default=12, help="least alignment score")
    p.add_argument("--penality", type=int, default=1, help="accepted and not used")
    p.add_argument("--sc", action="store_true", help="single cell")
    p.add_argument("--bam", action="store_true", help="inputs are alignments (.bam or .sam)")
    p.add_argument("--debug", action="store_true", help="keep the tables between steps")
    p.add_argument("--proV", action="append", default=[], help="V alignments (SAM)")
    p.add_argument("--proJ", action="append", default=[], help="J alignments (SAM)")
    p.add_argument("--resources", required=True, help="folder of the gene segments")
    p.add_argument("--prob", help="table of residues' probabilities")
    p.add_argument("--catalogue", help="JSON of further chains")
    p.add_argument("--impute", action="store_true", help="give reads of one segment the other by their end's k-mers")
    p.add_argument("--corrected-nn", action="store_true", help="NNseq is the corrected CDR3, not the read's own")
    p.add_argument("--max-length", type=int, default=MAX_LENGTH, help="bases of a read after extension, at most")
    p.add_argument("--compat", action="store_true")
    return p


def session(threads: int) -> SparkSession:
    """The session of the cluster that the program was submitted to, or that
    Spark's own configuration names; else a local one."""
    submitted = "PYSPARK_GATEWAY_PORT" in os.environ
    SparkContext._ensure_initialized()
    builder = SparkSession.builder.appName("clonespark")
    if not submitted and SparkConf().get("spark.master", "local[*]") == "local[*]":  # what Spark takes if nothing is said
        builder = builder.master(f"local[{threads}]")
    return builder.getOrCreate()


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    params = Params(species=a.species, chain=a.chain, region=a.region, kmer=a.kmer, min_score=a.bowsc, single_cell=a.sc, compat=a.compat, impute=a.impute, corrected_nn=a.corrected_nn, max_length=a.max_length)
    if a.catalogue:
        params.catalogue.load(a.catalogue)
    logging.basicConfig(level=logging.INFO, format="[%(asctime)s] %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    entry = params.entry()
    spark = session(a.thread)
    if a.proV or a.proJ:
        if len(a.output) != 1:
            raise SystemExit("alignments of one sample have one output")
        segments = [io.read_fasta_records(spark, f"{a.resources}/{f}") for f in (entry.v_file, entry.j_file)]
        v, j = (_all_sam(spark, paths, s) for paths, s in ((a.proV, "V"), (a.proJ, "J")))
        table = from_alignments(v, j, *segments, params, io.read_probabilities(spark, a.prob) if a.prob else None)
        io.write_clonotypes(table.drop("sample_id"), a.output[0], a.chain, a.region)
        if not a.debug:
            clean(spark)
        return 0
    if a.bam and not all(f.lower().removesuffix(".gz").endswith((".bam", ".sam")) for f in a.file):
        raise SystemExit("--bam needs files that end in .bam or .sam")
    run(spark, a.f1 or a.file, a.output, params, a.resources, a.f2 or None, a.prob)
    if not a.debug:
        clean(spark)
    return 0


def _all_sam(spark: SparkSession, paths: list[str], segment: str):
    out = None
    for i, path in enumerate(paths, 1):
        part = io.read_sam(spark, path, segment, "", i)
        out = part if out is None else out.unionByName(part)
    return out


if __name__ == "__main__":
    raise SystemExit(main())
