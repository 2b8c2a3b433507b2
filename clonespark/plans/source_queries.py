"""Queries of the readers and writers: files are written from the tables into
the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonespark.operators import align
from clonespark.plans.read_queries import RUN, synthetic_run
from clonespark.plans.registry import BASES, HEX, SIGNS, query, read
from clonespark.plans.repertoire import from_alignments
from clonespark.sources import io
from clonespark.staging import cut, scratch


def _file(df: DataFrame, line: str) -> str:
    """The folder of a text file with ``line``, an expression, for each row."""
    path = scratch(df.sparkSession, "file")
    df.selectExpr(f"{line} AS value").write.text(path)
    return path


#: Reads in both dialects; some qualities start with @.
_READS = {
    "qname": "'r' || CAST(event_id AS {s})",
    "seq": f"substr(translate(md5(event_type || CAST(event_id AS {{s}})), '{HEX}', '{BASES}'), 1, CAST(event_id % 20 + 12 AS INT))",
    "qual": f"CASE WHEN event_id % 9 = 0 THEN '@' ELSE '+' END || substr(translate(md5(CAST(event_id AS {{s}})), '{HEX}', '{SIGNS}'), 1, CAST(event_id % 20 + 11 AS INT))",
}
_READS_SQL = "r AS (SELECT event_id, user_id, " + ", ".join(f"{x.format(s='VARCHAR')} AS {n}" for n, x in _READS.items()) + " FROM events)"


def _reads(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("event_id", "user_id", *[F.expr(x.format(s="string")).alias(n) for n, x in _READS.items()])


_FASTQ = r"concat('@', qname, ' of the table\n', lower(seq), '\n+\n', qual)"


@query("read_fastq", f"WITH {_READS_SQL} SELECT 'a' AS sample_id, 1 AS file_idx, qname, seq, qual FROM r")
def read_fastq(spark, sf):
    return io.any_reads(spark, _file(_reads(spark, sf), _FASTQ), "a")


@query("read_pairs", f"""
WITH {_READS_SQL} SELECT 's' || CAST(user_id % 3 AS VARCHAR) AS sample_id, CAST(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END AS INTEGER) AS file_idx, qname, seq, qual FROM r
""")  # fmt: skip
def read_pairs(spark, sf):
    """Three samples of two files each."""
    reads = _reads(spark, sf)
    files = [[_file(reads.where(f"user_id % 3 = {k} AND event_id % 2 = {mate}"), _FASTQ) for k in range(3)] for mate in (0, 1)]
    return io.read_samples(spark, files[0], ["s0", "s1", "s2"], files[1])


@query("read_fasta", f"WITH {_READS_SQL} SELECT qname, seq, repeat('G', length(seq)) AS qual FROM r")
def read_fasta(spark, sf):
    """Sequences over several lines, in lower case."""
    return io.read_fasta(spark, _file(_reads(spark, sf), r"concat('>', qname, ' words\n', lower(left(seq, 10)), '\n', substr(seq, 11))")).select("qname", "seq", "qual")


_SAM = r"concat_ws('\t', qname, flag, rname, pos, '60', cigar, '*', '0', '0', seq, qual, concat('NM:i:', nm), 'XX:Z:AS:i:3', concat('AS:i:', as_score))"


def _sam(spark: SparkSession, sf: str) -> DataFrame:
    told = _reads(spark, sf).selectExpr(
        "qname", "seq", "qual", "cast(event_id * 37 % 4096 AS int) AS flag", "'g' || cast(user_id AS string) AS rname", "cast(event_id % 90 + 1 AS int) AS pos",
        "cast(length(seq) AS string) || 'M' AS cigar", "cast(event_id % 5 AS int) AS nm", "cast(event_id % 60 - 3 AS int) AS as_score",
    )
    path = _file(told, _SAM)
    spark.createDataFrame([("@HD\tVN:1.6",), ("@SQ\tSN:g1\tLN:90",)], "value string").write.mode("append").text(path)
    return io.read_sam(spark, path, "V", "a")


_SAM_SQL = f"""
{_READS_SQL}, m AS (SELECT qname, seq, qual, CAST(event_id * 37 % 4096 AS INTEGER) AS flag, 'g' || CAST(user_id AS VARCHAR) AS rname, CAST(event_id % 90 + 1 AS INTEGER) AS pos,
  CAST(length(seq) AS VARCHAR) || 'M' AS cigar, CAST(event_id % 5 AS INTEGER) AS nm, CAST(event_id % 60 - 3 AS INTEGER) AS as_score FROM r)"""


@query("read_sam", f"WITH {_SAM_SQL} SELECT qname, flag, rname, pos, cigar, as_score, nm, seq, qual FROM m")
def read_sam(spark, sf):
    return _sam(spark, sf).select("qname", "flag", "rname", "pos", "cigar", "as_score", "nm", "seq", "qual")


@query("sam_reads", f"""
WITH {_SAM_SQL} SELECT qname, CAST(CASE WHEN flag & 128 <> 0 THEN 2 ELSE 1 END AS INTEGER) AS file_idx,
CASE WHEN flag & 16 <> 0 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS seq, CASE WHEN flag & 16 <> 0 THEN reverse(qual) ELSE qual END AS qual FROM m WHERE flag & 2304 = 0
""")  # fmt: skip
def sam_reads(spark, sf):
    """Reads of alignments: primary lines, as they were sequenced."""
    return io.sam_reads(_sam(spark, sf)).select("qname", "file_idx", "seq", "qual")


@query("read_probabilities", """
SELECT CAST(c AS INTEGER) AS pos, chr(CAST(65 + n_nationkey AS INTEGER)) AS aa, CAST(n_nationkey * abs(c) % 7 AS DOUBLE) / 10 AS p FROM nation, (SELECT unnest([-4, -3, -2, 1, 2, 3, 8]) AS c)
""")  # fmt: skip
def read_probabilities(spark, sf):
    path = scratch(spark, "file")
    wide = read(spark, sf, "nation").select(F.char(F.col("n_nationkey").cast("long") + 65).alias("AA"), *[(F.col("n_nationkey") * abs(c) % 7 / 10.0).alias(str(c)) for c in (-4, -3, -2, 1, 2, 3, 8)])
    wide.coalesce(1).write.option("header", True).csv(path)
    return io.read_probabilities(spark, path)


@query("write_clonotypes", """
SELECT c_name AS "AAseq", c_mktsegment AS "Vregion", CAST(c_custkey % 40 AS BIGINT) AS "Frequency", row_number() OVER (ORDER BY c_custkey % 40 DESC, c_name, c_mktsegment) - 1 AS place FROM customer
""")  # fmt: skip
def write_clonotypes(spark, sf):
    """The result's rows, most frequent first, with their place in the file."""
    rows = read(spark, sf, "customer").select(F.col("c_name").alias("AAseq"), F.col("c_mktsegment").alias("Vregion"), (F.col("c_custkey") % 40).alias("Frequency"))
    path = io.write_clonotypes(rows, scratch(spark, "file"), "TRB", "CDR3")
    return io.read_clonotypes(spark, path, "AAseq string, Vregion string, Frequency long")


@query("repertoire_of_sam", RUN)
def repertoire_of_sam(spark, sf):
    """As repertoire_run, from SAM files of V and of J alignments."""
    reads, v, j, params = synthetic_run(spark, sf)
    hits = []
    for segments, name in ((v, "V"), (j, "J")):
        found = cut(align.align(reads, segments, name, params.min_score), "hits")
        hits.append(io.read_sam(spark, _file(found, _SAM), name, "s"))
    return from_alignments(*hits, v, j, params).drop("Prob")
