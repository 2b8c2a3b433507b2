"""FASTQ, FASTA, SAM and tables as DataFrames; clonotypes as CSV.

All readers split plain files and files of BGZF blocks (BAM, FASTQ by bgzip); another gzip file is one task, as its format demands.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clonespark.functions.dna import FILLED
from clonespark.sources.bam import read_bam
from clonespark.sources.fastq import block_records, of_blocks
from clonespark.staging import cut

READ_COLUMNS = ("sample_id", "file_idx", "qname", "seq", "qual")


def _tagged(df: DataFrame, sample_id: str, file_idx: int) -> DataFrame:
    return df.select(F.lit(sample_id).alias("sample_id"), F.lit(file_idx).alias("file_idx"), "*").select(*READ_COLUMNS)


def read_fasta_records(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq): the id is the first word of the header; sequences in upper case."""
    record = spark.read.option("lineSep", ">").text(path)
    lines = F.split("value", r"\r?\n", -1)
    seq = F.upper(F.regexp_replace(F.array_join(F.slice(lines, 2, F.size(lines)), ""), r"\s", ""))
    out = record.where(F.trim("value") != "").select(F.regexp_extract(F.get(lines, F.lit(0)), r"^\s*(\S*)", 1).alias("name"), seq.alias("seq"))
    return out.where("name <> ''")


def read_fasta(spark: SparkSession, path: str, sample_id: str = "", file_idx: int = 1) -> DataFrame:
    """Reads of a FASTA file; their qualities are made up."""
    rows = read_fasta_records(spark, path)
    return _tagged(rows.select(F.col("name").alias("qname"), "seq", F.expr(f"repeat('{FILLED}', length(seq))").alias("qual")), sample_id, file_idx)


def read_fastq(spark: SparkSession, path: str, sample_id: str = "", file_idx: int = 1) -> DataFrame:
    """Reads of a four-line FASTQ file, plain or .gz.

    A gzip file of BGZF blocks is opened in parts; another one is one task.  A plain file is split at each "\\n@", so its parts are read where they lie.  A
    quality line that starts with @ comes apart from its record and is put back:
    in its task, or, where the file's parts were cut between the two, by a join
    of what such cuts left, a row or two for each part.
    """
    if path.lower().endswith(".gz") and (blocks := of_blocks(spark, path)) is not None:
        return _tagged(block_records(blocks).where("length(seq) = length(qual)"), sample_id, file_idx)
    piece = spark.read.option("lineSep", "\n@").text(path).select("value", "_metadata.file_path", F.col("_metadata.file_block_start").alias("start"))

    def frame(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, at = None, None
        for pdf in batches:
            out = []
            for value, file, start in zip(pdf["value"], pdf["file_path"], pdf["start"], strict=True):
                if at != (file, start):
                    if head:
                        out.append((*head, None, *at))
                    head, at = None, (file, start)
                lines = value.replace("\r", "").split("\n")
                if len(lines) >= 3 and lines[2].startswith("+"):
                    if head:
                        out.append((*head, None, *at))
                    head = (lines[0].removeprefix("@").split(" ")[0].split("\t")[0], lines[1].upper())
                    if len(lines) > 3:
                        out.append((*head, lines[3], *at))
                        head = None
                elif value or head:  # nothing: the quality of one base is @
                    name, seq = head or (None, None)
                    out.append((name, seq, "@" + lines[0], *at))
                    head = None
            yield pd.DataFrame(out, columns=["qname", "seq", "qual", "file", "start"])
        if head:
            yield pd.DataFrame([(*head, None, *at)], columns=["qname", "seq", "qual", "file", "start"])

    rows = piece.mapInPandas(frame, "qname string, seq string, qual string, file string, start long")
    whole = rows.where("qname IS NOT NULL AND qual IS NOT NULL").select("qname", "seq", "qual")
    # a part's open head goes with the next part's open tail
    in_file = Window.partitionBy("file").orderBy("start", F.col("qname").isNotNull())
    open_rows = rows.where("qname IS NULL OR qual IS NULL").withColumn("qual", F.lead("qual").over(in_file))
    mended = open_rows.where("qname IS NOT NULL AND qual IS NOT NULL").select("qname", "seq", "qual")
    return _tagged(whole.unionByName(mended).where("length(seq) = length(qual)"), sample_id, file_idx)


def read_pairs(spark: SparkSession, first: str, second: str, sample_id: str = "") -> DataFrame:
    """Both mates of a pair of files, each a read of its own."""
    return read_fastq(spark, first, sample_id, 1).unionByName(read_fastq(spark, second, sample_id, 2))


def read_samples(spark: SparkSession, files: list[str], names: list[str], mates: list[str] | None = None) -> DataFrame:
    """Several samples as one table; a file without a name is an error."""
    if len(files) != len(names) or (mates and len(mates) != len(files)):
        raise ValueError("every input needs one output, and every first mate a second")
    parts = [read_pairs(spark, f, mates[i], n) if mates else any_reads(spark, f, n) for i, (f, n) in enumerate(zip(files, names, strict=True))]
    return reduce(DataFrame.unionByName, parts)


def any_reads(spark: SparkSession, path: str, sample_id: str = "", file_idx: int = 1) -> DataFrame:
    """Reads by the file's name: .fa/.fasta, .sam, .bam, else FASTQ; .gz after a text."""
    name = path.lower().removesuffix(".gz")
    if name.endswith((".fa", ".fasta", ".fna")):
        return read_fasta(spark, path, sample_id, file_idx)
    if name.endswith(".sam"):
        return sam_reads(read_sam(spark, path, "", sample_id, file_idx))
    if name.endswith(".bam"):
        return sam_reads(read_bam(spark, path, "", sample_id, file_idx))
    return read_fastq(spark, path, sample_id, file_idx)


def read_sam(spark: SparkSession, path: str, segment: str, sample_id: str = "", file_idx: int = 1) -> DataFrame:
    """Alignments of a SAM file: the columns that later steps need, scores from their tags."""
    f = F.split("value", "\t", -1)

    def tag(name: str) -> Column:
        return F.try_to_number(F.nullif(F.regexp_extract("value", rf"\t{name}:i:(-?\d+)", 1), F.lit("")), F.lit("S999999999")).cast("int")

    return spark.read.text(path).where(~F.col("value").startswith("@") & (F.col("value") != "")).select(
        F.lit(sample_id).alias("sample_id"), F.lit(file_idx).alias("file_idx"), F.lit(segment).alias("segment"),
        F.get(f, F.lit(0)).alias("qname"), F.get(f, F.lit(1)).cast("int").alias("flag"), F.get(f, F.lit(2)).alias("rname"), F.get(f, F.lit(3)).cast("int").alias("pos"),
        F.get(f, F.lit(5)).alias("cigar"), tag("AS").alias("as_score"), tag("NM").alias("nm"), F.get(f, F.lit(9)).alias("seq"), F.get(f, F.lit(10)).alias("qual"),
    )


def sam_reads(aln: DataFrame) -> DataFrame:
    """The reads of alignments: primary lines, mates by their flag, reverse hits turned back."""
    from clonespark.functions.dna import reverse_complement

    back = F.col("flag").bitwiseAND(16) != 0
    mate = F.when(F.col("flag").bitwiseAND(128) != 0, 2).otherwise(F.col("file_idx"))
    return aln.where(F.col("flag").bitwiseAND(2304) == 0).select(
        "sample_id", mate.alias("file_idx"), "qname", F.when(back, reverse_complement("seq")).otherwise(F.col("seq")).alias("seq"), F.when(back, F.reverse("qual")).otherwise(F.col("qual")).alias("qual")
    )


def read_probabilities(spark: SparkSession, path: str) -> DataFrame:
    """(pos, aa, p) of a table with a column AA and a column for each position."""
    wide = spark.read.option("header", True).csv(path)
    positions = [c for c in wide.columns if c != "AA"]
    long = wide.unpivot("AA", positions, "pos", "p")
    return long.select(F.col("pos").cast("int").alias("pos"), F.col("AA").alias("aa"), F.col("p").cast("double").alias("p"))


def result_path(prefix: str, chain: str, region: str) -> str:
    return f"{prefix}.{chain}.{region}.csv"


def write_clonotypes(df: DataFrame, prefix: str, chain: str, region: str) -> str:
    """One CSV folder, ``{prefix}.{chain}.{region}.csv``, most frequent first; see :func:`write_samples`."""
    return write_samples(df.withColumn("sample_id", F.lit(prefix)), [prefix], chain, region)[0]


def read_clonotypes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a result's folder with ``place``, from 0, in the order of its parts, however Spark deals them.

    Rows are counted within the stretches of files that tasks read whole; only the stretches' counts are summed up, a row each.
    """
    stretch = ["__file", "__block"]
    numbered = spark.read.option("header", True).schema(schema).csv(path).select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))
    rows = cut(numbered, "numbered")
    before = F.sum("n").over(Window.orderBy(*stretch).rowsBetween(Window.unboundedPreceding, -1))
    first = rows.groupBy(*stretch).agg(F.min("__at").alias("first"), F.count("*").alias("n")).select(*stretch, (F.coalesce(before, F.lit(0)) - F.col("first")).alias("first"))
    return rows.join(F.broadcast(first), stretch).withColumn("place", F.col("__at") + F.col("first")).drop(*stretch, "__at", "first")


def write_samples(df: DataFrame, prefixes: list[str], chain: str, region: str) -> list[str]:
    """A CSV folder for each prefix, from the rows whose ``sample_id`` it is, most frequent first.

    All samples are sorted and written by one job, in ranges, so neither a sample nor
    a folder is one task's work; the names of a folder's parts are in the rows' order, and
    each has a header.  Then every sample's folder is put in its place.  Rows of other
    samples are left out; a sample without rows has a header only.
    """
    spark = df.sparkSession
    names = list(dict.fromkeys(prefixes))
    order = [F.desc("Frequency"), *[F.col(c) for c in df.columns if c not in ("Frequency", "sample_id")]]
    numbers = spark.createDataFrame(list(enumerate(names)), "__sample int, sample_id string")
    rows = df.join(F.broadcast(numbers), "sample_id").drop("sample_id")  # as many rows as the caller has names
    whole = f"{names[0]}.parts-{uuid.uuid4().hex}"
    rows.repartitionByRange("__sample", *order).sortWithinPartitions("__sample", *order).write.partitionBy("__sample").option("header", True).csv(whole)
    for i, name in enumerate(names):
        if not _moved(spark, f"{whole}/__sample={i}", result_path(name, chain, region)):
            df.limit(0).drop("sample_id").coalesce(1).write.mode("overwrite").option("header", True).csv(result_path(name, chain, region))
    fs, path = _file_system(spark, whole)
    fs.delete(path, True)
    return [result_path(name, chain, region) for name in prefixes]


def _file_system(spark: SparkSession, path: str):
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def _moved(spark: SparkSession, source: str, target: str) -> bool:
    """Whether there was a folder to move; one of the target's name is replaced."""
    (fs, old), (other, new) = _file_system(spark, source), _file_system(spark, target)
    if not fs.exists(old):
        return False
    other.delete(new, True)
    done = other.create(other.makeQualified(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{source}/_SUCCESS"))) if fs.getUri() == other.getUri() else None
    if done is not None:
        done.close()
        if not fs.rename(old, new):
            raise OSError(f"{source} could not be moved to {target}")
        return True
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, old, other, new, True, spark.sparkContext._jsc.hadoopConfiguration())
    return True
