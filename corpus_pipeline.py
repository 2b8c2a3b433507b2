"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes what its predecessor kept; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonespark.llm import quality
from clonespark.llm.common import cut, table, text_of
from clonespark.llm.line_dedup import dedup_lines
from clonespark.llm.near_dedup import near_dedup
from clonespark.llm.packing import pack
from clonespark.llm.secret_scan import redact

MIN_SCORE = 0.7


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score MIN_SCORE or more; the others go."""
    net = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, net, out_col="__score").where(F.col("__score") >= MIN_SCORE).drop("__score")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line runs of 50 words or more that an earlier place has are deleted;
    documents that have nothing else go."""
    out = dedup_lines(docs, min_words=50).where("n_removed < n_lines")
    changed = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType)).drop("n_lines", "n_removed")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 0.8 or more on shingles of
    five words.  Different texts of one id are documents of their own.
    Documents without an id can't be grouped and stay."""
    own = F.xxhash64(text_of("text"))
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), own.alias("__text"))
    shared = cut(texts.groupBy("doc_id").agg(F.min("__text").alias("first"), F.max("__text").alias("last")).where("first <> last"), "shared-ids")
    named = docs.where("doc_id IS NOT NULL").withColumn("__id", F.col("doc_id").cast("long"))
    if not shared.isEmpty():
        # one text keeps the id, the others get ids above all
        top = texts.agg(F.max("doc_id")).first()[0]
        others = texts.join(shared, "doc_id").where("__text <> first").select(F.col("doc_id").alias("__id"), "__text").distinct()
        others = cut(others.withColumn("__new", F.lit(top) + 1 + F.monotonically_increasing_id()), "new-ids")
        named = named.withColumn("__text", own).join(others, ["__id", "__text"], "left").withColumn("__id", F.coalesce("__new", "__id")).drop("__text", "__new")
    kept = cut(near_dedup(named, width=5, percent=80, id_col="__id").where("kept").select(F.col("doc_id").alias("__id")), "kept")
    alone = named.join(kept.hint("merge"), "__id", "left_semi").dropDuplicates(["__id"])
    return alone.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    out = redact(docs)
    changed = F.when(F.size("spans") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType)).drop("spans")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids; a row for each piece, with its ids."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, size=2048)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_repeated_lines),
    ("near dedup", one_of_each_group),
    ("secret scan", without_secrets),
    ("packing", packed),
]

#: Neither the classifier nor the packing can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
