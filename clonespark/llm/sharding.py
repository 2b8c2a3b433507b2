"""Sharding by extendible hashing.

The directory is indexed by the leading bits of a 60-bit hash of the id.  It
starts with one bucket; a bucket above the byte limit splits on its next bit,
others stay, until every bucket fits.  Sizes are sums over hash prefixes, so a
round settles ``STEP`` bits at once and only rows of buckets that are still too
large go on; rows hold an id's hash and a byte count, never the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonespark.llm.common import cut, text_of

BITS, STEP = 60, 8
#: Rows of one page that are dealt out together.
CHUNK = 10_000


def shard(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, shard, depth, page): a row for each row of ``docs``.

    ``shard``: the hash prefix as ``depth`` binary digits, empty at depth 0; no
    shard has more than ``limit`` bytes of UTF-8 text, but for those of one
    document.  Such a document above the limit stays outside the directory, at
    depth BITS.  Rows that share a hash (a repeated id) cannot be split by it:
    if they exceed the limit, they are at depth BITS too and dealt to pages of
    that shard, each within the limit and of rows of one size, named by it and a
    number; ``page`` is the string 0 elsewhere.

    Null text: 0 bytes.  Null id: hashed as the word null.  Repeated rows: a
    row each.  Only the two named columns are read.  An empty table: no rows.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"),
            F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long").alias("h"),
        ),
        "shard-rows",
    )
    placed = []
    active, base = rows.where(F.col("n_bytes") <= limit), 0
    while base < BITS:
        bits = min(base + STEP, BITS)
        fine = active.groupBy(F.shiftright("h", BITS - bits).alias("p")).agg(F.sum("n_bytes").alias("n"))
        levels = fine.select("p", "n", F.explode(F.sequence(F.lit(base), F.lit(bits))).alias("depth"))
        at = F.expr(f"shiftright(p, {bits} - depth)")
        sums = levels.groupBy("depth", at.alias("prefix")).agg(F.sum("n").alias("total")).where(F.col("total") <= limit)
        leaf = levels.withColumn("prefix", at).join(sums, ["depth", "prefix"], "left_semi").groupBy("p").agg(F.min("depth").alias("depth"))
        found = cut(active.withColumn("p", F.shiftright("h", BITS - bits)).join(leaf, "p", "left").drop("p"), "shard-round")
        placed.append(found.where("depth IS NOT NULL").withColumn("page", F.lit(0)))
        active, base = found.where("depth IS NULL").drop("depth"), bits
        if active.isEmpty():
            break
    # equal rows are counted and dealt out again, so that no task holds all of them
    rest = rows.where(F.col("n_bytes") > limit).unionByName(active).groupBy("doc_id", "n_bytes", "h").agg(F.count("*").alias("c"))
    rest = rest.withColumn("first", F.explode(F.sequence(F.lit(0), F.col("c") - 1, F.lit(CHUNK)))).repartition("h", "n_bytes", "first")
    rest = rest.withColumn("i", F.explode(F.sequence("first", F.least(F.col("first") + CHUNK, "c") - 1)))
    in_page = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("n_bytes", F.lit(1))))
    rest = rest.withColumn("depth", F.lit(BITS)).withColumn("page", F.concat_ws("-", "n_bytes", F.floor(F.col("i") / in_page)))
    out = None
    for part in [*placed, rest]:
        part = part.select(
            "doc_id", "n_bytes",
            F.expr(f"CASE WHEN depth = 0 THEN '' ELSE lpad(bin(shiftright(h, {BITS} - depth)), depth, '0') END").alias("shard"),
            F.col("depth").cast("int").alias("depth"),
            F.col("page").cast("string").alias("page"),
        )
        out = part if out is None else out.unionByName(part)
    return out
