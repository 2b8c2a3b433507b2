"""The operators' queries over their tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonespark.llm import bpe, gif, quality
from clonespark.llm.common import table
from clonespark.llm.fim import fill_in_middle, restored
from clonespark.llm.filter_audit import audit
from clonespark.llm.html_extract import extract_pages
from clonespark.llm.line_dedup import dedup_lines
from clonespark.llm.near_dedup import near_dedup
from clonespark.llm.packing import pack
from clonespark.llm.secret_scan import scan_digest
from clonespark.llm.sharding import shard
from clonespark.llm.suffix_dedup import dedup_substrings
from clonespark.llm.topk import top_k


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line runs of 50 words or more that an earlier place has are deleted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, min_words=50)


OP1_SQL = r"""
WITH docs AS (SELECT doc_id AS d, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
ln AS (SELECT d, unnest(lines) AS line, generate_subscripts(lines, 1) AS p FROM docs),
w AS (SELECT d, p, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM ln),
c AS (SELECT d, p, sum(w) OVER (PARTITION BY d ORDER BY p) - w AS c0, sum(w) OVER (PARTITION BY d ORDER BY p) AS c1 FROM w),
runs AS (
  SELECT a.d, a.p AS s, min(b.p) AS e FROM c a JOIN c b ON a.d = b.d AND b.c1 >= a.c0 + 50 AND b.p >= a.p GROUP BY ALL
  UNION
  SELECT b.d, max(a.p) AS s, b.p AS e FROM c a JOIN c b ON a.d = b.d AND a.c0 <= b.c1 - 50 AND b.p >= a.p GROUP BY b.d, b.p),
named AS (SELECT r.*, array_to_string(list_slice(lines, s, e), chr(10)) AS run FROM runs r JOIN docs USING (d)),
later AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY run ORDER BY d, s) > 1),
gone AS (SELECT DISTINCT ln.d, ln.p FROM ln JOIN later l ON ln.d = l.d AND ln.p BETWEEN l.s AND l.e),
kept AS (
  SELECT ln.d, string_agg(line, chr(10) ORDER BY ln.p) FILTER (gone.p IS NULL) AS t, count(*) AS n, count(gone.p) AS g
  FROM ln LEFT JOIN gone ON ln.d = gone.d AND ln.p = gone.p GROUP BY ln.d)
SELECT d AS doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(t, '') END AS text,
  CAST(n AS INTEGER) AS n_lines, CAST(g AS INTEGER) AS n_removed
FROM docs JOIN kept USING (d)
"""


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, size=2048)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length", "cut"
    )


#: Small, so that the smallest tables split too.
SHARD_BYTES = 256 << 10


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of at most 256 KiB of text."""
    return shard(table(spark, sf_dir, "documents"), SHARD_BYTES)


OP3_SQL = f"""
WITH d AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h FROM documents),
sums AS (
  SELECT doc_id, n_bytes, h, depth, sum(n_bytes) OVER (PARTITION BY depth, h >> (60 - depth)) AS total
  FROM d, range(0, 61) AS r(depth) WHERE n_bytes <= {SHARD_BYTES}),
leaf AS (SELECT doc_id, n_bytes, h, CAST(min(depth) AS INTEGER) AS depth FROM sums WHERE total <= {SHARD_BYTES} GROUP BY ALL)
SELECT doc_id, n_bytes, depth, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h >> (60 - depth)), depth, '0') END AS shard, '0' AS page FROM leaf
"""


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as frames of GIFs, read back from the stored bytes."""
    stored = gif.encode_texts(table(spark, sf_dir, "documents"))
    read = gif.decode_media(stored)
    shape = F.array_join(F.transform("frames", lambda f: F.format_string("%dx%d@%d", f["width"], f["height"], f["delay_ms"])), ",")
    counts = F.aggregate("frames", F.array_repeat(F.lit(0), 64), lambda a, f: F.zip_with(a, f["histogram"], lambda x, y: x + y))
    return read.select(
        "doc_id", "n_bytes",
        F.length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -16, 16)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", F.size("frames").cast("string"), F.md5(shape), F.array_join(F.filter(counts.cast("array<string>"), lambda x: x != "0"), ",")).alias("feature"),
    )


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and the bytes that they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    told = ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), "ids")
    return bpe.decode(told, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text, learned from labels that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, net)
    return scored.select("doc_id", F.coalesce(quality.held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents at 0.8 or more on shingles of two words."""
    return near_dedup(table(spark, sf_dir, "documents"), width=2, percent=80)


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 1 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON r.other = l.a),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON least.doc_id = d.doc_id
"""


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text: the patterns' and the random field's."""
    return scan_digest(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, by its host's wrapper."""
    return extract_pages(table(spark, sf_dir, "pages"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector's 5 best among all others."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT q.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id) AS INTEGER) AS rank,
  c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 QUALIFY rank <= 5
"""


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every text that a document with a smaller id has in strings of 50."""
    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), length=50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut in three and written in another order, and what it is restored to."""
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR regexp_matches(t, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in all their orders, by language."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT w.part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false) AS e FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
k AS (
  SELECT part, good, bad, list_filter(['A', 'B', 'C', 'D', 'E'], lambda f: [a, b, c, d, e][ascii(f) - 64]) AS fails, count(*) AS n FROM m GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (
  SELECT f1.f || f2.f || f3.f || f4.f || f5.f AS filter_order FROM x f1, x f2, x f3, x f4, x f5
  WHERE len(list_distinct([f1.f, f2.f, f3.f, f4.f, f5.f])) = 5),
s AS (
  SELECT part, filter_order, step, filter_order[step] AS f, fails, good, bad, n, list_contains(fails, filter_order[step]) AS failing,
    len(list_filter(fails, lambda g: instr(filter_order, g) < step)) > 0 AS gone FROM k, o, range(1, 6) AS r(step)),
g AS (
  SELECT part, filter_order, step, f, sum(n) FILTER (NOT gone AND NOT failing) AS kept, sum(n) FILTER (failing AND NOT gone) AS removed, sum(n) FILTER (failing AND gone) AS redundant,
    sum(n) FILTER (fails = [f]) AS unique_fails, sum(n) FILTER (failing AND NOT gone AND good) AS good_lost, sum(n) FILTER (failing AND NOT gone AND bad) AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
  CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley FROM g
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_packing": op2_packing,
        "op3_sharding": op3_sharding,
        "op4_media_columns": op4_media_columns,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_quality": op6_quality,
        "op7_minhash_near_dedup": op7_minhash_near_dedup,
        "op8_secret_scan": op8_secret_scan,
        "op9_html_extraction": op9_html_extraction,
        "op10_top_k": op10_top_k,
        "op11_suffix_dedup": op11_suffix_dedup,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op3_sharding": OP3_SQL, "op7_minhash_near_dedup": OP7_SQL, "op10_top_k": OP10_SQL, "op12_fill_in_middle": OP12_SQL, "op13_filter_audit": OP13_SQL}
