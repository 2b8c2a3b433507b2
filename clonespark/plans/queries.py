"""Queries over the driver's tables, each with the SQL that it must agree with.

The tables hold no DNA; it is derived from their keys and texts by the same
expressions in Spark and in SQL.  That exercises operators, not biology.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonespark.functions import dna, motif
from clonespark.operators import align, annotate, extend, search
from clonespark.plans.catalogue import Catalogue
from clonespark.plans.registry import BASES, HEX, MOTIF, QUERIES, SIGNS, SQL, dna_of, dna_sql, hamming_sql, peptide_sql, query, read, sense, starts_sql
from clonespark.staging import cut

__all__ = ["QUERIES", "SQL", "entry"]

# --- sequences ------------------------------------------------------------------


@query("translate_frames", f"""
WITH d AS (SELECT doc_id, {dna_sql("text")} AS seq FROM documents)
SELECT doc_id, {peptide_sql("seq", "1")} AS frame1, {peptide_sql("seq", "2")} AS frame2, {peptide_sql("seq", "3")} AS frame3 FROM d
""")  # fmt: skip
def translate_frames(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", dna_of("text").alias("seq"))
    return d.select("doc_id", *[dna.translate("seq", k).alias(f"frame{k}") for k in (1, 2, 3)])


@query("reverse_complement", f"SELECT doc_id, reverse(translate({dna_sql('text')}, 'ACGT', 'TGCA')) AS seq FROM documents")
def reverse_complement(spark, sf):
    return read(spark, sf, "documents").select("doc_id", dna.reverse_complement(dna_of("text")).alias("seq"))


@query("hamming_predicate", f"""
WITH d AS (SELECT doc_id, {dna_sql("text")} AS a, {dna_sql("lang || text")} AS b FROM documents)
SELECT doc_id, CAST({hamming_sql("a", "b", 0)} AS INTEGER) AS d0, CAST({hamming_sql("a", "b", 3)} AS INTEGER) AS d3 FROM d
""")  # fmt: skip
def hamming_predicate(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", dna_of("text").alias("a"), dna_of("lang || text").alias("b"))
    return d.select("doc_id", dna.hamming("a", "b").alias("d0"), dna.hamming("a", "b", 3).alias("d3"))


@query("phred_errors", f"""
WITH e AS (SELECT event_id, translate(md5(CAST(event_id AS VARCHAR)), '{HEX}', '{SIGNS}') AS q FROM events)
SELECT event_id, round(list_sum(list_transform(range(1, 33), lambda i: pow(10.0, -(ascii(substr(q, i, 1)) - 33) / 10.0))), 9) AS errors FROM e
""")  # fmt: skip
def phred_errors(spark, sf):
    q = F.expr(f"translate(md5(cast(event_id AS string)), '{HEX}', '{SIGNS}')")
    return read(spark, sf, "events").select("event_id", F.round(dna.phred_errors(q), 9).alias("errors"))


@query("quality_max", f"""
WITH e AS (SELECT event_id, translate(md5(CAST(event_id AS VARCHAR)), '{HEX}', '{SIGNS}') AS a, substr(translate(md5(event_type || CAST(user_id AS VARCHAR)), '{HEX}', '{SIGNS}'), 1, 20) AS b FROM events)
SELECT event_id, array_to_string(list_transform(range(1, 21), lambda i: greatest(substr(a, i, 1), substr(b, i, 1))), '') AS q FROM e
""")  # fmt: skip
def quality_max(spark, sf):
    a = F.expr(f"translate(md5(cast(event_id AS string)), '{HEX}', '{SIGNS}')")
    b = F.expr(f"substr(translate(md5(event_type || cast(user_id AS string)), '{HEX}', '{SIGNS}'), 1, 20)")
    return read(spark, sf, "events").select("event_id", dna.quality_max(a, b).alias("q"))


_CIGAR = "l_linenumber || 'S' || CAST(l_suppkey % 60 + 1 AS {s}) || 'M' || CAST(l_partkey % 5 AS {s}) || 'I' || CAST(l_orderkey % 9 + 1 AS {s}) || 'M3S'"


@query("cigar_segment", """
SELECT l_orderkey, l_linenumber, CAST(l_linenumber + 1 AS INTEGER) AS start, CAST(l_linenumber + l_suppkey % 60 + 1 AS INTEGER) AS stop, 5 AS ops FROM lineitem
""")  # fmt: skip
def cigar_segment(spark, sf):
    df = read(spark, sf, "lineitem").withColumn("cigar", F.expr(_CIGAR.format(s="string")))
    return df.select("l_orderkey", "l_linenumber", dna.cigar_span("cigar")["start"].alias("start"), dna.cigar_span("cigar")["stop"].alias("stop"), F.size(dna.cigar_ops("cigar")).alias("ops"))


# --- motifs -----------------------------------------------------------------------

_ANCHORED = (
    "CASE WHEN {id} % 5 = 0 THEN substr('GATTACA', 1, CAST({id} % 7 AS INT)) ELSE '' END || CASE WHEN {id} % 4 < 3 THEN 'TATTTCTGCGCC' WHEN {id} % 8 = 3 THEN 'TGTGCCAGC' ELSE 'AAA' END || substr({insert}, 1, CAST({id} % 25 AS INT) * 3) || CASE WHEN {id} % 3 < 2 THEN 'TTCTTCGGCGAAGGC' ELSE 'CAGTACTTC' END || 'AC'"
)


def anchored(key: str, salt: str, kind: str) -> str:
    return _ANCHORED.format(id=key, insert=sense(f"{salt} || CAST({key} AS {kind})"))


@query("motif_offsets", f"""
WITH d AS (SELECT doc_id, {peptide_sql("seq", "1")} AS aa FROM (SELECT doc_id, {anchored("doc_id", "lang", "VARCHAR")} AS seq FROM documents))
SELECT doc_id, array_to_string({starts_sql("aa", MOTIF.cmotif, MOTIF.coffset)}, ',') AS c, array_to_string({starts_sql("aa", "[A-F]+", 0)}, ',') AS runs FROM d
""")  # fmt: skip
def motif_offsets(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", dna.translate(F.expr(anchored("doc_id", "lang", "string"))).alias("aa"))
    told = lambda p, o: F.array_join(motif.match_starts("aa", p, o).cast("array<string>"), ",")
    return d.select("doc_id", told(MOTIF.cmotif, MOTIF.coffset).alias("c"), told("[A-F]+", 0).alias("runs"))


def c_starts_sql(m: motif.Motif) -> str:
    """Where the C anchor of ``aa`` is; a mirrored one is matched on the turned peptide."""
    if m.mirrored is None:
        return starts_sql("aa", m.cmotif, m.coffset)
    return f"list_reverse(list_transform({starts_sql('reverse(aa)', m.cmotif, m.mirrored)}, lambda q: CAST(length(aa) AS INTEGER) + 1 - q))"


def cdr3_sql(seq: str, m: motif.Motif, source: str, t: str = "") -> str:
    """CTEs up to ``found{t}`` (id, able, cdr3, start) of the CDR3s in ``source`` (id, ...)."""
    return f"""
p{t} AS (SELECT id, frame, seq, {peptide_sql("seq", "frame")} AS aa FROM (SELECT id, {seq} AS seq FROM {source}) AS x, range(1, 4) AS r(frame)),
m{t} AS (SELECT *, {c_starts_sql(m)} AS c0, {starts_sql("aa", m.fmotif, m.foffset)} AS f0,
        {starts_sql("aa", m.inner_c, 0) if m.inner_c else "CAST([] AS INTEGER[])"} AS c1, {starts_sql("aa", m.inner_f, 2) if m.inner_f else "CAST([] AS INTEGER[])"} AS f1 FROM p{t}),
a{t} AS (SELECT id, frame, seq, aa, (len(c0) = 0) <> (len(f0) = 0) AS one,
        CASE WHEN len(c0) = 0 AND len(f0) > 0 THEN c1 ELSE c0 END AS cs, CASE WHEN len(f0) = 0 AND len(c0) > 0 THEN f1 ELSE f0 END AS fs FROM m{t}),
c{t} AS (SELECT *, unnest(cs) AS xc, generate_subscripts(cs, 1) AS i FROM a{t}),
f{t} AS (SELECT *, unnest(fs) AS xf FROM c{t}),
ok{t} AS (SELECT * FROM f{t} WHERE xf - xc BETWEEN 6 AND 34 AND (i = 1 OR NOT xf - cs[i - 1] BETWEEN 7 AND 35) AND instr(substr(aa, xc, xf - xc + 1), '*') = 0),
hit{t} AS (SELECT * FROM ok{t} QUALIFY row_number() OVER (PARTITION BY id ORDER BY frame, xc, xf) = 1),
able{t} AS (SELECT id, bool_or(one OR EXISTS (SELECT 1 FROM ok{t} WHERE ok{t}.id = a{t}.id AND ok{t}.frame = a{t}.frame)) AS able FROM a{t} GROUP BY id),
found{t} AS (SELECT able{t}.id, able, substr(seq, 3 * (xc - 1) + CAST(frame AS INTEGER), 3 * (xf - xc + 1)) AS cdr3, 3 * (xc - 1) + frame AS start FROM able{t} LEFT JOIN hit{t} ON able{t}.id = hit{t}.id)"""


@query("cdr3_extract", f"""
WITH d AS (SELECT doc_id AS id, lang FROM documents),{cdr3_sql(anchored("id", "lang", "VARCHAR"), MOTIF.first_pass(), "d")}
SELECT id AS doc_id, able, cdr3 FROM found
""")  # fmt: skip
def cdr3_extract(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.expr(anchored("doc_id", "lang", "string")).alias("seq"))
    m = d.withColumn("m", motif.find_cdr3("seq", F.lit(""), MOTIF.first_pass()))
    return m.select("doc_id", "m.able", "m.cdr3")


@query("cdr3_second_pass", f"""
WITH d AS (SELECT doc_id AS id, lang FROM documents),{cdr3_sql(anchored("id", "lang", "VARCHAR"), MOTIF, "d")}
SELECT id AS doc_id, able, cdr3, CASE WHEN cdr3 IS NOT NULL THEN substr(repeat('{SIGNS}', 12), CAST(start AS BIGINT), length(cdr3)) END AS qual FROM found
""")  # fmt: skip
def cdr3_second_pass(spark, sf):
    """The chain's own inner anchors, as reads have them after extension."""
    d = read(spark, sf, "documents").select("doc_id", F.expr(anchored("doc_id", "lang", "string")).alias("seq"))
    m = d.withColumn("m", search.find_cdr3("seq", F.left(F.lit(SIGNS * 12), F.length("seq")), MOTIF))
    return m.select("doc_id", "m.able", "m.cdr3", "m.qual")


#: Mouse anchors: MYLCA, SFYVCG twice, two that overlap when turned (LYMCTCYS has one), or none that reads forward.
_MIRROR = Catalogue().lookup("ms", "TRB").motif
_MOUSE_ENDS = "CASE {id} % 5 WHEN 0 THEN 'ATGTACCTCTGCGCC' WHEN 1 THEN 'AGCTTCTACGTCTGCGGCTTCTACGTGTGCGGA' WHEN 2 THEN 'CTCTACATGTGCACCTGCTACTCT' WHEN 3 THEN 'GTGTTCCTGTGTGCTAGC' ELSE 'GCCTGCCTCCACGTG' END"
_MOUSE = "substr('ACGTAC', 1, CAST({id} % 3 AS INT)) || " + _MOUSE_ENDS + " || substr({insert}, 1, CAST({id} % 25 AS INT) * 3) || CASE WHEN {id} % 7 < 6 THEN 'TCCTTCGGGGCCGGG' ELSE 'CAGTACTTC' END || 'AC'"


def mouse(key: str, kind: str) -> str:
    return _MOUSE.format(id=key, insert=sense(f"'m' || CAST({key} AS {kind})"))


@query("mirrored_anchors", f"""
WITH d AS (SELECT event_id AS id FROM events),{cdr3_sql(mouse("id", "VARCHAR"), _MIRROR, "d")}
SELECT id AS event_id, able, cdr3, start FROM found
""")  # fmt: skip
def mirrored_anchors(spark, sf):
    """Reads whose C anchor is written from right to left; both searches must agree."""
    d = read(spark, sf, "events").select("event_id", F.expr(mouse("event_id", "string")).alias("seq"))
    m = d.withColumn("m", search.find_cdr3("seq", F.lit(""), _MIRROR))
    start = F.instr("seq", F.coalesce("m.cdr3", F.lit("-")))
    return m.select("event_id", "m.able", "m.cdr3", F.when(F.col("m.cdr3").isNotNull(), start.cast("long")).alias("start"))


# --- joins, filters and windows ------------------------------------------------------


@query("primary_filter", "SELECT l_orderkey, l_linenumber, CAST(l_partkey * 37 % 4096 AS INTEGER) AS flag FROM lineitem WHERE (CAST(l_partkey * 37 % 4096 AS INTEGER) & 2308) = 0")
def primary_filter(spark, sf):
    df = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr("cast(l_partkey * 37 % 4096 AS int)").alias("flag"))
    return align.primary(df)


def _hits(spark, sf):
    return read(spark, sf, "lineitem").select(
        F.lit("s").alias("sample_id"), F.lit(1).alias("file_idx"), F.lit("V").alias("segment"), F.col("l_orderkey").cast("string").alias("qname"), F.lit(0).alias("flag"),
        F.concat(F.lit("G"), (F.col("l_partkey") % 40).cast("string")).alias("rname"), F.col("l_linenumber").alias("pos"), F.lit("30M").alias("cigar"),
        (F.col("l_quantity") % 10).cast("int").alias("as_score"), (F.col("l_suppkey") % 4).cast("int").alias("nm"), F.lit("A").alias("seq"), F.lit("G").alias("qual"),
    )


@query("best_hit", """
SELECT CAST(l_orderkey AS VARCHAR) AS qname, 'G' || CAST(l_partkey % 40 AS VARCHAR) AS rname, l_linenumber AS pos, CAST(l_quantity % 10 AS INTEGER) AS as_score
FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_quantity % 10 AS INTEGER) DESC, 'G' || CAST(l_partkey % 40 AS VARCHAR), l_linenumber) = 1
""")  # fmt: skip
def best_hit(spark, sf):
    return align.best_hit(_hits(spark, sf)).select("qname", "rname", "pos", "as_score")


@query("sample_stats", """
SELECT 'src' || CAST(doc_id % 6 AS VARCHAR) AS sample_id, avg(n_chars) AS mean_length, round(CAST(sum(doc_id % 3) AS DOUBLE) / sum(20 + doc_id % 50), 12) AS error_rate,
  CASE WHEN avg(n_chars) >= 150 THEN 25 WHEN avg(n_chars) >= 100 THEN 23 WHEN avg(n_chars) >= 75 THEN 19 ELSE 15 END AS k
FROM documents GROUP BY 1
""")  # fmt: skip
def sample_stats(spark, sf):
    hits = read(spark, sf, "documents").select(
        F.expr("'src' || cast(doc_id % 6 AS string)").alias("sample_id"), F.col("text").alias("seq"), (F.col("doc_id") % 3).alias("nm"), F.expr("'4S' || cast(20 + doc_id % 50 AS string) || 'M'").alias("cigar")
    )
    out = align.sample_stats(hits)
    return out.select("sample_id", "mean_length", F.round("error_rate", 12).alias("error_rate"), align.adaptive_k(F.col("mean_length")).alias("k"))


@query("mode_region", """
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, event_type, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1 AND count(*) OVER (PARTITION BY user_id) > 1
""")  # fmt: skip
def mode_region(spark, sf):
    return extend.mode_of(read(spark, sf, "events"), "user_id", "event_type")


# --- k-mer graph --------------------------------------------------------------------

_POOL_K = 6
_POOL_SQL = f"""
reads AS (SELECT 's' || CAST(doc_id % 2 AS VARCHAR) AS sample_id, right({dna_sql("text")}, {_POOL_K + 10}) AS e FROM documents),
pool AS (SELECT sample_id, kmer, count(*) AS n FROM (SELECT sample_id, unnest(list_transform(range(1, 12), lambda i: substr(e, i, {_POOL_K}))) AS kmer FROM reads)
  WHERE kmer NOT IN ('AAAAAA', 'CCCCCC', 'GGGGGG', 'TTTTTT') GROUP BY ALL)"""
_SUCC_SQL = """
succ AS (SELECT a.sample_id, a.kmer, b.kmer AS next, right(b.kmer, 1) AS base FROM pool a JOIN pool b
  ON a.sample_id = b.sample_id AND substr(a.kmer, 2) = substr(b.kmer, 1, 5) AND a.kmer <> b.kmer AND greatest(a.n, b.n) <= 10 * least(a.n, b.n)
  QUALIFY row_number() OVER (PARTITION BY a.sample_id, a.kmer ORDER BY b.n DESC, b.kmer) = 1)"""


def _pool(spark, sf):
    reads = read(spark, sf, "documents").select(F.expr("'s' || cast(doc_id % 2 AS string)").alias("sample_id"), F.lit("V").alias("part"), dna_of("text").alias("seq"))
    return extend.kmer_pool(reads, _POOL_K)


@query("kmer_pool", f"WITH {_POOL_SQL} SELECT sample_id, kmer, n FROM pool")
def kmer_pool(spark, sf):
    return _pool(spark, sf).withColumn("kmer", dna.unpacked("kmer", _POOL_K))


@query("kmer_successor", f"WITH {_POOL_SQL},{_SUCC_SQL} SELECT sample_id, kmer, next, base FROM succ")
def kmer_successor(spark, sf):
    succ = extend.successors(_pool(spark, sf), _POOL_K)
    return succ.select("sample_id", *[dna.unpacked(c, n).alias(c) for c, n in (("kmer", _POOL_K), ("next", _POOL_K), ("base", 1))])


@query("kmer_extend", f"""
WITH RECURSIVE {_POOL_SQL},{_SUCC_SQL},
walk AS (SELECT sample_id, kmer, next AS at, base AS path FROM succ
  UNION ALL SELECT w.sample_id, w.kmer, s.next, w.path || s.base FROM walk w JOIN succ s ON w.sample_id = s.sample_id AND w.at = s.kmer WHERE length(w.path) < 40)
SELECT sample_id, kmer, max_by(path, length(path)) AS path FROM walk GROUP BY ALL
""")  # fmt: skip
def kmer_extend(spark, sf):
    return extend.paths(extend.successors(_pool(spark, sf), _POOL_K), 40).withColumn("kmer", dna.unpacked("kmer", _POOL_K))


@query("kmer_extend_left", f"""
WITH RECURSIVE {_POOL_SQL},
succ AS (SELECT a.sample_id, a.kmer, b.kmer AS next, left(b.kmer, 1) AS base FROM pool a JOIN pool b
  ON a.sample_id = b.sample_id AND substr(a.kmer, 1, 5) = substr(b.kmer, 2) AND a.kmer <> b.kmer AND greatest(a.n, b.n) <= 10 * least(a.n, b.n)
  QUALIFY row_number() OVER (PARTITION BY a.sample_id, a.kmer ORDER BY b.n DESC, b.kmer) = 1),
walk AS (SELECT sample_id, kmer, next AS at, base AS path FROM succ
  UNION ALL SELECT w.sample_id, w.kmer, s.next, w.path || s.base FROM walk w JOIN succ s ON w.sample_id = s.sample_id AND w.at = s.kmer WHERE length(w.path) < 40)
SELECT sample_id, kmer, max_by(path, length(path)) AS path FROM walk GROUP BY ALL
""")  # fmt: skip
def kmer_extend_left(spark, sf):
    return extend.paths(extend.successors(_pool(spark, sf), _POOL_K, right=False), 40).withColumn("kmer", dna.unpacked("kmer", _POOL_K))


#: Four reads of each of many stretches of 96 bases, the last one from its J end.
_TILES = {
    "qname": "CAST(event_id AS {s})",
    "stretch": "CAST(CAST(floor(event_id / 4.0) AS INT) AS {s})",
    "part": "CASE WHEN event_id % 4 = 3 THEN 'J' ELSE 'V' END",
    "seq": f"substr(translate(md5('a' || stretch) || md5('b' || stretch) || md5('c' || stretch), '{HEX}', '{BASES}'), CAST(event_id % 4 * 10 + 1 AS INT), 40)",
}


def extension_sql(k: int, reads: str = "reads") -> str:
    """CTEs up to ``grown`` (sample_id, qname, seq, more), from ``reads`` and ``missing`` (sample_id, qname, part, seq)."""
    sides = {"r": (f"substr(a.kmer, 2) = substr(b.kmer, 1, {k - 1})", "right(b.kmer, 1)"), "l": (f"substr(a.kmer, 1, {k - 1}) = substr(b.kmer, 2)", "left(b.kmer, 1)")}
    out = f"""
ends AS (SELECT sample_id, CASE WHEN part = 'J' THEN left(seq, {k + 10}) ELSE right(seq, {k + 10}) END AS e FROM {reads} WHERE part <> 'VJ'),
pool AS (SELECT sample_id, kmer, count(*) AS n FROM (SELECT sample_id, substr(e, i, {k}) AS kmer FROM ends, range(1, 12) AS r(i) WHERE i + {k - 1} <= length(e))
  WHERE kmer NOT IN ({", ".join(f"'{b * k}'" for b in "ACGT")}) GROUP BY ALL)"""
    for t, (meets, base) in sides.items():
        start = f"right(seq, {k})" if t == "r" else f"left(seq, {k})"
        out += f""",
succ_{t} AS (SELECT a.sample_id, a.kmer, b.kmer AS next, {base} AS base FROM pool a JOIN pool b
  ON a.sample_id = b.sample_id AND {meets} AND a.kmer <> b.kmer AND greatest(a.n, b.n) <= 10 * least(a.n, b.n) QUALIFY row_number() OVER (PARTITION BY a.sample_id, a.kmer ORDER BY b.n DESC, b.kmer) = 1),
walk_{t} AS (SELECT sample_id, qname, 150 - length(seq) AS room, {start} AS at, '' AS path FROM missing WHERE part {"<>" if t == "r" else "="} 'J' AND length(seq) < 150
  UNION ALL SELECT w.sample_id, w.qname, w.room, s.next, w.path || s.base FROM walk_{t} w JOIN succ_{t} s ON w.sample_id = s.sample_id AND w.at = s.kmer WHERE length(w.path) < w.room),
more_{t} AS (SELECT sample_id, qname, max_by(path, length(path)) AS path FROM walk_{t} GROUP BY ALL)"""
    return out + """,
grown AS (SELECT m.sample_id, m.qname, coalesce(reverse(l.path), '') || m.seq || coalesce(r.path, '') AS seq, coalesce(length(l.path), 0) AS before, coalesce(length(r.path), 0) AS after
  FROM missing m LEFT JOIN more_r r USING (sample_id, qname) LEFT JOIN more_l l USING (sample_id, qname))"""


@query("extend_reads", f"""
WITH RECURSIVE reads AS (SELECT 's' AS sample_id, {", ".join(f"{x.format(s='VARCHAR')} AS {n}" for n, x in _TILES.items())} FROM events),
missing AS (SELECT * FROM reads),{extension_sql(15)}
SELECT qname, seq, repeat('G', before) || repeat('I', 40) || repeat('G', after) AS qual FROM grown
""")  # fmt: skip
def extend_reads(spark, sf):
    """V reads grown to the right and J reads to the left, at a k of 15 and up to 150 bases."""
    reads = read(spark, sf, "events").withColumn("sample_id", F.lit("s"))
    for name, x in _TILES.items():
        reads = reads.withColumn(name, F.expr(x.format(s="string")))
    reads = cut(reads.select("sample_id", "qname", "part", "seq", F.repeat(F.lit("I"), F.length("seq")).alias("qual")), "reads")
    return extend.extend(reads, extend.kmer_pool(reads, 15), 15).select("qname", "seq", "qual")


@query("impute_genes", f"""
WITH reads AS (SELECT CAST(event_id AS VARCHAR) AS qname, CASE WHEN event_id % 3 = 0 THEN 'J' ELSE 'V' END AS part, 'V' || CAST(event_id % 5 AS VARCHAR) AS vn, 'J' || CAST(event_id % 4 AS VARCHAR) AS jn,
  substr(translate(md5(CAST(user_id AS VARCHAR)), '{HEX}', '{BASES}'), CAST(event_id % 13 + 1 AS INT), 19) AS seq FROM events),
r AS (SELECT qname, part, seq, CASE WHEN part = 'V' THEN vn END AS v, CASE WHEN part = 'J' THEN jn END AS j FROM reads),
votes AS (SELECT part, CASE WHEN part = 'V' THEN left(seq, 15) ELSE right(seq, 15) END AS kmer, coalesce(v, j) AS region, count(*) AS n FROM r GROUP BY ALL),
known AS (SELECT * FROM votes QUALIFY count(*) OVER (PARTITION BY part, kmer) > 1 AND row_number() OVER (PARTITION BY part, kmer ORDER BY n DESC, region) = 1),
words AS (SELECT qname, CASE WHEN part = 'V' THEN 'J' ELSE 'V' END AS part, i, CASE WHEN part = 'V' THEN substr(seq, length(seq) - 14 - i, 15) ELSE substr(seq, i + 1, 15) END AS kmer FROM r, range(0, 5) AS t(i)),
told AS (SELECT qname, arg_min(region, i) AS region FROM words JOIN known USING (part, kmer) GROUP BY qname)
SELECT qname, part, CASE WHEN part = 'J' THEN region ELSE v END AS v, CASE WHEN part = 'V' THEN region ELSE j END AS j FROM r LEFT JOIN told USING (qname)
""")  # fmt: skip
def impute_genes(spark, sf):
    """The missing segment of reads by the k-mers at their other end."""
    part = F.expr("CASE WHEN event_id % 3 = 0 THEN 'J' ELSE 'V' END")
    seq = F.expr(f"substr(translate(md5(cast(user_id AS string)), '{HEX}', '{BASES}'), cast(event_id % 13 + 1 AS int), 19)")
    name = lambda letter, n: F.when(part == letter, F.concat(F.lit(letter), (F.col("event_id") % n).cast("string")))
    reads = read(spark, sf, "events").select(F.lit("s").alias("sample_id"), F.col("event_id").cast("string").alias("qname"), part.alias("part"), name("V", 5).alias("v"), name("J", 4).alias("j"), seq.alias("seq"))
    reads = cut(reads, "reads")
    return extend.impute(reads, extend.leaders(reads, 15), 15).select("qname", "part", "v", "j")


# --- annotation ---------------------------------------------------------------------

# even tenths: no product of six ends in a 5 at the sixth digit, where the dialects round differently
_PROB = {(c, a): round(((ord(a) + abs(c)) % 4 + 1) / 5, 1) for c in (1, 2, 3, -2, -3, -4) for a in "ACDEFGHIKLMNPQRSTVWY"}
_PROB_SQL = ", ".join(f"({c}, '{a}', {p})" for (c, a), p in sorted(_PROB.items()))


@query("prob_product", f"""
WITH d AS (SELECT doc_id, {peptide_sql("seq", "1")} AS aa FROM (SELECT doc_id, {sense("lang || CAST(doc_id AS VARCHAR)")} AS seq FROM documents)),
pr(c, a, p) AS (VALUES {_PROB_SQL}),
places AS (SELECT doc_id, aa, c, substr(aa, CASE WHEN c > 0 THEN c + 1 ELSE length(aa) + c + 1 END, 1) AS a FROM d, (SELECT DISTINCT c FROM pr))
SELECT doc_id, round(product(CAST(coalesce(p, 0) AS DOUBLE)), 5) AS prob FROM places LEFT JOIN pr USING (c, a) GROUP BY doc_id
""")  # fmt: skip
def prob_product(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", dna.translate(F.expr(sense("lang || cast(doc_id AS string)"))).alias("aa"))
    return d.select("doc_id", annotate.end_probability("aa", _PROB).alias("prob"))


_GENES = (("D1", "GGGACAGGGGGC"), ("D2", "GGGACTAGCGGGGGGG"))
_D_SEQ = "CASE WHEN doc_id % 3 = 0 THEN 'TGTGCC' || substr(translate(md5(text), '{0}', '{1}'), 1, CAST(doc_id % 9 AS INT)) || 'GGGACAGGGGGC' || substr(translate(md5(text), '{0}', '{1}'), 9, CAST(doc_id % 7 AS INT)) || 'TTC' WHEN doc_id % 3 = 1 THEN 'TGT' || substr('GGGACTAGCGGGGGGG', CAST(doc_id % 5 + 1 AS INT), 12) || substr(translate(md5(text), '{0}', '{1}'), 1, CAST(doc_id % 20 AS INT)) ELSE translate(md5(text), '{0}', '{1}') END".format(HEX, BASES)


def _gene_sql() -> str:
    """Global alignment with affine gaps, a row of the matrix a step: best, and best that ends in a gap of the gene."""
    match = "CASE WHEN substr(g, j, 1) = substr(s, i + 1, 1) THEN 5 ELSE -3 END"
    return f"""
WITH RECURSIVE d AS (SELECT DISTINCT {_D_SEQ} AS s FROM documents), genes(k, name, g) AS (VALUES {", ".join(f"({i}, '{n}', '{g}')" for i, (n, g) in enumerate(_GENES))}),
dp AS (SELECT s, k, g, 0 AS i, list_prepend(0, list_transform(range(1, length(g) + 1), lambda j: -4 - j)) AS best, list_transform(range(0, length(g) + 1), lambda j: -1000000) AS down FROM d, genes
  UNION ALL SELECT s, k, g, i + 1,
    list_transform(range(1, length(g) + 2), lambda j: greatest(fresh[j], CASE WHEN j = 1 THEN -1000000 ELSE list_max(list_transform(range(1, j), lambda h: fresh[h] - 4 - (j - h))) END)), lower
  FROM (SELECT *, list_prepend(-4 - (i + 1), list_transform(range(1, length(g) + 1), lambda j: greatest(best[j] + {match}, lower[j + 1]))) AS fresh
    FROM (SELECT *, list_transform(range(1, length(g) + 2), lambda j: greatest(down[j] - 1, best[j] - 5)) AS lower FROM dp WHERE i < length(s)))),
scored AS (SELECT s, k, name, best[length(dp.g) + 1] AS score, length(s) - length(dp.g) AS more FROM dp JOIN genes USING (k) WHERE i = length(s)),
first AS (SELECT * FROM scored WHERE score + more + 4 > 35 QUALIFY row_number() OVER (PARTITION BY s ORDER BY score DESC, k) = 1)
SELECT doc_id, x.s AS "NNseq", coalesce(name, 'None') AS "Dregion" FROM (SELECT doc_id, {_D_SEQ} AS s FROM documents) x LEFT JOIN first USING (s)
"""


@query("d_gene", _gene_sql())
def d_gene(spark, sf):
    """The best D gene of each sequence."""
    return annotate.with_d_gene(read(spark, sf, "documents").select("doc_id", F.expr(_D_SEQ).alias("NNseq")), _GENES)


_FLAGSHIP = anchored("event_id", "''", "{s}")


@query("clonotypes_of_reads", f"""
WITH d AS (SELECT event_id AS id, user_id FROM events),{cdr3_sql(anchored("id", "''", "VARCHAR"), MOTIF.first_pass(), "d")}
SELECT {peptide_sql("cdr3", "1")} AS "AAseq", cdr3 AS "NNseq", 'V' || CAST(user_id % 4 AS VARCHAR) AS "Vregion", count(*) AS "Frequency"
FROM found JOIN d USING (id) WHERE cdr3 IS NOT NULL GROUP BY ALL
""")  # fmt: skip
def clonotypes_of_reads(spark, sf):
    """Flagship: reads to frames, to CDR3s, to clonotypes."""
    reads = read(spark, sf, "events").select(F.expr(_FLAGSHIP.format(s="string")).alias("seq"), F.expr("'V' || cast(user_id % 4 AS string)").alias("Vregion"))
    # equal reads are searched once
    cells = reads.groupBy("seq", "Vregion").agg(F.count("*").alias("n"))
    found = cells.withColumn("NNseq", search.find_cdr3("seq", F.lit(""), MOTIF.first_pass())["cdr3"]).where("NNseq IS NOT NULL")
    return found.groupBy("NNseq", "Vregion").agg(F.sum("n").alias("Frequency")).select(dna.translate("NNseq").alias("AAseq"), "NNseq", "Vregion", "Frequency")


# these register their queries, and build on the SQL above
from clonespark.plans import correction_queries, read_queries, source_queries  # noqa: E402, F401


def entry(spark: SparkSession, sf: str) -> DataFrame:
    return clonotypes_of_reads(spark, sf).orderBy(F.desc("Frequency"), "NNseq", "Vregion")
