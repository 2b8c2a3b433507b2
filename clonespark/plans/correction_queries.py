"""Queries of the error correction over CDR3s that grow with the events: some
with thousands of copies, one for each user, copies with errors, and rare ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonespark.functions import dna
from clonespark.operators import annotate, correct
from clonespark.plans.catalogue import Chain, Params
from clonespark.plans.registry import BASES, HEX, MOTIF, SIGNS, hamming_sql, peptide_sql, query, read
from clonespark.plans.repertoire import from_cdr3
from clonespark.staging import cut


@query("abundance_thresholds", """
WITH x AS (SELECT p_partkey, CAST(p_size AS DOUBLE) * 10 AS n, 0.0031 AS p, 39.0 AS l FROM part),
y AS (SELECT *, pow((3 * sqrt(p * (1 - p)) + sqrt(9 * p * (1 - p) + 4 * pow(1 - p, l) * n)) / (2 * pow(1 - p, l)), 2) AS parent,
  l * (l - 1) / 2 * pow(p, 2) * pow(1 - p, l - 2) AS ps FROM x),
z AS (SELECT *, ps * floor(parent) + 3.0 * sqrt(floor(parent) * ps * (1 - ps)) AS copies FROM y)
SELECT p_partkey, round(parent, 6) AS parent, round(copies, 6) AS copies,
  round(CASE WHEN parent < 1 THEN 0 ELSE greatest(parent / 117 + 3.291 * sqrt(parent / 117 * (1 - 1 / 117.0)), 1) END, 6) AS share FROM z
""")  # fmt: skip
def abundance_thresholds(spark, sf):
    p, n, length = F.lit(0.0031), F.col("p_size").cast("double") * 10, F.lit(39.0)
    parent = dna.largest_parent(p, length, n)
    copies = dna.expected_copies(p, length, F.floor(parent), 2)
    return read(spark, sf, "part").select("p_partkey", F.round(parent, 6).alias("parent"), F.round(copies, 6).alias("copies"), F.round(dna.share_of(parent, F.lit(117)), 6).alias("share"))


def _changed(seq: str, place: str, digit: int) -> str:
    base = f"substr('ACGT', CAST(instr('{HEX}', substr(hx, {digit}, 1)) % 4 + 1 AS INT), 1)"
    return f"substr({seq}, 1, {place} - 1) || {base} || substr({seq}, {place} + 1)"


#: Columns of the reads, in both dialects: all share both ends, as real ones do.
_STEPS = {
    "sample_id": "'s' || CAST(user_id % 2 AS {s})",
    "key": "CASE WHEN event_id % 101 = 0 THEN 'r' || CAST(event_id AS {s}) WHEN event_id % 2 = 0 THEN 'h' || CAST(user_id % 5 AS {s}) ELSE 'u' || CAST(user_id AS {s}) END",
    "hx": "md5(CAST(event_id AS {s}))",
    "whole": f"'TGTGCCAGC' || substr(translate(md5(key), '{HEX}', '{BASES}'), 1, CAST(12 + user_id % 5 * 3 AS INT)) || 'TTC'",
    "p1": f"CAST(10 + instr('{HEX}', substr(hx, 1, 1)) % 12 AS INT)",
    "p2": f"CAST(10 + instr('{HEX}', substr(hx, 3, 1)) % 12 AS INT)",
    "one": f"CASE WHEN event_id % 11 = 0 THEN {_changed('whole', 'p1', 2)} ELSE whole END",
    "two": f"CASE WHEN event_id % 33 = 0 THEN {_changed('one', 'p2', 4)} ELSE one END",
    "cdr3": "CASE WHEN event_id % 50 = 7 THEN left(two, 15) WHEN event_id % 50 = 9 THEN repeat(two, 5) ELSE two END",
    "cdr3_qual": f"CASE WHEN event_id % 7 = 0 THEN repeat('#', CAST(length(cdr3) AS INT)) ELSE left(translate(hx || md5('q' || hx) || md5('r' || hx) || md5('s' || hx) || md5('t' || hx), '{HEX}', '{SIGNS}'), CASE WHEN event_id % 13 = 0 THEN 20 ELSE CAST(length(cdr3) AS INT) END) END",
    "v": "'V' || CAST(user_id % 5 AS {s})",
    "j": "'J' || CAST(user_id % 3 AS {s})",
}
_RATES = (("s0", 0.0031), ("s1", 0.01))


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """The reads, stored: as nested expressions of the aggregates they would be too large to compile."""
    e = read(spark, sf, "events")
    for name, x in _STEPS.items():
        e = e.withColumn(name, F.expr(x.format(s="string")))
    return cut(e.select("sample_id", "cdr3", "cdr3_qual", "v", "j"), "cells")


def rates(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{n}', double({p}))" for n, p in _RATES) + " AS r(sample_id, error_rate)")


def unique(reads: DataFrame) -> DataFrame:
    return cut(correct.unique_cdr3(reads), "unique")


def _parent(n: str) -> str:
    return f"floor(pow((3 * sqrt(p * (1 - p)) + sqrt(9 * p * (1 - p) + 4 * pow(1 - p, n) * {n})) / (2 * pow(1 - p, n)), 2))"


def _copies(parent: str, x: int, alpha: float) -> str:
    ways = " * ".join(f"((n - {i}) / {i + 1}.0)" for i in range(x))
    ps = f"({ways} * pow(p, {x}) * pow(1 - p, n - {x}))"
    return f"({ps} * {parent} + {alpha} * sqrt({parent} * {ps} * (1 - {ps})))"


def _share(copies: str, ways: str) -> str:
    return f"(CASE WHEN {copies} < 1 THEN 0.0 ELSE greatest({copies} / ({ways}) + 3.291 * sqrt({copies} / ({ways}) * (1 - 1.0 / ({ways}))), 1.0) END)"


_CELLS = f"""rates(sample_id, p) AS (VALUES {", ".join(f"('{n}', CAST({p} AS DOUBLE))" for n, p in _RATES)}),
cells AS (SELECT {", ".join(f"{x.format(s='VARCHAR')} AS {name}" for name, x in _STEPS.items())} FROM events)"""
#: From ``cells`` (sample_id, cdr3, cdr3_qual, v, j) and ``rates`` (sample_id, p) on.
_UNIQUE = """
u AS (SELECT sample_id, CAST(length(cdr3) AS INTEGER) AS len, cdr3, count(*) AS cnt, min(length(cdr3_qual)) AS shortest FROM cells WHERE length(cdr3) BETWEEN 21 AND 105 GROUP BY ALL),
signs AS (SELECT sample_id, cdr3, i, max(substr(cdr3_qual, i, 1)) AS s FROM cells, range(1, 106) AS r(i) WHERE i <= length(cdr3_qual) GROUP BY ALL),
uniq AS (SELECT sample_id, len, cdr3, cnt, left(string_agg(s, '' ORDER BY i), any_value(shortest)) AS qual FROM u JOIN signs USING (sample_id, cdr3) GROUP BY ALL)"""
_BANDS = f"""{_UNIQUE},
g AS (SELECT sample_id, len, p, CAST(len - 6 AS DOUBLE) AS n, max(cnt) AS most FROM uniq JOIN rates USING (sample_id) GROUP BY ALL),
g1 AS (SELECT *, {_parent("most")} AS nt FROM g), g2 AS (SELECT *, {_copies("nt", 1, 3.0)} AS c1 FROM g1), g3 AS (SELECT *, floor({_share("c1", "3 * n")}) AS top FROM g2),
g4 AS (SELECT *, {_parent("top")} AS nt2 FROM g3), g5 AS (SELECT *, {_copies("nt2", 1, 3.0)} AS c2 FROM g4), g6 AS (SELECT *, {_share("c2", "3 * n")} AS low FROM g5),
bands AS (SELECT sample_id, len, cdr3, qual, cnt, p, n, top, low, cnt <= low AS maybe, cnt > low AND cnt < top AS leaf, cnt >= top AS root FROM uniq JOIN g6 USING (sample_id, len))"""
_NEAR = f"""{_BANDS},
r1 AS (SELECT *, {_parent("cnt")} AS par FROM bands WHERE root),
roots AS (SELECT sample_id, len, cdr3, par - cnt AS budget, [{", ".join(_share(_copies("par", x, 3.291), f"n * {3**x}") for x in range(1, 8))}] AS up FROM r1),
pairs AS (SELECT l.sample_id, l.len, l.cdr3 AS a, r.cdr3 AS b, r.budget, {hamming_sql("l.cdr3", "r.cdr3", 3)} AS d, list_transform(r.up, lambda x: abs(x - l.cnt)) AS gaps
  FROM bands l JOIN roots r ON l.leaf AND l.sample_id = r.sample_id AND l.len = r.len),
near AS (SELECT sample_id, len, a, count(*) AS roots, min(b) AS b, arg_min(budget, b) AS budget FROM pairs WHERE d <= list_position(gaps, list_min(gaps)) GROUP BY ALL)"""
_WEIGHTS = f"""{_NEAR},
attached AS (SELECT n.sample_id, n.len, n.b AS root, n.a AS cdr3, l.qual, l.cnt, n.budget FROM near n JOIN bands l ON l.leaf AND l.sample_id = n.sample_id AND l.cdr3 = n.a WHERE roots = 1),
inn AS (SELECT *, substr(cdr3, i, 1) AS base, CASE WHEN substr(qual, i, 1) <> '' THEN ln(pow(10.0, -(ascii(substr(qual, i, 1)) - 33) / 10.0)) ELSE 0 END AS chance
  FROM attached, range(4, 103) AS r(i) WHERE i <= len - 3),
tas AS (SELECT sample_id, root, i, base, sum(chance) AS w FROM inn GROUP BY ALL),
weights AS (SELECT sample_id, len, root, cdr3, cnt, budget, max(cnt) * product(w) AS weight FROM inn JOIN tas USING (sample_id, root, i, base) GROUP BY ALL)"""
_RESCUED = f"""{_BANDS},
good AS (SELECT * FROM bands m WHERE maybe AND EXISTS (SELECT 1 FROM bands r WHERE r.root AND r.sample_id = m.sample_id AND r.len = m.len)
  AND coalesce(list_sum(list_transform(range(1, length(qual) + 1), lambda i: pow(10.0, -(ascii(substr(qual, i, 1)) - 33) / 10.0))), 0) < 1),
rescued AS (SELECT * FROM good m WHERE NOT EXISTS (SELECT 1 FROM bands s WHERE (s.leaf OR s.root) AND s.sample_id = m.sample_id AND s.len = m.len AND {hamming_sql("m.cdr3", "s.cdr3", 3)} <= 3))"""


@query("quality_merge", f"WITH {_CELLS},{_UNIQUE} SELECT sample_id, len, cdr3, qual, cnt FROM uniq")
def quality_merge(spark, sf):
    return correct.unique_cdr3(cells(spark, sf))


@query("abundance_bands", f"WITH {_CELLS},{_BANDS} SELECT sample_id, len, cdr3, cnt, CAST(top AS BIGINT) AS top, round(low, 6) AS low, maybe, leaf, root FROM bands")
def abundance_bands(spark, sf):
    told = correct.bands(unique(cells(spark, sf)), rates(spark))
    return told.select("sample_id", "len", "cdr3", "cnt", F.col("top").cast("long").alias("top"), F.round("low", 6).alias("low"), "maybe", "leaf", "root")


@query("hamming_neighbours", f"""
WITH {_CELLS},{_UNIQUE}
SELECT a.sample_id, a.cdr3 AS a, b.cdr3 AS b, CAST({hamming_sql("a.cdr3", "b.cdr3", 3)} AS INTEGER) AS d FROM uniq a JOIN uniq b
ON a.sample_id = b.sample_id AND a.len = b.len AND a.cnt < 5 AND b.cnt >= 5 WHERE {hamming_sql("a.cdr3", "b.cdr3", 3)} <= 7
""")  # fmt: skip
def hamming_neighbours(spark, sf):
    u = unique(cells(spark, sf))
    left, right = (u.where(c).select("sample_id", "len", F.col("cdr3").alias(n)) for c, n in (("cnt < 5", "a"), ("cnt >= 5", "b")))
    return correct.neighbours(left, right, correct.TO_ROOT).select("sample_id", "a", "b", "d")


@query("leaf_reach", f"WITH {_CELLS},{_NEAR} SELECT sample_id, a AS leaf, roots, b AS root, CAST(budget AS BIGINT) AS budget FROM near")
def leaf_reach(spark, sf):
    """Leaves with the roots that are in reach."""
    near = correct.near_roots(cut(correct.bands(unique(cells(spark, sf)), rates(spark)), "bands"))
    return near.select("sample_id", F.col("a").alias("leaf"), "roots", F.col("b").alias("root"), F.col("budget").cast("long").alias("budget"))


@query("leaf_weights", f"WITH {_CELLS},{_WEIGHTS} SELECT sample_id, root, cdr3, cnt, weight > 0 AS positive, CASE WHEN weight <> 0 THEN round(ln(abs(weight)), 6) END AS size FROM weights")
def leaf_weights(spark, sf):
    """Weights of the leaves that have one root, by their errors' chances."""
    told = cut(correct.bands(unique(cells(spark, sf)), rates(spark)), "bands")
    near = correct.near_roots(told).where("roots = 1").select("sample_id", "len", F.col("a").alias("cdr3"), F.col("b").alias("root"))
    weighed = correct.leaf_weights(told.where("leaf").select("sample_id", "len", "cdr3", "qual", "cnt").join(near, ["sample_id", "len", "cdr3"]))
    return weighed.select("sample_id", "root", "cdr3", "cnt", (F.col("weight") > 0).alias("positive"), F.round(F.log(F.abs("weight")), 6).alias("size"))


@query("greedy_absorb", """
WITH RECURSIVE l AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) % 50 + 1 AS cnt, row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(value) AS BIGINT) % 50 + 1 DESC, event_id) AS i FROM events WHERE value IS NOT NULL),
w AS (SELECT user_id, event_id, cnt, i, cnt <= 40 AS taken, 40 - CASE WHEN cnt <= 40 THEN cnt ELSE 0 END AS rest FROM l WHERE i = 1
  UNION ALL SELECT l.user_id, l.event_id, l.cnt, l.i, l.cnt <= w.rest, w.rest - CASE WHEN l.cnt <= w.rest THEN l.cnt ELSE 0 END FROM w JOIN l ON l.user_id = w.user_id AND l.i = w.i + 1)
SELECT user_id, lpad(CAST(event_id AS VARCHAR), 12, '0') AS leaf, taken FROM w
""")  # fmt: skip
def greedy_absorb(spark, sf):
    cnt = F.floor("value") % 50 + 1
    leaves = read(spark, sf, "events").where("value IS NOT NULL").select("user_id", F.lpad(F.col("event_id").cast("string"), 12, "0").alias("leaf"), cnt.alias("cnt"))
    return correct.absorb(leaves.withColumn("weight", F.col("cnt").cast("double")).withColumn("budget", F.lit(40)), ["user_id"], "leaf").select("user_id", "leaf", "taken")


@query("rescued_cdr3s", f"WITH {_CELLS},{_RESCUED} SELECT sample_id, cdr3, cnt FROM rescued")
def rescued_cdr3s(spark, sf):
    """Rare CDR3s of good quality without a neighbour."""
    return correct.rescues(cut(correct.bands(unique(cells(spark, sf)), rates(spark)), "bands")).select("sample_id", "cdr3", "cnt")


VERDICT = f"""{_WEIGHTS},{_RESCUED.removeprefix(_BANDS + ",")},
queue AS (SELECT *, row_number() OVER (PARTITION BY sample_id, root ORDER BY weight DESC, cnt DESC, cdr3) AS i FROM weights WHERE cnt <= budget),
walk AS (SELECT sample_id, len, root, cdr3, i, true AS taken, budget - cnt AS rest FROM queue WHERE i = 1
  UNION ALL SELECT q.sample_id, q.len, q.root, q.cdr3, q.i, q.cnt <= w.rest, w.rest - CASE WHEN q.cnt <= w.rest THEN q.cnt ELSE 0 END FROM walk w JOIN queue q ON q.sample_id = w.sample_id AND q.root = w.root AND q.i = w.i + 1),
every AS (SELECT sample_id, len, cdr3, 0 AS rank, 'absorbed' AS status, root AS root FROM walk WHERE taken
  UNION ALL SELECT sample_id, len, cdr3, 2, 'leaf', NULL FROM walk WHERE NOT taken UNION ALL SELECT sample_id, len, cdr3, 2, 'leaf', NULL FROM weights WHERE cnt > budget
  UNION ALL SELECT sample_id, len, cdr3, 1, 'root', NULL FROM bands WHERE root UNION ALL SELECT sample_id, len, cdr3, 3, 'rescued', NULL FROM rescued
  UNION ALL SELECT sample_id, len, cdr3, 2, 'leaf', NULL FROM bands b WHERE leaf AND NOT EXISTS (SELECT 1 FROM near n WHERE n.sample_id = b.sample_id AND n.a = b.cdr3)),
verdict AS (SELECT sample_id, len, cdr3, status, root FROM every QUALIFY row_number() OVER (PARTITION BY sample_id, cdr3 ORDER BY rank) = 1)"""


@query("error_correction", f"WITH RECURSIVE {_CELLS},{VERDICT} SELECT sample_id, len, cdr3, status, root FROM verdict")
def error_correction(spark, sf):
    """All of the correction."""
    return correct.correct(unique(cells(spark, sf)), rates(spark))


COUNTED = f"""SELECT sample_id, {peptide_sql("fixed", "1")} AS "AAseq", cdr3 AS "NNseq", v AS "Vregion", j AS "Jregion", count(*) AS "Frequency"
FROM (SELECT c.*, coalesce(root, c.cdr3) AS fixed FROM cells c JOIN verdict w ON c.sample_id = w.sample_id AND c.cdr3 = w.cdr3) GROUP BY ALL"""


@query("clonotype_count", f"WITH RECURSIVE {_CELLS},{VERDICT} {COUNTED}")
def clonotype_count(spark, sf):
    """Corrected reads counted."""
    reads = cells(spark, sf)
    return annotate.clonotypes(reads, correct.correct(unique(reads), rates(spark)))


@query("single_cell", f"WITH {_CELLS},{_BANDS}, verdict AS (SELECT sample_id, cdr3, NULL AS root FROM bands WHERE cnt > top) {COUNTED}")
def single_cell(spark, sf):
    """Correction of single cells: CDR3s above the threshold."""
    params = Params(species="synthetic", single_cell=True)
    params.catalogue.register("synthetic", "TRB", "CDR3", Chain("", "", MOTIF))
    return from_cdr3(cells(spark, sf), rates(spark), params).drop("Prob")
