"""Findings of the third round."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from clonespark.functions import dna
from clonespark.operators import align, classify, correct, extend
from clonespark.plans.queries import MOTIF
from clonespark.sources import io


def test_tables_of_kmers_are_never_broadcast(spark):
    reads = spark.range(200).select(F.lit("s").alias("sample_id"), F.col("id").cast("string").alias("qname"), F.when(F.col("id") % 2 == 0, "V").otherwise("J").alias("part"), F.expr("translate(md5(cast(id AS string)), '0123456789abcdef', 'ACGTACGTACGTACGT')").alias("seq"))
    reads = reads.withColumn("qual", F.repeat(F.lit("I"), F.length("seq"))).withColumn("v", F.when(F.col("part") == "V", "V1")).withColumn("j", F.when(F.col("part") == "J", "J1"))
    longer = extend.extend(reads, extend.kmer_pool(reads, 15), 15)
    known = spark.createDataFrame([("s", "J", "A" * 15, "J1")], "sample_id string, part string, kmer string, region string")
    for df in (longer, extend.impute(reads, known, 15)):
        assert df.count() == 200
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_gap_may_open_inside_the_best_stretch(spark):
    """Three bases are put in near the end, where two more bases of the first diagonal agree: 64 - 3 - 9."""
    ref = "GTTGCGAGAGTTAGCCAGGCGTTATCAGAATCGCAGGGCCGCCCGCGCTACTTCATCTTGTTAT"
    seq = "GTTGCGAGAGTTAGCCAGGCGTTATCAGAATCGCAGGGCGGCCCGCGCTACTTGATCATCTTGTTAT"
    reads = spark.createDataFrame([("s", 1, "a", seq, "I" * len(seq)), ("s", 1, "b", seq[::-1].translate(str.maketrans("ACGT", "TGCA")), "I" * len(seq))], "sample_id string, file_idx int, qname string, seq string, qual string")
    got = align.align(reads, spark.createDataFrame([("G1", ref)], "name string, seq string"), "V").select("as_score", "cigar", "nm").collect()
    assert [tuple(r) for r in got] == [(52, "53M3I11M", 4)] * 2


def test_places_of_a_result_that_several_tasks_read(spark, tmp_path):
    rows = spark.range(3000).select(F.concat(F.lit("A"), F.col("id").cast("string")).alias("AAseq"), (F.col("id") % 40).alias("Frequency"))
    path = io.write_clonotypes(rows, str(tmp_path / "out"), "TRB", "CDR3")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 4
        got = sorted((r["place"], -r["Frequency"], r["AAseq"]) for r in io.read_clonotypes(spark, path, "AAseq string, Frequency long").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [x[0] for x in got] == list(range(3000))
    assert [x[1:] for x in got] == sorted(x[1:] for x in got)


def test_signs_are_compared_without_lambdas(spark):
    pairs = [("ACGT", "AGG"), ("", "A"), (None, "A"), ("é\0", "a\0b"), ("A" * 3_000_000, "C" * 2_000_001), ("NNac", "NXaC")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").select("i", "a", "b", dna.hamming("a", "b").alias("d"), dna.hamming("a", "b", 1).alias("d1"), dna.quality_max("a", "b").alias("q"))
    assert "lambda" not in df._jdf.queryExecution().executedPlan().toString()
    for r in df.collect():
        a, b = r["a"], r["b"]
        if a is None:
            assert (r["d"], r["d1"], r["q"]) == (None, None, None)
            continue
        both = list(zip(a, b, strict=False))
        assert r["d"] == sum(x != y for x, y in both) and r["d1"] == sum(x != y for x, y in both[1:-1])
        assert r["q"] == "".join(max(x) for x in both)


def test_wide_reaches_meet_in_blocks(spark, monkeypatch):
    """Reaches of one length by blocks and by parts, several blocks a side, letters beside the four; no pair is a row of a join."""
    monkeypatch.setattr(correct, "BLOCK", 50)
    draw = random.Random(3)
    made = lambda n, k, letters: sorted({"TGTGCC" + "".join(draw.choice(letters) for _ in range(n - 9)) + "TTC" for _ in range(k)})
    xs = {n: made(n, 120, letters) for n, letters in ((21, "ACGT"), (48, "AACGTNR\u00e9"), (81, "AC"))}
    ys = {n: [(y, 7 if i % 3 else i % 2) for i, y in enumerate(made(n, 70, "ACGT") + x[:9])] for n, x in xs.items()}
    left = spark.createDataFrame([("s", n, x) for n, some in xs.items() for x in some] + [("t", 21, "A" * 21)], "sample_id string, len int, a string")
    right = spark.createDataFrame([("s", n, y, most) for n, some in ys.items() for y, most in some], "sample_id string, len int, b string, most int")
    df = correct.neighbours(left, right)
    apart = lambda x, y: sum(u != v for u, v in zip(x[3:-3], y[3:-3], strict=True))
    got = df.collect()
    assert len(got) == len({(r.a, r.b) for r in got}) > 500
    assert {(r.len, r.a, r.b): r.d for r in got} == {(n, x, y): d for n, some in xs.items() for x in some for y, most in ys[n] if (d := apart(x, y)) <= most}
    wide = correct.neighbours(left.where("len = 21"), right.where("len = 21").drop("most"), 7)
    assert wide.count() > 500 and "bases" not in wide._jdf.queryExecution().optimizedPlan().toString()


def test_equal_ends_are_cut_into_kmers_once(spark):
    seqs = ["ACGTTGCAAGGCTTACGATCAGGT", "TTGACCANGATTACAGGCATCCAGTT", "A" * 30, "ACG"]
    reads = spark.createDataFrame([("s", "V" if i % 2 else "J", seqs[i % 4]) for i in range(400)], "sample_id string, part string, seq string")
    pool = extend.kmer_pool(reads, 5)
    words = Counter(end[i : i + 5] for n in range(4) for end in [seqs[n][:15] if n % 2 == 0 else seqs[n][-15:]] for i in range(len(end) - 4))
    want = {w: 100 * n for w, n in words.items() if set(w) <= set("ACGT") and len(set(w)) > 1}
    assert {r.word: r.n for r in pool.select(dna.unpacked("kmer", 5).alias("word"), "n").collect()} == want
    plan = pool._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Generate") :]  # ends are counted first


def test_seeds_by_table_and_by_search(spark):
    draw = random.Random(4)
    made = lambda n, letters="ACGT": "".join(draw.choice(letters) for _ in range(n))
    refs = sorted((f"V{i}", made(60)) for i in range(5))
    reads = [r[1][a : a + 40] + made(20) for a in range(0, 20, 4) for r in refs] + [made(50, "ACGTN") for _ in range(50)] + ["N" * 12]
    one, other = align.Segments(refs, 10), align.Segments(refs, 10)
    other.slots = lambda words: (at := np.flatnonzero(np.isin(words, other.words)), np.searchsorted(other.words, words[at]))
    assert one.best(reads, 12) == other.best(reads, 12) and len(one.best(reads, 12)) >= 25
    code = align.coded(made(300, "ACGTN"))
    for k in (1, 2, 5, 10, 13, 31):
        text = code.tolist()
        assert align.rolled(code, k).tolist() == [-1 if 4 in text[i : i + k] else sum(c * 4 ** (k - 1 - j) for j, c in enumerate(text[i : i + k])) for i in range(len(text) - k + 1)]


def test_one_python_step_classifies_reads(spark):
    ref, cdr3 = "ACGGTTCA" * 8 + "TATTTCTGCGCC", "GCAGACGAGTTCGGA"
    rows = [("s", 1, str(i), "V1", 1, "76M", ref + cdr3 * (i % 2 + 1), "I" * 200) for i in range(20)] + [("s", 1, "x", "V1", 1, "76M", ref.translate(str.maketrans("ACGT", "CGTA")) + cdr3, "I" * 91)]
    v = spark.createDataFrame(rows, "sample_id string, file_idx int, qname string, rname string, pos int, cigar string, seq string, qual string")
    segments = spark.createDataFrame([("V1", ref)], "name string, seq string")
    told = classify.classify(classify.with_segments(v, segments), classify.with_segments(v.where("false"), segments), MOTIF, spark.sql("SELECT 's' AS sample_id, 15 AS k"))
    got = told.collect()
    assert sorted(int(r.qname) for r in got) == list(range(20)) and {r.part for r in got} == {"V"}
    alone = classify.assign_v(classify.with_segments(v, segments), MOTIF.first_pass())
    plan = alone.where("m.able").select("qname", "m.cdr3")._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ArrowEvalPython") == 1
