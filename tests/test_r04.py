"""Findings of the fourth round."""

import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clonespark.functions import dna
from clonespark.llm import suffix_dedup as sd
from clonespark.llm import topk
from clonespark.operators import extend
from clonespark.plans import queries


@pytest.mark.parametrize("name", ["assign_segments", "classify_reads"])
def test_inserts_that_agree_with_a_segment_by_chance(spark, tmp_path, name):
    """Inserts of the first three users agree with a V segment at a score of 12, that of the fourth with a J segment."""
    users = (501, 509, 1235, 1941, 7, 8)
    rows = [(4 * (len(users) * n + i) + kind, user) for n in range(3) for i, user in enumerate(users) for kind in range(4)]
    spark.createDataFrame(rows, "event_id long, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, str(tmp_path))
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("kinds", [1, 3, 5000])
def test_queries_meet_rows_by_part_and_block(spark, monkeypatch, kinds):
    """Many rows as good as others, several shards a part; queries are sent once for each part, not for each shard."""
    monkeypatch.setattr(topk, "TOGETHER", 7)
    monkeypatch.setattr(topk, "CROWD", 2)
    draw = np.random.default_rng(kinds)
    vectors = draw.normal(size=(kinds, 40))[np.arange(3000) % kinds] if kinds < 3000 else draw.normal(size=(3000, 40))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    df = spark.createDataFrame([((i * 7919) % 3000, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    out = topk.top_k(df, F.col("vec_id") % 50 == 0, rows_in_shard=150, queries_in_block=8)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out.collect())
    by_id = np.floor(vectors * 256).astype(np.int64)[np.argsort([(i * 7919) % 3000 for i in range(3000)])]
    want = []
    for q in range(0, 3000, 50):
        scores = by_id @ by_id[q]
        order = [i for i in np.argsort(-scores, kind="stable").tolist() if i != q][:5]
        want += [(q, n + 1, i, int(scores[i])) for n, i in enumerate(order)]
    assert got == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "collect_list" not in plan


def test_only_segments_that_share_windows_are_indexed(monkeypatch):
    """Copies of a segment are marked without an index; parts of segments, and what has copies too, by it."""
    draw = np.random.default_rng(5)
    seen = []

    class Index(sd.RunLengthIndex):
        def __init__(self, rows, sizes, ids, length):
            seen.append(len(rows))
            super().__init__(rows, sizes, ids, length)

    monkeypatch.setattr(sd, "RunLengthIndex", Index)
    alone = [draw.integers(0, 255, draw.integers(50, 70), np.uint8).tobytes() for _ in range(300)]
    whole = [draw.integers(0, 255, 70, np.uint8).tobytes() for _ in range(20)]
    parts = [w[5:60] for w in whole] + [b"a" * 60, b"a" * 55]
    blocks = [[(i, t) for i, t in enumerate(alone)] + [(900 + i, w) for i, w in enumerate(whole)], [(300 - i, t) for i, t in enumerate(alone)] + [(890 + 2 * i, p) for i, p in enumerate(parts)]]
    sent = [sd.squeezed(np.array([len(t) for _, t in b], np.uint32), np.array([i for i, _ in b], np.int64), np.frombuffer(b"".join(t for _, t in b), np.uint8)) for b in blocks]
    told = sd._judged(pa.table([[7, 7], [0, 1], pa.array([0, 0], pa.int32()), [len(b) for b in blocks], pa.array(sent, pa.binary())], schema=sd._SENT_TYPES), 50)
    least = {}
    for i, t in blocks[0] + blocks[1]:
        for at in range(len(t) - 49):
            least[t[at : at + 50]] = min(i, least.get(t[at : at + 50], i))
    for b, data in zip(blocks, told["data"].to_pylist(), strict=True):
        held = sd.stretched(data)
        want = [least[t[at : at + 50]] < i for i, t in b for at in range(len(t) - 49)]
        assert np.unpackbits(held[4 * len(b) :], count=len(want)).astype(bool).tolist() == want
    assert seen == [42]


@pytest.mark.parametrize("k", [2, 15, 23, 28, 32])
def test_neighbours_of_kmers_without_a_join(spark, k):
    """The pool of ends of any length, with other letters too, and both tables of successors against a restatement."""
    draw = random.Random(k)
    made = lambda n, letters="ACGT": "".join(draw.choice(letters) for _ in range(n))
    cores = [made(60) for _ in range(6)] + ["T" * 50, "A" * 20 + made(30), made(k), made(k - 1)]
    seqs = [c[a : a + draw.randint(k, 45)] + made(draw.randint(0, 3), "ACGTN") for c in cores for a in range(0, 30, 3)] + [made(k + 8, "AC") for _ in range(20)] + ["ACGTN" * 9]
    reads = [(f"s{i % 2}", "J" if i % 3 == 0 else "V", s) for i, s in enumerate(seqs)]
    pool = extend.kmer_pool(spark.createDataFrame(reads, "sample_id string, part string, seq string"), k, "G")
    want = Counter()
    for sample, part, seq in reads:
        end = seq[: k + 10] if part == "J" else seq[-k - 10 :]
        want.update((sample, w) for i in range(len(end) - k + 1) if set(w := end[i : i + k]) <= set("ACGT") and w != "G" * k)
    assert {(r.sample_id, r.word): r.n for r in pool.select("sample_id", dna.unpacked("kmer", k).alias("word"), "n").collect()} == want
    for right in (True, False):
        told = {}
        for (sample, w), n in want.items():
            near = [(-want[sample, x], b) for b in "ACGT" if (x := w[1:] + b if right else b + w[:-1]) != w and (sample, x) in want and max(n, want[sample, x]) <= 10 * min(n, want[sample, x])]
            if near:
                told[sample, w] = (w[1:] + min(near)[1] if right else min(near)[1] + w[:-1], "ACGT".index(min(near)[1]))
        succ = extend.successors(pool, k, right)
        got = succ.select("sample_id", dna.unpacked("kmer", k).alias("a"), dna.unpacked("next", k).alias("b"), "base").collect()
        assert len(got) == len(told) and {(r.sample_id, r.a): (r.b, r.base) for r in got} == told
        assert "Join" not in succ._jdf.queryExecution().optimizedPlan().toString()
