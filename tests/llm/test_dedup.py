"""Line dedup, near dedup and sharding against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from clonespark.llm import near_dedup as nd
from clonespark.llm.line_dedup import dedup_lines
from clonespark.llm.sharding import shard

from cases import ODD


def lines_by_brute_force(rows, least):
    docs = sorted(set(rows))
    places, words = [], {}
    for d, t in docs:
        ls = t.split("\n")
        words[d] = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in ls]
        places += [(d, i, ls) for i in range(len(ls))]
    gone = defaultdict(set)
    for n, (d, i, ls) in enumerate(places):
        for e, j, ms in places[:n]:
            k = 0
            while i + k < len(ls) and j + k < len(ms) and ls[i + k] == ms[j + k]:
                k += 1
            if k and sum(words[d][i : i + k]) >= least:
                gone[d].update(range(i, i + k))
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in docs}


@pytest.mark.parametrize("seed,least", [(1, 1), (2, 5), (3, 9)])
def test_lines(spark, table, seed, least):
    draw = random.Random(seed)
    pool = ["", "a", "b c", "d e f", "g h i j", "k l m n o p"]
    rows = [(i, "\n".join(draw.choice(pool) for _ in range(draw.randint(1, 12)))) for i in range(12)]
    got = {r.doc_id: r.text for r in dedup_lines(table(rows), least).collect()}
    assert got == lines_by_brute_force(rows, least)


def test_lines_odd(odd, empty):
    rows = dedup_lines(odd, 3).collect()
    assert len(rows) == len(ODD)
    told = {(r.doc_id, r.text) for r in rows}
    assert {(5, None), (6, ""), (9, "same"), (9, "other"), (None, None)} <= told
    assert dedup_lines(odd, 3).columns[:2] == ["doc_id", "text"] and dedup_lines(empty).count() == 0


def sets_of(rows, width):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        out[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    return out


def copies(seed, n=150):
    draw = random.Random(seed)
    base = [[draw.choice("abcdefghijklmnop") + str(draw.randrange(400)) for _ in range(draw.randint(1, 120))] for _ in range(n // 6)]
    rows = []
    for i in range(n):
        w = list(draw.choice(base))
        for _ in range(draw.choice([0, 0, 1, 2, 4, 7, 12])):
            w[draw.randrange(len(w))] = draw.choice("xyz") + str(draw.randrange(99))
        rows.append((i, draw.choice(["{}", " {}\n", "{}"]).format(" ".join(w).upper() if draw.random() < 0.2 else " ".join(w))))
    return [*rows, (n, ""), (n + 1, None), (n + 2, "  ")]


@pytest.mark.parametrize("seed,width", [(1, 2), (2, 5)])
def test_near(spark, table, seed, width):
    rows = copies(seed)
    sets = sets_of(rows, width)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.near_dedup(table(rows), width).collect()}
    assert got == {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}
    assert len(set(map(find, sets))) < len(sets) - 20


@pytest.mark.parametrize("seed", [3, 4])
def test_near_with_repeated_ids(table, seed):
    """Documents are ids: rows of one id are linked, unless they have no shingles."""
    draw = random.Random(seed)
    rows = [(d // draw.choice([1, 1, 1, 2, 7]), t) for d, t in copies(seed)] + [(3, "a b c"), (90, "a b c"), (90, "d e f"), (90, ""), (91, "d e f"), (None, "a b c")]
    sets = [next(iter(sets_of([row], 2).values())) for row in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, _), s in zip(rows, sets, strict=True):
        for (b, _), t in zip(rows, sets, strict=True):
            if a is not None and b is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = [(d, len(s), None if d is None else find(d) if s else d) for (d, _), s in zip(rows, sets, strict=True)]
    got = nd.near_dedup(table(rows), 2).collect()
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in got)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_large_group_of_near_copies(spark, table):
    draw = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(draw.randint(1, 14)):
            w[draw.randrange(150)] = f"x{draw.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = sets_of(rows, 2)
    root = list(range(400))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(400):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: r.component_id for r in nd.near_dedup(table(rows), 2).collect()}
    assert got == {i: find(i) for i in range(400)} and 1 < len(set(got.values())) < 300


def test_marks_lose_no_row(spark, monkeypatch):
    source = spark.range(3000).selectExpr("id AS doc_id", "cast(id AS string) AS text").unionByName(spark.sql("SELECT cast(null AS long) AS doc_id, 'x' AS text"))
    ids = spark.range(0, 3000, 37).selectExpr("id AS doc_id")
    assert {r.doc_id for r in nd.marked(source, ids).collect()} == set(range(0, 3000, 37))
    monkeypatch.setattr(nd, "MARKS", 2)  # full: others come too, none is lost
    got = nd.marked(source, ids)
    assert got.columns == source.columns and set(range(0, 3000, 37)) < {r.doc_id for r in got.collect()}


def test_signature_agrees_with_similarity():
    draw = np.random.default_rng(1)
    a = draw.integers(0, 2**63, 300).astype(np.uint64)
    for share in (0.5, 0.8):
        k = int(300 * 2 * share / (1 + share))
        b = np.concatenate([a[:k], draw.integers(0, 2**63, 300 - k).astype(np.uint64)])
        x = nd.super_minhash([np.unique(a), np.unique(b)])
        assert abs((x[0] == x[1]).mean() - share) < 0.13
    small = nd.super_minhash([a[:1], a[:3], np.zeros(0, np.uint64)])
    assert (small[:2] < 2**64 - 1).all() and (small[2] == 2**64 - 1).all()


def test_near_odd(odd, empty):
    rows = nd.near_dedup(odd, 2).collect()
    assert len(rows) == len(ODD)
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert {r.n_shingles for r in rows if r.doc_id in (5, 6, 7)} == {0} and {r.n_shingles for r in rows if r.doc_id == 11} == {1}
    assert nd.near_dedup(empty).count() == 0


@pytest.mark.parametrize("limit", [40, 200, 5000])
def test_shards(table, limit):
    draw = random.Random(limit)
    rows = [(i, "x" * draw.randint(0, 30)) for i in range(300)] + [(7, "y" * 10)] * 40 + [(None, "z" * 9)] * 30 + [(1000, "w" * (limit + 5))]
    out = shard(table(rows), limit).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in out) == Counter((d, len(t)) for d, t in rows)
    size, count = defaultdict(int), Counter()
    for r in out:
        size[r.shard, r.page] += r.n_bytes
        count[r.shard, r.page] += 1
    assert all(s <= limit or count[k] == 1 for k, s in size.items())
    # a bucket was split only because its parent was too large
    inner = [r for r in out if r.n_bytes <= limit]
    for prefix, depth in {(r.shard, r.depth) for r in inner if 0 < r.depth < 60}:
        assert len(prefix) == depth and sum(r.n_bytes for r in inner if r.shard.startswith(prefix[:-1])) > limit


def test_shards_odd(odd, empty):
    assert shard(odd, 1000).count() == len(ODD) and shard(empty, 10).count() == 0
