"""Suffix-array dedup: the index against its definition, the operator against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clonespark.llm import suffix_dedup as sd
from clonespark.llm.suffix_dedup import dedup_substrings

from cases import ODD


def by_brute_force(rows, length):
    least = {}
    for d, t in rows:
        b, d = (t or "").encode(), -1 if d is None else d
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            least[w] = min(d, least.get(w, d))
    out = []
    for d, t in rows:
        b, e = (t or "").encode(), -1 if d is None else d
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if least[b[i : i + length]] < e:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d if d is None or d >= 0 else None, t, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return Counter(out)


def held_against(df, rows, length):
    got = Counter((r.doc_id, r.text, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in dedup_substrings(df, length).collect())
    assert got == by_brute_force(rows, length)


def repetitive(seed, n, letters="ab", passage=30):
    draw = random.Random(seed)
    pool = ["".join(draw.choices(letters, k=draw.randint(5, passage))) for _ in range(12)]
    return [(i, "".join(draw.choice(pool) if draw.random() < 0.6 else draw.choice("abcdé") for _ in range(draw.randrange(25)))) for i in range(n)]


@pytest.mark.parametrize("seed,length,letters", [(1, 8, "ab"), (2, 13, "abc"), (3, 21, "a"), (4, 50, "abcdefgh")])
def test_repetitive(spark, table, seed, length, letters):
    rows = repetitive(seed, 60, letters, 90 if length == 50 else 30)
    random.Random(seed).shuffle(rows)
    held_against(table(rows), rows, length)


def test_crowded_anchors_go_by_window(spark, table, monkeypatch):
    monkeypatch.setattr(sd, "CROWD", 2)
    rows = repetitive(9, 50) + [(100 + i, "the same passage of many words, in every text" + "xyz"[i % 3] * i) for i in range(20)]
    held_against(table(rows), rows, 12)


def test_odd_rows(spark, odd, empty):
    assert dedup_substrings(empty).count() == 0
    got = {(r.doc_id, r.text): r for r in dedup_substrings(odd.where("coalesce(length(text), 0) < 1000")).collect()}
    want = by_brute_force([r for r in ODD if len(r[1] or "") < 1000], 50)
    assert {k: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for k, r in got.items()} == {k[:2]: k[2:] for k in want}
    long_ = {r.doc_id: (r.n_bytes, r.n_removed) for r in dedup_substrings(odd.unionByName(odd.where("doc_id > 10").withColumn("doc_id", F.col("doc_id") + 10))).collect()}
    assert long_[11] == (300_000, 0) and long_[21] == (300_000, 300_000) and long_[12] == (300_000, 0) and long_[22] == (300_000, 300_000)


def test_columns_and_ids(spark, table):
    text = "exactly the same words, long enough for a window of fifty bytes"
    clash = table([(3, text), (3, text + "!"), (1, text), (2, text)], extra=False).selectExpr("doc_id", "text", "1 AS N_Bytes", "2 AS KEPT", "3 AS __block", "4 AS __seq", "5 AS block")
    out = dedup_substrings(clash)
    assert out.columns == ["doc_id", "text", "__block", "__seq", "block", "n_bytes", "n_removed", "n_spans", "kept"]
    assert {(r.doc_id, r.n_removed, r["__seq"]) for r in out.collect()} == {(1, 0, 4), (2, len(text), 4), (3, len(text), 4)}
    with pytest.raises(ValueError):
        dedup_substrings(clash, 7)


def strings(seed, n, letters, width):
    draw = random.Random(seed)
    return ["".join(draw.choices(letters, k=draw.randint(9, width - 2))).encode() for _ in range(n)]


@pytest.mark.parametrize("seed,letters", [(1, "ab"), (2, "abcdefghij"), (3, "a")])
def test_index_and_matching_statistics(seed, letters):
    width, length = 32, 9
    texts = sorted(strings(seed, 40, letters, width), key=len, reverse=True)
    rows = np.zeros((len(texts), width), np.uint8)
    for i, t in enumerate(texts):
        rows[i, : len(t)] = np.frombuffer(t, np.uint8) + 1
    sizes, ids = np.array([len(t) for t in texts]), np.array([random.Random(seed).randrange(20) for _ in texts])
    index = sd.RunLengthIndex(rows, sizes, ids, length)
    # the transform by definition: suffixes in order, ties by text
    suffixes = sorted((t[p:], i, p) for i, t in enumerate(texts) for p in range(len(t) + 1))
    told = np.repeat(index.heads, np.diff(np.append(index.starts, len(suffixes))))
    assert told.tolist() == [texts[i][p - 1] + 1 if p else 0 for _, i, p in suffixes]
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    assert index.first_place.tolist() == [first[suffixes[j][1]] + suffixes[j][2] for j in index.starts]
    # statistics of other texts than those of the index
    others = sorted([*strings(seed + 7, 20, letters + "z", width), *(t[2:20] for t in texts[:5])], key=len, reverse=True)
    q = np.zeros((len(others), width), np.uint8)
    for i, t in enumerate(others):
        q[i, : len(t)] = np.frombuffer(t, np.uint8) + 1
    seen = 0
    for m, column, long_, row in index.stream(q, np.array([len(t) for t in others])):
        for i in range(m):
            rest = others[i][column[i] :]
            best = next(n for n in range(len(rest), -1, -1) if any(rest[:n] in t for t in texts))
            assert long_[i] == best
            if best >= length:
                assert suffixes[row[i]][0].startswith(rest[:best])
                want = min(ids[j] for s, j, _ in suffixes if s[:length] == rest[:length])
                assert index.least[np.searchsorted(index.intervals, row[i], side="right") - 1] == want
                seen += 1
    assert seen


def test_segments_hold_every_window_once():
    texts = [b"", b"short", b"x" * 200, bytes(random.Random(1).choices(range(97, 101), k=70_000)), b"y" * 50]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    seg = sd.segments_of(data, at, 50)
    windows = np.repeat(seg.starts, seg.windows) + sd._upto(seg.windows)
    assert windows.tolist() == [i for a, b in zip(at, at[1:], strict=False) for i in range(a, b - 49)]
    assert seg.windows.max() <= 50 - sd.anchor_length(50) + 1
    assert (at[seg.docs] <= seg.starts).all() and (seg.starts + seg.windows + 49 <= at[seg.docs + 1]).all()
    # equal windows have equal hashes wherever they stand
    by_text = {}
    for h, s, n in zip(seg.hashes.tolist(), seg.starts.tolist(), seg.windows.tolist(), strict=True):
        for i in range(s, s + n):
            assert by_text.setdefault(data[i : i + 50].tobytes(), h) == h
