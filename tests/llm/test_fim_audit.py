"""Fill-in-middle and the filter audit against plain restatements."""

import hashlib
import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from clonespark.llm import fim
from clonespark.llm.filter_audit import audit, words_of
from clonespark.llm.fim import fill_in_middle, restored

from cases import ODD


def plainly(doc_id, text):
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    t = text or ""
    n = len(t)
    if not n or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = t[:a], t[a:b], t[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def texts(seed, n):
    draw = random.Random(seed)
    pool = ["a", "<", "P", ">", "<P", "S>", "M", "é", "日", "😀", "\n", "\0", "<<P", "<M>"]
    for i in range(n):
        weights = [8] * (len(pool) - 1) + [draw.choice([0, 0, 0, 1])]
        yield i, "".join(draw.choices(pool, weights, k=draw.choice([0, 1, 2, 5, 40, 127, 128, 129, 700])))


def test_forms(spark, table):
    rows = [*texts(1, 400), *ODD]
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in fill_in_middle(table(rows)).withColumn("back", restored()).collect())
    assert got == Counter((d, *plainly(d, t), t or "") for d, t in rows)
    assert {form for _, _, form, *_ in got} == {"plain", "psm", "spm"}


def test_every_state_at_every_piece_border():
    # the automaton's pieces start from three bytes: shift all texts by 0..3 bytes over the borders
    for text in ("😀" * 200, "日" * 200, "é" * 200, "<P>" * 100, "<<P" * 100, "<" + "P>" * 100):
        for shift in range(5):
            t = ("x" * shift + text).encode()
            seen = fim.scan(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
            s = t.decode()
            assert (seen.units[0], seen.sentinels[0]) == (len(s), sum(s.count(x) for x in ("<P>", "<S>", "<M>")))
            units = np.arange(len(s) + 1)
            found = fim.cuts(np.frombuffer(t, np.uint8), np.array([0, len(t)]), seen, np.zeros(len(units), int), units)
            assert found.tolist() == [len(s[:u].encode()) for u in units]


def test_fim_columns_and_empty(spark, table, empty):
    clash = table([(1, "abc")], extra=False).selectExpr("doc_id", "text", "1 AS N", "2 AS Form", "3 AS keys", "4 AS other")
    out = fill_in_middle(clash)
    assert out.columns == ["doc_id", "text", "keys", "other", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert out.first().keys == 3 and out.first().n == 3
    assert fill_in_middle(empty).count() == 0
    with pytest.raises(ValueError):
        fill_in_middle(table([(1, "a")], extra=False).withColumnRenamed("text", "output"), text_col="output")


def fates(rows, labels):
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    out = Counter()
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, x in labels if x == 1} - {None}
    parts = {p or "" for _, _, p in rows}
    for d, text, part in rows:
        t, part = text or "", part or ""
        w = t.encode().split()
        fails = {f for f, bad in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in t for c in "#$%&*|"), d is not None and first[t] < d), strict=True) if bad}
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                now = f in fails and not gone
                out[part, order, step, "redundant"] += f in fails and gone
                out[part, order, step, "unique_fails"] += fails == {f}
                gone |= now
                out[part, order, step, "removed"] += now
                out[part, order, step, "kept"] += not gone
                out[part, order, step, "good_lost"] += now and d in good
                out[part, order, step, "toxic_lost"] += now and d in toxic
                out[part, f, "shapley"] += now
    return parts, out


def test_audit(spark, table):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    pool = [" ".join(draw.choices(words[: draw.choice([5, 90, 400])], k=draw.choice([3, 150, 199, 200, 260]))) + draw.choice(["", " A#B", " " + "CAPS" * 30]) for _ in range(12)]
    rows = [(draw.choice([None, draw.randrange(60)]) if i % 5 == 0 else i, draw.choice([*pool, None, ""]), draw.choice(["en", "de", None])) for i in range(150)] + [(d, t, "odd") for d, t in ODD]
    labels = [(i, draw.randrange(2), draw.randrange(2)) for i in range(0, 150, 2)] + [(None, 1, 1), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("mask", F.lit("x")).withColumn("ID", F.lit(1))
    got = audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    parts, want = fates(rows, labels)
    assert len(got) == 600 * len(parts) == len({(r.part, r.filter_order, r.step) for r in got})
    for r in got:
        for name in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"):
            assert r[name] == want[r.part, r.filter_order, r.step, name], (r, name)
        assert r.shapley == want[r.part, r.filter_order[r.step - 1], "shapley"]


def test_audit_of_nothing(spark, empty):
    assert audit(empty.withColumn("lang", F.lit("en")), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_words_in_pieces(monkeypatch):
    from clonespark.llm import filter_audit

    monkeypatch.setattr(filter_audit, "PIECE", 7)
    draw = random.Random(5)
    for _ in range(300):
        b = "".join(draw.choices(["a", "bb", " ", "\n", "\x0b", "é", " ", "long" * 5], k=draw.randrange(60))).encode()
        assert words_of(b) == (len(b.split()), len(set(b.split())))
