"""Error correction against a plain restatement."""

import random
from collections import defaultdict
from math import comb, floor, log, prod, sqrt

import numpy as np

from clonespark.operators import correct


def restated(cells, p, single_cell=False):
    """cells: (cdr3, qual); returns {cdr3: (status, root)}."""
    out = {}
    lengths = defaultdict(lambda: defaultdict(list))
    for c, q in cells:
        if 21 <= len(c) <= 105:
            lengths[len(c)][c].append(q)

    def parent(n, length):
        q = (1 - p) ** length
        return ((3 * sqrt(p * (1 - p)) + sqrt(9 * p * (1 - p) + 4 * q * n)) / (2 * q)) ** 2

    def copies(n, length, x, a=3.0):
        ps = comb(length, x) * p**x * (1 - p) ** (length - x)
        return ps * n + a * sqrt(n * ps * (1 - ps))

    def share(n, ways):
        return 0.0 if n < 1 else max(n / ways + 3.291 * sqrt(n / ways * (1 - 1 / ways)), 1.0)

    for length, group in lengths.items():
        n = length - 6
        uniq = {c: ("".join(map(max, *qs)) if len(qs) > 1 else qs[0], len(qs)) for c, qs in group.items()}
        top = floor(share(copies(floor(parent(max(x[1] for x in uniq.values()), n)), n, 1), 3 * n))
        if single_cell:
            out |= {c: ("kept", None) for c, (_, k) in uniq.items() if k > top}
            continue
        low = share(copies(floor(parent(top, n)), n, 1), 3 * n)
        roots = {c: k for c, (_, k) in uniq.items() if k >= top}
        leaves = {c: k for c, (_, k) in uniq.items() if low < k < top}
        maybe = {c: k for c, (_, k) in uniq.items() if k <= low}
        if not roots:
            out |= {c: ("leaf", None) for c in leaves}
            continue
        dist = lambda a, b: sum(x != y for x, y in zip(a[3:-3], b[3:-3], strict=True))
        up = {r: [share(copies(floor(parent(k, n)), n, x, 3.291), n * 3**x) for x in range(1, 8)] for r, k in roots.items()}
        trees = defaultdict(list)
        res = {}
        for c, k in leaves.items():
            near = [r for r in roots if dist(c, r) <= 1 + min(range(7), key=lambda i: (abs(up[r][i] - k), i))]
            if not near:
                res[c] = ("leaf", None)
            elif len(near) == 1:
                trees[near[0]].append(c)
        for c, k in maybe.items():
            if sum(10 ** (-(ord(s) - 33) / 10) for s in uniq[c][0]) < 1 and not any(dist(c, x) <= 3 for x in {**leaves, **roots}):
                res.setdefault(c, ("rescued", None))
        for r, own in trees.items():
            table = defaultdict(float)
            for c in own:
                for i in range(3, length - 3):
                    table[c[i], i] += log(10 ** (-(ord(uniq[c][0][i]) - 33) / 10))
            rest = floor(parent(roots[r], n)) - roots[r]
            for c in sorted(own, key=lambda c: (-uniq[c][1] * prod(table[c[i], i] for i in range(3, length - 3)), -uniq[c][1], c)):
                if uniq[c][1] <= rest:
                    rest -= uniq[c][1]
                    res[c] = ("absorbed", r)
                else:
                    res[c] = ("leaf", None)
        for c in roots:
            if res.get(c, ("",))[0] != "absorbed":
                res[c] = ("root", None)
        out |= res
    return out


def cells(seed, p=0.03):
    draw = random.Random(seed)
    out = []
    for length in (24, 30, 36):
        bases = ["".join(draw.choice("ACGT") for _ in range(length)) for _ in range(4)]
        for b, n in zip(bases, (400, 150, 30, 3), strict=True):
            for _ in range(n):
                s = list(b)
                for _ in range(draw.choice([0, 0, 0, 1, 1, 2])):
                    i = draw.randrange(length)
                    s[i] = draw.choice("ACGT")
                out.append(("".join(s), "".join(draw.choice("5?DI") for _ in range(length))))
    out += [("ACGT", "IIII"), ("A" * 120, "I" * 120)]
    return out


def check(spark, seed, p, single=False):
    rows = cells(seed)
    df = spark.createDataFrame([("s", c, q) for c, q in rows], "sample_id string, cdr3 string, cdr3_qual string")
    rates = spark.createDataFrame([("s", p)], "sample_id string, error_rate double")
    got = {r.cdr3: (r.status, r.root) for r in correct.correct(correct.unique_cdr3(df), rates, single).collect()}
    want = restated(rows, p, single)
    assert got == want
    return {s for s, _ in want.values()}


def test_correction(spark):
    assert check(spark, 1, 0.01) | check(spark, 2, 0.03) >= {"root", "absorbed"}


def test_no_errors_keeps_all(spark):
    assert check(spark, 3, 0.0) == {"root"}


def test_single_cell(spark):
    assert check(spark, 4, 0.02, True) == {"kept"}


def test_neighbours_of_many_cdr3s_that_share_both_ends(spark):
    """20,000 leaves and 300 roots of one length, with reaches of 1 to 7."""
    draw = np.random.default_rng(5)
    letters, n = np.frombuffer(b"ACGT", np.uint8), 36
    ends = np.frombuffer(b"TGTGCCAGCAGCTTTGGCGAACAGTACTTC", np.uint8)

    def join(middle):
        return [bytes(np.concatenate([ends[:15], letters[m], ends[15:]])[:n]).decode() for m in middle]

    roots = draw.integers(0, 4, (300, 12))
    leaves = roots[draw.integers(0, 300, 20_000)].copy()
    for _ in range(3):
        at = draw.integers(0, 12, len(leaves))
        leaves[np.arange(len(leaves)), at] = draw.integers(0, 4, len(leaves))
    a, b = sorted(set(join(leaves))), sorted(set(join(roots)))
    most = {x: 1 + i % 7 for i, x in enumerate(b)}
    left = spark.createDataFrame([("s", n, x) for x in a], "sample_id string, len int, a string")
    right = spark.createDataFrame([("s", n, x, most[x]) for x in b], "sample_id string, len int, b string, most int")
    got = {(r.a, r.b): r.d for r in correct.neighbours(left, right).collect()}
    x, y = (np.array([list(s[3:-3].encode()) for s in side], np.uint8) for side in (a, b))
    d = (x[:, None] != y).sum(2)
    i, j = np.nonzero(d <= np.array([most[s] for s in b]))
    assert got == {(a[p], b[q]): int(d[p, q]) for p, q in zip(i, j, strict=True)} and len(got) > 20_000


def test_letters_beside_the_four(spark):
    rows = [("s", 30, "ACGTN" * 6), ("s", 30, "ACGTR" * 6), ("s", 30, "ACGTY" * 6)]
    df = spark.createDataFrame(rows, "sample_id string, len int, a string")
    got = {(r.a[4], r.b[4]): r.d for r in correct.neighbours(df, df.withColumnRenamed("a", "b"), 5).collect()}
    assert got == {(c, e): 0 if c == e else 5 for c in "NRY" for e in "NRY"}
