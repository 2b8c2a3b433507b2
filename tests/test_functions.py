"""Column functions against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from clonespark.functions import dna, motif
from clonespark.operators import search
from clonespark.plans.catalogue import Catalogue

DRAW = random.Random(3)
SEQS = ["", "A", "AC", "ACG", "TAATAGTGA", "ACGNNNACG", *("".join(DRAW.choice("ACGT") for _ in range(DRAW.randint(1, 90))) for _ in range(60))]
TRB = motif.Motif("(LR|YF|YI|YL|YQ|YR)C(A|S|T|V|G|R|P|D)", "[FTYH]{1}FG[ADENPQS]{1}G", 2, 1, "(CAS|CSA|CAW|CAT|CSV|CAI|CAR)", "(QYF|LFF)")


def protein(seq, frame=1):
    return "".join(dna.CODONS.get(seq[i : i + 3], "X") for i in range(frame - 1, len(seq) - 2, 3))


def located(peptide, m):
    """The rule, restated: right to left over C, first accepted F, later ones overwrite."""
    cs = [x.start() + 1 + m.coffset for x in re.finditer(m.cmotif, peptide)]
    if m.mirrored is not None:
        cs = sorted(len(peptide) - x.start() - m.mirrored for x in re.finditer(m.cmotif, peptide[::-1]))
    fs = [x.start() + 1 + m.foffset for x in re.finditer(m.fmotif, peptide)]
    status, span = 0, None
    if (not cs) != (not fs):
        status = 2
        if not cs:
            cs = [x.start() + 1 for x in re.finditer(m.inner_c, peptide)]
        else:
            fs = [x.start() + 3 for x in re.finditer(m.inner_f, peptide)]
    backwards = cs[::-1]
    for i, xc in enumerate(backwards):
        for xf in fs:
            if 6 <= xf - xc <= 34 and (i == len(backwards) - 1 or not 7 <= xf - backwards[i + 1] <= 35) and "*" not in peptide[xc - 1 : xf]:
                status, span = 3, (xc, xf)
                break
    return status, span


def peptides():
    parts = ["YFCA", "CAS", "FFGEG", "QYF", "LRCS", "A", "G", "*", "K", "DDDDD", "EEEEEE"]
    return ["".join(DRAW.choice(parts) for _ in range(DRAW.randint(0, 14))) for _ in range(400)]


def test_sequences(spark):
    df = spark.createDataFrame([(s, s[::-1]) for s in SEQS] + [(None, None)], "s string, r string")
    rows = df.select(
        "s", "r", dna.translate("s").alias("t1"), dna.translate("s", 2).alias("t2"), dna.translate("s", 3).alias("t3"), dna.reverse_complement("s").alias("rc"),
        dna.kmers("s", 5).alias("k"), dna.hamming("s", "r", 3).alias("h"), dna.phred_errors("s").alias("e"), dna.quality_max("s", "r").alias("q"),
    ).collect()
    for x in rows:
        if x.s is None:
            assert x.t1 is None and x.h is None
            continue
        assert (x.t1, x.t2, x.t3) == (protein(x.s), protein(x.s, 2), protein(x.s, 3))
        assert x.rc == x.s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
        assert x.k == [x.s[i : i + 5] for i in range(len(x.s) - 4)]
        assert x.h == sum(a != b for a, b in list(zip(x.s, x.r, strict=True))[3 : max(3, len(x.s) - 3)])
        assert x.e == pytest.approx(sum(10 ** (-(ord(c) - 33) / 10) for c in x.s))
        assert x.q == "".join(map(max, x.s, x.r))


def test_hamming_by_numbers_and_by_signs(spark):
    draw = random.Random(8)
    pool = {"plain": "ACGT", "iupac": "ACGTNRYSWKMBDHV-", "other": "ACGTacgt.*é"}
    pairs = [(None, "A"), ("A", None), ("", ""), ("A", "C")]
    for letters in pool.values():
        for n in (1, 6, 7, 14, 15, 16, 30, 31, 45, 200):
            a = "".join(draw.choice(letters) for _ in range(n))
            pairs.append((a, "".join(c if draw.random() < 0.7 else draw.choice(letters) for c in a) + "A" * draw.randint(0, 3)))
    for skip in (0, 3):
        for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", dna.hamming("a", "b", skip).alias("d")).collect():
            both = None if r.a is None or r.b is None else list(zip(r.a, r.b, strict=False))
            assert r.d == (None if both is None else sum(x != y for x, y in both[skip : max(skip, len(both) - skip)])), r


@pytest.mark.parametrize("cigar,span", [("119S28M3S", (120, 147)), ("30M", (1, 30)), ("5S10M2I3M", (6, 15)), ("10S", None), ("", None)])
def test_cigar(spark, cigar, span):
    x = spark.createDataFrame([(cigar,)], "c string").select(dna.cigar_span("c").alias("x")).first().x
    assert (x and (x.start, x.stop)) == span


def test_locate_three_ways(spark):
    rows = spark.createDataFrame([(p,) for p in peptides()], "p string").select("p", motif.locate("p", TRB).alias("x")).collect()
    seen = set()
    for r in rows:
        status, span = located(r.p, TRB)
        assert r.x.status == status and (status != 3 or (r.x.start, r.x.stop) == span), r.p
        assert search.locate(r.p, TRB) == (status, *(span or (0, 0)))
        seen.add(status)
    assert seen == {0, 2, 3}


def test_mirrored_anchor(spark):
    """A pattern written from right to left: MYLCA in the peptide is AC(LYM) in the catalogue."""
    draw = random.Random(9)
    mouse = Catalogue().lookup("ms", "TRB").motif
    parts = ["MYLCA", "VYFCG", "YMCS", "LYC", "SFGAG", "TFGSG", "K", "A", "G", "*", "DDDDD", "EEEEEE", "VHLCT", "ACLYM"]
    peptides = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 14))) for _ in range(400)]
    rows = spark.createDataFrame([(p,) for p in peptides], "p string").select("p", motif.locate("p", mouse.first_pass()).alias("x"), motif.c_starts("p", mouse).alias("c")).collect()
    seen = set()
    for r in rows:
        status, span = located(r.p, mouse.first_pass())
        assert r.x.status == status and (status != 3 or (r.x.start, r.x.stop) == span), r.p
        assert search.locate(r.p, mouse.first_pass()) == (status, *(span or (0, 0)))
        assert all(r.p[c - 1] == "C" for c in r.c) and r.c == sorted(r.c)
        seen.add(status)
    assert seen == {0, 2, 3}
    planted = "TTGGAAGACATGTACCTCTGCGCCAGCAGCCAAGATAGTTCAGGTCAGAACACCTCCTTCGGGGCCGGGACC"  # LEDMYLCASSQDSSGQNTSFGAG
    assert search.find([planted], [None], mouse.first_pass())[0][0] == "TGCGCCAGCAGCCAAGATAGTTCAGGTCAGAACACCTCCTTC"
    assert search.find([planted], [None], mouse.forward())[0][0] is None
    # from the right: of two matches that overlap there, the right one counts
    twice = motif.Motif("CAC", "F", 0, 0, mirrored=0)
    assert search._anchors(["ACACACA"], twice)[0] == {0: [6]} and search._anchors(["ACACAC"], twice.forward())[0] == {0: [2]}


@pytest.mark.parametrize("gap,found", [(5, False), (6, True), (34, True), (35, False)])
def test_anchor_distance(gap, found):
    # C is the second residue after the start of YFCA, F the first of FFGEG's match plus one
    peptide = "YFCA" + "K" * (gap - 3) + "FFGEG"
    assert (search.locate(peptide, TRB)[0] == 3) is found


def test_find_cdr3_column_equals_udf(spark):
    seqs = ["A" * DRAW.randint(0, 2) + "TATTTCTGCGCC" + "".join(DRAW.choice(["GCA", "TGC", "TAA", "GAC"]) for _ in range(DRAW.randint(0, 9))) + "TTCTTCGGCGAAGGC" for _ in range(60)] + ["", None]
    df = spark.createDataFrame([(s, None if s is None else "I" * (len(s) // 2)) for s in seqs], "s string, q string")
    rows = df.select(motif.find_cdr3("s", "q", TRB).alias("a"), search.find_cdr3("s", "q", TRB).alias("b")).collect()
    assert all((r.a.cdr3, r.a.qual, r.a.able or None) == (r.b.cdr3, r.b.qual, r.b.able or None) for r in rows)
    assert any(r.a.cdr3 for r in rows)


@pytest.mark.parametrize("cmotif", ["YFC[A-Z]", "YFC[^P]", "(YF|FC)C?A", "YFC(?=A)."])
def test_batches_are_searched_as_single_reads(cmotif):
    """Patterns that may match a line's end are searched peptide by peptide."""
    m = motif.Motif(cmotif, TRB.fmotif, 2, 1, TRB.inner_c, "LFF")
    seqs = ["".join(DRAW.choice(["TATTTCTGC", "GCC", "CCA", "TTCTTCGGCGAAGGC", "CTG", "A"]) for _ in range(DRAW.randint(0, 14))) for _ in range(300)] + [None, "", "TATTTCTGC"]
    found = search.find(seqs, [None] * len(seqs), m)
    assert found == [search.find([s], [None], m)[0] for s in seqs] and sum(bool(x[0]) for x in found) > 5
    joined = search.residues([s or "" for s in seqs])
    at = 0
    for s, x in zip(seqs, found, strict=True):
        if s:
            assert x[2] == any(search.locate(joined[at + f : max(at, at + len(s) - 2) : 3], m)[0] > 0 for f in range(3)) or x[0]
            at += len(s)


def test_thresholds(spark):
    p, n, k = 0.0031, 33, 5
    x = spark.range(1).select(
        dna.largest_parent(F.lit(p), F.lit(n), F.lit(200)).alias("m"), dna.expected_copies(F.lit(p), F.lit(n), F.lit(500), k).alias("e"),
        dna.share_of(F.lit(50.0), F.lit(99)).alias("s"), dna.share_of(F.lit(0.5), F.lit(99)).alias("z"), dna.largest_parent(F.lit(0.0), F.lit(n), F.lit(7)).alias("zero"),
    ).first()
    from math import comb, sqrt

    q = (1 - p) ** n
    assert x.m == pytest.approx(((3 * sqrt(p * (1 - p)) + sqrt(9 * p * (1 - p) + 4 * q * 200)) / (2 * q)) ** 2)
    ps = comb(n, k) * p**k * (1 - p) ** (n - k)
    assert x.e == pytest.approx(500 * ps + 3 * sqrt(500 * ps * (1 - ps)))
    assert x.s == pytest.approx(max(50 / 99 + 3.291 * sqrt(50 / 99 * (1 - 1 / 99)), 1)) and x.z == 0 and x.zero == pytest.approx(7)
