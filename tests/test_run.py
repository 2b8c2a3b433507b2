"""Sources, alignment, extension, annotation and whole runs."""

import gzip
import json
import os
import random
import re
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clonespark import staging
from clonespark.cli import main, parser
from clonespark.functions import dna
from clonespark.operators import align, annotate, extend
from clonespark.plans import queries
from clonespark.plans.catalogue import Catalogue, Chain, Params
from clonespark.plans.repertoire import from_reads, run
from clonespark.sources import fastq, io
from clonespark.sources.bam import read_bam, records

DRAW = random.Random(11)


def bases(n):
    return "".join(DRAW.choice("ACGT") for _ in range(n))


def test_fastq_and_gz(spark, tmp_path):
    reads = [(f"r{i} extra", bases(30 + i), "".join(DRAW.choice("@I+5") for _ in range(30 + i))) for i in range(50)]
    reads[7] = (reads[7][0], reads[7][1], "@" + reads[7][2][1:])
    text = "".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in reads)
    (tmp_path / "a.fastq").write_text(text)
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write(text)
    want = sorted((n.split()[0], s, q) for n, s, q in reads)
    for name in ("a.fastq", "b.fq.gz"):
        assert sorted((r.qname, r.seq, r.qual) for r in io.any_reads(spark, str(tmp_path / name)).collect()) == want
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")  # parts that cut records
    try:
        assert sorted((r.qname, r.seq, r.qual) for r in io.read_fastq(spark, str(tmp_path / "a.fastq")).collect()) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    pairs = io.read_pairs(spark, str(tmp_path / "a.fastq"), str(tmp_path / "b.fq.gz"), "x")
    assert {(r.file_idx, r.n) for r in pairs.groupBy("file_idx").agg(F.count("*").alias("n")).collect()} == {(1, 50), (2, 50)}


def test_fasta_sam_prob(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">g1 x\nacgt\nACG\n>g2\nttt\n")
    assert sorted(map(tuple, io.read_fasta_records(spark, str(tmp_path / "a.fa")).collect())) == [("g1", "ACGTACG"), ("g2", "TTT")]
    assert sorted(r.qual for r in io.read_fasta(spark, str(tmp_path / "a.fa")).collect()) == ["GGG", "GGGGGGG"]
    (tmp_path / "a.sam").write_text("@HD\tVN:1\nq1\t0\tg1\t3\t60\t2S5M\t*\t0\t0\tACGTACG\tIIIIIII\tNM:i:1\tAS:i:12\nq2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n")
    rows = io.read_sam(spark, str(tmp_path / "a.sam"), "V").orderBy("qname").collect()
    assert (rows[0].as_score, rows[0].nm, rows[0].pos, rows[1].as_score) == (12, 1, 3, None)
    assert align.primary(io.read_sam(spark, str(tmp_path / "a.sam"), "V")).count() == 1
    (tmp_path / "p.csv").write_text("AA,-4,1,2\nA,0.1,0.2,0.3\nC,0.5,0,1\n")
    assert (1, "A", 0.2) in {tuple(r) for r in io.read_probabilities(spark, str(tmp_path / "p.csv")).collect()}


def test_bam(spark, tmp_path):
    def record(name, flag, ref, pos, cigar, seq, qual, tags):
        packed = bytearray((len(seq) + 1) // 2)
        for i, c in enumerate(seq):
            packed[i // 2] |= "=ACMGRSVTWYHKDBN".index(c) << (0 if i % 2 else 4)
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 9, 0, len(cigar), flag, len(seq), -1, -1, 0) + name.encode() + b"\0"
        body += b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in cigar) + bytes(packed) + bytes(ord(q) - 33 for q in qual) + tags
        return struct.pack("<i", len(body)) + body

    data = b"BAM\1" + struct.pack("<i", 3) + b"@HD" + struct.pack("<i", 1) + struct.pack("<i", 3) + b"g1\0" + struct.pack("<i", 99)
    data += record("q1", 16, 0, 2, [(2, "S"), (5, "M")], "ACGTACG", "IIIIII5", b"XZZhey\0ASC\x0cNMs\x01\0XBBc\x02\0\0\0\1\2")
    data += record("q2", 4, -1, -1, [], "ACN", "III", b"")
    (tmp_path / "a.bam").write_bytes(gzip.compress(data[:40]) + gzip.compress(data[40:]))
    rows = read_bam(spark, str(tmp_path / "a.bam"), "V").orderBy("qname").collect()
    assert [tuple(r)[3:] for r in rows] == [("q1", 16, "g1", 3, "2S5M", 12, 1, "ACGTACG", "IIIIII5"), ("q2", 4, "*", 0, "*", None, None, "ACN", "III")]
    assert {(r.qname, r.seq, r.qual) for r in io.any_reads(spark, str(tmp_path / "a.bam")).collect()} == {("q1", "CGTACGT", "5IIIIII"), ("q2", "ACN", "III")}
    for n in (1, 9, len(data) - 45):  # cut within the last alignment, and within the first
        with pytest.raises(ValueError, match="ends within"):
            list(records(gzip.compress(data[:-n])))


def bgzf(data, size):
    """Blocks of ``size`` bytes of data each, and the empty block at the end."""
    out = b""
    for part in [data[i : i + size] for i in range(0, len(data), size)] + [b""]:
        c = zlib.compressobj(0 if len(out) % 3 == 0 else 6, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        out += b"\x1f\x8b\x08\x04" + struct.pack("<IBBHBBHH", 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def bam(n, seed):
    """A BAM file's data: alignments of all lengths, some with the bytes that a block starts with."""
    draw = random.Random(seed)
    data = b"BAM\1" + struct.pack("<i", 600) + b"@CO\t" + b"x" * 596 + struct.pack("<i", 40) + b"".join(struct.pack("<i", 5) + f"g{i:03}\0".encode() + struct.pack("<i", 999) for i in range(40))
    for i in range(n):
        name, l_seq = f"read{i}" * draw.randint(1, 4), draw.choice([0, 1, 30, 151, 900])
        body = struct.pack("<iiBBHHHiiii", draw.randint(-1, 39), draw.randint(-1, 900), len(name) + 1, 9, 0, 1, draw.choice([0, 16, 4]), l_seq, -1, -1, 0) + name.encode() + b"\0" + struct.pack("<I", l_seq << 4)
        body += bytes(draw.choice([0x11, 0x24, 0x88]) for _ in range((l_seq + 1) // 2)) + bytes(draw.randrange(2, 40) for _ in range(l_seq)) + b"ASC" + bytes([i % 200]) + b"XZZ" + draw.choice([b"", b"\x1f\x8b\x08\x04", b"plain"]) + b"\0"
        data += struct.pack("<i", len(body)) + body
    return data


@pytest.mark.parametrize("size,part", [(300, 700), (4000, 5000), (4000, 900), (60_000, 30_000), (500, 10_000_000)])
def test_bam_in_parts(spark, tmp_path, monkeypatch, size, part):
    """Blocks and parts end anywhere within alignments."""
    data = bam(400, size)
    (tmp_path / "a.bam").write_bytes(bgzf(data, size))
    want = sorted(map(repr, records(gzip.compress(data))))
    assert len(want) == 400
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(part))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = read_bam(spark, str(tmp_path / "a.bam"), "V")
        assert sorted(repr(tuple(r)[3:]) for r in got.collect()) == want
        (tmp_path / "b.bam").write_bytes(bgzf(data[:-20], size))
        with pytest.raises(Exception, match="ends within an alignment"):
            read_bam(spark, str(tmp_path / "b.bam"), "V").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("size,part", [(300, 2), (4000, 1), (2000, 3), (60_000, 1)])
def test_bgzip_fastq_in_parts(spark, tmp_path, monkeypatch, size, part):
    """Blocks and parts end anywhere within records; qualities start with @ and +."""
    draw = random.Random(size)
    rows = []
    for i in range(400):
        n = draw.choice([0, 1, 30, 150])
        rows.append((f"q{i}", "".join(draw.choice("ACGTN") for _ in range(n)), "".join(draw.choice("@+IA#") for _ in range(n))))
    text = "".join(f"@{q} x\n{s}\n+\n{u}\n" for q, s, u in rows).encode()
    (tmp_path / "a.fastq").write_bytes(text)
    (tmp_path / "a.fastq.gz").write_bytes(bgzf(text, size))
    (tmp_path / "b.fastq.gz").write_bytes(gzip.compress(text))
    (tmp_path / "c.fastq.gz").write_bytes(bgzf(text[:-30], size))
    read = lambda name: sorted((r.qname, r.seq, r.qual) for r in io.read_fastq(spark, str(tmp_path / name)).collect())
    monkeypatch.setattr(fastq, "PART", part)
    monkeypatch.setattr(fastq.of_blocks, "__defaults__", (part,))
    assert read("a.fastq.gz") == sorted(rows)
    parts = fastq.of_blocks(spark, str(tmp_path / "a.fastq.gz")).select("start").distinct().count()
    assert parts > 2 or size > 50_000
    assert fastq.of_blocks(spark, str(tmp_path / "b.fastq.gz")) is None and [x for x in read("b.fastq.gz") if x[1]] == [x for x in sorted(rows) if x[1]]
    with pytest.raises(Exception, match="ends within a record"):
        read("c.fastq.gz")


def test_samples_are_written_by_one_job(spark, tmp_path):
    rows = [(str(tmp_path / f"s{i % 7}"), f"AA{i}", i % 13) for i in range(300)] + [("other", "AA", 1)]
    df = spark.createDataFrame(rows, "sample_id string, AAseq string, Frequency long").repartition(5)
    prefixes = [str(tmp_path / f"s{i}") for i in range(8)]
    sc = spark.sparkContext
    sc.setJobGroup("sink", "sink")
    paths = io.write_samples(df, prefixes, "TRB", "CDR3")
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert paths == [f"{p}.TRB.CDR3.csv" for p in prefixes] and not [p for p in tmp_path.iterdir() if ".parts-" in p.name]
    assert len(sc.statusTracker().getJobIdsForGroup("sink")) < 8
    for i, path in enumerate(paths):
        lines = []
        for part in sorted(x for x in os.listdir(path) if x.startswith("part-")):
            head, *some = open(f"{path}/{part}").read().splitlines()
            assert head == "AAseq,Frequency"
            lines += some
        want = sorted(((a, n) for s, a, n in rows if s == prefixes[i]), key=lambda x: (-x[1], x[0]))
        assert lines == [f"{a},{n}" for a, n in want] and "_SUCCESS" in os.listdir(path)
    assert io.write_clonotypes(df.drop("sample_id"), prefixes[0], "TRB", "CDR3") == paths[0]  # again, over the old one


def test_align_finds_gene_and_strand(spark):
    refs = [(f"V{i}", bases(80)) for i in range(20)]
    rows, want = [], {}
    for i in range(60):
        name, ref = refs[i % 20]
        s = list(bases(20) + ref[20:] + bases(15))
        s[45] = "A" if s[45] != "A" else "C"
        s = "".join(s)
        back = i % 2
        rows.append(("s", 1, f"q{i}", s.translate(str.maketrans("ACGT", "TGCA"))[::-1] if back else s, "I" * len(s)))
        want[f"q{i}"] = (name, 16 * back, s)
    df = spark.createDataFrame([*rows, ("s", 1, "none", bases(9), "I" * 9), ("s", 1, "null", None, None)], "sample_id string, file_idx int, qname string, seq string, qual string")
    hits = align.best_hit(align.align(df, spark.createDataFrame(refs, "name string, seq string"), "V")).collect()
    assert {h.qname: (h.rname, h.flag, h.seq) for h in hits} == want
    assert all(h.nm >= 1 for h in hits)


def test_align_scores_every_place_that_may_be_best(spark):
    draw = random.Random(3)
    true = "".join(draw.choice("ACGT") for _ in range(80))
    other = dict(zip("ACGT", "CGTA", strict=True))

    def changed(*at):
        return "".join(other[c] if i in at else c for i, c in enumerate(true))

    # one mismatch in the middle: fewer seeds but a better score than two near the ends
    refs = [("Z", changed(40))] + [(f"A{i:02}", changed(4, 8 + i % 2)) for i in range(30)]
    assert align.most(80, 61, 10) == 77 and align.most(80, 62, 10) == 77
    df = spark.createDataFrame([("s", 1, "q", true, "I" * 80)], "sample_id string, file_idx int, qname string, seq string, qual string")
    hit = align.align(df, spark.createDataFrame(refs, "name string, seq string"), "V").collect()

    def score(ref):
        return align.stretches(np.array([[1 if a == b else -2 for a, b in zip(true, ref, strict=True)]]))[0][0]

    assert [(h.rname, h.as_score) for h in hit] == [min(((n, score(r)) for n, r in refs), key=lambda x: (-x[1], x[0]))] == [("Z", 77)]
    for _ in range(200):
        same = np.array([draw.random() < 0.9 for _ in range(draw.randint(10, 90))])
        seeds = sum(same[i : i + 10].all() for i in range(len(same) - 9))
        assert align.stretches(np.where(same, 1, -2)[None, :])[0][0] <= align.most(len(same), int(seeds), 10)


def test_many_near_identical_segments(spark):
    """The best of 41 alleles is found whatever its name."""
    true = bases(114)
    refs = [(f"V{i:02}", true[:60] + ("A" if true[60] != "A" else "C") + true[61 : 70 + i % 3] + bases(41 - i % 3)) for i in range(40)] + [("V99", true)]
    df = spark.createDataFrame([("s", 1, "q", bases(20) + true, None)], "sample_id string, file_idx int, qname string, seq string, qual string")
    hit = align.align(df, spark.createDataFrame(refs, "name string, seq string"), "V").collect()
    assert [(h.rname, h.as_score, h.cigar, h.nm) for h in hit] == [("V99", 114, "20S114M", 0)]


def gapped_score(x, y):
    """The best local alignment with affine gaps, cell by cell."""
    best, low = 0, -(10**9)
    h, e = [0] * (len(y) + 1), [low] * (len(y) + 1)
    for a in x:
        new, f = [0] * (len(y) + 1), low
        for j in range(1, len(y) + 1):
            e[j] = max(h[j] - 7, e[j] - 1)
            f = max(new[j - 1] - 7, f - 1)
            new[j] = max(0, h[j - 1] + (1 if a == y[j - 1] else -2), e[j], f)
        h, best = new, max(best, *new)
    return best


def test_gaps(spark):
    refs = [(f"V{i}", bases(100)) for i in range(5)]
    rows, want = [], {}
    for i in range(60):
        name, ref = refs[i % 5]
        cuts = [(33, 2), (66, 1)][: 1 + i % 2]
        s = ref
        for at, n in cuts:
            s = s[:at] + s[at + n :] if i % 3 else s[:at] + bases(n) + s[at:]
        s = bases(i % 4) + s
        rows.append(("s", 1, f"q{i}", s.translate(str.maketrans("ACGT", "TGCA"))[::-1] if i % 7 == 0 else s, "I" * len(s)))
        want[f"q{i}"] = (name, gapped_score(s, ref), 16 * (i % 7 == 0))
    df = spark.createDataFrame(rows, "sample_id string, file_idx int, qname string, seq string, qual string")
    hits = align.align(df, spark.createDataFrame(refs, "name string, seq string"), "V").collect()
    assert {h.qname: (h.rname, h.as_score, h.flag) for h in hits} == want
    for h in hits:  # the cigar tells the score and the mismatches
        ref, x, y, score, nm = dict(refs)[h.rname], 0, h.pos - 1, 0, 0
        for n, op in re.findall(r"(\d+)([A-Z])", h.cigar):
            n = int(n)
            if op == "M":
                wrong = sum(a != b for a, b in zip(h.seq[x : x + n], ref[y : y + n], strict=True))
                score, nm = score + n - 3 * wrong, nm + wrong
            elif op in "ID":
                score, nm = score - 6 - n, nm + n
            x, y = x + n * (op in "SMI"), y + n * (op in "MD")
        assert (x, score, nm) == (len(h.seq), h.as_score, h.nm) and any(op in h.cigar for op in "ID")


def test_gaps_anywhere_score_as_the_whole_matrix():
    """Changed bases and gaps near each other and near the ends, where no seed stands beside them."""
    draw = random.Random(5)
    any_ = lambda n: "".join(draw.choice("ACGT") for _ in range(n))
    refs = [(f"V{i}", any_(90)) for i in range(4)]
    table, seqs = align.Segments(refs, 10), []
    for i in range(40):
        s = list(refs[i % 4][1])
        for _ in range(draw.randint(1, 4)):
            at, n = draw.randrange(5, len(s) - 5), draw.randint(1, 8)
            if (kind := draw.random()) < 0.4:
                s[at] = draw.choice("ACGTN")
            elif kind < 0.7:
                s[at:at] = any_(n)
            else:
                del s[at : at + n]
        seqs.append(any_(draw.randrange(15)) + "".join(s) + any_(draw.randrange(20)))
    found, gapped = table.best(seqs, 12), 0
    for i, s in enumerate(seqs):
        back = s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
        assert found[i][0] == max(gapped_score(x, r) for x in (s, back) for _, r in refs)
        _, name, pos, cigar, score, nm, seq, _ = table.told(s, None, found[i])
        ref, x, y, told, wrong = dict(refs)[name], 0, pos - 1, 0, 0
        for n, op in re.findall(r"(\d+)([A-Z])", cigar):
            n = int(n)
            if op == "M":
                differ = sum(a != b for a, b in zip(seq[x : x + n], ref[y : y + n], strict=True))
                told, wrong = told + n - 3 * differ, wrong + differ
            elif op in "ID":
                told, wrong = told - 6 - n, wrong + n
            x, y = x + n * (op in "SMI"), y + n * (op in "MD")
        assert (x, told, wrong) == (len(s), score, nm)
        gapped += "I" in cigar or "D" in cigar
    assert gapped > 15


def test_reads_of_few_letters_cost_no_more_than_others():
    draw = random.Random(6)
    any_ = lambda n: "".join(draw.choice("ACGT") for _ in range(n))
    refs = [(f"V{i}", any_(290)) for i in range(100)] + [("VA", any_(100) + "A" * 60 + any_(100) + "AC" * 30)]
    table = align.Segments(refs, 10)

    def seconds(reads):
        table.best(reads[:5], 12)
        began = time.process_time()
        table.best(reads, 12)
        return time.process_time() - began

    plain = seconds([any_(150) for _ in range(300)])
    for reads in ([any_(90) + "A" * 60 for _ in range(300)], [any_(60) + "AC" * 45 for _ in range(300)], ["A" * 150] * 300):
        assert seconds(reads) < 20 * plain
    # and they are scored as the whole matrix has it
    for s in (any_(40) + "A" * 60, "AC" * 30 + "A" * 40, "A" * 30 + any_(3) + "A" * 45):
        assert table.best([s], 12)[0][0] == max(gapped_score(x, r) for x in (s, s.translate(str.maketrans("ACGT", "TGCA"))[::-1]) for _, r in refs[-2:])


def test_align_splits_work_that_is_too_large(spark, monkeypatch):
    refs = [(f"V{i}", bases(80)) for i in range(9)]
    seqs = [dict(refs)[f"V{i % 9}"][i % 20 :] + bases(9) for i in range(40)]
    table = align.Segments(refs, 10)
    whole = table.best(seqs, 12)
    monkeypatch.setattr(align, "HITS", 100)
    monkeypatch.setattr(align, "CELLS", 1)
    assert table.best(seqs, 12) == whole and len(whole) == 40
    assert align.Segments([], 10).best(seqs, 12) == {} and table.best(["N" * 40, "A"], 12) == {}


def test_align_refuses_a_catalogue_beyond_its_bound(spark, monkeypatch):
    monkeypatch.setattr(align, "MAX_SEGMENTS", 3)
    df = spark.createDataFrame([], "sample_id string, file_idx int, qname string, seq string, qual string")
    with pytest.raises(ValueError, match="segments"):
        align.align(df, spark.createDataFrame([(f"V{i}", "ACGT" * 5) for i in range(4)], "name string, seq string"), "V")


@pytest.mark.parametrize("k", [7, 15, 32])
def test_walks_follow_counts_and_stop(spark, k):
    genome = bases(120)
    reads = [("s", "V", genome[i : i + 40]) for i in range(0, 80) for _ in range(3)]
    df = spark.createDataFrame(reads, "sample_id string, part string, seq string")
    pool = extend.kmer_pool(df, k)
    table = {r.kmer: r.n for r in pool.withColumn("kmer", dna.unpacked("kmer", k)).collect()}

    def walk(seq):
        seg, cur = seq[-k:], table.get(seq[-k:], 0)
        while len(seq) < 150:
            for n, b in sorted(((table.get(seg[1:] + b, 0), b) for b in "ACGT"), key=lambda x: (-x[0], x[1])):
                if n and max(n, cur) <= 10 * min(n, cur) and seg[1:] + b != seg:
                    seg, cur, seq = seg[1:] + b, n, seq + b
                    break
            else:
                return seq
        return seq

    some = df.limit(30).withColumn("qual", F.lit("I"))
    got = extend.extend(some, pool, k).collect()
    assert sorted(r.seq for r in got) == sorted(walk(r.seq) for r in some.collect())
    assert all(len(r.qual) == len(r.seq) for r in got) and (k == 7 or any(len(r.seq) > 100 for r in got))


def test_packed_bases(spark):
    words = ["", "A", "T", "ACGT", "T" * 31, "T" * 32, "A" * 32, "G" + "A" * 31, "ACGTN", "acgt", "A" * 33, None]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", dna.packed("w").alias("p")).withColumn("u", dna.unpacked("p", F.length("w"))).collect()
    for r in rows:
        plain = r.w is not None and len(r.w) <= 32 and not set(r.w) - set("ACGT")
        assert (r.p is not None) == (plain and r.w != "") or r.w == ""
        if plain and r.w:
            assert r.u == r.w and r.p % (1 << 64) == int("".join(str("ACGT".index(c)) for c in r.w), 4)


def test_segments_of_one_name(spark):
    reads = spark.createDataFrame([("s", 1, "q", "ACGTTGCAACGGTACT", None)], "sample_id string, file_idx int, qname string, seq string, qual string")
    segments = lambda *rows: spark.createDataFrame(list(rows), "name string, seq string")
    same = segments(("V", "ACGTTGCAACGGTACT"), ("V", "acgttgcaacggtact"))
    assert [(h.rname, h.as_score) for h in align.align(reads, same, "V").collect()] == [("V", 16)]
    with pytest.raises(ValueError, match="one name"):
        align.align(reads, segments(("V", "ACGTTGCAACGGTACT"), ("V", "ACGTTGCAACGGTAC")), "V")


def test_reads_grow_to_the_length_asked_for(spark):
    genome, k = bases(120), 15
    reads = spark.createDataFrame([("s", "V", genome[i : i + 40], "I" * 40, None) for i in range(80) for _ in range(3)], "sample_id string, part string, seq string, qual string, cdr3 string")
    some = reads.limit(3)
    assert {len(r.seq) for r in extend.extend(some, extend.kmer_pool(reads, k), k, 70).collect()} == {70}
    assert parser().parse_args(["-f", "a", "-o", "b", "--resources", "c", "--max-length", "99", "--corrected-nn"]).max_length == 99


def test_walks_round_a_cycle_and_from_given_starts(spark):
    k, ring = 5, "ACGTTGCAAC"
    reads = spark.createDataFrame([("s", "V", (ring * 3)[i : i + 15]) for i in range(10)] + [("s", "V", "TTTCCCGGAACTTAG"), ("s", "V", "NNNNNNACG"), ("s", "J", "AC")], "sample_id string, part string, seq string")
    succ = extend.successors(extend.kmer_pool(reads, k), k)
    starts = reads.limit(4).select("sample_id", dna.packed(F.right("seq", F.lit(k))).alias("kmer"))
    got = {r.word: r.path for r in extend.paths(succ, 100, starts).withColumn("word", dna.unpacked("kmer", k)).collect()}
    assert len(got) == 4
    for word, path in got.items():
        at = (ring * 2).index(word) + k
        assert path == (ring * 13)[at : at + 100]
    with pytest.raises(ValueError, match="32"):
        extend.kmer_pool(reads, 33)
    # reads shorter than k, or with other letters at their end, stay
    some = reads.where("part = 'J' OR seq LIKE 'N%'").withColumn("qual", F.lit(""))
    assert sorted(r.seq for r in extend.extend(some, extend.kmer_pool(reads, k), k).collect()) == ["AC", "NNNNNNACG"]


def test_d_gene_against_full_table():
    def slow(a, b):
        low = -(10**9)
        m = [[low] * (len(b) + 1) for _ in range(len(a) + 1)]
        x, y = [r[:] for r in m], [r[:] for r in m]
        m[0][0] = 0
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                if i:
                    x[i][j] = max(max(m[i - 1][j], y[i - 1][j]) - 5, x[i - 1][j] - 1)
                if j:
                    y[i][j] = max(max(m[i][j - 1], x[i][j - 1]) - 5, y[i][j - 1] - 1)
                if i and j:
                    m[i][j] = max(m[i - 1][j - 1], x[i - 1][j - 1], y[i - 1][j - 1]) + (5 if a[i - 1] == b[j - 1] else -3)
        return max(m[-1][-1], x[-1][-1], y[-1][-1])

    for _ in range(15):
        some, b = [bases(DRAW.randint(1, 25)) for _ in range(10)], bases(DRAW.randint(1, 14))
        assert annotate.global_scores(some, b).tolist() == [slow(a, b) for a in some]
    assert annotate.best_d_genes(["TGT" + "GGGACAGGGGGC" + "TTC", "AAAA", ""], (("D1", "GGGACAGGGGGC"), ("D2", "AAAAAAAA"), ("D3", "GGGACAGGGGGC"))) == ["D1", "None", "None"]
    assert annotate.best_d_genes([], (("D1", "ACG"),)) == []


def test_whole_run_finds_what_was_planted(spark, tmp_path):
    v, j = {f"V{i}": bases(70) + "TATTTCTGCGCC" for i in range(3)}, {f"J{i}": "TTCTTCGGCGAAGGC" + bases(40) for i in range(2)}
    planted, lines = {}, []
    for i in range(6):
        insert = "".join(DRAW.choice(["GCA", "GAC", "AAG", "CTC", "AAC"]) for _ in range(6 + i))
        vn, jn = f"V{i % 3}", f"J{i % 2}"
        whole = v[vn] + insert + j[jn]
        planted[(vn, jn, "TGCGCC" + insert + "TTCTTC")] = 0
        for n in range(20):
            lines.append(f"@r{i}_{n}\n{whole}\n+\n{'I' * len(whole)}\n")
            planted[(vn, jn, "TGCGCC" + insert + "TTCTTC")] += 1
    (tmp_path / "r.fastq").write_text("".join(lines))
    (tmp_path / "v.fa").write_text("".join(f">{n}\n{s.lower()}\n" for n, s in v.items()))
    (tmp_path / "j.fa").write_text("".join(f">{n}\n{s.lower()}\n" for n, s in j.items()))
    params = Params(species="synthetic", catalogue=Catalogue())
    params.catalogue.register("synthetic", "TRB", "CDR3", Chain("v.fa", "j.fa", queries.MOTIF, (("D1", "GGGACAGGGGGC"),)))
    paths = run(spark, [str(tmp_path / "r.fastq")], [str(tmp_path / "out")], params, str(tmp_path))
    rows = spark.read.option("header", True).csv(paths[0]).collect()
    assert {(r.Vregion, r.Jregion, r.NNseq): int(r.Frequency) for r in rows} == planted
    assert rows[0].asDict().keys() == {"AAseq", "NNseq", "Prob", "Vregion", "Jregion", "Dregion", "Frequency"}


def test_command_line_from_alignments(spark, tmp_path, caplog):
    """--proV and --proJ: SAM files in, one result out; so do reads, which are logged."""
    v, j = bases(70) + "TATTTCTGCGCC", "TTCTTCGGCGAAGGC" + bases(40)
    whole = v + "GCAGACAAGCTC" + j
    (tmp_path / "v.fa").write_text(f">V1\n{v}\n")
    (tmp_path / "j.fa").write_text(f">J1\n{j}\n")
    (tmp_path / "c.json").write_text(json.dumps([{"species": "hs", "chain": "IGL", "v_file": "v.fa", "j_file": "j.fa", "motif": vars(queries.MOTIF)}]))
    (tmp_path / "r.fq").write_text("".join(f"@q{i}\n{whole}\n+\n{'I' * len(whole)}\n" for i in range(9)))
    for part, name, at, n in (("v", "V1", 1, len(v)), ("j", "J1", len(v) + 13, len(j))):
        clip = f"{at - 1}S" if at > 1 else ""
        tail = f"{len(whole) - at + 1 - n}S" if len(whole) >= at + n else ""
        lines = [f"q{i}\t0\t{name}\t1\t60\t{clip}{n}M{tail}\t*\t0\t0\t{whole}\t{'I' * len(whole)}\tNM:i:0\tAS:i:{n}\n" for i in range(9)]
        (tmp_path / f"{part}.sam").write_text("@HD\tVN:1.6\n" + "".join(lines))
    common = ["--chain", "IGL", "--resources", str(tmp_path), "--catalogue", str(tmp_path / "c.json"), "--debug"]
    want = [("TGCGCCGCAGACAAGCTCTTCTTC", "V1", "J1", "9")]
    with caplog.at_level("INFO", "clonespark"):
        assert main(["--proV", str(tmp_path / "v.sam"), "--proJ", str(tmp_path / "j.sam"), "-o", str(tmp_path / "a"), *common]) == 0
        assert main(["-f", str(tmp_path / "r.fq"), "-o", str(tmp_path / "b"), "--impute", *common]) == 0
    for out in "ab":
        rows = spark.read.option("header", True).csv(str(tmp_path / f"{out}.IGL.CDR3.csv")).collect()
        assert [(r.NNseq, r.Vregion, r.Jregion, r.Frequency) for r in rows] == want
    assert caplog.text.count("search range: 9 reads; found: 9; left: 0") == 2 and caplog.text.count("reads with a CDR3: 9; rescued: 0") == 2
    with pytest.raises(SystemExit):
        main(["--proV", "v", "-o", "a", "-o", "b", *common])


def test_imputed_segments(spark):
    """Reads that end before J get the J of the k-mers that they grew into."""
    j = {f"J{i}": bases(60) for i in range(2)}
    rows = [("s", "J", None, n, s[-40:]) for n, s in j.items() for _ in range(3 + (n == "J1"))] + [("s", "J", None, "J9", j["J0"][-40:])]
    rows += [("s", "V", "V1", None, bases(30) + j["J0"][:-i] if i else bases(30) + j["J0"]) for i in range(8)] + [("s", "VJ", "V1", "J1", bases(40)), ("s", "V", "V1", None, "ACGT")]
    reads = spark.createDataFrame(rows, "sample_id string, part string, v string, j string, seq string")
    known = extend.leaders(reads, 15)
    assert [(r.part, r.region) for r in known.collect()] == [("J", "J0")]
    got = extend.impute(reads, known, 15).collect()
    assert len(got) == len(rows)
    assert sorted((len(r.seq), r.j) for r in got if r.part == "V" and len(r.seq) > 4) == [(83 + i, None) for i in range(7)] + [(90, "J0")]


def test_samples_with_j_hits_only(spark):
    v = spark.createDataFrame([("a", 1, "q", "A" * 80, "80M", 2)], "sample_id string, file_idx int, qname string, seq string, cigar string, nm int")
    j = v.unionByName(v.withColumn("sample_id", F.lit("b")))
    got = {r.sample_id: (r.mean_length, r.error_rate) for r in align.sample_stats(v, j).collect()}
    assert got == {"a": (80.0, 0.025), "b": (80.0, 0.0031)}


def test_a_cluster_needs_a_shared_folder():
    class Session:
        conf = {}
        sparkContext = type("Context", (), {"master": "yarn"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_dir(Session)


def test_unknown_chain_names_the_known():
    with pytest.raises(KeyError, match="hs-TRB-CDR3"):
        Params(chain="IGL").entry()


def test_inputs_need_outputs(spark):
    with pytest.raises(ValueError):
        io.read_samples(spark, ["a", "b"], ["x"])
    assert parser().parse_args(["-f", "a", "-o", "b", "--resources", "r"]).kmer == 10000


def test_empty_reads(spark):
    reads = spark.createDataFrame([], "sample_id string, file_idx int, qname string, seq string, qual string")
    refs = spark.createDataFrame([("V1", bases(60))], "name string, seq string")
    assert from_reads(reads, refs, refs, Params()).count() == 0
