"""Nucleotide sequences, qualities and cigars as Columns.

Coordinates are 1-based and inclusive, as in SQL.  Null in, null out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The standard genetic code, codons in the order T, C, A, G.
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {"".join(c): a for c, a in zip(product("TCAG", repeat=3), AMINO_ACIDS, strict=True)}
#: The quality sign of bases that no read showed.
FILLED = "G"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def codon_map() -> Column:
    return F.create_map(*[F.lit(x) for pair in CODONS.items() for x in pair])


def translate(seq: Column | str, frame: Column | int = 1) -> Column:
    """Amino acids of the whole codons from base ``frame`` (1 to 3) on; X for a
    codon with other letters than ACGT; empty if there is none."""
    seq = _col(seq)
    frame = F.lit(frame) if isinstance(frame, int) else frame
    n = F.floor((F.length(seq) - frame + 1) / 3).cast("int")
    code = codon_map()
    one = lambda i: F.coalesce(F.element_at(code, F.substring(seq, frame + i * 3, F.lit(3))), F.lit("X"))
    return F.when(n >= 1, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), one), "")).when(seq.isNotNull(), F.lit(""))


def frames(seq: Column | str) -> Column:
    """The three peptides, by frame."""
    seq = _col(seq)
    return F.array(*[translate(seq, k) for k in (1, 2, 3)])


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(F.translate(_col(seq), "ACGTacgtN", "TGCAtgcaN"))


def kmers(seq: Column | str, k: int) -> Column:
    """All stretches of ``k`` bases in order; none if the sequence is shorter."""
    seq = _col(seq)
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(seq) - k + 1, F.lit(1))), lambda i: F.substring(seq, i, F.lit(k)))
    return F.when(F.length(seq) >= k, every).otherwise(F.array().cast("array<string>"))


def packed(kmer: Column | str) -> Column:
    """A number of two bits a base, A to T as 0 to 3; null with other letters, or beyond 32 bases."""
    kmer = _col(kmer)
    return F.when((F.length(kmer) <= 32) & ~kmer.rlike("[^ACGT]"), F.conv(F.translate(kmer, "ACGT", "0123"), 4, -10).cast("long"))


def unpacked(code: Column | str, n: Column | int) -> Column:
    """The ``n`` bases of a number."""
    code, n = _col(code), F.lit(n) if isinstance(n, int) else n
    # a half at a time, as a whole may be negative
    half = lambda x: F.lpad(F.conv(x.cast("string"), 10, 4), 16, "0")
    digits = F.concat(half(F.shiftrightunsigned(code, 32)), half(code.bitwiseAND(F.lit(0xFFFFFFFF))))
    return F.translate(F.right(digits, n), "0123", "ACGT")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(**columns: Column) -> Column:
    """Columns for ``select`` that are computed once: a later filter on them, which else is moved before them, would run a Python function again."""
    return F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))).alias(*columns)


#: Signs that a comparison holds at once.
CELLS = 1 << 20


def _aligned(a: list[str], b: list[str], n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, and their texts' first ``n`` signs as arrays, with where they are; texts of like lengths go together, so that a long one doesn't widen the others."""
    sizes = np.ceil(np.log2(np.maximum(n, 1))).astype(int)
    for size in np.unique(sizes[n > 0]).tolist():
        every = np.flatnonzero((sizes == size) & (n > 0))
        for i in range(0, len(every), step := max(1, CELLS >> size)):
            some = every[i : i + step]
            width = int(n[some].max())
            x, y = (np.array([t[k] for k in some.tolist()], dtype=f"U{width}").view(np.uint32).reshape(len(some), width) for t in (a, b))
            yield some, x, y, np.arange(width) < n[some][:, None]


def _lengths(a: pd.Series, b: pd.Series) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    """Both as texts, the shorter length of each two, and whether one is null."""
    null = (a.isna() | b.isna()).to_numpy()
    x, y = ([t if isinstance(t, str) else "" for t in s.tolist()] for s in (a, b))
    return x, y, np.minimum(np.fromiter(map(len, x), int, len(x)), np.fromiter(map(len, y), int, len(y))), null


def hamming(a: Column | str, b: Column | str, skip: int = 0) -> Column:
    """Places that differ, ``skip`` at either end left out, up to the shorter length.

    Whole Arrow batches are compared as arrays: higher-order functions are not compiled.
    """

    @F.pandas_udf("int")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y, n, null = _lengths(a, b)
        out = np.zeros(len(x), np.int32)
        for rows, u, v, inside in _aligned(x, y, np.maximum(0, n - skip)):
            out[rows] = ((u != v) & inside)[:, skip:].sum(axis=1)
        return pd.Series(pd.arrays.IntegerArray(out, null))

    return run(_col(a), _col(b))


def phred_errors(qual: Column | str) -> Column:
    """Expected errors: the sum of 10 ** -((sign - 33) / 10)."""
    signs = F.filter(F.split(_col(qual), ""), lambda c: c != "")
    return F.aggregate(signs, F.lit(0.0), lambda s, c: s + F.pow(F.lit(10.0), -(F.ascii(c) - 33) / 10.0))


def quality_max(a: Column | str, b: Column | str) -> Column:
    """The better sign at each place, up to the shorter length."""

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y, n, null = _lengths(a, b)
        out = np.full(len(x), "", object)
        for rows, u, v, inside in _aligned(x, y, n):
            best = np.where(inside, np.maximum(u, v), 0).astype(np.uint32).view(f"U{u.shape[1]}")[:, 0].tolist()
            out[rows] = [t.ljust(k, "\0") for t, k in zip(best, n[rows].tolist(), strict=True)]  # arrays drop these at the end
        out[null] = None
        return pd.Series(out, dtype=object)

    return run(_col(a), _col(b))


def first_bases(seq: Column | str, n: Column | int) -> Column:
    return F.left(_col(seq), F.lit(n) if isinstance(n, int) else n)


def last_bases(seq: Column | str, n: Column | int) -> Column:
    return F.right(_col(seq), F.lit(n) if isinstance(n, int) else n)


def cigar_ops(cigar: Column | str) -> Column:
    """array<struct<n int, op string>>."""
    cigar = _col(cigar)
    parts = F.regexp_extract_all(cigar, F.lit(r"(\d+)([A-Za-z])"), F.lit(0))
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, r"\d+", 0).cast("int").alias("n"), F.right(x, F.lit(1)).alias("op")))


def cigar_span(cigar: Column | str) -> Column:
    """struct<start, stop> of the first M run in the read; null without one."""
    cigar = _col(cigar)
    first = r"^((?:\d+[A-LN-Za-z])*)(\d+)M"
    skipped = F.regexp_extract(cigar, first, 1)
    # only several parts before the run need a sum over them
    summed = F.aggregate(cigar_ops(skipped), F.lit(0), lambda s, x: s + x["n"])
    one = F.substring(skipped, F.lit(1), F.length(skipped) - 1)
    before = F.when(skipped == "", 0).when(one.rlike("^[0-9]+$"), one.cast("int")).otherwise(summed)
    n = F.regexp_extract(cigar, first, 2)
    return F.when(n != "", F.struct((before + 1).alias("start"), (before + n.cast("int")).alias("stop")))


def ratio_ok(x: Column, y: Column, most: int = 10) -> Column:
    """Whether two counts are within ``most`` times of each other."""
    return F.greatest(x, y) <= most * F.least(x, y)


# --- abundance thresholds -----------------------------------------------------


def largest_parent(p: Column, length: Column, n: Column) -> Column:
    """Upper bound of the true abundance of a sequence seen ``n`` times without
    an error, at an error rate ``p`` a base over ``length`` bases."""
    q = F.pow(1 - p, length)
    spread = p * (1 - p)
    root = (3 * F.sqrt(spread) + F.sqrt(9 * spread + 4 * q * n)) / (2 * q)
    return root * root


def binomial(n: Column, k: int) -> Column:
    out = F.lit(1.0)
    for i in range(k):
        out = out * (n - i) / (i + 1)
    return out


def expected_copies(p: Column, length: Column, n: Column, errors: int, alpha: float = 3.0) -> Column:
    """Copies with that many errors of a sequence with ``n``, plus ``alpha`` deviations."""
    ps = binomial(length, errors) * F.pow(p, F.lit(errors)) * F.pow(1 - p, length - errors)
    return ps * n + alpha * F.sqrt(n * ps * (1 - ps))


def share_of(n: Column, ways: Column, alpha: float = 3.291) -> Column:
    """Most copies of one of ``ways`` equally likely variants of ``n`` copies; 1 at least, 0 if n < 1."""
    q = F.lit(1.0) / ways
    return F.when(n < 1, F.lit(0.0)).otherwise(F.greatest(n * q + alpha * F.sqrt(n * q * (1 - q)), F.lit(1.0)))
