"""Clonotypes: counted, with the probability of their ends and their D gene."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonespark.functions.dna import translate

#: A column of the probability table, and the residue that it tells of (from the start, or from the end if negative).
PLACES = ((1, 2), (2, 3), (3, 4), (-2, -1), (-3, -2), (-4, -3))
#: The scores of a global alignment to a D gene, and what a hit must exceed.
MATCH, MISMATCH, OPEN, EXTEND, BONUS, LEAST = 5, -3, -4, -1, 4, 35


def clonotypes(reads: DataFrame, verdict: DataFrame, corrected_nn: bool = False) -> DataFrame:
    """(sample_id, AAseq, NNseq, Vregion, Jregion, Frequency).

    AAseq is of the corrected CDR3; NNseq is the read's own, or the corrected
    one with ``corrected_nn``.  Reads that the verdict doesn't have go.
    """
    cells = reads.where("cdr3 IS NOT NULL").groupBy("sample_id", "cdr3", F.coalesce("v", F.lit("None")).alias("Vregion"), F.coalesce("j", F.lit("None")).alias("Jregion")).agg(F.count("*").alias("n"))
    told = cells.join(verdict.select("sample_id", "cdr3", F.coalesce("root", "cdr3").alias("fixed")), ["sample_id", "cdr3"])
    nn = F.col("fixed") if corrected_nn else F.col("cdr3")
    counts = told.groupBy("sample_id", "fixed", nn.alias("NNseq"), "Vregion", "Jregion").agg(F.sum("n").alias("Frequency"))
    return counts.withColumn("AAseq", translate("fixed")).groupBy("sample_id", "AAseq", "NNseq", "Vregion", "Jregion").agg(F.sum("Frequency").alias("Frequency"))


def end_probability(aa: Column | str, table: dict[tuple[int, str], float]) -> Column:
    """The product of six residues' probabilities, to 5 digits; 0 for a residue without one.

    ``table``: probability by (column, residue), of a file with a few dozen rows.
    """
    aa = F.col(aa) if isinstance(aa, str) else aa
    out = F.lit(1.0)
    for column, place in PLACES:
        letters = {a: p for (c, a), p in table.items() if c == column}
        known = F.create_map(*[F.lit(x) for pair in sorted(letters.items()) for x in pair]) if letters else F.create_map().cast("map<string,double>")
        at = F.lit(place) if place > 0 else F.length(aa) + place
        out = out * F.coalesce(F.element_at(known, F.substring(aa, at, F.lit(1))), F.lit(0.0))
    return F.bround(out, 5)


def probability_table(long: DataFrame) -> dict[tuple[int, str], float]:
    rows = long.limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("not a table of residues by positions")
    return {(r["pos"], r["aa"]): r["p"] for r in rows}


def global_scores(seqs: list[str], ref: str) -> np.ndarray:
    """The best global alignment's score of each sequence with affine gaps: a gap
    of n costs OPEN + n * EXTEND.  All sequences take a row of their matrix at once."""
    y = np.frombuffer(ref.upper().encode("ascii", "replace"), np.uint8)
    raw = [s.upper().encode("ascii", "replace") for s in seqs]
    length = np.array([len(s) for s in raw], np.int64)
    x = np.zeros((len(raw), int(length.max(initial=0))), np.uint8)
    x[np.arange(x.shape[1]) < length[:, None]] = np.frombuffer(b"".join(raw), np.uint8)
    steps = EXTEND * np.arange(len(y) + 1)
    best = np.tile(steps + OPEN * (steps != 0), (len(raw), 1)).astype(np.int64)
    down = np.full_like(best, -(10**9))
    out = best[:, -1].copy()
    for i in range(1, x.shape[1] + 1):
        down = np.maximum(down + EXTEND, best + OPEN + EXTEND)
        new = np.empty_like(best)
        new[:, 0] = OPEN + EXTEND * i
        new[:, 1:] = np.maximum(best[:, :-1] + np.where(y == x[:, i - 1 : i], MATCH, MISMATCH), down[:, 1:])
        # a gap along the row: the best start so far, less what its length costs
        start = np.maximum.accumulate(new - steps, axis=1)
        new[:, 1:] = np.maximum(new[:, 1:], start[:, :-1] + steps[1:] + OPEN)
        best = new
        ended = length == i
        out[ended] = best[ended, -1]
    return out


def best_d_genes(seqs: list[str], genes: tuple[tuple[str, str], ...]) -> list[str]:
    """The D gene of the best score that passes, the first of equals, for each sequence; else None, as a word."""
    out, most = np.array(["None"] * len(seqs), object), np.full(len(seqs), -(10**9))
    length = np.array([len(s) for s in seqs])
    for name, ref in genes:
        score = global_scores(seqs, ref)
        better = (score + length - len(ref) + BONUS > LEAST) & (score > most) & (length > 0)
        out[better], most[better] = name, score[better]
    return out.tolist()


def with_d_gene(df: DataFrame, genes: tuple[tuple[str, str], ...], seq_col: str = "NNseq") -> DataFrame:
    """``df`` with Dregion; each distinct sequence is aligned once."""

    @F.pandas_udf("string")
    def find(seqs: pd.Series) -> pd.Series:
        return pd.Series(best_d_genes([s or "" for s in seqs], genes))

    told = df.select(seq_col).distinct().withColumn("Dregion", find(seq_col))
    return df.join(told, seq_col, "left")
