"""CDR3 search: anchors by pattern in three reading frames, as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from clonespark.functions.dna import FILLED, _col, let, translate


#: The inner anchors of the first pass, the same for all chains.
FIRST_PASS_C = "(CAS|CSA|CAW|CAT|CSV|CAI|CAR|CAG|CSG)"
FIRST_PASS_F = "(QYF|QFF|AFF|LFF|YTF|QHF|LHF|IYF|LTF)"
#: An accepted pair is 6 to 34 residues apart; a C with a left neighbour 7 to 35 before the F is not.
NEAREST, FARTHEST = 6, 34


@dataclass(frozen=True)
class Motif:
    """Patterns of both anchors, and what is added to where they match; inner
    patterns are looked for where only the other anchor matches, if there are any.

    ``mirrored``: the C pattern reads peptides from their ends to their starts, as some
    catalogues write it; matches are looked for from the right and so don't overlap
    from the right, and this offset, in place of ``coffset``, is counted to the left.
    """

    cmotif: str
    fmotif: str
    coffset: int
    foffset: int
    inner_c: str | None = None
    inner_f: str | None = None
    mirrored: int | None = None

    def first_pass(self) -> Motif:
        return replace(self, inner_c=FIRST_PASS_C, inner_f=FIRST_PASS_F)

    def forward(self) -> Motif:
        return replace(self, mirrored=None)


def match_starts(text: Column | str, pattern: str, offset: int = 0) -> Column:
    """1-based starts of the non-overlapping matches, plus ``offset``."""
    text = _col(text)
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    lengths = F.zip_with(F.transform(gaps, F.length), F.transform(matches, F.length), lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        here = s["at"] + x["g"]
        return F.struct((here + F.coalesce(x["m"], F.lit(0))).alias("at"), F.when(x["m"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(here + offset))).alias("out"))

    return F.aggregate(lengths, start, step, lambda s: s["out"])


def c_starts(text: Column | str, motif: Motif) -> Column:
    """Where the C anchor is, ascending; a mirrored pattern is matched on the turned peptide and its places turned back."""
    text = _col(text)
    if motif.mirrored is None:
        return match_starts(text, motif.cmotif, motif.coffset)
    return F.reverse(F.transform(match_starts(F.reverse(text), motif.cmotif, motif.mirrored), lambda at: F.length(text) + 1 - at))


def locate(peptide: Column | str, motif: Motif) -> Column:
    """struct<status, start, stop>: residues of the CDR3 in a peptide.

    Status 3: found.  2: only one anchor matched, so the other was looked for by
    its inner pattern, and no pair was accepted.  0: neither or both matched and
    no pair was accepted.  Of several, the leftmost C with an accepted F wins,
    with its first one.
    """

    def accepted(text: Column, all_c: Column, xc: Column, i: Column, xf: Column) -> Column:
        left = F.element_at(all_c, F.greatest(i, F.lit(1)))  # the neighbour to the left of item i, counted from 0
        alone = (i == 0) | ~(xf - left).between(NEAREST + 1, FARTHEST + 1)
        return (xf - xc).between(NEAREST, FARTHEST) & alone & ~F.substring(text, xc, xf - xc + 1).contains("*")

    def best_pair(text: Column, a: Column) -> Column:
        def of_c(xc: Column, i: Column) -> Column:
            return F.transform(F.slice(F.filter(a["f"], lambda xf: accepted(text, a["c"], xc, i, xf)), 1, 1), lambda xf: F.struct(xc.alias("c"), xf.alias("f")))

        return F.get(F.flatten(F.transform(a["c"], of_c)), F.lit(0))

    def told(text: Column, a: Column) -> Column:
        return let(
            best_pair(text, a),
            lambda best: F.struct(F.when(best.isNotNull(), 3).when(a["one"], 2).otherwise(0).alias("status"), best["c"].alias("start"), best["f"].alias("stop")),
        )

    def refilled(text: Column, a: Column) -> Column:
        only_f, only_c = (F.size(a["c"]) == 0) & (F.size(a["f"]) > 0), (F.size(a["f"]) == 0) & (F.size(a["c"]) > 0)
        inner = lambda pattern, offset: match_starts(text, pattern, offset) if pattern else F.array().cast("array<int>")
        return F.struct(
            F.when(only_f, inner(motif.inner_c, 0)).otherwise(a["c"]).alias("c"),
            F.when(only_c, inner(motif.inner_f, 2)).otherwise(a["f"]).alias("f"),
            (only_f | only_c).alias("one"),
        )

    def of_text(text: Column) -> Column:
        first = F.struct(c_starts(text, motif).alias("c"), match_starts(text, motif.fmotif, motif.foffset).alias("f"))
        return let(first, lambda a: let(refilled(text, a), lambda b: told(text, b)))

    return let(_col(peptide), of_text)


def find_cdr3(seq: Column | str, qual: Column | str, motif: Motif) -> Column:
    """struct<cdr3, qual, able> of a read: the first frame with a CDR3 wins.

    ``able``: some frame had an anchor.  A quality that is shorter than the read
    goes on with FILLED.
    """
    seq, qual = _col(seq), _col(qual)
    found = F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda k: F.struct(k.alias("frame"), locate(translate(seq, k), motif).alias("at")))

    def cut(all_frames: Column, hit: Column) -> Column:
        start = (hit["at"]["start"] - 1) * 3 + hit["frame"]
        length = (hit["at"]["stop"] - hit["at"]["start"] + 1) * 3
        return F.struct(
            F.substring(seq, start, length).alias("cdr3"),
            F.when(hit.isNotNull(), F.substring(F.rpad(qual, F.length(seq), FILLED), start, length)).alias("qual"),
            F.exists(all_frames, lambda x: x["at"]["status"] > 0).alias("able"),
        )

    return let(found, lambda x: let(F.get(F.filter(x, lambda y: y["at"]["status"] == 3), F.lit(0)), lambda hit: cut(x, hit)))
