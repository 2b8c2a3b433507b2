"""CDR3 search for whole tables: Arrow batches in place of nested lambdas.

:func:`clonespark.functions.motif.find_cdr3` says the same as one Column
expression, but higher-order functions aren't compiled; on reads of 150 bases
this operator took a hundredth of its time.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from clonespark.functions.dna import AMINO_ACIDS, FILLED
from clonespark.functions.motif import FARTHEST, NEAREST, Motif

_CODE = np.full(256, 64, np.uint8)
for _i, _c in enumerate("TCAG"):
    _CODE[ord(_c)] = _i
#: By 16 * first + 4 * second + third; X where a base isn't one of the four.
_RESIDUES = np.full(65, ord("X"), np.uint8)
_RESIDUES[:64] = np.frombuffer(AMINO_ACIDS.encode(), np.uint8)


def residues(seqs: list[str]) -> str:
    """The residue of the codon that starts at each base of the joined reads."""
    c = _CODE[np.frombuffer("".join(seqs).encode("ascii", "replace") + b"NN", np.uint8)].astype(np.int64)
    known = (c[:-2] < 64) & (c[1:-1] < 64) & (c[2:] < 64)
    return _RESIDUES[np.where(known, 16 * c[:-2] + 4 * c[1:-1] + c[2:], 64)].tobytes().decode()


@lru_cache(64)
def _patterns(m: Motif) -> tuple[re.Pattern | None, ...]:
    return tuple(re.compile(p) if p else None for p in (m.cmotif, m.fmotif, m.inner_c, m.inner_f))


def pair(peptide: str, cs: list[int], fs: list[int], m: Motif) -> tuple[int, int, int]:
    """(status, start, stop) as the Column expression has it, from where both anchors match."""
    if bool(cs) == bool(fs):
        status = 0
    else:
        status = 2
        _, _, ic, if_ = _patterns(m)
        if cs:
            fs = [x.start() + 3 for x in if_.finditer(peptide)] if if_ else []
        else:
            cs = [x.start() + 1 for x in ic.finditer(peptide)] if ic else []
    for i, xc in enumerate(cs):
        for xf in fs:
            near = i and NEAREST + 1 <= xf - cs[i - 1] <= FARTHEST + 1
            if NEAREST <= xf - xc <= FARTHEST and not near and "*" not in peptide[xc - 1 : xf]:
                return 3, xc, xf
    return status, 0, 0


def _matches(pattern: re.Pattern, peptides: list[str], text: str, starts: np.ndarray, offset: int) -> dict[int, list[int]]:
    """Peptide -> where the pattern matches it, plus ``offset``; ``text``: all peptides, a line each."""
    out: dict[int, list[int]] = {}
    if re.search(r"\[\^|\\[SWDnsxu]|[$^]|\(\?", pattern.pattern):  # may match a line's end or tell one
        for i, peptide in enumerate(peptides):
            if at := [x.start() + 1 + offset for x in pattern.finditer(peptide)]:
                out[i] = at
        return out
    at = np.fromiter((x.start() for x in pattern.finditer(text)), np.int64)
    line = np.searchsorted(starts, at, "right") - 1
    for i, place in zip(line.tolist(), (at - starts[line] + 1 + offset).tolist(), strict=True):
        out.setdefault(i, []).append(place)
    return out


def _anchors(peptides: list[str], m: Motif) -> tuple[dict[int, list[int]], dict[int, list[int]]]:
    """Peptide -> where the C anchor is, and the F anchor, ascending."""
    starts = np.cumsum([0, *(len(p) + 1 for p in peptides[:-1])])
    text = "\n".join(peptides)
    cm, fm, _, _ = _patterns(m)
    fs = _matches(fm, peptides, text, starts, m.foffset)
    if m.mirrored is None:
        return _matches(cm, peptides, text, starts, m.coffset), fs
    turned = [p[::-1] for p in peptides]
    found = _matches(cm, turned, "\n".join(turned), starts, m.mirrored)
    return {i: [len(peptides[i]) + 1 - at for at in reversed(places)] for i, places in found.items()}, fs


def locate(peptide: str, m: Motif) -> tuple[int, int, int]:
    """(status, start, stop) of one peptide."""
    cs, fs = _anchors([peptide], m)
    return pair(peptide, cs.get(0, []), fs.get(0, []), m)


def find(seqs: list[str | None], quals: list[str | None], m: Motif) -> list[tuple[str | None, str | None, bool | None]]:
    """(cdr3, qual, able) of each read; a null read has nulls."""
    joined, peptides, at = residues([s or "" for s in seqs]), [], 0
    for seq in seqs:
        n = len(seq or "")
        peptides += [joined[at + frame : at + n - 2 : 3] if n > 2 else "" for frame in range(3)]
        at += n
    all_c, all_f = _anchors(peptides, m)
    out: list[tuple[str | None, str | None, bool | None]] = []
    for i, (seq, qual) in enumerate(zip(seqs, quals, strict=True)):
        if seq is None:
            out.append((None, None, None))
            continue
        cdr3 = sign = None
        able = False
        for frame in range(3):
            cs, fs = all_c.get(3 * i + frame), all_f.get(3 * i + frame)
            if not cs and not fs:
                continue
            status, c, f = pair(peptides[3 * i + frame], cs or [], fs or [], m)
            able |= status > 0
            if status == 3:
                a, b = 3 * (c - 1) + frame, 3 * f + frame
                cdr3 = seq[a:b]
                sign = None if qual is None else qual.ljust(len(seq), FILLED)[a:b]
                break
        out.append((cdr3, sign, able))
    return out


def find_cdr3(seq: Column | str, qual: Column | str, m: Motif) -> Column:
    """struct<cdr3, qual, able>; see the Column expression of that name."""

    @F.pandas_udf("cdr3 string, qual string, able boolean")
    def run(seqs: pd.Series, quals: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(find(seqs.tolist(), quals.tolist(), m), columns=["cdr3", "qual", "able"])

    return run(seq, qual)
