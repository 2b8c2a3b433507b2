"""What is known of each species and chain, and a run's parameters.

Gene segments and the probability table are read from the user's own files;
nothing of them is kept here.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from clonespark.functions.motif import Motif


@dataclass(frozen=True)
class Chain:
    """File names of V and J segments, anchors, and D genes by name."""

    v_file: str
    j_file: str
    motif: Motif
    d_genes: tuple[tuple[str, str], ...] = ()


# segments' file names, anchor patterns, offsets and D genes of each species and chain.
_CHAINS: dict[tuple[str, str, str], Chain] = {
    ("hs", "TRA", "CDR3"): Chain(
        "TR/hs/TRA/TRAV-gai3-DNA.fa", "TR/hs/TRA/TRAJ-gai2-DNA.fa",
        Motif("[EHILMSTV]{1}Y[FILY]{1}C[AGILV]{1}", "(LA|YI|FI|II|LY|LM|PT|TI|LV|ST|VT|LT|LI|LQ|MR|VI|FV|FQ|LF|LL|FE|FT|LS|LN|FY)F((ARG)|(G[A-Z]{1}G))", 3, 0),
    ),
    ("hs", "TRB", "CDR3"): Chain(
        "TR/hs/TRB/TRBV-gai6-DNA.fa", "TR/hs/TRB/TRBJ-gai3-DNA.fa",
        Motif("(LR|YF|YI|YL|YQ|YR)C(A|S|T|V|G|R|P|D)", "[FTYH]{1}FG[ADENPQS]{1}G", 2, 1, "(CAS|CSA|CAW|CAT|CSV|CAI|CAR)"),
        (("TRBD1*01", "GGGACAGGGGGC"), ("TRBD2*01", "GGGACTAGCGGGGGGG"), ("TRBD2*02", "GGGACTAGCGGGAGGG")),
    ),
    ("hs", "TRG", "CDR3"): Chain(
        "TR/hs/TRGV.fa", "TR/hs/TRGJ.fa",
        Motif("(YY|YH)C(A|T)", "([LV]{1}FG[SP]{1}G)|(IFAEG)|(TFAKG)", 2, 1, "(CAT|CAW|CTT|CAL|CAC|CAA)", "(KLF)|(KVF)|(KIF)|(KTF)"),
    ),
    ("hs", "TRD", "CDR3"): Chain(
        "TR/hs/TRDV.fa", "TR/hs/TRDJ.fa",
        Motif("(YF|YL|YY)C(A|S)", "[I|F]FG[K|T]G", 2, 1),
        (("TRDD1*01", "GAAATAGT"), ("TRDD2*01", "CCTTCCTAC"), ("TRDD3*01", "ACTGGGGGATACG")),
    ),
    ("hs", "IGH", "CDR3"): Chain(
        "IG/hs/IGHV-gai2-DNA.fa", "IG/hs/IGHJ.fa",
        Motif("(LYY|TAV|YVA|TYY|MYY|VYD|AFN|AYY|EYY|THY|VYY|LYH|VDY)C", "[VLHYPIS]{1}WG[QR]{1}G", 3, 1),
    ),
    ("ms", "TRB", "CDR3"): Chain(
        "TR/ms/TRBV-CDR3.fa", "TR/ms/TRBJ-CDR3.fa",
        Motif("[AGPST]{1}C(LHV|FYI|LYF|LFV|FYV|LYL|MYL|LYT|TCY|LYV|FYL|FYT|LYM|LYI|FYM)", "(SF|FF|YF|HF|TF|DH|LF)G[ADMREKLSPH]{1}G", 0, 1, mirrored=1),
    ),
    ("pig", "TRB", "CDR3"): Chain(
        "TR/pig/TRBV-gai1-DNA.fa", "TR/pig/TRBJ-gai1-DNA.fa",
        Motif("(FF|FL|LF|YF|YL|YV)C", "[HILTYFM]{1}FG[ADEGLPS]{1}G", 2, 1, None, "(LH|LI|LT|LY|QH|QI|QY|RY|VF|YN)F"),
        (("TRBD1*01", "GGGACAGGGGGGC"), ("TRBD2*01", "GGAGCTATGGGGGGGG"), ("TRBD3*01", "GGAGCTATGGGGGGGGG")),
    ),
}


class Catalogue:
    """Chains by (species, chain, region); ``register`` adds or replaces one."""

    def __init__(self, chains: dict[tuple[str, str, str], Chain] | None = None):
        self.chains = dict(_CHAINS if chains is None else chains)

    def register(self, species: str, chain: str, region: str, entry: Chain) -> None:
        self.chains[species, chain, region] = entry

    def lookup(self, species: str, chain: str, region: str = "CDR3") -> Chain:
        try:
            return self.chains[species, chain, region]
        except KeyError:
            known = "\n".join("-".join(k) for k in sorted(self.chains))
            raise KeyError(f"{species}-{chain}-{region} is not supported; these are:\n{known}") from None

    def load(self, path: str) -> None:
        """Add entries of a JSON list: species, chain, region, v_file, j_file, motif {...}, d_genes [[name, bases], ...]."""
        with open(path, encoding="utf-8") as f:
            for x in json.load(f):
                entry = Chain(x["v_file"], x["j_file"], Motif(**x["motif"]), tuple((n, s.upper()) for n, s in x.get("d_genes", [])))
                self.register(x["species"], x["chain"], x.get("region", "CDR3"), entry)


#: k follows the mean read length by this ladder unless it is given.
AUTO_K = 10000


@dataclass(frozen=True)
class Params:
    """A run's parameters.  ``impute`` gives reads of one segment the other by
    the k-mers of their end.  ``compat`` keeps the homopolymer rule, the quality
    rule of rescues and the direction of mirrored anchors as they have always been
    (see the README)."""

    species: str = "hs"
    chain: str = "TRB"
    region: str = "CDR3"
    kmer: int = AUTO_K
    min_score: int = 12
    single_cell: bool = False
    max_length: int = 150
    compat: bool = False
    impute: bool = False
    corrected_nn: bool = False
    default_error_rate: float = 0.0031
    catalogue: Catalogue = field(default_factory=Catalogue)

    def entry(self) -> Chain:
        found = self.catalogue.lookup(self.species, self.chain, self.region)
        return replace(found, motif=found.motif.forward()) if self.compat else found

    def with_(self, **changes: object) -> Params:
        return replace(self, **changes)
