"""The queries by name, their SQL, and expressions that both dialects have.

The driver's tables hold no DNA; it is derived from their keys and texts by the
same expressions in Spark and in SQL.  That exercises operators, not biology.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clonespark.functions import dna
from clonespark.plans.catalogue import Catalogue

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

HEX, BASES = "0123456789abcdef", "ACGTACGTACGTACGT"
SIGNS = "5678ABCDEFGHIJKL"
#: Sense codons for hex digits, so that inserts have no stop in frame.
SENSE = ("GCA", "TGC", "GAC", "GAG", "TTC", "GGA", "CAC", "ATC", "AAG", "CTC", "ATG", "AAC", "CCA", "CAG", "AGA", "TCA")
#: The anchors of one chain.
MOTIF = Catalogue().lookup("hs", "TRB").motif


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dna_of(x: str) -> Column:
    return F.expr(f"translate(md5({x}), '{HEX}', '{BASES}')")


def dna_sql(x: str) -> str:
    return f"translate(md5({x}), '{HEX}', '{BASES}')"


def sense(x: str) -> str:
    """An expression of both dialects: 96 bases without a stop in frame."""
    out = f"md5({x})"
    for digit, codon in zip(HEX, SENSE, strict=True):
        # digits and lower-case letters go in, upper-case ones come out
        out = f"replace({out}, '{digit}', '{codon}')"
    return out


def peptide_sql(seq: str, frame: str) -> str:
    at = lambda k: f"(instr('TCAG', substr({seq}, CAST({frame} + 3 * i + {k} AS BIGINT), 1)) - 1)"
    return f"array_to_string(list_transform(range(0, (length({seq}) - {frame} + 1) // 3), lambda i: substr('{dna.AMINO_ACIDS}', CAST(16 * {at(0)} + 4 * {at(1)} + {at(2)} + 1 AS BIGINT), 1)), '')"


def starts_sql(text: str, pattern: str, offset: int) -> str:
    m, g = f"regexp_extract_all({text}, '{pattern}')", f"string_split_regex({text}, '{pattern}')"
    return f"list_transform(range(1, len({m}) + 1), lambda i: CAST(1 + {offset} + length(array_to_string(list_slice({g}, 1, i), '')) + length(array_to_string(list_slice({m}, 1, i - 1), '')) AS INTEGER))"


def hamming_sql(a: str, b: str, skip: int) -> str:
    return f"len(list_filter(range({skip + 1}, least(length({a}), length({b})) - {skip} + 1), lambda i: substr({a}, i, 1) <> substr({b}, i, 1)))"
