"""FASTQ files of BGZF blocks, opened in parts.

bgzip writes gzip files whose blocks can be opened one by one.  Spark doesn't split
files that end in .gz, so one task passes a file's bytes on, unopened, and deals
them out; what costs time, opening blocks and framing records, is done by many.
Blocks are found as those of BAM files are, and records by their form.  What lies
between the records of two parts, a block and a record or two, is put together
afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonespark.sources.bam import MAGIC, block_size, inflated, opened
from clonespark.staging import cut

_ROW = "qname string, seq string, qual string"
_ENDS = "file string, start long, lead binary, head binary, tail binary, open binary"
_MORE = [c.split()[0] for c in _ENDS.split(", ")]


#: Blocks of a part, of up to 64 KiB each.
PART = 256


def of_blocks(spark: SparkSession, path: str, part: int = PART) -> DataFrame | None:
    """(file, start, number, piece): what lies between the marks of blocks, ``part`` of
    them a part; None if a file doesn't consist of BGZF blocks."""
    # with this codec Spark gives the bytes as they are
    codec = spark.sparkContext._jvm.org.apache.hadoop.io.compress.PassthroughCodec
    lines = spark.read.option("io.compression.codecs", codec.CLASSNAME).option(codec.OPT_EXTENSION, ".gz")
    pieces = lines.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path).select("_metadata.file_path", F.col("value").cast("binary").alias("piece"))

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, int] = {}
        for pdf in batches:
            numbers = []
            for file in pdf["file_path"]:
                numbers.append(counts.get(file, 0))
                counts[file] = numbers[-1] + 1
            yield pd.DataFrame({"file": pdf["file_path"], "start": [n // part for n in numbers], "number": numbers, "piece": pdf["piece"]})

    pieces = pieces.mapInPandas(numbered, "file string, start long, number long, piece binary")

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        told: dict[str, list[bytes]] = {}
        for pdf in batches:
            for file, piece in zip(pdf["file"], pdf["piece"], strict=True):
                if len(told.setdefault(file, [])) < 2:
                    told[file].append(bytes(piece))
        yield pd.DataFrame({"plain": [not (len(x) == 2 and not x[0] and block_size(MAGIC + x[1]) is not None) for x in told.values()]})

    return None if not pieces.where("number < 2").mapInPandas(first, "plain boolean").where("plain").isEmpty() else pieces


def framed(text: bytes) -> tuple[list[tuple[str, str, str]], bytes]:
    """(records, the rest) of text that starts with a record; a quality may start with @."""
    lines, out, at, used = text.split(b"\n"), [], 0, 0
    while at + 4 <= len(lines) and (at + 4 < len(lines) or len(lines[at + 3].rstrip(b"\r")) >= len(lines[at + 1].rstrip(b"\r")) > 0):
        name, seq, _, qual = (x.rstrip(b"\r").decode("latin-1") for x in lines[at : at + 4])
        out.append((name.removeprefix("@").split(" ")[0].split("\t")[0], seq.upper(), qual))
        used += sum(map(len, lines[at : at + 4])) + 4
        at += 4
    return out, text[used:]


def lines_of(text: bytes) -> tuple[list[tuple[str, str, str]], bytes]:
    """(records, the rest) of text whose last line may go on."""
    end = text.rfind(b"\n") + 1
    rows, rest = framed(text[:end])
    return rows, rest + text[end:]


def first_record(text: bytes) -> int | None:
    """Where the first record starts of text that starts anywhere: a line with @ two lines before one with +
    whose neighbours are equally long; None if there is none that is whole."""
    at = 0 if text.startswith(b"@") else text.find(b"\n@") + 1
    while at or text.startswith(b"@"):
        lines = text[at:].split(b"\n", 4)
        if len(lines) < 5:
            return None
        if lines[2].startswith(b"+") and len(lines[1].rstrip(b"\r")) == len(lines[3].rstrip(b"\r")) and lines[4][:1] in (b"@", b"", b"\n", b"\r"):
            return at
        found = text.find(b"\n@", at)
        if found < 0:
            return None
        at = found + 1
    return None


def block_records(pieces: DataFrame) -> DataFrame:
    """(qname, seq, qual) of all files."""
    names = [c.split()[0] for c in _ROW.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lines = ((f, s, bytes(p)) for pdf in batches for f, s, p in zip(pdf["file"], pdf["start"], pdf["piece"], strict=True))
        for (file, start), some in groupby(lines, lambda x: x[:2]):
            blocks = (p for _, _, p in some)
            if start == 0:
                next(blocks)  # what precedes the first block: nothing
            rest: dict = {}
            head, buffer = (b"", b"") if start == 0 else (None, b"")
            for data in inflated(blocks, rest):
                buffer += data
                if head is None and (at := first_record(buffer)) is not None:
                    head, buffer = buffer[:at], buffer[at:]
                if head is not None and len(buffer) > 1 << 20:
                    rows, buffer = lines_of(buffer)
                    yield pd.DataFrame(rows, columns=names).assign(**dict.fromkeys(_MORE))
            tail = None
            if head is not None:
                rows, tail = lines_of(buffer)
                if rows:
                    yield pd.DataFrame(rows, columns=names).assign(**dict.fromkeys(_MORE))
            ends = (file, start, rest["lead"], (buffer if head is None else head) if rest["begun"] else None, tail, rest["open"])
            yield pd.DataFrame([(None, None, None, *ends)], columns=[*names, *_MORE])

    def mend(group: pd.DataFrame) -> pd.DataFrame:
        rows, carry, block = [], b"", b""

        def close() -> None:
            """The block that a part began and another one ended."""
            nonlocal carry, block
            if block:
                data = opened(block)
                if data is None:
                    raise ValueError("the FASTQ file ends within a block")
                carry, block = carry + data, b""

        def settle(last: bool) -> None:
            nonlocal carry
            some, left = framed(carry)
            if left.strip():
                raise ValueError("the FASTQ file ends within a record" if last else "the parts of the FASTQ file don't meet at a record")
            rows.extend(some)
            carry = b""

        for lead, head, tail, rest in group.sort_values("start")[["lead", "head", "tail", "open"]].itertuples(index=False):
            block += bytes(lead)
            if head is None:  # all of the part is within a block
                continue
            close()
            carry += bytes(head)
            if tail is not None:
                settle(last=False)
                carry = bytes(tail)
            block += bytes(rest)
        close()
        settle(last=True)
        return pd.DataFrame(rows, columns=names)

    dealt = pieces.repartition("file", "start").sortWithinPartitions("file", "start", "number")
    told = cut(dealt.mapInPandas(run, f"{_ROW}, {_ENDS}"), "fastq")
    inside = told.where("file IS NULL").select(*names)
    # a record or two for each part
    return inside.unionByName(told.where("file IS NOT NULL").select(*_MORE).groupBy("file").applyInPandas(mend, _ROW))
