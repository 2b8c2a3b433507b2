"""BAM: binary alignments as the rows that SAM text gives.

A BAM file is a row of small gzip blocks (BGZF).  Spark's line reader splits it at
the four bytes that each block starts with, so the file is read in parts where
they lie.  Each part looks for the first alignment that starts in it; what lies
before that, and what is left at a part's end, is a few hundred bytes that are put
together afterwards.  They must make whole alignments, which proves that every
part began at the right place.  A file of other gzip streams is one task.
"""

from __future__ import annotations

import gzip
import io
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "qname string, flag int, rname string, pos int, cigar string, as_score int, nm int, seq string, qual string"
_BASES, _OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_PAIRS = [a + b for a in _BASES for b in _BASES]


def _tags(data: bytes) -> dict[str, int]:
    """The whole-number tags."""
    out, at = {}, 0
    while at + 3 <= len(data):
        name, kind, at = data[at : at + 2].decode(), chr(data[at + 2]), at + 3
        if kind in "ZH":
            at = data.index(0, at) + 1
        elif kind == "B":
            size, n = _SIZES[chr(data[at])], struct.unpack_from("<i", data, at + 1)[0]
            at += 5 + size * n
        else:
            if kind in "cCsSiI":
                out[name] = struct.unpack_from({"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}[kind], data, at)[0]
            at += _SIZES[kind]
    return out


def header(data: bytes) -> tuple[int, list[str]] | None:
    """(where the alignments begin, names of the references), None if the data ends before that."""
    if data[:4] != b"BAM\1"[: len(data)]:
        raise ValueError("not a BAM file")
    try:
        at = 8 + struct.unpack_from("<i", data, 4)[0]
        n, names = struct.unpack_from("<i", data, at)[0], []
        at += 4
        for _ in range(n):
            size = struct.unpack_from("<i", data, at)[0]
            names.append(data[at + 4 : at + 3 + size].decode())
            at += 8 + size
    except struct.error:
        return None
    return (at, names) if at <= len(data) else None


def alignment(data: bytes, names: list[str]) -> tuple:
    """A row of an alignment's bytes."""
    ref, pos, l_name, _, _, n_cigar, flag, l_seq = struct.unpack_from("<iiBBHHHi", data)
    at = 32
    name = data[at : at + l_name - 1].decode()
    at += l_name
    cigar = "".join(f"{x >> 4}{_OPS[x & 15]}" for x in struct.unpack_from(f"<{n_cigar}I", data, at)) or "*"
    at += 4 * n_cigar
    seq = "".join(_PAIRS[x] for x in data[at : at + (l_seq + 1) // 2])[:l_seq] or "*"
    at += (l_seq + 1) // 2
    raw = data[at : at + l_seq]
    qual = "*" if not raw or raw[0] == 255 else bytes(x + 33 for x in raw).decode()
    tags = _tags(data[at + l_seq :])
    return name, flag, names[ref] if ref >= 0 else "*", pos + 1, cigar, tags.get("AS"), tags.get("NM"), seq, qual


def whole(data: bytes, at: int, names: list[str]) -> tuple[list[tuple], int]:
    """The alignments that lie wholly in ``data`` from ``at`` on, and where they end."""
    rows = []
    while at + 4 <= len(data):
        size = struct.unpack_from("<i", data, at)[0]
        if at + 4 + size > len(data):
            break
        rows.append(alignment(data[at + 4 : at + 4 + size], names))
        at += 4 + size
    return rows, at


def records(content: bytes) -> Iterator[tuple]:
    """The alignments of a file's bytes; one that ends within an alignment is an error."""
    with gzip.GzipFile(fileobj=io.BytesIO(content)) as f:
        data = f.read(1 << 16)
        while not (told := header(data)):
            more = f.read(1 << 20)
            if not more:
                raise ValueError("the BAM file ends within its header")
            data += more
        at, names = told
        while True:
            rows, at = whole(data, at, names)
            yield from rows
            more = f.read(1 << 20)
            if not more:
                break
            data, at = data[at:] + more, 0
        if at < len(data):
            raise ValueError("the BAM file ends within an alignment")


MAGIC = b"\x1f\x8b\x08\x04"


def block_size(block: bytes) -> int | None:
    """The bytes of a block, as its extra field says; None without one."""
    at, end = 12, 12 + struct.unpack_from("<H", block, 10)[0] if len(block) >= 12 else 0
    while at + 4 <= min(end, len(block)):
        name, size = block[at : at + 2], struct.unpack_from("<H", block, at + 2)[0]
        if name == b"BC" and size == 2 and at + 6 <= len(block):
            return struct.unpack_from("<H", block, at + 4)[0] + 1
        at += 4 + size
    return None


def opened(block: bytes) -> bytes | None:
    """The data of a whole block; None if the bytes aren't one."""
    if block_size(block) != len(block):
        return None
    try:
        return zlib.decompress(block, wbits=31)  # which compares the checksum
    except zlib.error:
        return None


def inflated(pieces: Iterator[bytes], rest: dict[str, bytes]) -> Iterator[bytes]:
    """The data of the blocks; ``pieces`` are what follows each MAGIC of a part.

    A block may hold the four bytes of MAGIC too, and the part may begin or end
    within it: ``rest`` gets ``lead``, what precedes the first block, and
    ``open``, what follows the last one.
    """
    held: list[bytes] = []
    rest["lead"], begun = b"", False
    for piece in pieces:
        held.append(MAGIC + piece)
        while held:
            block = b"".join(held)
            size = block_size(block)
            data = opened(block) if size == len(block) else None
            if data is not None:
                held, begun = [], True
                yield data
            elif size is not None and len(block) < size:
                break
            elif begun:
                raise ValueError("not a file of BGZF blocks")
            else:  # no block starts here: this is still the last part's
                rest["lead"] += held.pop(0)
    if begun:
        rest["open"] = b"".join(held)
    else:
        rest["lead"], rest["open"] = rest["lead"] + b"".join(held), b""
    rest["begun"] = begun


def first_alignment(data: bytes, references: int) -> int | None:
    """The first place from which alignments follow each other up to the data's
    end; None if none starts in it."""

    def fits(at: int) -> int | None:
        """Where the next one starts; None if this can't be an alignment."""
        if at + 36 > len(data):
            return len(data)
        size, ref, pos, l_name, _, _, n_cigar, _, l_seq, other, other_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
        name = data[at + 36 : at + 36 + l_name]
        sound = -1 <= ref < references and -1 <= other < references and pos >= -1 and other_pos >= -1 and l_name > 1 and l_seq >= 0
        sound = sound and 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq <= size and name.find(0) in (l_name - 1, -1 if len(name) < l_name else l_name - 1)
        return at + 4 + size if sound else None

    for start in range(len(data) - 35):
        at: int | None = start
        while at is not None and at < len(data):
            at = fits(at)
        if at is not None:
            return start
    return None


def read_bam(spark: SparkSession, path: str, segment: str, sample_id: str = "", file_idx: int = 1, whole_file: bool = False) -> DataFrame:
    """Alignments of a BAM file, with the columns of SAM text's."""
    names = [c.split()[0] for c in ROW.split(", ")]
    lines = spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    pieces = lines.select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    told = None if whole_file else _header(pieces)
    if told is None:
        found = spark.read.format("binaryFile").load(path).select("content").mapInPandas(lambda batches: _rows_of_files(batches, names), ROW)
    else:
        found = _split(pieces, *told, names)
    return found.select(F.lit(sample_id).alias("sample_id"), F.lit(file_idx).alias("file_idx"), F.lit(segment).alias("segment"), *names)


def _header(pieces: DataFrame) -> tuple[int, list[str]] | None:
    """The header of the file's first blocks; None if they aren't BGZF."""
    n = 8
    while True:
        first = [bytes(r["piece"]) for r in pieces.where("start = 0").select("piece").limit(n).collect()]
        if len(first) < 2 or block_size(MAGIC + first[1]) is None:
            return None
        data = b""
        try:
            for more in inflated(iter(first[1:]), {}):
                data += more
                if told := header(data):
                    return told
        except ValueError:
            if len(first) < n:
                return None
        if len(first) < n:
            return None
        n *= 8


def _rows_of_files(batches: Iterator[pd.DataFrame], names: list[str]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for content in pdf["content"]:
            rows = []
            for r in records(content):
                rows.append(r)
                if len(rows) == 10_000:
                    yield _frame(rows, names)
                    rows = []
            yield _frame(rows, names)


#: Data of a part that the search for its first alignment looks at, at least.
LOOK = 1 << 18


def _split(pieces: DataFrame, begin: int, references: list[str], names: list[str]) -> DataFrame:
    """Alignments of a file's parts, and of what lies between them."""
    more = ["file", "start", "lead", "head", "tail", "open"]
    schema = f"{ROW}, file string, start long, lead binary, head binary, tail binary, open binary"

    def part(data: Iterator[bytes], first: bool) -> Iterator[tuple[list[tuple], bytes | None, bytes | None]]:
        """(rows, head, tail); head: what precedes the first alignment, all if none starts here."""
        buffer, at = b"", None
        for block in data:
            buffer += block
            if at is None:
                if first and len(buffer) >= begin:
                    at = begin
                    yield [], b"", None
                elif not first and len(buffer) >= LOOK and (found := first_alignment(buffer, len(references))) is not None:
                    yield [], buffer[:found], None
                    at = found
            if at is not None:
                rows, at = whole(buffer, at, references)
                yield rows, None, None
                buffer, at = buffer[at:], 0
        if at is None:
            at = first_alignment(buffer, len(references)) if not first else None
            yield [], buffer if at is None else buffer[:at], None
            if at is None:
                return
            rows, at = whole(buffer, at, references)
            yield rows, None, None
        yield [], None, buffer[at:]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from itertools import groupby

        lines = ((f, s, bytes(p)) for pdf in batches for f, s, p in zip(pdf["file"], pdf["start"], pdf["piece"], strict=True))
        for (file, start), some in groupby(lines, lambda x: x[:2]):
            data = (p for _, _, p in some)
            if start == 0:
                next(data)  # what precedes the first block: nothing
            head, tail, rest = None, None, {}
            for rows, h, t in part(inflated(data, rest), start == 0):
                head, tail = h if h is not None else head, t if t is not None else tail
                if rows:
                    yield _frame(rows, names).assign(**dict.fromkeys(more))
            ends = (file, start, rest["lead"], head if rest["begun"] else None, tail, rest["open"])
            yield pd.DataFrame([(*[None] * len(names), *ends)], columns=[*names, *more]).astype({"flag": "Int32", "pos": "Int32", "as_score": "Int32", "nm": "Int32"})

    def mend(group: pd.DataFrame) -> pd.DataFrame:
        rows, carry, block = [], b"", b""

        def close() -> None:
            """The block that a part began and another one ended."""
            nonlocal carry, block
            if block:
                data = opened(block)
                if data is None:
                    raise ValueError("the BAM file ends within a block")
                carry, block = carry + data, b""

        for lead, head, tail, rest in group.sort_values("start")[["lead", "head", "tail", "open"]].itertuples(index=False):
            block += bytes(lead)
            if head is None:  # all of the part is within a block
                continue
            close()
            carry += bytes(head)
            if tail is not None:
                some, at = whole(carry, 0, references)
                if at != len(carry):
                    raise ValueError("the parts of the BAM file don't meet at an alignment: read it with whole_file")
                rows += some
                carry = bytes(tail)
            block += bytes(rest)
        close()
        some, at = whole(carry, 0, references)
        if at < len(carry):
            raise ValueError("the BAM file ends within an alignment")
        return _frame(rows + some, names)

    from clonespark.staging import cut

    told = cut(pieces.mapInPandas(run, schema), "bam")
    inside = told.where("file IS NULL").select(*names)
    # a few hundred bytes for each part
    between = told.where("file IS NOT NULL").select(*more).groupBy("file").applyInPandas(mend, ROW)
    return inside.unionByName(between)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=names)
    return pdf.astype({"as_score": "Int32", "nm": "Int32"}) if rows else pdf
