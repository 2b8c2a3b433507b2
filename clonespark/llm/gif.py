"""Media columns: GIF.

``decode`` reads any GIF87a or GIF89a: sub-blocks, LZW code streams (widths,
clear codes, deferred clears), global and local palettes, interlace, frame
rectangles, delays, disposal and transparency.  ``encode`` stores bytes as an
animation of 8-bit samples under a grey palette, each frame a code stream of its
own with dictionary codes.

The widths of the codes follow from their places since the last clear code, so
codes are read and written as arrays; strings and entries are met one by one.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clonespark.llm.common import mapped, others, text_of

#: Samples in a row of the images that ``encode`` makes; rows in a frame at most.
WIDTH, ROWS = 192, 64
#: Literals after a clear code: one entry fewer than would widen the codes.
RUN = 254
GREY = bytes(x for i in range(256) for x in (i, i, i))


def lzw_literals(samples: bytes) -> bytes:
    """A code stream of 9-bit literals: clear, up to RUN samples, ..., end."""
    data = np.frombuffer(samples, np.uint8)
    runs = -(-len(data) // RUN)
    codes = np.full((runs, RUN + 1), 256, np.uint16)
    whole = len(data) // RUN
    codes[:whole, 1:] = data[: whole * RUN].reshape(whole, RUN)
    flat = codes.ravel()
    if whole < runs:
        rest = data[whole * RUN :]
        flat[whole * (RUN + 1) + 1 : whole * (RUN + 1) + 1 + len(rest)] = rest
        flat = flat[: whole * (RUN + 1) + 1 + len(rest)]
    n = len(flat) + 1
    c = np.zeros((-(-n // 8), 8), np.uint16)
    c.ravel()[: n - 1] = flat
    c.ravel()[n - 1] = 257
    out = np.empty((len(c), 9), np.uint8)
    out[:, 0] = c[:, 0] & 255
    for m in range(1, 8):
        out[:, m] = (c[:, m] << m | c[:, m - 1] >> (9 - m)) & 255
    out[:, 8] = c[:, 7] >> 1
    return out.ravel()[: -(-n * 9 // 8)].tobytes()


def lzw_encode(samples: bytes) -> bytes:
    """A code stream of 8-bit samples: every string that was met gets a code of
    9 to 12 bits; a clear code when all 4,096 are given."""
    codes = [256]
    add, table, new = codes.append, {}, 258
    get = table.get
    rest = iter(samples)
    now = next(rest, -1)
    for x in rest:
        key = now << 8 | x
        known = get(key)
        if known is not None:
            now = known
            continue
        add(now)
        if new < 4096:
            table[key] = new
            new += 1
        else:
            add(256)
            table.clear()
            new = 258
        now = x
    if now >= 0:
        add(now)
    add(257)
    c = np.array(codes, np.int64)
    # the reader has made an entry with each code but the first after a clear
    places = np.arange(len(c))
    clears = np.where(c == 256, places, -1)
    since = places - np.concatenate([[-1], np.maximum.accumulate(clears)[:-1]]) - 1
    entries = 258 + np.maximum(since - 1, 0)
    widths = 9 + (entries >= 512) + (entries >= 1024) + (entries >= 2048)
    ends = np.cumsum(widths)
    starts = ends - widths
    bits = c << (starts & 7)
    at = starts >> 3
    # codes have bits of their own, so that sums are unions
    out = np.bincount(np.concatenate([at, at + 1, at + 2]), np.concatenate([bits & 255, bits >> 8 & 255, bits >> 16]))
    return out.astype(np.uint8)[: int(ends[-1]) + 7 >> 3].tobytes()


def lzw_decode(data: bytes, min_size: int, count: int) -> bytes:
    """``count`` samples at most of a GIF code stream; a broken stream gives what came before the break."""
    if min_size > 8:
        raise ValueError("not a GIF")
    clear = 1 << min_size
    stream = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    fresh = [bytes((i,)) for i in range(clear)] + [b"", b""]
    table, last, since, at, have = fresh.copy(), b"", 0, 0, 0
    out: list[bytes] = []
    while have < count:
        # codes up to the next clear: their widths follow from their places
        n = 512 if since == 0 else 4096
        size = clear + 2 + np.maximum(np.arange(since, since + n) - 1, 0)
        widths = np.full(n, min_size + 1)
        for w in range(min_size + 1, 12):
            widths += size >= 1 << w
        if since == 0:
            widths[0] = min_size + 1
        ends = at + np.cumsum(widths)
        n = int(np.searchsorted(ends, len(data) * 8, "right"))
        ends, widths = ends[:n], widths[:n]
        starts = ends - widths
        byte = starts >> 3
        codes = (stream[byte] | stream[byte + 1] << 8 | stream[byte + 2] << 16) >> (starts & 7) & (1 << widths) - 1
        stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
        stop = int(stops[0]) if len(stops) else n
        told: list[bytes] = []
        add, enter, size = told.append, table.append, len(table)
        whole = True
        for code in codes[:stop].tolist():
            if code < size:
                entry = table[code]
            elif code == size and last:  # the entry just made: its last sample is its first
                entry = last + last[:1]
            else:
                whole = False
                break
            add(entry)
            if last and size < 4096:
                enter(last + entry[:1])
                size += 1
            last = entry
        out += told
        have += sum(map(len, told))
        if not whole or n == 0 or stop < n and codes[stop] == clear + 1:
            break
        if stop < n:
            table, last, since, at = fresh.copy(), b"", 0, int(ends[stop])
        else:
            since, at = since + n, int(ends[-1])
    return b"".join(out)[:count]


def sub_blocks(data: bytes) -> bytes:
    whole = len(data) // 255
    blocks = np.full((whole, 256), 255, np.uint8)
    blocks[:, 1:] = np.frombuffer(data, np.uint8, whole * 255).reshape(whole, 255)
    rest = data[whole * 255 :]
    return blocks.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def encode(payload: bytes, delay: int = 10) -> bytes:
    """A GIF whose frames hold ``payload``, WIDTH samples in a row, ROWS rows in a frame.

    The length is a positive multiple of WIDTH.
    """
    rows = len(payload) // WIDTH
    assert rows and rows * WIDTH == len(payload)
    parts = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, ROWS), 0xF7, 0, 0), GREY]
    for top in range(0, rows, ROWS):
        n = min(ROWS, rows - top)
        parts += [
            b"\x21\xf9\x04", struct.pack("<BHB", 1 << 2, delay, 0), b"\0",
            b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, n, 0),
            b"\x08", sub_blocks(lzw_encode(payload[top * WIDTH : (top + n) * WIDTH])),
        ]
    return b"".join([*parts, b"\x3b"])


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    transparent: int  # an index of the palette, -1: none
    samples: bytes  # palette indices, rows in their order on the screen
    palette: np.ndarray  # (n, 3)
    canvas: np.ndarray  # (screen height, screen width, 3) as shown

    def histogram(self) -> list[int]:
        """Pixels shown by the two high bits of red, green and blue: 64 counts."""
        c = self.canvas.reshape(-1, 3) >> 6
        return np.bincount(c[:, 0] * 16 + c[:, 1] * 4 + c[:, 2], minlength=64).tolist()


def frames(media: bytes) -> Iterator[Frame]:
    """The frames of a GIF, as shown one after another.

    Disposal 2 clears the frame's rectangle to black, 3 brings back what was
    there before; 0 and 1 leave it.  A cut-off file gives its whole frames.
    """
    if media[:6] not in (b"GIF87a", b"GIF89a") or len(media) < 13:
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", media, 6)
    at = 13
    shared = np.zeros((0, 3), np.uint8)
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared = np.frombuffer(media, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    canvas = np.zeros((height, width, 3), np.uint8)
    delay, disposal, transparent = 0, 0, -1

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(media) and media[at]:
            parts.append(media[at + 1 : at + 1 + media[at]])
            at += 1 + media[at]
        return b"".join(parts), at + 1

    while at < len(media):
        kind = media[at]
        if kind == 0x21 and at + 2 < len(media):
            label = media[at + 1]
            body, at = blocks(at + 2)
            if label == 0xF9 and len(body) >= 4:
                packed, hundredths, index = struct.unpack_from("<BHB", body)
                delay, disposal, transparent = hundredths * 10, packed >> 2 & 7, index if packed & 1 else -1
        elif kind == 0x2C and at + 10 < len(media):
            left, top, w, h, packed = struct.unpack_from("<HHHHB", media, at + 1)
            at += 10
            palette = shared
            if packed & 0x80:
                n = 2 << (packed & 7)
                palette = np.frombuffer(media, np.uint8, 3 * n, at).reshape(n, 3)
                at += 3 * n
            min_size = media[at]
            data, at = blocks(at + 1)
            flat = lzw_decode(data, min_size, w * h)
            image = np.zeros(w * h, np.uint8)
            image[: len(flat)] = np.frombuffer(flat, np.uint8)
            image = image.reshape(h, w)
            if packed & 0x40:
                order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
                straight = np.empty_like(image)
                straight[order] = image
                image = straight
            before = canvas.copy() if disposal == 3 else None
            part = canvas[top : top + h, left : left + w]
            inside = image[: part.shape[0], : part.shape[1]]
            colours = np.zeros((256, 3), np.uint8)
            colours[: len(palette)] = palette
            if transparent < 0:
                part[...] = colours[inside]
            else:
                shown = inside != transparent
                part[shown] = colours[inside[shown]]
            yield Frame(left, top, w, h, delay, disposal, transparent, image.tobytes(), palette, canvas)
            if disposal == 2:
                part[...] = 0
            elif before is not None:
                canvas = before
            delay, disposal, transparent = 0, 0, -1
        else:
            break


FRAME = "index int, left int, top int, width int, height int, delay_ms int, disposal int, transparent int, histogram array<int>"


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text as UTF-8, with blanks appended up to
    a positive multiple of WIDTH, in a GIF.

    Null text: as empty.  Null doc_id: stays.  Repeated rows repeat; other
    columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                raw = part.column(1).to_pylist()
                media = [encode(x + b" " * (-len(x) % WIDTH or (0 if x else WIDTH))) for x in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(text_of(text_col), "UTF-8").alias("text"))
    return mapped(rows, run, "doc_id long, n_bytes long, media binary")


def decode_media(df: DataFrame, media_col: str = "media") -> DataFrame:
    """``df`` with, after its columns, ``samples`` (all frames' samples through
    the red of their palettes) and ``frames`` (timed, each with its colour
    histogram); columns of those names are replaced.

    Null media: null for both.  Bytes that aren't a GIF: no frames, empty samples.
    """
    kept = others(df, "samples", "frames")
    schema = T.StructType([*(df.schema[c] for c in kept), *T._parse_datatype_string(f"samples binary, frames array<struct<{FRAME.replace(' ', ':').replace(',:', ',')}>>").fields])
    at = kept.index(media_col)

    def one(media: bytes | None) -> tuple[bytes | None, list | None]:
        if media is None:
            return None, None
        samples, shown = [], []
        try:
            for i, f in enumerate(frames(media)):
                samples.append(f.samples.translate(bytes(f.palette[:, 0].tolist() + [0] * (256 - len(f.palette)))))
                shown.append((i, f.left, f.top, f.width, f.height, f.delay_ms, f.disposal, f.transparent, f.histogram()))
        except (ValueError, struct.error, IndexError):
            pass
        return b"".join(samples), shown

    names = [x.split()[0] for x in FRAME.split(", ")]
    frame_type = pa.list_(pa.struct([(n, pa.list_(pa.int32()) if n == "histogram" else pa.int32()) for n in names]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                found = [one(x) for x in part.column(at).to_pylist()]
                shown = [None if x[1] is None else [dict(zip(names, y, strict=True)) for y in x[1]] for x in found]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x[0] for x in found], pa.binary()), pa.array(shown, frame_type)], names=[*kept, "samples", "frames"])

    return mapped(df.select(*kept), run, schema)
