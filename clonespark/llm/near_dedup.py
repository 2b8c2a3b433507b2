"""MinHash near-dedup: SuperMinHash signatures, banding, verification, union-find.

1. A document's set holds the hashes of its distinct word shingles.  A
   SuperMinHash signature gives each element one value in every register by a
   permutation of its own: the j-th register it visits gets j plus a fraction.
   Once all registers are below j the rest cannot matter and the document is
   done, so long documents take a visit or two an element.
2. Equal sets are one class, which has the smallest of its ids as its node; only
   classes go on.  Texts that share an id are linked by it.
3. Classes that agree on all registers of a band meet in a bucket.  Each is
   first verified against the bucket's hub, the member that meets most others,
   so a group of n near copies costs n pairs, and union-find joins them.
4. What is left are buckets that still hold several components.  Members beside
   the bucket's largest component meet all members as blocks of bounded size;
   pairs of different components are verified there, so hubs lose no link, and
   only links leave the task, never pairs.

Links are confirmed on the full sets.  Candidates come from signatures: with
28 bands of 5 registers a pair at a similarity of 0.8 shares no bucket with a
probability of 2e-5.  Pairs, buckets and components stay distributed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonespark.llm.common import cut, drop, hold, mapped, text_of

BANDS, IN_BAND = 28, 5
REGISTERS = BANDS * IN_BAND
BLOCK = 64
#: Bytes of a text that are hashed at once.
PIECE = 1 << 20
#: Rows of 64 bits of a table that marks ids, at most; 16 bytes each.
MARKS = 1 << 17

U = np.uint64
_draw = np.random.Generator(np.random.PCG64(20240229))
BYTE = _draw.integers(1, 2**64, 256, np.uint64, endpoint=False) | U(1)
BYTE[65:91] = BYTE[97:123]  # A-Z as a-z
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
BASE = U(0x9E3779B97F4A7C15)
BASE_INVERSE = U(pow(int(BASE), -1, 2**64))
SALT = _draw.integers(1, 2**64, 64, np.uint64, endpoint=False) | U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _word_hashes(piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words of a piece that cuts none."""
    size = PIECE * 2
    while size < len(piece):
        size *= 2
    up, down = hold(("powers", size), lambda: (_powers(BASE, size), _powers(BASE_INVERSE, size)))
    word = ~BLANK[piece]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    sums = np.zeros(len(piece) + 1, np.uint64)
    np.cumsum(BYTE[piece] * up[: len(piece)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * SALT[0]), starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of words in each text."""
    lengths = np.array([len(x) + 1 for x in texts], np.int64)
    ends = np.cumsum(lengths)
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    hashes, places, at = [], [], 0
    while at < len(data):
        to = min(len(data), at + PIECE)
        if to < len(data):  # on to the next blank
            while not BLANK[data[to - 1]]:
                step = np.flatnonzero(BLANK[data[to : to + PIECE]])
                to = to + int(step[0]) + 1 if len(step) else min(len(data), to + PIECE)
        h, s = _word_hashes(data[at:to])
        hashes.append(h)
        places.append(s + at)
        at = to
    hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    places = np.concatenate(places) if places else np.zeros(0, np.int64)
    return hashes, np.diff(np.searchsorted(places, ends, "left"), prepend=0)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; fewer words than ``width`` make one, none make none."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    n = len(words) - width + 1
    grams = np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        grams += words[k : k + n] * SALT[1 + k]
    grams = mix(grams)
    out = []
    for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
        start = end - count
        if count >= width:
            out.append(np.unique(grams[start : end - width + 1]))
        elif count:
            out.append(mix((words[start:end] * SALT[1 : 1 + count]).sum(keepdims=True, dtype=np.uint64) + U(count % 2**32) * SALT[40 : 41]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def super_minhash(sets: list[np.ndarray], registers: int = REGISTERS) -> np.ndarray:
    """A row of ``registers`` values for each set: visit number in the high 32 bits, fraction below."""
    full = U(2**64 - 1)
    out = np.full((len(sets), registers), full, np.uint64)
    visit = np.arange(1, registers + 1, dtype=np.uint64) * BASE
    todo = [i for i, s in enumerate(sets) if len(s)]
    for at in range(0, len(todo), 128):
        rows = todo[at : at + 128]
        items = np.concatenate([sets[i] for i in rows])
        owner = np.repeat(np.arange(len(rows)), [len(sets[i]) for i in rows])
        values = np.full((len(rows), registers), full, np.uint64)
        order = None
        for j in range(registers):
            draw = mix(items + visit[j])
            pick = j + ((draw >> U(40)) % U(registers - j)).astype(np.int64)
            if order is None:
                register = pick
            else:
                line = np.arange(len(items))
                register = order[line, pick].astype(np.int64)
                order[line, pick] = order[:, j]
            np.minimum.at(values.reshape(-1), owner * registers + register, U(j) << U(32) | draw & U(0xFFFFFFFF))
            open_ = (values >= U(j + 1) << U(32)).any(1)
            if not open_.any():
                break
            keep = open_[owner]
            if order is None:  # permutations only for sets that need a second visit
                items, owner, pick = items[keep], owner[keep], pick[keep]
                order = np.tile(np.arange(registers, dtype=np.int16), (len(items), 1))
                order[np.arange(len(items)), pick] = 0
            elif not keep.all():
                items, owner, order = items[keep], owner[keep], order[keep]
        out[rows] = values
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, th, n, f1, f2, bands, sig) of (doc_id, text, th): set size, fingerprint, band keys, low 16 bits of the registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                sets = shingle_sets(part.column(1).to_pylist(), width)
                values = super_minhash(sets)
                keys = np.zeros((len(sets), BANDS), np.uint64)
                for k in range(IN_BAND):
                    keys += mix(values[:, k::IN_BAND]) * SALT[10 + k]
                keys = mix(keys + np.arange(1, BANDS + 1, dtype=np.uint64) * SALT[41])
                one = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
                two = np.array([mix(s ^ SALT[42]).sum(dtype=np.uint64) for s in sets], np.uint64)
                low = values.astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(_signed(one)), pa.array(_signed(two)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(_signed(keys.reshape(-1)))),
                        pa.array([x.tobytes() for x in low], pa.binary()),
                    ],
                    names=["doc_id", "th", "n", "f1", "f2", "bands", "sig"],
                )

    return mapped(docs, run, "doc_id long, th long, n long, f1 long, f2 long, bands array<long>, sig binary")


def _parts(batch: pa.RecordBatch, size: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Slices of about ``size`` bytes of text (or one longer text), 256 rows at most."""
    lengths, at, held = np.diff(np.frombuffer(batch.column(1).buffers()[1], np.int32, batch.num_rows + 1 + batch.column(1).offset)[batch.column(1).offset :]), 0, 0
    for i, n in enumerate(lengths.tolist()):
        held += n
        if held >= size or i + 1 - at >= 256:
            yield batch.slice(at, i + 1 - at)
            at, held = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def marked(source: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``source`` whose doc_id is in ``ids``, and some others: those
    whose hash meets a mark.  The marks are a table of at most MARKS rows, so it is
    broadcast, and texts that aren't needed stay where they are read."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(64 * MARKS))
    word, bit = F.shiftright(slot, 6).alias("word"), slot.bitwiseAND(63).cast("int").alias("bit")
    marks = ids.select(word, bit).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("marks"))
    found = source.select("*", word, bit).join(F.broadcast(marks), "word").where("shiftright(marks, bit) & 1 = 1")
    return found.select(*source.columns)


def full_sets(texts: DataFrame, width: int) -> DataFrame:
    """(class, items) of (class, text): the sorted set as bytes of unsigned 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                sets = shingle_sets(part.column(1).to_pylist(), width)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["class", "items"])

    return mapped(texts, run, "class long, items binary")


def _linked(x: pa.Scalar, y: pa.Scalar, percent: int) -> bool:
    p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
    at = np.searchsorted(q, p)
    both = int((q[np.minimum(at, len(q) - 1)] == p).sum())
    return 100 * both >= percent * (len(p) + len(q) - both)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the nodes of the pairs of classes (x, y) with 100 * intersection >= percent * union.

    ``pairs``: x and y, structs of class and node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([_linked(x, y, percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    left, right = sets.select(F.col("class").alias("cx"), F.col("items").alias("sx")), sets.select(F.col("class").alias("cy"), F.col("items").alias("sy"))
    flat = pairs.select(F.col("x.class").alias("cx"), F.col("x.node").alias("a"), F.col("y.class").alias("cy"), F.col("y.node").alias("b"))
    return mapped(flat.join(left, "cx").join(right, "cy").select("a", "b", "sx", "sy"), run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component.

    Union by the smallest neighbour and path shortening, as joins: each node
    hands its smallest neighbour to all its neighbours until only stars are left.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).where("node <> root").distinct(), "edges")
    state = None
    while True:
        told = now.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if tuple(told) == state:
            break
        state = tuple(told)
        both = now.unionByName(now.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = cut(both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("m")), "least")
        known = both.join(least, "node").select(F.col("root").alias("node"), F.col("m").alias("root"))
        new = known.unionByName(least.select("node", F.col("m").alias("root"))).where("node <> root").distinct()
        new = cut(new, "edges")
        drop(now, least)
        now = new
    return now


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs``.

    Words: what ASCII white space separates, A-Z lower-cased.  Documents link if 100 *
    intersection >= ``percent`` * union of their shingle sets.  component_id:
    the smallest id that links reach; kept: whether it is the row's own.

    Null and empty texts and texts without words: no shingles, linked with
    nothing.  Null id: linked with nothing, component_id null, kept.  Equal rows
    get equal results.  Different texts of one id are one document's and linked
    by it, those without shingles apart.  Only the two named columns are read.
    An empty table gives no rows.
    """
    text = text_of(text_col)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(text, "UTF-8").alias("text"), F.xxhash64(text).alias("th"))
    features = cut(signatures(source, width), "signatures")
    said = features.where("n > 0 AND doc_id IS NOT NULL")
    classes = cut(
        said.groupBy("f1", "f2", "n").agg(F.min(F.struct("doc_id", "th")).alias("r"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
        .select("f1", "f2", "n", F.col("r.doc_id").alias("node"), F.col("r.th").alias("th"), "bands", "sig", F.monotonically_increasing_id().alias("class")),
        "classes",
    )
    keys = classes.select("class", "node", "n", F.posexplode("bands").alias("band", "key"))
    crowded = cut(keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "crowded")
    members = cut(keys.join(crowded, "key"), "members")

    weight = cut(members.groupBy("class").agg(F.sum("c").alias("w")), "weight")
    best = F.struct("w", (-F.col("node")).alias("last"), "class", "node", "n")
    hubs = members.join(weight, "class").groupBy("key").agg(F.max(best).alias("h")).select("key", F.struct("h.class", "h.node").alias("hub"), F.col("h.n").alias("hub_n"))
    hubs = cut(hubs, "hubs")
    fits = F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent
    own = F.struct("class", "node")
    met = members.join(hubs, "key").where((F.col("node") != F.col("hub.node")) & fits)
    pairs = cut(met.select(F.greatest(own, F.col("hub")).alias("x"), F.least(own, F.col("hub")).alias("y")).distinct(), "pairs")
    needed = cut(classes.join(weight, "class", "left_semi").select("class", F.col("node").alias("doc_id"), "th"), "needed")
    # rows that repeat an id and a text are one before they meet
    once = marked(source, needed).dropDuplicates(["doc_id", "th"])
    sets = cut(full_sets(once.join(needed, ["doc_id", "th"]).select("class", "text"), width), "sets")
    links = verify(pairs, sets, percent)
    # ids that have texts of several classes
    kind = F.struct("f1", "f2", "n")
    shared = cut(said.groupBy("doc_id").agg(F.min(kind).alias("lo"), F.max(kind).alias("hi")).where("lo <> hi").select("doc_id"), "shared")
    if not shared.isEmpty():
        by_id = said.join(shared, "doc_id").join(classes.select("f1", "f2", "n", "node"), ["f1", "f2", "n"]).select("doc_id", "node").distinct()
        links = links.unionByName(by_id.where("node <> doc_id").select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
    roots = components(cut(links, "links"))

    # buckets of several components: members beside the largest one meet all members
    named = members.where("c > 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = named.groupBy("key", "root").agg(F.count("*").alias("k"))
    split = parts.groupBy("key").agg(F.max(F.struct("k", (-F.col("root")).alias("last"))).alias("most"), F.sum("k").alias("c")).where("most.k < c")
    split = cut(split.select("key", (-F.col("most.last")).alias("major"), (F.col("c") - F.col("most.k")).alias("minors")), "split")
    told = named.join(split, "key").withColumn("minor", F.col("root") != F.col("major"))
    told = cut(told.select("key", "band", "class", "node", "n", "root", "minor", F.ceil(F.col("minors") / BLOCK).cast("int").alias("lb"), F.ceil(F.col("c") / BLOCK).cast("int").alias("rb")), "met")
    data = classes.select("class", "sig").join(told.select("class").distinct(), "class", "left_semi").join(sets, "class")
    told = told.join(cut(data, "data"), "class")
    item = F.struct("node", "root", "n", "minor", "sig", "items")

    def in_block(of: str) -> Column:
        return F.pmod(F.xxhash64("class"), F.col(of)).cast("int")

    left = told.where("minor").groupBy("key", "band", "rb", in_block("lb").alias("block")).agg(F.collect_list(item).alias("members"))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("rb") - 1)))
    right = told.groupBy("key", in_block("rb").alias("other")).agg(F.collect_list(item).alias("others"))
    links2 = cut(mapped(left.join(right, ["key", "other"]).select("band", "members", "others"), _settled(percent), "a long, b long").distinct(), "links")
    if not links2.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links2))

    whole = features.select("doc_id", F.col("n").alias("n_shingles"), "f1", "f2").join(classes.select("f1", "f2", F.col("n").alias("n_shingles"), "node"), ["f1", "f2", "n_shingles"], "left")
    whole = whole.join(roots, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "node", "doc_id"))
    return whole.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _settled(percent: int):
    """Links between two blocks of a bucket's members: a pair is looked at in
    the first band that it shares, if its components differ, its sizes fit, and
    its signatures agree as often as a link's would, less 4.4 standard
    deviations; it is confirmed on the full sets unless links found here have
    joined the two already."""
    share = percent / 100
    least = (share - 4.4 * (share * (1 - share) / REGISTERS) ** 0.5) * REGISTERS

    def block(column, i) -> tuple:
        items = column[i].values
        ids, roots, n, minor = (items.field(k).to_numpy(zero_copy_only=False) for k in ("node", "root", "n", "minor"))
        return ids, roots, n, minor, np.frombuffer(b"".join(items.field("sig").to_pylist()), np.uint16).reshape(len(ids), REGISTERS), items.field("items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                band = batch.column(0)[i].as_py()
                (x, rx, nx, _, sx, ix), (y, ry, ny, my, sy, iy) = block(batch.column(1), i), block(batch.column(2), i)
                fit = (rx[:, None] != ry) & (np.minimum(nx[:, None], ny) * 100 >= np.maximum(nx[:, None], ny) * percent)
                fit &= ~my | (x[:, None] > y)  # two beside the largest component meet from both sides
                p, q = np.nonzero(fit)
                same = sx[p] == sy[q]
                near = (same.sum(1) >= least) & (same.reshape(-1, BANDS, IN_BAND).all(2).argmax(1) == band)
                of: dict[int, int] = {}

                def find(r: int) -> int:
                    while r in of:
                        r = of[r]
                    return r

                out = []
                for a, b in zip(p[near].tolist(), q[near].tolist(), strict=True):
                    ra, rb = find(int(rx[a])), find(int(ry[b]))
                    if ra != rb and _linked(ix[a], iy[b], percent):
                        of[max(ra, rb)] = min(ra, rb)
                        out.append((max(int(x[a]), int(y[b])), min(int(x[a]), int(y[b]))))
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], names=["a", "b"])

    return run
