"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages (its lines, long ones in stretches of about
``PASSAGE`` bytes at blanks).  A passage is described by measures of its whole
text: shares of kinds of characters, word lengths, repetition, capitals and
marks at word ends.  A small network encodes each passage, h = tanh(W x + b);
gated attention gives it a weight, softmax over the document of
w . (tanh(V h) * sigmoid(U h)); the score is a logistic function of the weighted
mean of the h.  Only documents have labels; the weights are learned from them.

Training takes at most ``max_documents`` labelled ids, those of smallest hash,
one text of each and at most ``max_passages`` evenly spaced passages of it, and
runs on the driver on the passages' measures; scoring is one pass over all whole
texts and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonespark.llm.common import free_name, mapped, others, text_of
from clonespark.llm.near_dedup import BLANK, word_hashes

PASSAGE = 1000

# Kinds of bytes: blank, lower, upper, digit, beyond ASCII, and single marks
_MARKS = ".,|!?#$%&*\"'-:;()=/@"
_KIND = np.full(256, 5 + len(_MARKS), np.uint8)
_KIND[BLANK] = 0
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 4
for _i, _c in enumerate(_MARKS):
    _KIND[ord(_c)] = 5 + _i
KINDS = 6 + len(_MARKS)
MEASURES = KINDS + 9


def passage_bounds(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Starts of the passages: at texts' starts, after line feeds, and at the
    first blank after each PASSAGE bytes of a line; ``ends`` of texts in ``data``."""
    starts = np.union1d(np.append(0, ends[:-1]), np.flatnonzero(data == 10) + 1)
    starts = starts[starts < len(data)]
    sizes = np.diff(np.append(starts, len(data)))
    long = np.flatnonzero(sizes > 2 * PASSAGE)
    if len(long):
        blanks = np.flatnonzero(BLANK[data])
        more = []
        for a, n in zip(starts[long].tolist(), sizes[long].tolist(), strict=True):
            at = np.searchsorted(blanks, np.arange(a + PASSAGE, a + n - PASSAGE, PASSAGE))
            cut = blanks[at[at < len(blanks)]] + 1
            more.append(cut[cut < a + n])
        starts = np.union1d(starts, np.concatenate(more))
    return starts


def measures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(x, counts): a row of MEASURES for each passage, and the number of passages of each text, 1 at least."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    starts = passage_bounds(data, ends)
    sizes = np.diff(np.append(starts, len(data)))
    # line feeds alone say nothing, but a text keeps one passage
    first = np.isin(starts, np.append(0, ends[:-1]))
    keep = (sizes > 1) | first
    owner = np.repeat(np.arange(len(starts)), sizes)
    n = len(starts)
    counts = np.bincount(owner * KINDS + _KIND[data], minlength=n * KINDS).reshape(n, KINDS).astype(np.float64)
    total = np.maximum(counts[:, 1:].sum(1), 1)
    word = ~BLANK[data]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    a, b = edge[::2], edge[1::2]
    of = owner[a] if len(a) else np.zeros(0, np.int64)
    words = np.maximum(np.bincount(of, minlength=n), 1)
    length = (b - a).astype(np.float64)
    mean = np.bincount(of, length, n) / words
    spread = np.sqrt(np.maximum(np.bincount(of, length**2, n) / words - mean**2, 0))
    last = _KIND[data[b - 1]] if len(b) else np.zeros(0, np.uint8)
    capital = np.bincount(of, _KIND[data[a]] == 2, n) / words if len(a) else np.zeros(n)
    marked = np.bincount(of, last >= 5, n) / words
    hashes, _ = word_hashes(texts)
    if len(hashes) != len(a):
        raise AssertionError("words are counted in two ways that must agree")
    distinct = np.zeros(n)
    if len(a):
        order = np.lexsort((hashes, of))
        h, o = hashes[order], of[order]
        new = np.append(True, (h[1:] != h[:-1]) | (o[1:] != o[:-1]))
        distinct = np.bincount(o[new], minlength=n) / words
    repeated = np.zeros(n)
    if len(a) > 1:
        same = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
        repeated = np.bincount(of[1:][same], minlength=n) / words
    x = np.column_stack([
        np.sqrt(counts / total[:, None]), np.log1p(total) / 8, np.log1p(words) / 6, mean / 10, np.minimum(spread / 10, 3),
        capital, marked, distinct, repeated, counts[:, 2] / np.maximum(counts[:, 1] + counts[:, 2], 1),
    ]).astype(np.float32)
    text = np.searchsorted(ends, starts, "right")
    return x[keep], np.bincount(text[keep], minlength=len(texts))


@dataclass
class Attention:
    """Gated attention over passages; ``shift`` and ``scale`` standardise measures."""

    shift: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        """Scores of the bags whose passages stand one after another in ``x``; every bag has one."""
        w = self.w
        bag = np.repeat(np.arange(len(counts)), counts)
        starts = np.append(0, np.cumsum(counts)[:-1])
        z = (x - self.shift) / self.scale
        h = np.tanh(z @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (t * g) @ w["a"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        weight = e / np.add.reduceat(e, starts)[bag]
        m = np.add.reduceat(h * weight[:, None], starts, 0)
        score = 1 / (1 + np.exp(-np.clip(m @ w["c"] + w["d"], -30, 30)))
        return {"bag": bag, "starts": starts, "z": z, "h": h, "t": t, "g": g, "weight": weight, "m": m, "score": score}

    def gradient(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, importance: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.w, self.forward(x, counts)
        bag, h, t, g, weight = f["bag"], f["h"], f["t"], f["g"], f["weight"]
        s = (f["score"] - y) * importance / importance.sum()
        dm = s[:, None] * w["c"]
        dweight = (h * dm[bag]).sum(1)
        de = weight * (dweight - np.add.reduceat(weight * dweight, f["starts"])[bag])
        dt, dg = de[:, None] * w["a"] * g * (1 - t * t), de[:, None] * w["a"] * t * g * (1 - g)
        dh = (weight[:, None] * dm[bag] + dt @ w["V"].T + dg @ w["U"].T) * (1 - h * h)
        return {"W": f["z"].T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ de, "c": f["m"].T @ s, "d": s.sum(keepdims=True)}


def fit(x: np.ndarray, counts: np.ndarray, y: np.ndarray, hidden: int = 16, gate: int = 8, steps: int = 150, seed: int = 1) -> Attention:
    """Maximum likelihood with Adam over all bags, classes weighing the same."""
    draw = np.random.default_rng(seed)
    d = x.shape[1]
    w = {
        "W": draw.normal(0, d**-0.5, (d, hidden)), "b": np.zeros(hidden), "V": draw.normal(0, hidden**-0.5, (hidden, gate)),
        "U": draw.normal(0, hidden**-0.5, (hidden, gate)), "a": draw.normal(0, gate**-0.5, gate), "c": draw.normal(0, hidden**-0.5, hidden), "d": np.zeros(1),
    }
    x = x.astype(np.float64)
    scale = x.std(0) if len(x) else np.ones(d)
    net = Attention(x.mean(0) if len(x) else np.zeros(d), np.where(scale > 1e-6, scale, 1), w)
    if not len(y) or len(set(y.tolist())) < 2:  # one class or none: the score is its share
        net.w = {k: np.zeros_like(v) for k, v in w.items()}
        net.w["d"] = np.array([0.0 if not len(y) else 4.0 if y[0] else -4.0])
        return net
    importance = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    m, v = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}
    for step in range(1, steps + 1):
        rate = 0.02 * (1 - 0.9 * step / steps)
        for k, g in net.gradient(x, counts, y, importance).items():
            g = g + 1e-4 * w[k]
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return net


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    start = 0
    while start < batch.num_rows:
        texts, size = [], 0
        for x in batch.column(column).slice(start):
            texts.append(x.as_py())
            size += len(texts[-1])
            if size > 300_000:
                break
        yield batch.slice(start, len(texts)), texts
        start += len(texts)


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, max_documents: int = 2000, max_passages: int = 500) -> Attention:
    """Learn from ``labels.quality`` of rows that aren't held out.

    At most ``max_documents`` labelled ids, those of smallest hash, so the driver
    gets ``max_documents * max_passages`` rows of MEASURES numbers at most.  Of
    several texts of an id the one of smallest hash is taken; conflicting labels
    of an id count as their mean, rounded up from a half.  Null ids and labels are left out.
    """
    asked = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
        .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_documents)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _parts(batch, 2):
                x, counts = measures(texts)
                stops = np.cumsum(counts)
                rows = []
                for b, n in zip(stops.tolist(), counts.tolist(), strict=True):
                    some = np.unique(np.linspace(b - n, b - 1, min(n, max_passages)).astype(np.int64))
                    rows.append(x[some].tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, pa.binary())], names=["doc_id", "y", "x"])

    # at most max_documents short rows on one side
    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(asked), "doc_id")
    one = F.min(F.struct(F.xxhash64("text"), "text"))["text"]
    texts = texts.groupBy("doc_id", "y").agg(F.encode(one, "UTF-8").alias("text"))
    rows = sorted(mapped(texts, run, "doc_id long, y int, x binary").collect(), key=lambda r: (r["doc_id"], bytes(r["x"])))
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, MEASURES) for r in rows]
    x = np.concatenate(bags) if bags else np.zeros((0, MEASURES), np.float32)
    return fit(x, np.array([len(b) for b in bags], np.int64), np.array([r["y"] for r in rows], np.int64))


def score(docs: DataFrame, net: Attention, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with ``out_col``: 0 to 1, higher for better; a column of that name is replaced.

    Null text: as empty, which is scored as one passage without characters.
    Ids may be null or repeat; equal texts get equal scores; an empty table
    gives no rows.
    """
    kept = others(docs, out_col)
    schema = docs.select(*kept).withColumn(out_col, F.lit(0.0)).schema
    at = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _parts(batch, at):
                x, counts = measures(texts)
                y = net.forward(x.astype(np.float64), counts)["score"]
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(np.round(y, 9))], names=[*kept, out_col])

    return mapped(docs.select(*kept, F.encode(text_of(text_col), "UTF-8").alias(free_name(docs, "text"))), run, schema)
