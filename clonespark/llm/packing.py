"""Packing: documents into fixed-size token sequences, in order, by dynamic programming.

The token stream of a block of documents is cut into windows of at most
``size`` ids.  Cuts may fall at a document's end (free), at a sentence's end
(``sentence_penalty``) or, inside a sentence of more than ``stride`` ids, after
every ``stride`` ids of it (``inside_penalty``).  A window costs its padding: 0
if its length is a power of two, else ``size`` less its length.  The cheapest
chain of cuts is found exactly: with v(i) = cost(i) + place(i), the best window
start within reach is the minimum of v over a sliding range, which a monotone
queue keeps; windows of a power of two of ``min_exact`` ids or more are tried
beside it.

Documents stay in the order of the scan; nothing is shuffled.  A task holds one
block of ``block_ids`` ids (or one longer document) at a time, and makes ids
for ``block_bytes`` of text (or one longer text) at once.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonespark.llm.bpe import Merges
from clonespark.llm.common import give_back, hold, mapped, slices, text_of

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length long, cut string"


#: Words of these characters only are normalised by lower-casing and nothing else.
PLAIN = re.compile("[!-~\xa1-\u024f]+").fullmatch
#: Letters of these, with one mark after them or none.
MARKS = ".,!?:;"
LETTERS = f"^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+[{MARKS}]?$"


class Pieces:
    """Ids of texts by a `tokenizers` file of a BPE with word ends.

    Texts are cut at blanks and line feeds, which neither merges nor
    normalisation cross.  Ids are made once for each distinct word of a block;
    words and their ids are kept as arrays, up to ``keep`` words beside those of
    the last block.  Words of plain Latin letters are one piece, with a mark
    after them two; other plain ones are split by the file's pattern; the merges
    of all new pieces are replayed together.  The rest, and words with a special
    token of the file, go through the library.
    """

    def __init__(self, path: str, keep: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keep = keep
        self.words, self.ids, self.ends = pa.array([""]), np.zeros(0, np.uint32), np.zeros(1, np.int64)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        vocab, end = told["model"]["vocab"], told["model"]["end_of_word_suffix"]
        self.special = [t["content"] for t in told["added_tokens"]]
        if any(" " in t or "\n" in t for t in self.special):
            raise ValueError("special tokens with blanks can't be found within words")
        self.pattern = regex.compile(told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        merges = [x if isinstance(x, list) else x.split(" ") for x in told["model"]["merges"]]
        self.merges = Merges({(vocab[a], vocab[b]): vocab[a + b] for a, b in merges})
        if sorted(self.merges.merged.tolist()) != [vocab[a + b] for a, b in merges]:
            raise ValueError("the ids of merged tokens aren't in the order of the merges")
        # bytes as the file writes them: printable ones as they are, others from U+0100 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = iter(range(256, 512))
        sign = [chr(i) if i in plain else chr(next(others)) for i in range(256)]
        self.byte = np.array([vocab[c] for c in sign], np.int64)
        self.last_byte = np.array([vocab[c + end] for c in sign], np.int64)
        self.sentence_end = np.zeros(max([*vocab.values(), *(t["id"] for t in told["added_tokens"])]) + 1, bool)
        for word, i in vocab.items():
            self.sentence_end[i] = word.endswith((f".{end}", f"!{end}", f"?{end}"))

    def replayed(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after the other, and how many each has."""
        offsets = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
        data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        ids = self.byte[data]
        last = offsets[1:] - offsets[0] - 1
        ids[last] = self.last_byte[data[last]]
        return self.merges.replay_all(ids, np.diff(offsets))

    def learn(self, words: pa.Array) -> None:
        """Ids of words that aren't known, and that aren't empty."""
        plain = pc.match_substring_regex(words, LETTERS)
        easy = words.filter(plain)
        lower = pc.utf8_lower(easy)
        stem = pc.utf8_rtrim(lower, characters=MARKS)
        coded = stem.dictionary_encode()
        split, rest = {}, []
        for w in words.filter(pc.invert(plain)).to_pylist():
            if not PLAIN(w) or "\u0130" in w or "<" in w and any(t in w for t in self.special):
                rest.append(w)
            else:
                split[w] = self.pattern.findall(w.lower())
        number = {p: len(coded.dictionary) + i for i, p in enumerate(dict.fromkeys(p for x in split.values() for p in x))}
        counts, flat = self.replayed(pa.concat_arrays([coded.dictionary, pa.array(number, pa.string())]))

        ids, ends = gathered(flat, counts, coded.indices.to_numpy())
        marked = (pc.binary_length(lower).to_numpy() > pc.binary_length(stem).to_numpy()).nonzero()[0]
        marks = [ord(m) for m in pc.utf8_slice_codeunits(lower.take(pa.array(marked)), -1).to_pylist()]
        each = np.diff(ends)
        each[marked] += 1
        self.add(easy, np.insert(ids, ends[marked + 1], self.last_byte[marks] if marks else []), each)
        if split:
            sizes = np.array([len(x) for x in split.values()], np.int64)
            ids, ends = gathered(flat, counts, np.array([number[p] for x in split.values() for p in x], np.int64))
            self.add(pa.array(split, pa.string()), ids, np.diff(ends[np.concatenate([[0], np.cumsum(sizes)])]))
        if rest:
            told = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
            self.add(pa.array(rest, pa.string()), np.array([i for x in told for i in x], np.uint32), np.array([len(x) for x in told], np.int64))

    def add(self, words: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        self.words = pa.concat_arrays([self.words, words])
        self.ends = np.concatenate([self.ends, np.cumsum(counts) + len(self.ids)])
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])

    def forget(self, kept: np.ndarray) -> None:
        """All but the words at these places."""
        counts = np.diff(self.ends, prepend=0)
        ids, ends = gathered(self.ids, counts, kept)
        self.words, self.ids, self.ends = self.words.take(pa.array(kept)), ids, ends[1:]

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of texts, their ids, how many each has) for slices of ``texts``, in order."""
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        offsets = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        del words
        vocabulary, place = coded.dictionary, coded.indices.to_numpy()
        at = pc.index_in(vocabulary, self.words)
        if at.null_count:
            if len(self.words) > self.keep:
                self.forget(np.union1d(at.drop_null().to_numpy(), pc.index_in(pa.array([""]), self.words).to_numpy()))
            self.learn(vocabulary.filter(at.is_null()))
            at = pc.index_in(vocabulary, self.words)
        place = at.to_numpy()[place]
        del coded, vocabulary, at
        counts = np.diff(self.ends, prepend=0)
        for a, b in slices(np.diff(offsets), 200_000):
            ids, ends = gathered(self.ids, counts, place[offsets[a] : offsets[b]])
            yield b - a, ids, np.diff(ends[offsets[a : b + 1] - offsets[a]])


def gathered(flat: np.ndarray, counts: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The items at ``place`` one after the other, and where they end, from 0 on;
    item i of ``flat`` has ``counts[i]`` values."""
    each = counts[place]
    ends = np.concatenate([[0], np.cumsum(each)])
    at = np.arange(ends[-1])
    at += np.repeat((np.cumsum(counts) - counts)[place] - ends[:-1], each)
    return flat[at], ends


def pieces(path: str) -> Pieces:
    return hold(("pieces", path), lambda: Pieces(path))


def best_cuts(places: np.ndarray, penalties: np.ndarray, size: int, min_exact: int = 64) -> list[int]:
    """Indices of the cheapest chain of cuts from the first place to the last.

    ``places`` increase from 0, neighbours at most ``size`` apart; the penalty
    of the last place is not charged.
    """
    exact: dict[int, list[int]] = {}
    power = min_exact
    while power <= size:
        at = np.searchsorted(places, places - power)
        for j in np.flatnonzero((places >= power) & (places[at] == places - power)).tolist():
            exact.setdefault(j, []).append(int(at[j]))
        power *= 2
    place, penalty, last = places.tolist(), penalties.tolist(), len(places) - 1
    cost, value, before = [0.0] * (last + 1), [0.0] * (last + 1), [0] * (last + 1)
    queue, head = [0], 0
    for j in range(1, last + 1):
        p = place[j]
        while place[queue[head]] < p - size:
            head += 1
        i = queue[head]
        least = value[i] + size - p
        if j in exact:
            for k in exact[j]:
                if cost[k] < least:
                    least, i = cost[k], k
        if j < last:
            least += penalty[j]
        cost[j], before[j] = least, i
        value[j] = v = least + p
        while len(queue) > head and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    chain = [last]
    while chain[-1]:
        chain.append(before[chain[-1]])
    return chain[::-1]


def cut_places(ids: np.ndarray, ends: np.ndarray, sentence_end: np.ndarray, stride: int, sentence_penalty: float, inside_penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Where a stream may be cut, and the penalties; ``ends``: of documents."""
    n = int(ends[-1])
    penalty = np.full(n + 1, -1.0)
    penalty[np.flatnonzero(sentence_end[ids]) + 1] = sentence_penalty
    penalty[0] = penalty[ends] = 0
    places = np.flatnonzero(penalty >= 0)
    gaps = np.diff(places)
    for at, gap in zip(places[:-1][gaps > stride].tolist(), gaps[gaps > stride].tolist(), strict=True):
        penalty[at + stride : at + gap : stride] = inside_penalty
    places = np.flatnonzero(penalty >= 0)
    return places, penalty[places]


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = 2048, id_col: str = "doc_id", text_col: str = "text",
    sentence_penalty: float = 16, inside_penalty: float = 128, stride: int = 64, min_exact: int = 64, block_ids: int = 1_000_000, block_bytes: int = 6_000_000,
) -> DataFrame:
    """Pack ``docs`` into sequences of at most ``size`` ids; a row for each piece.

    doc_id; start and length of the piece within its document's ids, which end
    with ``end_id``; ids (little-endian unsigned 32 bits); doc_tokens;
    sequence_id; offset in the sequence; sequence_length; cut: what the
    sequence's last cut fell on (document, sentence, inside).

    Null and empty texts are documents of one id, ``end_id``.  A null doc_id
    stays null.  Repeated rows are documents of their own.  Among equally cheap
    cuts the one with the longer window wins.  Only the two named columns are
    read, so others cannot clash.  An empty table gives no rows.  A special token
    that a text spells out is that token, as in the library's plain call.
    """
    def of_block(ids: np.ndarray, doc_ids: pa.Array, ends: np.ndarray, first: int) -> tuple[pa.RecordBatch, int]:
        places, penalties = cut_places(ids, ends, pieces(tokenizer).sentence_end, stride, sentence_penalty, inside_penalty)
        chain = best_cuts(places, penalties, size, min_exact)
        cuts, kinds = places[chain], np.where(penalties[chain] == 0, 0, np.where(penalties[chain] == sentence_penalty, 1, 2))
        starts = np.union1d(np.append(0, ends[:-1]), cuts[:-1])
        stops = np.append(starts[1:], ends[-1])
        doc = np.searchsorted(ends, starts, "right")
        seq = np.searchsorted(cuts, starts, "right") - 1
        doc_start = np.append(0, ends[:-1])
        names = np.array(["document", "sentence", "inside"])
        edges = (4 * np.append(starts, ends[-1])).astype(np.int64)
        stored = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(ids)])
        columns = [
            doc_ids.take(pa.array(doc)), pa.array(starts - doc_start[doc]), pa.array(stops - starts), stored.cast(pa.binary()),
            pa.array((ends - doc_start)[doc]), pa.array(first + seq), pa.array(starts - cuts[seq]), pa.array((cuts[1:] - cuts[:-1])[seq]), pa.array(names[kinds[1:]][seq]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")]), first + len(cuts) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 36
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal first, held, total
            doc_ids = pa.concat_arrays([x[0] for x in held])
            out, first = of_block(np.concatenate([x[1] for x in held]), doc_ids, np.cumsum(np.concatenate([x[2] for x in held])), first)
            held, total = [], 0
            return out

        for batch in batches:
            for a, b in slices(pc.binary_length(batch.column(1)).to_numpy(), block_bytes):
                doc_ids = batch.column(0)[a:b]
                for n, ids, counts in pieces(tokenizer).encode(batch.column(1)[a:b]):
                    stops = np.cumsum(counts + 1)
                    ids = np.insert(ids, np.cumsum(counts), end_id)
                    at = 0
                    while at < n:  # a block ends with the document that fills it
                        done = int(stops[at - 1]) if at else 0
                        to = min(n, int(np.searchsorted(stops, done + block_ids - total)) + 1)
                        held.append((doc_ids[at:to], ids[done : stops[to - 1]], counts[at:to] + 1))
                        total += int(stops[to - 1]) - done
                        at = to
                        if total >= block_ids:
                            yield flush()
                    doc_ids = doc_ids[n:]
                give_back()
        if held:
            yield flush()

    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")), run, SCHEMA)
