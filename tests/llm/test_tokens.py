"""Packing and byte-level BPE."""

import base64
import random
import re
import unicodedata
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import tiktoken
from tokenizers import Tokenizer

from clonespark.llm import bpe, packing

from cases import ODD

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ENDS = [(i, "The end. <|endoftext|>" * (i * 7 % 90)) for i in range(60)]
SIGNS = "aaaabA \n\t\x1c\x85　é'st.ΣİI漢字0011١__==😀ñréß|<>"


def texts(n, seed=1):
    draw = random.Random(seed)
    return ["".join(draw.choice(SIGNS) for _ in range(draw.randrange(40))) for _ in range(n)]


def plain_bpe():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTES, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_as_the_library():
    enc, mine = plain_bpe(), bpe.Encoder(BYTES, public_tokenizers.PATTERN)
    some = texts(6000) + ["=" * 501, "a" * 999, " " * 77, "<|endoftext|>"]
    for a in range(0, len(some), 100):
        for t, x in zip(some[a : a + 100], mine.encode(some[a : a + 100]), strict=True):
            assert np.frombuffer(x, "<i4").tolist() == enc.encode_ordinary(t), repr(t)


def test_bpe_operators(odd, empty):
    enc = plain_bpe()
    got = bpe.decode(bpe.encode(odd, BYTES, public_tokenizers.PATTERN).selectExpr("doc_id", "ids", "size(ids) AS n"), BYTES).collect()
    assert sorted((r.n, bytes(r.decoded)) for r in got) == sorted((len(enc.encode_ordinary(t or "")), (t or "").encode()) for _, t in ODD)
    assert bpe.encode(empty, BYTES, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("keep", [300, 500_000])
def test_pieces_as_the_library(keep):
    tok, mine = Tokenizer.from_file(WORDS), packing.Pieces(WORDS, keep=keep)
    draw = random.Random(4)
    some = texts(6000, 2) + ["<|endoftext|> Don't we'LL", "x" * 5000, "hello <|endoftext|> world <|startoftext|>x", "a<|startoftext|>İ<|ENDOFTEXT|>.", ""]
    some += [" ".join(draw.choice(["The", "the,", "Ünd", "naïve.", "é!?", "ŉ", "A.B", "ab.", ",", "word:"]) for _ in range(9)) for _ in range(300)]
    for a in range(0, len(some), 100):
        got = []
        for n, ids, counts in mine.encode(pa.array(some[a : a + 100])):
            assert n == len(counts) and len(ids) == counts.sum()
            got += np.split(ids, np.cumsum(counts)[:-1])
        for t, x in zip(some[a : a + 100], got, strict=True):
            assert x.tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_letters_that_only_change_case():
    some = [c for c in map(chr, range(0x250)) if re.match(packing.LETTERS, c)]
    assert len(some) > 400 and all(unicodedata.category(c)[0] == "L" and unicodedata.normalize("NFC", c) == c for c in some)
    assert pc.utf8_lower(pa.array(some)).to_pylist() == [c.lower() for c in some]


def test_cuts_are_the_cheapest():
    draw = random.Random(5)
    for _ in range(300):
        size, n = 16, draw.randrange(1, 60)
        places = np.array(sorted({0, n} | {i for i in range(n) if draw.random() < 0.4 or i % 8 == 0}))
        penalties = [draw.choice([0, 2, 5]) for _ in places]

        def cost(i, j):
            length = int(places[j] - places[i])
            return (0 if length & (length - 1) == 0 and length >= 4 else size - length) + (penalties[j] if j < len(places) - 1 else 0)

        best = [0] + [10**9] * (len(places) - 1)
        for j in range(1, len(places)):
            best[j] = min(best[i] + cost(i, j) for i in range(j) if places[j] - places[i] <= size)
        chain = packing.best_cuts(places, np.array(penalties, float), size, 4)
        assert chain[0] == 0 and chain[-1] == len(places) - 1 and sum(cost(a, b) for a, b in zip(chain, chain[1:], strict=False)) == best[-1]


@pytest.mark.parametrize("block", [50, 1_000_000])
def test_every_id_is_in_one_piece(table, odd, empty, block):
    tok = Tokenizer.from_file(WORDS)
    for df, rows in ((odd, ODD), (table(ENDS), ENDS)):
        out = packing.pack(df, WORDS, size=256, block_ids=block).collect()
        seqs = defaultdict(list)
        for r in out:
            assert len(r.ids) == 4 * r.length and r.length > 0
            seqs[r.sequence_id].append((r.offset, r.length))
        for parts in seqs.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 256
        want = sorted(tok.encode(t or "", add_special_tokens=False).ids + [1] for _, t in rows)
        by_doc = defaultdict(list)
        for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
            whole = by_doc[r.doc_id, r.doc_tokens]
            if r.start == 0:
                whole.append([])
            assert len(whole[-1]) == r.start
            whole[-1] += np.frombuffer(r.ids, "<u4").tolist()
        assert sorted(x for v in by_doc.values() for x in v) == want
    assert packing.pack(empty, WORDS).count() == 0
