"""Secret scans: fixed patterns, and a linear-chain conditional random field.

Tokens are runs of letters, digits and ``+/_.-``; every other visible character
is a token of its own.  The field tags each token as secret begin, inside or
outside, from its shape (length, kinds of characters, changes of kind, shares of
digits and vowels, longest run without a vowel, hexadecimal only), from its neighbours (the two words before,
by a hash of their last part, so that ``db_password`` and ``clientSecret`` are
told by ``password`` and ``secret``; an assignment sign or quote next to it) and
from the file (how much of it looks like settings or has digits), and is decoded
by Viterbi.

It is trained where it is used, by maximum likelihood over lines that
:func:`training_lines` invents, so it depends on no corpus.  Transitions are
fitted within ``+-BOUND``: a token whose outside score leads by more than they
could ever repay is outside on every best path; chains are cut there, which
makes decoding exact and cheap.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clonespark.llm.common import mapped, others, text_of

#: The patterns of the three kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")

SPANS = "array<struct<kind:string,start:int,end:int>>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the patterns by start, then kind; offsets in code points."""
    found = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "api")):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


# Kinds of characters: 0 blank, 1 lower a-f, 2 lower g-z, 3 upper, 4 digit, 5 joining, 6 beyond ASCII, 7 assignment, 8 quote, 9 other
_KIND = np.full(129, 9, np.uint8)
_KIND[:33] = 0
_KIND[127] = 0
_KIND[[ord(c) for c in "abcdef"]] = 1
_KIND[[ord(c) for c in "ghijklmnopqrstuvwxyz"]] = 2
_KIND[65:91] = 3
_KIND[48:58] = 4
_KIND[[ord(c) for c in "+/_.-"]] = 5
_KIND[128] = 6
_KIND[[ord(c) for c in ":="]] = 7
_KIND[[ord(c) for c in "\"'`"]] = 8
_LENGTHS = np.array([2, 4, 8, 12, 16, 20, 32, 64])
_VOWEL = np.isin(np.arange(129), [ord(c) for c in "aeiouyAEIOUY"])
_PRIME = 0x100000001B3
#: By place in a word's last part; later places don't count.
_POWERS = np.array([*(pow(_PRIME, i + 1, 2**64) for i in range(24)), 0], np.uint64)
#: Hashes of words, and none.
WORDS = 1024
BOUND = 4.0

#: Number of values of each feature; a token has one value of each.
SIZES = (len(_LENGTHS) + 1, 32, 5, 4, 2, 4, 3, 3, 2, 2, 4, 5, 5, WORDS + 1, WORDS + 1)
OFFSETS = np.concatenate([[0], np.cumsum(SIZES)[:-1]])


def tokens_of(code: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(starts, stops, document, features) of the tokens of several texts.

    ``code``: code points, each text followed by a line feed; ``ends``: after that.
    """
    kind = _KIND[np.minimum(code, 128)]
    run = (kind >= 1) & (kind <= 6)
    single = kind >= 7
    step = np.diff(run.astype(np.int8), prepend=0)
    starts = np.flatnonzero((step == 1) | single)
    is_run = run[starts]
    run_stops = np.flatnonzero(np.diff(run.astype(np.int8), append=0) == -1) + 1
    stops = starts + 1
    stops[is_run] = run_stops
    n = len(starts)
    if not n:
        return starts, stops, starts, np.zeros((0, len(SIZES)), np.int32)

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(code) + 1, np.int32)
        np.cumsum(mask, out=total[1:])
        return total[stops] - total[starts]

    length = stops - starts
    low_hex, low, up, digit, joining = (count(kind == k) for k in (1, 2, 3, 4, 5))
    beyond = length - low_hex - low - up - digit - joining
    letter = (kind >= 1) & (kind <= 3)
    change = np.zeros(len(code), bool)
    change[1:] = (letter[1:] & (kind[:-1] == 4)) | (letter[:-1] & (kind[1:] == 4))
    change[starts] = False
    changes = count(change)
    punct = np.where(is_run, 0, np.where(kind[starts] == 7, 1, np.where(kind[starts] == 8, 2, 3)))

    # the last part of a word: after a joining sign, or from a capital letter that follows a small one
    small, capital = (kind == 1) | (kind == 2), kind == 3
    turn = np.zeros(len(code), bool)
    turn[1:] = capital[1:] & small[:-1]
    turns = count(turn) - turn[starts]
    opens = turn.copy()
    opens[1:] |= (kind[:-1] == 5) & (kind[1:] != 5)
    opens[starts] = True
    place = np.arange(len(code))
    first = np.maximum.accumulate(np.where(opens, place, 0))
    lower = np.where(capital, code + 32, code).astype(np.uint64)
    sums = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(np.where((kind >= 1) & (kind <= 3), lower * _POWERS[np.minimum(place - first, 24)], np.uint64(0)), out=sums[1:])
    hashes = sums[stops] - sums[first[stops - 1]]
    own = ((hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(54)).astype(np.int32) + 1
    own[hashes == 0] = 0

    doc = np.searchsorted(ends, starts, "right")
    same = lambda k: doc[k:] == doc[:-k]
    # the nearest two words before the token, up to six tokens back
    words = np.where(is_run & (hashes != 0), np.arange(n), -1)
    last = np.maximum.accumulate(words)
    previous = np.full((2, n), -1)
    previous[0, 1:] = last[:-1]
    known = previous[0] >= 0
    previous[1, known] = previous[0, previous[0, known]]
    near = (previous >= 0) & (np.arange(n) - previous <= 6) & (doc[previous] == doc)
    named = np.where(near, own[previous], 0)
    signed, before, after = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
    for k in (1, 2):
        if n > k:
            signed[k:] = np.where((signed[k:] == 0) & (punct[:-k] == 1) & same(k), k, signed[k:])
    if n > 1:
        before[1:] = np.where(same(1), np.where(punct[:-1] == 2, 2, np.where(punct[:-1] == 0, 0, 1)), 0)
        after[:-1] = np.where(same(1), np.where(punct[1:] == 2, 2, np.where(punct[1:] == 0, 0, 1)), 0)
    docs = len(ends)
    per = np.maximum(np.bincount(doc, minlength=docs), 1)
    settings = np.bincount(doc, punct == 1, docs) / per > 0.04
    digits = np.bincount(doc, digit > 0, docs) / per > 0.15
    share = digit / length
    letters = np.maximum(low_hex + low + up, 1)
    vowel = _VOWEL[np.minimum(code, 128)]
    vowels = count(vowel) / letters
    hard = place - np.maximum.accumulate(np.where(letter & ~vowel, -1, place))
    hard = np.maximum.reduceat(hard, starts)
    features = np.stack(
        [
            np.searchsorted(_LENGTHS, length, "right"),
            (digit > 0) + 2 * (up > 0) + 4 * ((low_hex + low) > 0) + 8 * (joining > 0) + 16 * (beyond > 0),
            np.searchsorted([1e-9, 0.15, 0.4, 0.9], share, "right"),
            np.searchsorted([1, 2, 4], changes, "right"),
            (is_run & (low_hex + digit == length)).astype(np.int32),
            punct, signed, np.maximum(before, after), settings[doc].astype(np.int32), digits[doc].astype(np.int32),
            np.searchsorted([1, 2, 4], turns, "right"), np.searchsorted([1e-9, 0.15, 0.3, 0.5], vowels, "right"),
            np.searchsorted([2, 4, 5, 7], hard, "right"), named[0], named[1],
        ],
        axis=1,
    ).astype(np.int32)
    return starts, stops, doc, features


#: Words that name a secret in the invented lines, and some that stand before them.
NAMES = (
    "password", "passwd", "pwd", "pass", "passphrase", "secret", "secrets", "token", "apikey", "api_key", "api key", "key", "auth", "authorization", "bearer", "basic",
    "credential", "credentials", "private_key", "access_key", "secret_key", "client_secret", "access_token", "refresh_token", "auth_token", "signature", "sig", "pin", "cookie", "session", "license_key", "encryption_key", "pw",
)
OWNERS = ("db", "aws", "user", "admin", "my", "app", "service", "root", "client", "account", "smtp", "mail", "redis", "master", "github", "cloud", "prod", "test", "web", "server")


def training_lines(n: int = 2400, seed: int = 7) -> list[tuple[str, list[tuple[int, int]]]]:
    """Invented lines, and where their secrets are."""
    draw = random.Random(seed)
    lower, upper, digits, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    both = lower + upper + digits
    pick = lambda chars, a, b: "".join(draw.choice(chars) for _ in range(draw.randint(a, b)))
    sound = lambda a, b: "".join(draw.choice("bcdfghjklmnprstvw") + draw.choice("aeiou") + draw.choice(["", "", "n", "r", "st"]) for _ in range(draw.randint(a, b)))

    def word() -> str:
        w = draw.choice([sound(1, 4), sound(1, 3), pick(lower, 1, 3)])
        return draw.choice([w, w, w, w, w.capitalize(), w.upper(), w + draw.choice(".,"), "é" + w, w + draw.choice(["###", "$$$", "%%%", "!!"])])

    def identifier() -> str:
        parts = [sound(1, 2) for _ in range(draw.randint(2, 4))]
        return draw.choice(["_".join(parts), "-".join(parts), ".".join(parts), "_".join(parts).upper(), parts[0] + "".join(p.capitalize() for p in parts[1:]), "/".join(["", *parts]), "_".join(parts) + pick(digits, 1, 2)])

    def name() -> str:
        w = draw.choice(NAMES)
        if draw.random() < 0.4:
            w = f"{draw.choice([*OWNERS, sound(1, 2)])}_{w}"
        parts = w.replace(" ", "_").split("_")
        return draw.choice([w, w, w.upper(), w.replace("_", "-"), parts[0] + "".join(p.capitalize() for p in parts[1:]), w.replace("_", " "), ".".join(parts)])

    def plain() -> str:
        return draw.choice([
            lambda: f"{sound(1, 3)}.{sound(1, 3)}{draw.randint(1, 99)}@{sound(1, 3)}.com",
            lambda: f"+{draw.randint(1, 99)} ({draw.randint(100, 999)}) {draw.randint(100, 999)}-{draw.randint(1000, 9999)}",
            lambda: ".".join(str(draw.randint(0, 255)) for _ in range(4)),
            lambda: f"https://{sound(1, 3)}.example.com/{sound(1, 3)}/{draw.randint(1, 9999)}?{sound(1, 1)}={pick(digits, 1, 6)}",
            lambda: f"https://{sound(1, 3)}.org/{sound(1, 3)}/{sound(1, 3)}-{sound(1, 3)}_{sound(1, 2)}.html",
            lambda: f"{draw.randint(1990, 2030)}-{draw.randint(1, 12):02}-{draw.randint(1, 28):02}T{draw.randint(0, 23):02}:{draw.randint(0, 59):02}:00Z",
            lambda: pick(digits, 1, 16), lambda: f"{pick(digits, 1, 3)}.{pick(digits, 1, 4)}", lambda: f"Version {draw.randint(1, 9)}.{draw.randint(0, 20)}.{draw.randint(0, 9)}-beta{draw.randint(1, 9)}",
            identifier, identifier, lambda: f"{identifier()}({identifier()}, {word()}={draw.choice([pick(digits, 1, 4), identifier()])})", lambda: f"{identifier()} = {identifier()}",
            lambda: f"{sound(1, 3)} = {pick(digits, 1, 5)}", lambda: f"{sound(1, 3)}: {sound(1, 4)}", lambda: f'"{sound(1, 3)}": "{draw.choice([sound(1, 4), identifier(), pick(digits, 1, 9)])}",',
            lambda: f"{sound(1, 2)}_{pick(digits, 8, 8)}_{pick(digits, 4, 6)}.jpg", lambda: f"/{sound(1, 2)}/{sound(1, 2)}3.{draw.randint(1, 20)}/{sound(1, 2)}-{sound(1, 2)}/{sound(2, 3)}.so.{draw.randint(1, 9)}",
            lambda: "CC-BY-NC-" + pick(digits, 1, 1), lambda: f"{pick(upper, 2, 4)}-{pick(digits, 3, 5)}{pick(upper, 0, 1)}", lambda: f"{pick(upper, 1, 2)}{pick(digits, 1, 3)}{pick(upper, 0, 2)}",
            lambda: " ".join(pick(digits, 4, 4) for _ in range(4)), lambda: sound(5, 12), lambda: pick(upper, 4, 14), lambda: pick(hexa, 6, 8), lambda: "0x" + pick(hexa, 2, 8),
            lambda: "-".join(pick(hexa, k, k) for k in (8, 4, 4, 4, 12)),
            lambda: "".join(sound(1, 2).capitalize() for _ in range(draw.randint(2, 4))) + draw.choice(["", "()", "(", "[", ","]), lambda: f"{sound(1, 2)}{pick(digits, 1, 2)}{draw.choice(['', sound(1, 2)])}",
            lambda: f"{sound(1, 2)}={draw.choice(['', chr(34), chr(39)])}{draw.choice([identifier(), sound(1, 2) + pick(digits, 1, 3)])}", lambda: f"<{sound(1, 1)} {draw.choice(['name', 'key', 'id'])}='{draw.choice([identifier, name])()}' value='{draw.choice([sound(1, 3), identifier(), pick(digits, 1, 5)])}'/>",
            lambda: f"{sound(1, 2)}://{sound(1, 3)}:{pick(digits, 2, 5)}/{sound(1, 2)}", lambda: f"{sound(1, 2)}:{sound(1, 2)}@{sound(1, 2)}",
            # names of secrets without one
            lambda: f"{draw.choice(['the', 'a', 'your', 'this', 'no'])} {name()} {draw.choice([sound(1, 3), 'is', 'was', 'of'])} {word()}",
            lambda: f"{name()}{draw.choice([' = ', ': ', '=', ' '])}{draw.choice(['None', 'null', 'true', 'required', 'string', identifier(), identifier() + '()', '', pick(digits, 1, 4), '<' + sound(1, 2) + '>', '${' + identifier() + '}', sound(2, 4)])}",
            lambda: f"{name()} {draw.choice(['limit', 'must be', 'for', 'and', 'in'])} {pick(digits, 1, 4)} {word()}",
        ])()

    def strong() -> str:
        return draw.choice([
            lambda: pick(hexa, 24, 64), lambda: pick(hexa.upper(), 24, 64), lambda: "AKIA" + pick(upper + digits, 16, 16), lambda: pick(both, 20, 44), lambda: pick(both + "+/", 24, 88) + draw.choice(["", "=", "=="]),
            lambda: draw.choice([pick(lower, 2, 4), pick(lower, 2, 4) + "_" + pick(lower, 2, 4)]) + draw.choice("_-") + pick(both, 16, 40), lambda: ".".join(pick(both + "_-", 20, 40) for _ in range(3)), lambda: pick(lower + digits, 24, 40), lambda: pick(upper + digits, 20, 40), lambda: pick(lower, 3, 6) + "-" + pick(both + "_-", 20, 30),
        ])()

    def weak() -> str:
        """Told from words by their names only."""
        return draw.choice([
            lambda: pick(both, 8, 20), lambda: sound(1, 2).capitalize() + pick(digits, 2, 4) + draw.choice(["", "!", "#" + pick(both, 1, 3), "$" + pick(both, 2, 4), "@" + pick(digits, 1, 3)]),
            lambda: sound(1, 2) + draw.choice("-_.") + sound(1, 2) + pick(digits, 2, 4), lambda: pick(both, 4, 8) + draw.choice("!#%&*") + pick(both, 3, 8), lambda: pick(lower, 3, 6) + pick(digits, 2, 6) + pick(lower, 0, 4),
        ])()

    out = []
    for _ in range(n):
        text, spans = "", []

        def put(before: str, value: str, after: str) -> None:
            nonlocal text
            text += before
            spans.append((len(text), len(text) + len(value)))
            text += value + after + draw.choice([" ", " ", "\n"])

        for _ in range(draw.randint(1, 4)):
            roll = draw.random()
            if roll < 0.16:
                quote = draw.choice(['"', "'", "", ""])
                before = draw.choice([" = ", ": ", "=", ":", " := ", " => ", " is ", " "])
                kind = draw.random()
                if kind < 0.5:
                    put(name() + before + quote, draw.choice([weak, strong])() if before not in (" ", " is ") else strong(), quote)
                elif kind < 0.6:
                    put(f'"{name()}": "', draw.choice([weak, strong])(), '",')
                elif kind < 0.7:
                    put(f"{sound(1, 2)}://{sound(1, 2)}:", draw.choice([weak, strong])(), f"@{sound(1, 3)}:{pick(digits, 2, 4)}/{sound(1, 2)}")
                elif kind < 0.8:
                    put(f"{draw.choice(['Authorization: ', '-H ', ''])}{draw.choice(['Bearer', 'bearer', 'Token', 'Basic', 'token'])} ", strong(), quote)
                elif kind < 0.84:
                    put(f"<{sound(1, 1)} {draw.choice(['name', 'key', 'id'])}={quote}{name()}{quote} value='", draw.choice([weak, strong])(), "'/>")
                elif kind < 0.92:
                    put(f"{draw.choice(['--', '-', ';', '&', '?'])}{name()}{draw.choice(['=', ' ', '='])}", draw.choice([weak, strong])(), draw.choice(["", ";", "&"]))
                else:
                    put(quote, strong(), quote)
            elif roll < 0.45:
                text += plain() + draw.choice([" ", "\n"])
            else:
                text += " ".join(word() for _ in range(draw.randint(1, 8))) + draw.choice([" ", " ", " | ", "\n"])
        out.append((text, spans))
    return out


def _code(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    code = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    return code, np.cumsum([len(t) + 1 for t in texts])


@lru_cache(1)
def model(steps: int = 70) -> tuple[np.ndarray, np.ndarray]:
    """(emission weights by feature value and tag, transitions); tags: outside, begin, inside."""
    lines = training_lines()
    code, ends = _code([t for t, _ in lines])
    starts, stops, doc, features = tokens_of(code, ends)
    firsts = np.append(0, ends[:-1])
    gold = np.zeros(len(starts), np.int64)
    for i, (_, spans) in enumerate(lines):
        own = np.flatnonzero(doc == i) if spans else ()
        for a, b in spans:
            at = [t for t in own if starts[t] >= a + firsts[i] and stops[t] <= b + firsts[i]]
            gold[at] = 2
            gold[at[:1]] = 1
    columns = features + OFFSETS
    place = np.arange(len(doc)) - np.searchsorted(doc, doc)
    n, t = len(lines), int(place.max()) + 1
    there = np.zeros((t, n, 1), bool)
    there[place, doc] = True
    weights, moves = np.zeros((sum(SIZES), 3)), np.zeros((3, 3))
    state = [np.zeros_like(x) for x in (weights, weights, moves, moves)]
    one, flat = np.eye(3), columns.ravel()
    follows = (place[1:] > 0).nonzero()[0]
    told = np.zeros((3, 3))
    np.add.at(told, (gold[follows], gold[follows + 1]), 1)
    for step in range(1, steps + 1):
        e = weights[columns].sum(1)
        chance = np.ones((t, n, 3))  # of the tags by their scores alone, 1 beyond a line's end
        chance[place, doc] = np.exp(e - e.max(1, keepdims=True))
        pass_on = np.exp(moves)
        alpha, beta, scale = np.zeros((t, n, 3)), np.ones((t, n, 3)), np.ones((t, n, 1))
        for k in range(t):
            new = (alpha[k - 1] @ pass_on if k else 1) * chance[k]
            scale[k] = new.sum(1, keepdims=True)
            alpha[k] = np.where(there[k], new / scale[k], alpha[k - 1]) if k else new / scale[k]
        expected = np.zeros((3, 3))
        for k in range(t - 2, -1, -1):
            ahead = np.where(there[k + 1], chance[k + 1] * beta[k + 1] / scale[k + 1], 0)
            beta[k] = np.where(there[k + 1], ahead @ pass_on.T, 1)
            expected += alpha[k].T @ ahead
        share = (alpha * beta)[place, doc]
        miss = one[gold] - share
        g = np.stack([np.bincount(flat, np.repeat(miss[:, k], columns.shape[1]), len(weights)) for k in range(3)], 1)
        h = told - expected * pass_on
        for x, grad, m, v in ((weights, g / n - 1e-3 * weights, state[0], state[1]), (moves, h / n - 1e-3 * moves, state[2], state[3])):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            x += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        np.clip(moves, -BOUND, BOUND, out=moves)
    return weights, moves


def viterbi(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best tags of one chain."""
    best, back = scores[0], []
    for e in scores[1:]:
        x = best[:, None] + moves
        back.append(x.argmax(0))
        best = x.max(0) + e
    tags = [int(best.argmax())]
    for b in back[::-1]:
        tags.append(int(b[tags[-1]]))
    return np.array(tags[::-1])


def field_spans(texts: list[str], weights: np.ndarray, moves: np.ndarray) -> list[list[tuple[int, int]]]:
    """The secrets that the field finds in each text."""
    code, ends = _code(texts)
    starts, stops, doc, features = tokens_of(code, ends)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if not len(starts):
        return out
    scores = np.zeros((len(starts), 3))
    for k, offset in enumerate(OFFSETS):
        scores += weights[features[:, k] + offset]
    repay = 2 * (moves.max() - moves.min())
    live = np.flatnonzero(scores[:, 0] - scores[:, 1:].max(1) <= repay)
    if not len(live):
        return out
    # a cut-off token on either side keeps the transitions from and to outside
    breaks = np.flatnonzero((np.diff(live) > 1) | (np.diff(doc[live]) > 0)) + 1
    firsts = np.append(0, ends[:-1])
    for chain in np.split(live, breaks):
        a, b, d = int(chain[0]), int(chain[-1]) + 1, int(doc[chain[0]])
        lead, tail = a > 0 and doc[a - 1] == d, b < len(doc) and doc[b] == d
        e = scores[a:b].copy()
        if lead:
            e[0] += moves[0]
        if tail:
            e[-1] += moves[:, 0]
        open_ = None
        for i, tag in enumerate(viterbi(e, moves).tolist()):
            if open_ is not None and tag != 2:
                out[d].append((open_, int(stops[a + i - 1] - firsts[d])))
                open_ = None
            if tag and open_ is None:
                open_ = int(starts[a + i] - firsts[d])
        if open_ is not None:
            out[d].append((open_, int(stops[b - 1] - firsts[d])))
    return out


def all_spans(texts: list[str], weights: np.ndarray, moves: np.ndarray) -> list[list[tuple[str, int, int]]]:
    """Base spans, and the field's that overlap none of them, by start, then kind."""
    out = []
    for text, added in zip(texts, field_spans(texts, weights, moves), strict=True):
        base = base_spans(text)
        starts, reach = [x for _, x, _ in base], [0, *accumulate((y for _, _, y in base), max)]
        new = [("crf", a, b) for a, b in added if reach[bisect_left(starts, b)] <= a]
        out.append(sorted([*base, *new], key=lambda s: (s[1], KINDS.index(s[0]))))
    return out


def _scanned(docs: DataFrame, text_col: str, mark: str | None, added: list[T.StructField]) -> DataFrame:
    """``docs`` with ``spans`` added, and the text redacted if ``mark`` is given."""
    weights, moves = model()
    kept = others(docs, "spans")
    schema = T.StructType([*(docs.schema[c] for c in kept), *added])
    at = kept.index(text_col)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def redacted(text: str | None, spans: list) -> str | None:
        if not spans:
            return text
        parts, done = [], 0
        for _, a, b in spans:
            if b <= done:
                continue
            if a >= done:
                parts += [text[done:a], mark]
            done = b
        return "".join([*parts, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                texts, size = [], 0
                for x in batch.column(at).slice(start):
                    texts.append(x.as_py())
                    size += len(texts[-1] or "")
                    if size > 500_000:
                        break
                part = batch.slice(start, len(texts))
                start += len(texts)
                spans = all_spans([t or "" for t in texts], weights, moves)
                columns = list(part.columns)
                if mark is not None:
                    columns[at] = pa.array([redacted(t, s) for t, s in zip(texts, spans, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for x in spans], kind)], names=[*kept, "spans"])

    return mapped(docs.select(*kept), run, schema)


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``spans``: (kind, start, end) of every secret, in code points.

    Null and empty texts have none; ids may be null or repeat; a column named
    ``spans`` is replaced; an empty table gives no rows.  Spans of different
    kinds may overlap; ties in start go by kind: assign, access, hex, crf.
    """
    return _scanned(docs, text_col, None, [T.StructField("spans", T._parse_datatype_string(SPANS))])


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """As :func:`scan`, with each span, or run of overlapping ones, replaced by ``mark``."""
    return _scanned(docs, text_col, mark, [T.StructField("spans", T._parse_datatype_string(SPANS))])


def told(spans: str = "spans") -> dict[str, Column]:
    """Counts and the joined form of spans."""

    def joined(x: Column) -> Column:
        return F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    base = F.filter(spans, lambda s: s["kind"] != "crf")
    out = {f"n_{k}": count(k) for k in KINDS[:3]}
    return out | {"base_sha256": F.sha2(joined(base), 256), "spans": joined(F.col(spans))}


def scan_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans as text)."""
    found = scan(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))).select("doc_id", "spans")
    return found.select("doc_id", *[c.alias(k) for k, c in told().items()])
