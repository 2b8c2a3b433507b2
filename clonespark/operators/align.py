"""Assigning reads to gene segments, and what is measured on the assignments.

``align`` finds, for each read, the segment with the best local alignment (match
+1, mismatch -2, a gap of n bases -6 - n, both strands).  Seeds of ``k`` equal bases
tell the diagonals; the best stretch of each segment's best diagonal is scored, and
where a gap can pay, the alignment is extended from its middle to both sides by
dynamic programming in a band, until it has lost ``DROP``.  Segments are a
catalogue of a few hundred short sequences whose size is checked; their seed
table goes to every task, so reads are aligned where they lie, without a
shuffle.  A task works on whole batches of reads as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonespark.functions.dna import cigar_ops

ALIGNMENT = "sample_id string, file_idx int, segment string, qname string, flag int, rname string, pos int, cigar string, as_score int, nm int, seq string, qual string"
#: Bases of all segments together, at most.
MAX_CATALOGUE = 20_000_000
#: Segments, at most.
MAX_SEGMENTS = 200_000
#: The scores of a match, of a mismatch, and of a gap, at its start and for each base.
MATCH, MISMATCH, OPEN, EXTEND = 1, -2, 6, 1
#: Seed hits and cells of the score matrix that a task holds at once; cells of a step of an extension.
HITS, CELLS, STEP = 4_000_000, 4_000_000, 1 << 15
#: Diagonals to either side of the first one, at least, that an extension may go over to: beyond, a stretch needs a seed.
BAND = 12
#: What an extension may lose against its best before it ends.
DROP = 30
#: Bases after which most extensions have ended; the others are done again, whole.
SOON = 40
#: Bases of a seed, at most, for a table of all seeds (4 bytes each).
TABLED = 10
FAR = -(10**6)
_BACK = str.maketrans("ACGTN", "TGCAN")
_CODE = np.full(256, 4, np.uint8)
_CODE[np.frombuffer(b"ACGT", np.uint8)] = range(4)


def coded(text: str) -> np.ndarray:
    """0 to 3 for A, C, G and T, 4 for other signs."""
    return _CODE[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]


def rolled(code: np.ndarray, k: int) -> np.ndarray:
    """The number of the k bases that start at each place, -1 if they aren't all known."""
    n = max(0, len(code) - k + 1)
    out, done, power, size = np.zeros(n, np.int64), 0, code.astype(np.int64), 1
    # numbers of 1, 2, 4... bases, of which k's bits tell the parts
    while done < k:
        if k & size:
            out = (out << 2 * size) + power[done : done + n]
            done += size
        if done < k:
            power = (power[: max(0, len(power) - size)] << 2 * size) + power[size:]
            size *= 2
    unknown = np.concatenate([[0], np.cumsum(code > 3)])
    return np.where(unknown[k : k + n] > unknown[:n], -1, out)


def most(overlap: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """The best score that ``overlap`` bases of which ``seeds`` windows of ``k``
    agree can have: a mismatch spoils k windows at most, a base left out at an
    end one."""
    missing = np.maximum(0, overlap - k + 1) - seeds
    if k < MATCH - MISMATCH:
        return np.asarray(overlap)
    return overlap * MATCH - (MATCH - MISMATCH) * (missing // k) - np.minimum(MATCH - MISMATCH, missing % k * MATCH)


def stretches(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, start, stop) of each row's best stretch, the first and shortest of several; stop is exclusive."""
    total = np.zeros((len(steps), steps.shape[1] + 1), np.int32)
    np.cumsum(steps, axis=1, out=total[:, 1:])
    low = np.minimum.accumulate(total, axis=1)
    gain = total - low
    stop = gain.argmax(1)
    rows = np.arange(len(steps))
    place = np.arange(total.shape[1])
    start = np.where((total == low[rows, stop][:, None]) & (place <= stop[:, None]), place, 0).max(1)
    return gain[rows, stop], start, stop


def gain(left: np.ndarray, right: np.ndarray, wrong: np.ndarray, seeded: np.ndarray, k: int) -> np.ndarray:
    """The most that gaps can add to a stretch with ``wrong`` mismatches and so many free bases at its sides.

    A gap may open inside the stretch, before some of its mismatches, and then goes on over its free bases;
    without a seed at most k - 1 of those are equal in a row.
    """

    def most_of(free: np.ndarray) -> np.ndarray:
        rows, rest = np.divmod(free, k)
        return np.where(seeded, free * MATCH, rows * ((k - 1) * MATCH + MISMATCH) + rest * MATCH)

    spared, gap = (MATCH - MISMATCH) * wrong, OPEN + EXTEND
    left, right = most_of(left) - gap, most_of(right) - gap
    return np.maximum(0, np.maximum(np.maximum(left, right), left + right) + spared)


def extensions(x: np.ndarray, y: np.ndarray, keep: bool = False) -> tuple[np.ndarray, ...]:
    """(best score, its row, its diagonal, whether it hasn't ended) of each column's alignment from the first bases on, and the
    matrices; diagonals and matrices only if ``keep``.

    ``x``: [base, pair]; ``y``: [base, pair] with as many bases more as there are diagonals
    besides the middle one, so that row i meets ``y[i : i + diagonals]``.  Signs that
    aren't bases differ on both sides.  Affine gaps; the end is free.
    """
    steps, pairs = x.shape
    band = len(y) - steps + 1
    half = band // 2
    kind = np.int16 if steps + band < 5000 else np.int32
    low = np.iinfo(kind).min // 2
    place = np.arange(band, dtype=kind)[:, None]
    rise, fall = place * kind(EXTEND), place * kind(EXTEND) + kind(OPEN)
    h = np.where(place > half, -OPEN - EXTEND * (place - half), np.where(place == half, 0, low)).astype(kind).repeat(pairs, axis=1)
    e = np.full_like(h, low)
    best, row, diagonal = np.zeros(pairs, kind), np.full(pairs, -1), np.full(pairs, half)
    active, going, kept = np.arange(pairs), np.ones(pairs, bool), []
    for i in range(steps):
        h += (y[i : i + band] == x[i]) * kind(MATCH - MISMATCH)
        h += kind(MISMATCH)
        new = np.full_like(e, low)
        np.maximum(before[1:] - kind(OPEN + EXTEND) if i else first_open(h.shape, half, kind), e[1:] - kind(EXTEND), out=new[:-1])
        e = new
        np.maximum(h, e, out=h)
        f, near = np.empty_like(h), 1
        np.add(h[:-1], rise[:-1], out=f[1:])
        f[0] = low
        while near < band - 1:  # the largest of all diagonals before, by doubling
            further = f.copy()
            np.maximum(f[near:], f[:-near], out=further[near:])
            f, near = further, 2 * near
        f -= fall
        np.maximum(h, f, out=h)
        before = h.copy()
        if keep:
            kept.append((h.copy(), e.copy(), f))
        top = h.max(axis=0)
        better = np.flatnonzero(top > best[active])
        if len(better):
            best[active[better]], row[active[better]] = top[better], i
            if keep:
                diagonal[better] = h[:, better].argmax(axis=0)
        if not keep and (i % 8 == 7 or i == steps - 1):
            on = top >= best[active] - DROP
            going[active[~on]] = False
            if not on.any():
                break
            if on.mean() < 0.7:
                active, h, e, before, x, y = active[on], h[:, on], e[:, on], before[:, on], x[:, on], y[:, on]
    return best.astype(np.int64), row, diagonal, going, kept


def first_open(shape: tuple[int, int], half: int, kind: type) -> np.ndarray:
    """What a gap in the segment costs that opens before the first base."""
    out = np.full((shape[0] - 1, shape[1]), np.iinfo(kind).min // 2, kind)
    out[half - 1] = -OPEN - EXTEND
    return out


def traced(kept: list[tuple[np.ndarray, ...]], x: np.ndarray, y: np.ndarray, pair: int, row: int, diagonal: int, gaps_first: bool) -> list[tuple[int, int]]:
    """(row, diagonal) of the aligned bases, from the last to the first; of equal ways a gap comes as late or as early as it may."""
    half = len(kept[0][0]) // 2 if kept else 0
    out, i, k = [], row, diagonal
    at = lambda i, k: int(kept[i][0][k, pair]) if i >= 0 else (0 if k == half else -OPEN - EXTEND * (k - half) if k > half else FAR)
    while i >= 0:
        h, e, f = (int(m[k, pair]) for m in kept[i])
        matched = h - at(i - 1, k) == (MATCH if x[i, pair] == y[i + k, pair] else MISMATCH)
        if h in (e, f) and (gaps_first or not matched):
            n = 1
            if h == f:
                while at(i, k - n) - OPEN - EXTEND * n != f:
                    n += 1
                k -= n
            else:
                while at(i - n, k + n) - OPEN - EXTEND * n != e:
                    n += 1
                i, k = i - n, k + n
            continue
        out.append((i, k))
        i -= 1
    return out


class Segments:
    """Segments and where their seeds are."""

    def __init__(self, refs: list[tuple[str, str]], k: int):
        self.k, self.names = k, [n for n, _ in refs]
        self.length = np.array([len(s) for _, s in refs], np.int64)
        self.code = coded("".join(s + "N" for _, s in refs))
        self.begin = np.cumsum(self.length + 1) - self.length - 1
        words = rolled(self.code, k)
        at = np.flatnonzero(words >= 0)
        at = at[np.argsort(words[at], kind="stable")]
        self.words, self.first, self.count = np.unique(words[at], return_index=True, return_counts=True)
        self.segment = np.searchsorted(self.begin, at, "right") - 1
        self.place = at - self.begin[self.segment]
        self.table: np.ndarray | None = None

    def slots(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the words that some segment has, where these are among ``self.words``)."""
        if self.k > TABLED:
            known = np.flatnonzero(words >= 0)
            slot = np.minimum(np.searchsorted(self.words, words[known]), max(0, len(self.words) - 1))
            return tuple(x[self.words[slot] == words[known]] for x in (known, slot)) if len(self.words) else (known[:0], slot[:0])
        if self.table is None:  # made by each task's worker, not sent; the last place is that of unknown words, -1
            self.table = np.full(4**self.k + 1, -1, np.int32)
            self.table[self.words] = np.arange(len(self.words))
        slot = self.table[words]
        known = np.flatnonzero(slot >= 0)
        return known, slot[known]

    def best(self, reads: list[str], min_score: int) -> dict[int, tuple]:
        """Read -> (score, segment, strand, [(shift, start, stop)]) of its best alignment.

        Of equal scores the smaller name, then the forward strand, then the smaller shift wins.
        """
        n, k = len(reads), self.k
        fore = coded("".join(s + "N" for s in reads))
        code = np.concatenate([fore, np.where(fore < 4, 3 - fore, 4)[::-1]])
        length = np.array([len(s) for s in reads], np.int64)
        begin = np.cumsum(length + 1) - length - 1
        # the sides of a read: itself, and turned; sides in the order of their places
        sides = np.concatenate([begin, (2 * len(fore) - begin - length)[::-1]])
        number = np.concatenate([2 * np.arange(n), 2 * np.arange(n)[::-1] + 1])
        words = rolled(code, k)
        known, slot = self.slots(words)
        count = self.count[slot]
        if n > 1 and count.sum() > HITS:
            half = n // 2
            return self.best(reads[:half], min_score) | {half + i: x for i, x in self.best(reads[half:], min_score).items()}
        if not len(known):
            return {}
        at = np.searchsorted(sides, known, "right") - 1
        hit = np.repeat(self.first[slot] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        spread = int(length.max() + self.length.max()) + 1
        shift = self.place[hit] - np.repeat(known - sides[at], count) + int(length.max())
        keys, votes = np.unique((np.repeat(number[at], count) * len(self.names) + self.segment[hit]) * spread + shift, return_counts=True)
        group, shift = keys // spread, keys % spread - int(length.max())
        side, segment = group // len(self.names), group % len(self.names)
        start = np.empty(2 * n, np.int64)
        start[number] = sides
        read = side // 2
        a, b = np.maximum(0, -shift), np.minimum(length[read], self.length[segment] - shift)
        bound = most(b - a, votes, k)

        def steps_of(places: np.ndarray) -> np.ndarray:
            """A row for each place, from its first base on."""
            width = np.arange(int((b - a)[places].max()))
            inside = width < (b - a)[places][:, None]
            x = code[np.minimum((start[side] + a)[places][:, None] + width, len(code) - 1)]
            y = self.code[np.minimum((self.begin[segment] + a + shift)[places][:, None] + width, len(self.code) - 1)]
            return np.where(inside & (x == y) & (x < 4), MATCH, MISMATCH).astype(np.int32)

        score, x, y = (np.full(len(keys), v, np.int64) for v in (FAR, 0, 0))
        limit = np.full(n, min_score, np.int64)

        def settle(places: np.ndarray) -> None:
            rows = max(1, CELLS // int((b - a).max()))
            for i in range(0, len(places), rows):
                some = places[i : i + rows]
                score[some], x[some], y[some] = stretches(steps_of(some))
            np.maximum.at(limit, read[places], score[places])

        # the place that promises most of each read, then all that may be as good
        order = np.lexsort((-bound, read))
        top = order[np.flatnonzero(np.diff(read[order], prepend=-1))]
        settle(top)
        settle(np.flatnonzero((bound >= limit[read]) & (score == FAR)))
        order = np.lexsort((shift, side % 2, segment, -score, read))
        order = order[np.flatnonzero(np.diff(read[order], prepend=-1))]
        found = {int(read[i]): (int(score[i]), int(segment[i]), int(side[i] % 2), [(int(shift[i]), int(a[i] + x[i]), int(a[i] + y[i]))]) for i in order.tolist() if score[i] >= min_score}

        # one diagonal of each segment is the middle of a band in which gaps may pay
        edges = np.flatnonzero(np.diff(group, prepend=-1))
        sizes = np.diff(np.append(edges, len(group)))
        order = np.lexsort((-bound, -score, group))
        middle = order[edges]
        settle(middle[score[middle] == FAR])
        far = np.maximum(shift[edges + sizes - 1] - shift[middle], shift[middle] - shift[edges])
        left = np.minimum(a[middle] + x[middle], a[middle] + x[middle] + shift[middle])
        right = np.minimum(length[read[middle]] - a[middle] - y[middle], self.length[segment[middle]] - a[middle] - y[middle] - shift[middle])
        wrong = (y[middle] - x[middle] - score[middle]) // (MATCH - MISMATCH)
        more = gain(left, right, wrong, sizes > 1, k)
        far = np.minimum(far, np.maximum(left, right) + (MATCH - MISMATCH) * wrong)  # a longer gap costs more than the rest can give
        half = BAND << np.ceil(np.log2(np.maximum(far + 4, BAND) / BAND)).astype(np.int64)
        total = np.where(more > 0, score[middle] + more, FAR)
        reach = np.full(len(middle), FAR, np.int64)

        def extend(chosen: np.ndarray) -> None:
            for width in np.unique(half[chosen]).tolist():
                some = chosen[half[chosen] == width]
                for i in range(0, len(some), max(1, STEP // (2 * width + 1))):
                    part = some[i : i + max(1, STEP // (2 * width + 1))]
                    places = middle[part]
                    cell = a[places] + self._anchor(places, steps_of, x, y)
                    reach[part] = MATCH
                    for way in (1, -1):
                        added, _, _, going, _ = extensions(*window(places, cell, width, way, SOON))
                        if len(again := np.flatnonzero(going)):
                            added[again] = extensions(*window(places[again], cell[again], width, way))[0]
                        reach[part] += added
            np.maximum.at(limit, read[middle[chosen]], reach[chosen])

        def window(places: np.ndarray, cell: np.ndarray, width: int, way: int, most_steps: int = 1 << 30) -> tuple[np.ndarray, np.ndarray]:
            """The bases of reads and segments from a cell on, to the right or the left, as :func:`extensions` takes them."""
            r, t = cell, cell + shift[places]
            n_read, n_segment = (length[read[places]] - 1 - r, self.length[segment[places]] - 1 - t) if way > 0 else (r, t)
            steps = min(most_steps, int(np.minimum(n_read, n_segment + width).max(initial=0)))
            i, j = np.arange(steps)[:, None], np.arange(steps + 2 * width)[:, None] - width
            bases = code[np.clip(start[side[places]] + r + way * (i + 1), 0, len(code) - 1)]
            signs = self.code[np.clip(self.begin[segment[places]] + t + way * (j + 1), 0, len(self.code) - 1)]
            inside = (t + way * (j + 1) >= 0) & (t + way * (j + 1) < self.length[segment[places]])
            return np.where((i < n_read) & (bases < 4), bases, 7).astype(np.uint8), np.where(inside & (signs < 4), signs, 8).astype(np.uint8)

        hopeful = np.flatnonzero((total >= limit[read[middle]]) & (total > FAR))
        order = hopeful[np.lexsort((-score[middle[hopeful]], read[middle[hopeful]]))]
        top = order[np.flatnonzero(np.diff(read[middle[order]], prepend=-1))]
        extend(top)
        extend(hopeful[(total[hopeful] >= limit[read[middle[hopeful]]]) & (reach[hopeful] == FAR)])
        tried = np.flatnonzero(reach >= np.maximum(limit[read[middle]], min_score))
        order = tried[np.lexsort((side[middle[tried]] % 2, segment[middle[tried]], -reach[tried], read[middle[tried]]))]
        order = order[np.flatnonzero(np.diff(read[middle[order]], prepend=-1))]
        told = [(int(reach[g]), int(segment[middle[g]]), int(side[middle[g]] % 2)) for g in order.tolist()]
        wins = [r not in found or (-found[r][0], *found[r][1:3]) > (-one[0], *one[1:]) for r, one in zip(read[middle[order]].tolist(), told, strict=True)]
        order, told = order[wins], [one for one, win in zip(told, wins, strict=True) if win]
        for width in np.unique(half[order]).tolist():
            rows = np.flatnonzero(half[order] == width)
            for i in range(0, len(rows), max(1, STEP // 64 // (2 * width + 1))):
                some = rows[i : i + max(1, STEP // 64 // (2 * width + 1))]
                places = middle[order[some]]
                cell = a[places] + self._anchor(places, steps_of, x, y)
                bases = [[(c, d)] for c, d in zip(cell.tolist(), shift[places].tolist(), strict=True)]
                for way in (1, -1):
                    signs = window(places, cell, width, way)
                    _, row, diagonal, _, kept = extensions(*signs, keep=True)
                    for n, (c, d) in enumerate(zip(cell.tolist(), shift[places].tolist(), strict=True)):
                        path = traced(kept, *signs, n, int(row[n]), int(diagonal[n]), way > 0)
                        bases[n] += [(c + way * (i + 1), d + way * (j - width)) for i, j in path]
                for n, place, aligned in zip(some.tolist(), places.tolist(), bases, strict=True):
                    found[int(read[place])] = (*told[n], _parts(sorted(aligned)))
        return found

    @staticmethod
    def _anchor(places: np.ndarray, steps_of, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The middle of the longest run of equal bases in the stretch of each of the places."""
        steps = steps_of(places)
        at = np.arange(steps.shape[1])
        equal = (steps == MATCH) & (at >= x[places][:, None]) & (at < y[places][:, None])
        run = at - np.maximum.accumulate(np.where(equal, -1, at), axis=1)
        end = run.argmax(axis=1)
        return end - run[np.arange(len(places)), end] // 2

    def told(self, seq: str, qual: str | None, hit: tuple) -> tuple:
        """(flag, rname, pos, cigar, as_score, nm, seq, qual) of a read's alignment."""
        score, segment, back, parts = hit
        s, q = seq, qual if isinstance(qual, str) else "G" * len(seq)
        if back:
            s, q = s.translate(_BACK)[::-1], q[::-1]
        if len(parts) == 1 and score == (parts[0][2] - parts[0][1]) * MATCH:  # all bases agree
            shift, x, y = parts[0]
            cigar = f"{f'{x}S' if x else ''}{y - x}M{f'{len(s) - y}S' if y < len(s) else ''}"
            return 16 if back else 0, self.names[segment], shift + x + 1, cigar, score, 0, s, q
        code, ref = coded(s), self.code[self.begin[segment] :]
        cigar, nm, before = "", 0, None
        for shift, x, y in parts:
            if before is not None:
                gap = shift - before
                cigar += f"{abs(gap)}{'D' if gap > 0 else 'I'}"
                nm += abs(gap)
            elif x:
                cigar += f"{x}S"
            cigar += f"{y - x}M"
            nm += int((code[x:y] != ref[x + shift : y + shift]).sum())
            before = shift
        if y < len(s):
            cigar += f"{len(s) - y}S"
        return 16 if back else 0, self.names[segment], parts[0][0] + parts[0][1] + 1, cigar, score, nm, s, q


def _parts(bases: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """[(diagonal, start, stop)] of aligned (place in the read, diagonal)."""
    out: list[tuple[int, int, int]] = []
    for at, shift in bases:
        if out and out[-1][0] == shift and out[-1][2] == at:
            out[-1] = (shift, out[-1][1], at + 1)
        else:
            out.append((shift, at, at + 1))
    return out


def align(reads: DataFrame, segments: DataFrame, segment: str, min_score: int = 12, k: int = 10) -> DataFrame:
    """Best hit of each read among ``segments`` (name, seq), none below ``min_score``.

    Of equal scores the smaller name, then the forward strand, wins.  Of the
    places that seeds point to, all are scored whose seeds allow the best score,
    and of a segment that a seed points to, one with gaps if it may be better.
    Repeated segments count once.  Signs other than A, C, G and T match nothing.  Reads without a sequence have
    no hit.  Hits on the reverse strand come back turned, with flag 16.
    """
    refs = sorted((r["name"], r["seq"].upper()) for r in segments.select("name", "seq").where("seq <> ''").limit(MAX_SEGMENTS + 1).collect())
    if len(refs) > MAX_SEGMENTS:
        raise ValueError("too many segments for a table on every task")
    refs = sorted(set(refs))
    if len({name for name, _ in refs}) < len(refs):
        raise ValueError("segments of one name must have one sequence")
    if sum(len(s) for _, s in refs) > MAX_CATALOGUE:
        raise ValueError("too many bases in the segments for a table on every task")
    table = reads.sparkSession.sparkContext.broadcast(Segments(refs, k))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                part = part[part["seq"].map(lambda s: isinstance(s, str) and len(s) >= k)]
                seqs = [s.upper() for s in part["seq"]]
                found = table.value.best(seqs, min_score) if seqs else {}
                rows = list(zip(part["sample_id"], part["file_idx"], part["qname"], part["qual"], strict=True))
                for i in sorted(found):
                    sample, idx, qname, qual = rows[i]
                    out.append((sample, idx, segment, qname, *table.value.told(seqs[i], qual, found[i])))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ALIGNMENT.split(", ")])

    return reads.select("sample_id", "file_idx", "qname", "seq", "qual").mapInPandas(run, ALIGNMENT)


def primary(aln: DataFrame) -> DataFrame:
    """Without unmapped, secondary and supplementary lines."""
    return aln.where(F.col("flag").bitwiseAND(2308) == 0)


def best_hit(aln: DataFrame) -> DataFrame:
    """The line of the best score for each read of each file and segment type.

    Ties: the smaller segment, then the smaller place.  A partial aggregate
    keeps one line a read before anything is shuffled.
    """
    key = ["sample_id", "file_idx", "segment", "qname"]
    rest = [c for c in aln.columns if c not in key]
    # smallest of (-score, name, place, ...): one ordered struct
    named = ["rname", "pos", "flag", "cigar"]
    order = F.struct((-F.coalesce("as_score", F.lit(-1))).alias("__s"), *named, *[c for c in rest if c not in named])
    return aln.groupBy(*key).agg(F.min(order).alias("h")).select(*key, *[F.col(f"h.{c}").alias(c) for c in rest]).select(*aln.columns)


def adaptive_k(mean_length: Column, chosen: int | None = None) -> Column:
    """15, 19, 23 or 25 from a mean length of 50, 75, 100 or 150 on; 15 below
    50, so that short reads are searched too; ``chosen`` if it is given."""
    if chosen is not None:
        return F.lit(chosen)
    return F.when(mean_length >= 150, 25).when(mean_length >= 100, 23).when(mean_length >= 75, 19).otherwise(15)


def sample_stats(v_hits: DataFrame, j_hits: DataFrame | None = None, default_error_rate: float = 0.0031) -> DataFrame:
    """(sample_id, mean_length, error_rate): of a sample's V hits.

    error_rate: mismatches over bases of M, I, = and X; the default where no
    hit tells, 0 where there are no such bases.  Samples with J hits only have
    the J reads' mean length and the default rate.
    """
    ops = cigar_ops("cigar")
    mapped = F.aggregate(F.filter(ops, lambda x: x["op"].isin("M", "I", "=", "X")), F.lit(0), lambda s, x: s + x["n"])
    # most hits have one of a few cigars: each is read once
    alike = v_hits.groupBy("sample_id", "cigar").agg(F.count("*").alias("n"), F.count("seq").alias("seqs"), F.sum(F.length("seq")).alias("bases"), F.sum("nm").alias("nm"))
    out = alike.groupBy("sample_id").agg(F.try_divide(F.sum("bases"), F.sum("seqs")).alias("mean_length"), F.sum("nm").alias("nm"), F.sum(mapped * F.col("n")).alias("mapped"))
    rate = F.when(F.col("nm").isNull(), F.lit(default_error_rate)).when(F.col("mapped") == 0, 0.0).otherwise(F.col("nm") / F.col("mapped"))
    out = out.select("sample_id", "mean_length", rate.alias("error_rate"))
    if j_hits is None:
        return out
    others = j_hits.groupBy("sample_id").agg(F.avg(F.length("seq")).alias("mean_length")).join(out, "sample_id", "left_anti")
    return out.unionByName(others.withColumn("error_rate", F.lit(default_error_rate)))
