"""Likelihoods of all fragment lengths over Arrow batches, in numpy.

Bases are bytes padded with zeros, qualities offsets from zero; rows are reads.  What a base scores against each letter is looked up
once, so an adapter is scored at all places of all reads by one addition for each of its bases.  Overlaps, which cost more, are
looked up only where a candidate can still be among the best two: its adapters' score with a perfect overlap bounds it from above.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

import numpy as np

from ..config import COMPARED, FAST, FAST_LIMIT, Options
from ..plans import tables as T

WILD = ord("I")
RC = np.zeros(256, np.uint8)
for _a, _b in zip(b"ACGTN", b"TGCAN"):
    RC[_a] = _b
CODE = np.full(256, 4, np.int64)
for _i, _b in enumerate(b"ACGT"):
    CODE[_b] = _i
NONE = -np.inf


class Reads:
    """A batch of reads as matrices."""

    def __init__(self, seqs: list[str], quals: list[str], offset: int):
        for s, q in zip(seqs, quals):
            if len(s) != len(q):
                raise ValueError(f"sequence and quality differ in length: {len(s)}, {len(q)}")
        self.len = np.array([len(s) for s in seqs], np.int64)
        self.width = int(self.len.max()) if len(seqs) else 0
        flat = "".join(s.ljust(self.width, "\0") for s in seqs).encode("ascii", "replace")
        self.base = np.frombuffer(flat, np.uint8).reshape(len(seqs), self.width)
        flat = "".join(q.ljust(self.width, "\0") for q in quals).encode("latin-1", "replace")
        self.raw = np.frombuffer(flat, np.uint8).reshape(len(seqs), self.width).astype(np.int64)
        self.qual = np.clip(self.raw - offset, 0, T.QUALITIES - 1)

    @functools.cached_property
    def scores(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each base, if it matches and if it does not; looked up once for all candidates."""
        return T.match()[self.qual], T.mismatch()[self.qual]

    def part(self, rows: slice, places: slice) -> Reads:
        out = object.__new__(Reads)
        out.len, out.base, out.raw, out.qual = self.len[rows], self.base[rows, places], self.raw[rows, places], self.qual[rows, places]
        out.width = out.base.shape[1]
        return out

    def rows(self, start: int, end: int) -> Reads:
        """Some of the reads, no wider than they need."""
        return self.part(slice(start, end), slice(0, int(self.len[start:end].max(initial=0))))

    def first(self, width: int) -> Reads:
        """The first places of all reads; their lengths stay."""
        return self.part(slice(None), slice(0, width))

    def __len__(self) -> int:
        return len(self.len)

    def turned(self) -> Reads:
        """Reverse complement, with reversed qualities."""
        out = object.__new__(Reads)
        out.len, out.width = self.len, self.width
        at = self.len[:, None] - 1 - np.arange(self.width)[None, :]
        ok = at >= 0
        at = np.maximum(at, 0)
        take = lambda m: np.where(ok, np.take_along_axis(m, at, 1), 0)
        base = take(self.base)
        out.base = RC[base]
        if ((out.base == 0) & ok).any():
            raise ValueError("a base is none of A, C, G, T, N")
        out.raw, out.qual = take(self.raw), take(self.qual)
        return out


LETTERS = {c: k for k, c in enumerate(b"ACGTI")}  # I, the wildcard, fits every base
OTHER = 5  # fits no base
CELLS = 1 << 17  # bases of the rows that are scored together, so that matrices stay in the processor's cache
TRIED = 4  # candidates of each pair that are scored before the others are bounded


def letter_scores(reads: Reads, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """[letter, read, place]: what each base scores against each letter, and whether it fits; zeros behind the reads' ends."""
    n, w = reads.base.shape
    inside = np.arange(w) < reads.len[:, None]
    hit, miss = reads.scores
    score = np.zeros((len(LETTERS) + 1, n, w + pad))
    fits = np.zeros((len(LETTERS) + 1, n, w + pad), np.int16)
    score[OTHER, :, :w] = miss * inside
    for c, k in LETTERS.items():
        same = inside if c == WILD else (reads.base == c)
        fits[k, :, :w] = same
        score[k, :, :w] = np.where(same, hit, miss) * inside
    return score, fits


def letters_of(seq: bytes) -> np.ndarray:
    return np.array([LETTERS.get(c, OTHER) for c in seq], np.int64)


def adapter_places(reads: Reads, seq: str, places: int) -> tuple[np.ndarray, np.ndarray]:
    """A(x) for x below places: log10 likelihood that the adapter starts at x, and compared bases that match; zeros from a read's end."""
    a = seq.encode()[:COMPARED]
    if any(c not in LETTERS for c in a):
        return adapter_places_any(reads, a, places)
    codes, x = letters_of(a), np.arange(min(places, reads.width))
    score, fits = letter_scores(reads, len(a))
    n = len(x)
    head, hits_head = np.zeros((len(reads), n)), np.zeros((len(reads), n), np.int16)
    for j, k in enumerate(codes[:FAST]):
        head += score[k, :, j : j + n]
        hits_head += fits[k, :, j : j + n]
    ll, hits = head.copy(), hits_head.copy()
    for j, k in enumerate(codes[FAST:], FAST):
        ll += score[k, :, j : j + n]
        hits += fits[k, :, j : j + n]
    return finished(reads, x, len(a), head, hits_head, ll, hits, places)


def adapter_places_any(reads: Reads, a: bytes, places: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for an adapter with other letters, which fit themselves."""
    x = np.arange(min(places, reads.width))
    n, pad = len(x), ((0, 0), (0, len(a)))
    inside = np.pad(np.arange(reads.width) < reads.len[:, None], pad)
    hit, miss = (np.pad(m, pad) * inside for m in reads.scores)
    base = np.pad(reads.base, pad)
    ll, hits = np.zeros((len(reads), n)), np.zeros((len(reads), n), np.int16)
    head, hits_head = ll, hits
    for j, c in enumerate(a):
        same = ((base[:, j : j + n] == c) | (c == WILD)) & inside[:, j : j + n]
        ll = ll + np.where(same, hit[:, j : j + n], miss[:, j : j + n])
        hits = hits + same
        if j + 1 == FAST:
            head, hits_head = ll, hits
    return finished(reads, x, len(a), head, hits_head, ll, hits, places)


def finished(reads: Reads, x: np.ndarray, size: int, head, hits_head, ll, hits, places: int) -> tuple[np.ndarray, np.ndarray]:
    """Hopeless comparisons stop after FAST bases, for the rest an expectation stands; bases behind the adapter count as random."""
    room = np.maximum(reads.len[:, None] - x, 0)
    m = np.minimum(room, size)
    lost = (m >= FAST) & (head - FAST * T.LAMBDA < FAST_LIMIT)
    if lost.any():
        sums = np.pad(np.cumsum(reads.qual * (np.arange(reads.width) < reads.len[:, None]), axis=1), ((0, 0), (1, FAST)), mode="edge")
        sums[:, 0] = 0
        mean = (sums[:, FAST : FAST + len(x)] - sums[:, : len(x)])[lost] // FAST
        ll[lost] = head[lost] + (m[lost] - FAST) * (0.75 * T.mismatch()[mean] + 0.25 * T.match()[mean])
        hits = np.where(lost, hits_head, hits)
    ll = ll + T.LAMBDA * (room - m)
    more = ((0, 0), (0, places - len(x)))
    return np.pad(ll, more), np.pad(hits, more)


@functools.cache
def overlap_scores() -> np.ndarray:
    """Flat: mismatches by quality 1 and 2, then matches; PAD, the quality of no base, scores nothing."""
    out = np.zeros((2, PAD + 1, PAD + 1))
    out[0, :PAD, :PAD], out[1, :PAD, :PAD] = T.pair_mismatch(), T.pair_match()
    return out.ravel()


PAD = T.QUALITIES


class Overlap:
    """Pairs ready to be laid over each other: the turned mate stands at the right, so that for a fragment of x bases the same columns
    of all pairs meet."""

    def __init__(self, one: Reads, turned: Reads):
        self.w1, self.w2 = one.width, turned.width
        self.base1, self.base2 = one.base, np.ones_like(turned.base)  # no base at all equals none
        self.row1 = (np.where(np.arange(one.width) < one.len[:, None], one.qual, PAD) * (PAD + 1)).astype(np.int32)
        self.qual2 = np.full(turned.base.shape, PAD, np.int32)
        at = np.arange(turned.width) - (turned.width - turned.len[:, None])
        there = at >= 0
        at = np.maximum(at, 0)
        if turned.width:
            self.base2 = np.where(there, np.take_along_axis(turned.base, at, 1), 1).astype(np.uint8)
            self.qual2 = np.where(there, np.take_along_axis(turned.qual, at, 1), PAD).astype(np.int32)

    def score(self, x: int, rows: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        """Of the bases that overlap in a fragment of x bases, and how many match."""
        i, end = max(0, x - self.w2), min(self.w1, x)
        k = i + self.w2 - x
        end = max(end, i)
        same = self.base1[rows, i:end] == self.base2[rows, k : k + end - i]
        at = self.row1[rows, i:end] + self.qual2[rows, k : k + end - i] + same * np.int32((PAD + 1) ** 2)
        return overlap_scores()[at].sum(axis=1), same.sum(axis=1)


class Best(NamedTuple):
    """The best two candidates and how many bases match in the best; the status quo is -1 and first, as is a missing second."""

    x: np.ndarray
    ll: np.ndarray
    matches: np.ndarray
    second_x: np.ndarray
    second: np.ndarray

    def sure(self, least_matches: int = 0) -> np.ndarray:
        with np.errstate(invalid="ignore"):
            return (self.x >= 0) & (self.second - self.ll < np.log10(1 / 20)) & (self.matches >= least_matches)


def best_two(start: np.ndarray, ll: np.ndarray, matches: np.ndarray) -> Best:
    """Of the status quo and all candidates, in this order; of equal ones the first."""
    every = np.concatenate([start[:, None], ll], axis=1)
    rows = np.arange(len(start))
    first = every.argmax(axis=1)
    top = every[rows, first]
    every[rows, first] = NONE
    second = every.argmax(axis=1)
    low = every[rows, second]
    hits = np.concatenate([np.zeros((len(start), 1), matches.dtype), matches], axis=1)[rows, first].astype(np.int64)
    return Best(first - 1, top, hits, np.where(low == NONE, 0, second) - 1, low)


def in_blocks(scan):
    """A scan of reads (or mates) by rows whose matrices stay small."""

    @functools.wraps(scan)
    def run(*args):
        *reads, o = args
        n, width = len(reads[0]), max(r.width for r in reads)
        step = max(1, CELLS // max(width, 1))
        parts = [scan(*(r.rows(at, at + step) for r in reads), o) for at in range(0, n, step)] or [scan(*reads, o)]
        return Best(*map(np.concatenate, zip(*parts)))

    return run


def survival(length: np.ndarray, o: Options) -> np.ndarray:
    """Of the prior, looked up once for each length."""
    distinct, back = np.unique(np.maximum(length, 0), return_inverse=True)
    return np.array([T.log10_survival(int(n), o.loc, o.scale) for n in distinct])[back]


def densities(places: int, o: Options) -> np.ndarray:
    return np.array([T.log10_density(x, o.loc, o.scale) for x in range(places)]) if o.prior else np.zeros(places)


@in_blocks
def scan_single(reads: Reads, o: Options) -> Best:
    last = reads.len - o.cutoff
    start = reads.len * T.LAMBDA
    if o.prior:
        start = start + survival(last, o)
    places = max(0, int(last.max())) if len(reads) else 0
    x = np.arange(places)
    ll, hits = adapter_places(reads, o.adapters[0], places)
    ll = np.where(x < last[:, None], ll + x * T.LAMBDA + densities(places, o), NONE)
    return best_two(start, ll, hits)


@in_blocks
def scan_pairs(one: Reads, two: Reads, o: Options) -> Best:
    """two is read as it came; its turned form is what overlaps."""
    longest = np.maximum(one.len, two.len)
    end = 2 * longest - o.min_overlap
    start = (one.len + two.len) * T.LAMBDA
    if o.prior:
        start = start + survival(end, o)
    able = end if o.partial else np.minimum(end, longest + 1)
    able = np.minimum(able, one.len + two.len + 1)
    places = max(0, int(able.max())) if len(one) else 0
    x = np.arange(places)
    a, ha = adapter_places(one, o.adapters[0], places)
    b, hb = adapter_places(two, o.adapters[1], places)
    bound = np.where(x < able[:, None], a + b + x * T.LAMBDA + densities(places, o), NONE)
    return with_overlaps(one, two, start, bound, ha + hb)


@in_blocks
def scan_overhang(one: Reads, two: Reads, o: Options) -> Best:
    """Without adapters: what hangs over counts as random; only lengths that leave an overhang."""
    longest = np.maximum(one.len, two.len)
    end = np.minimum(2 * longest - o.min_overlap, longest - 1)
    places = max(0, int(end.max())) if len(one) else 0
    x = np.arange(places)
    over = np.maximum(0, one.len[:, None] - x - 1) + np.maximum(0, two.len[:, None] - x - 1)
    bound = np.where((x < end[:, None]) & (over > 0), T.LAMBDA * over + x * T.LAMBDA, NONE)
    return with_overlaps(one, two, (one.len + two.len) * T.LAMBDA, bound, np.zeros(bound.shape, np.int16))


def with_overlaps(one: Reads, two: Reads, start: np.ndarray, bound: np.ndarray, matches: np.ndarray) -> Best:
    """The best two when each candidate gets its overlap's score, which is never above zero: first that of the most promising, then of
    all whose bound is not below the second best by then."""
    n, places = bound.shape
    laid = Overlap(one, two.turned())
    ll, matches = np.full(bound.shape, NONE), matches.astype(np.int64)
    todo = np.zeros(bound.shape, bool)
    if places > TRIED:
        np.put_along_axis(todo, np.argpartition(-bound, TRIED, axis=1)[:, :TRIED], True, axis=1)
    for step in range(2):
        if step or places <= TRIED:
            known = np.sort(np.concatenate([start[:, None], ll], axis=1), axis=1)[:, -2:]
            todo = (bound >= known[:, :1]) & (ll == NONE) if places > TRIED else ~todo
        todo &= bound > NONE
        for x in np.flatnonzero(todo.any(axis=0)):
            rows = np.flatnonzero(todo[:, x])
            score, hits = laid.score(int(x), slice(None) if len(rows) == n else rows)
            ll[rows, x] = bound[rows, x] + score
            matches[rows, x] += hits
        if places <= TRIED:
            break
    return best_two(start, ll, matches)


@functools.lru_cache(maxsize=16)
def chimera_weights(chimeras: tuple[str, ...], width: int) -> tuple[np.ndarray, np.ndarray]:
    """A column for each chimera and shift: one where a place's letter counts, place by place; and the chimeras' lengths."""
    shifted = [c.encode()[shift:] for c in chimeras for shift in (0, 1)]
    out = np.zeros((len(LETTERS) + 1, width, len(shifted)))
    for k, c in enumerate(shifted):
        codes = letters_of(c[:width])
        out[codes, np.arange(len(codes)), k] = 1
    return out, np.array([len(c) for c in shifted])


def chimeric(reads: Reads, o: Options) -> np.ndarray:
    """Reads that a chimera explains better than chance, at shift 0 or 1."""
    step = max(1, CELLS // max(reads.width, 1))
    if len(reads) > step:
        return np.concatenate([chimeric(reads.rows(at, at + step), o) for at in range(0, len(reads), step)])
    plain = lambda c: all(b in LETTERS for b in c.encode())
    chimeras, odd = tuple(filter(plain, o.chimera_list)), [c for c in o.chimera_list if not plain(c)]
    out = np.zeros(len(reads), bool)
    for c in odd:  # letters that fit themselves
        for shift in (0, 1):
            a = np.frombuffer(c.encode(), np.uint8)[shift:]
            w, m = min(len(a), reads.width), np.minimum(reads.len, len(a))
            same = (reads.base[:, :w] == a[:w]) | (a[:w] == WILD)
            score = np.where(same, reads.scores[0][:, :w], reads.scores[1][:, :w]) * (np.arange(w) < m[:, None])
            out |= (m > 0) & (score.sum(axis=1) + T.LAMBDA * (reads.len - m) > reads.len * T.LAMBDA)
    if not chimeras or not reads.width:
        return out
    width = min(reads.width, max(map(len, chimeras)))
    weights, size = chimera_weights(chimeras, width)
    score = letter_scores(reads.first(width), 0)[0]
    total = np.einsum("lnw,lwk->nk", score, weights, optimize=True)
    m = np.minimum(reads.len[:, None], size)
    return out | ((m > 0) & (total + T.LAMBDA * (reads.len[:, None] - m) > reads.len[:, None] * T.LAMBDA)).any(axis=1)


def consensus(one: Reads, two: Reads, x: np.ndarray, record: np.ndarray, o: Options) -> list[tuple[str, str]]:
    """Sequence and quality of fragments of x bases; two is turned."""
    width = int(x.max()) if len(x) else 0
    if not width:
        return [("", "")] * len(x)
    i = np.arange(width)[None, :]
    j = i + two.len[:, None] - x[:, None]
    in1, in2 = (i < one.len[:, None]) & (i < x[:, None]), (j >= 0) & (j < two.len[:, None]) & (i < x[:, None])
    at1, at2 = np.broadcast_to(np.minimum(i, one.width - 1), j.shape), np.clip(j, 0, two.width - 1)
    b1, q1, r1 = (np.take_along_axis(m, at1, 1) for m in (one.base, one.qual, one.raw))
    b2, q2, r2 = (np.take_along_axis(m, at2, 1) for m in (two.base, two.qual, two.raw))
    toss = T.coin(o.seed, record.astype(np.int64)[:, None], i)
    second = np.where(b1 == b2, False, (r2 > r1) | ((r2 == r1) & toss))
    both = in1 & in2
    base = np.where(both, np.where(second, b2, b1), np.where(in1, b1, b2))
    qual = np.where(both, T.consensus_quality()[CODE[b1], CODE[b2], q1, q2] + o.offset, np.where(in1, r1, r2))
    return [(bytes(base[k, : x[k]]).decode("ascii"), bytes(qual[k, : x[k]].astype(np.uint8)).decode("latin-1")) for k in range(len(x))]
