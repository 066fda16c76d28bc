"""Score tables by quality, pair of qualities and length."""

from __future__ import annotations

import functools
import math

import numpy as np

LAMBDA = math.log10(0.25)
QUALITIES = 64
CAP = 60


@functools.cache
def error() -> np.ndarray:
    """Error probability by quality; below 2 counts as 2."""
    return 10.0 ** (-np.maximum(np.arange(QUALITIES), 2) / 10.0)


@functools.cache
def match() -> np.ndarray:
    return np.log10(1 - error())


@functools.cache
def mismatch() -> np.ndarray:
    return np.log10(error() / 3)


@functools.cache
def pair_match() -> np.ndarray:
    a, b = error()[:, None], error()[None, :]
    return np.log10((1 - a) * (1 - b) + 3 * (a / 3) * (b / 3))


@functools.cache
def pair_mismatch() -> np.ndarray:
    a, b = error()[:, None], error()[None, :]
    return np.log10((1 - a) * (b / 3) + (a / 3) * (1 - b) + 2 * (a / 3) * (b / 3))


@functools.cache
def consensus_quality() -> np.ndarray:
    """[base 1, base 2, quality 1, quality 2], bases A C G T N: the larger quality of the observed bases."""
    p = np.maximum(1 - error(), 0.25)
    hit = np.full((5, 4, QUALITIES), 0.0)
    for b in range(5):
        for k in range(4):
            hit[b, k] = p if b == k else (1 - p) / 3
    w = hit[:, None, :, :, None] * hit[None, :, :, None, :]  # base 1, base 2, true base, quality 1, quality 2
    total = w.sum(axis=2)
    out = np.zeros((5, 5, QUALITIES, QUALITIES), np.int64)
    for a in range(5):
        for b in range(5):
            for k in {a, b} - {4}:
                with np.errstate(divide="ignore"):
                    q = np.floor(np.minimum(CAP, -10 * np.log10((total[a, b] - w[a, b, k]) / total[a, b])) + 0.5)
                out[a, b] = np.maximum(out[a, b], q.astype(np.int64))
    return out


def log10_density(x: int, loc: float, scale: float) -> float:
    """Of the log-normal; 0 counts as 1."""
    x = max(x, 1)
    return -((math.log(x) - loc) ** 2) / (2 * scale * scale) / math.log(10) - math.log10(scale * math.sqrt(2 * math.pi) * x)


def log10_survival(x: int, loc: float, scale: float) -> float:
    tail = 0.5 * math.erfc((math.log(max(x, 1)) - loc) / (scale * math.sqrt(2)))
    return math.log10(tail) if tail > 0 else -math.inf


def coin(seed: int, record, position):
    """Of a tie: true for the second mate.  Plain integer arithmetic, so that SQL can repeat it."""
    return (record * 7919 + position * 104729 + seed * 15485863) % 1009 >= 505
