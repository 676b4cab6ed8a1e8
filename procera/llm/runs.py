"""Runs of windows: how repeated fixed-length windows are found without moving every window.

A document is a sequence of symbols, a window W consecutive ones. Each window is
represented by its minimiser, the least-hashed K-gram inside it (leftmost of
equals). Equal windows have equal minimisers, so windows are only ever compared
under one key. Consecutive windows with the same minimiser occurrence form a run,
which travels as one row.

Defined results: a text of fewer than W symbols (NULL, empty and blank ones too) has no
runs; texts of any length are taken in blocks of bounded size; equal minimisers in one
window go by the leftmost.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Low bits of a comparison key that hold the position, and symbols cut at a time so that positions fit.
PLACE = 24
BLOCK = 1 << 23
_MASK = np.uint64((1 << PLACE) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k symbols from every position, by doubling."""
    out, size, level = None, 0, symbols
    n = len(symbols) - k + 1
    span = 1
    while True:
        if k & span:
            part = level[size : size + n]
            out = part.copy() if out is None else out * np.uint64(0x9E3779B97F4A7C15) + part
            size += span
        span *= 2
        if span > k:
            return mixed(out)
        half = span // 2
        level = (level[:-half] * np.uint64(0xD6E8FEB86659FD93 + 2 * span)) ^ (level[half:] + (level[half:] >> np.uint64(29)))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value among `width` neighbours from every position."""
    n, span = len(x) - width + 1, 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[width - span : width - span + n])


@dataclass
class Runs:
    """Start of the first window, number of windows, position and hash of the minimiser, per run."""

    start: np.ndarray
    count: np.ndarray
    at: np.ndarray
    key: np.ndarray

    def where(self, kept: np.ndarray) -> Runs:
        return Runs(self.start[kept], self.count[kept], self.at[kept], self.key[kept])


def runs(symbols: np.ndarray, window: int, k: int) -> Runs | None:
    """All windows of one document, in runs. `symbols` are well-mixed 64-bit values."""
    total = len(symbols) - window + 1
    if total < 1:
        return None
    parts = []
    for low in range(0, total, BLOCK):
        here = symbols[low : min(low + BLOCK, total) + window - 1]
        g = grams(here, k)
        order = (g & ~_MASK) | np.arange(len(g), dtype=np.uint64)
        at = (sliding_min(order, window - k + 1) & _MASK).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        count = np.diff(np.append(first, len(at)))
        parts.append((first + low, count, at[first] + low, g[at[first]]))
    return Runs(*(np.concatenate(x) for x in zip(*parts, strict=True)))
