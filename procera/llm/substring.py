"""Substring dedup: repeated 35-word windows are found by Rabin-Karp hashes and removed.

Every window of a contested run has a rolling polynomial hash of its words' 128-bit
hashes (two bases, one on each half). Windows travel in runs (see `repeats`): a run whose
words recur whole is repeated throughout, the windows of contested runs are hashed one by
one and counted among all runs that share their minimiser. Runs are compared by their
words, not by the symbols that choose the minimiser. The repeated windows of a document
merge into maximal removed intervals.

Defined results: NULL, empty or short texts (under 35 words) keep all their words;
equal windows in one document count as repeated; repeated rows are copies of each
other. Windows are judged on the input. An empty table gives no rows. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procera.llm.repeats import Piece, Spec, Text, gaps, merged, spans, tagged
from procera.llm.runs import mixed

WINDOW = 35
GRAM = 8
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bases of the two window hashes.
_BASES = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x27D4EB2F165667C5))


@lru_cache(maxsize=4)
def powers(base: int, size: int) -> np.ndarray:
    return np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size, base, np.uint64), dtype=np.uint64)))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return powers(int(base), max(1 << 12, 1 << n.bit_length()))[: n + 1]


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the words."""
    inside = np.concatenate(([False], ~_BLANK[raw], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def word_ids(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial number of each word, for minimisers only: different words may share one."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * _powers(_BASE, len(raw))[:-1], dtype=np.uint64)))
    return mixed((sums[end] - sums[start]) * _powers(_INVERSE, len(raw))[start] + (end - start).astype(np.uint64))


def read(text: str | None) -> Text:
    """Words as symbols; behind them the words themselves, joined by one space."""
    data = (text or "").encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8)
    start, end = word_spans(raw)
    edge = np.concatenate((np.zeros(1, np.int64), np.cumsum(end - start + 1)))
    return Text(word_ids(raw, start, end), b" ".join(data.split()), edge, 1)


def rabin_karp(words: list[bytes], window: int) -> np.ndarray:
    """Rolling hashes of all windows, one row each, from prefix sums: two bases over the halves of the words' hashes."""
    halves = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)
    out = np.empty((len(words) - window + 1, 2), np.uint64)
    for i, base in enumerate(_BASES):
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(halves[:, i] * _powers(base, len(words))[:-1], dtype=np.uint64)))
        out[:, i] = (sums[window:] - sums[:-window]) * _powers(inverse, len(words))[: len(out)]
    return out


def judge(groups: list[list[Piece]], width: int) -> list[tuple[int, int, int]]:
    """(group, piece, offset) of the windows whose hash is counted twice or more in their group."""
    out = []
    for g, group in enumerate(groups):
        rolled = [rabin_karp(x.body.split(b" "), WINDOW).tobytes() for x in group]
        places = [(w[at : at + 16], i, at // 16) for i, w in enumerate(rolled) for at in range(0, len(w), 16)]
        counts = Counter(w for w, _, _ in places)
        out += [(g, i, at) for w, i, at in places if counts[w] > 1]
    return out


SPEC = Spec(WINDOW, GRAM, read, lambda body: body.split(b" "), b" ".join, (7, 1), judge)


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts, removed, kept = [], [], []
        for text, ranges in zip(b.column(1), b.column(2), strict=True):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            words = data.split()
            out = merged(ranges.as_py(), len(words))
            counts.append(len(words))
            removed.append(int((out[:, 1] - out[:, 0]).sum()))
            kept.append(b" ".join(w for a, z in gaps(out, len(words)) for w in words[a:z]).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept (remaining words joined by one space)."""
    rows = tagged(docs.select("doc_id", "text"))
    joined = rows.join(spans(rows, SPEC, "substring"), ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words bigint, n_removed bigint, kept string")


def report(docs: DataFrame) -> DataFrame:
    return deduplicated(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
