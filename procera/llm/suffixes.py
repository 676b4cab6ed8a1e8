"""Suffix-array dedup: repeated 200-byte strings by column-wise multi-string construction.

The candidates come from `repeats`: contested runs of windows under one
minimiser. A run is cut into blocks of up to WIDTH consecutive windows at
fixed distances from the minimiser, so equal windows fall into equal blocks. All
windows of a block share a core of WINDOW - WIDTH + 1 bytes. A core becomes one
symbol, so that a block is a string of at most 2 WIDTH - 1 symbols and a window is
WIDTH consecutive symbols of it.

On a bounded collection of such strings the Burrows-Wheeler transform and the
common prefixes are built column by column: round j inserts the suffix of
length j of every string that has one, at the place that the transform of round
j - 1 gives, and updates the neighbours' common prefixes by range minima over the
previous round's column. Suffixes whose common prefix with a neighbour reaches
WIDTH are repeated windows.

A minimiser or core under which very many different strings meet is narrowed to
blocks of fewer windows with a longer core (see `repeats`), and the same construction
decides those; no task gathers an unbounded group.

Defined results: NULL text is empty; strings never cross documents; repeats inside
one document and overlapping ones count; repeated rows are copies of each
other. Windows are judged on the input. An empty table gives no rows. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procera.llm.repeats import Piece, Spec, Text, blocks, gaps, merged, spans, tagged
from procera.llm.runs import mixed

WINDOW = 200
GRAM = 64
WIDTH = 16
#: Symbols of one collection.
SLICE = 1 << 19
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))


def read(text: str | None) -> Text:
    data = (text or "").encode("utf-8", "surrogatepass")
    return Text(_BYTE[np.frombuffer(data, np.uint8)], data)


def columns(strings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String, suffix length and common prefix with the predecessor, of all suffixes in order.

    Ends of strings sort first and differ from each other. Symbols are non-negative.
    """
    m = len(strings)
    size = np.array([len(s) for s in strings], np.int64)
    flat = np.concatenate([*strings, np.zeros(0, np.int64)]).astype(np.int64)
    end = np.cumsum(size)
    sid, head, tail, lcp = np.arange(m), np.full(m, -1), np.arange(m), np.zeros(m, np.int64)
    length = np.zeros(m, np.int64)
    fresh = np.arange(m)
    for j in range(1, (int(size.max()) if m else 0) + 1):
        at = fresh[size[sid[fresh]] >= j]  # positions whose transform symbol is no end
        symbol = flat[end[sid[at]] - j]
        order = np.lexsort((at, symbol))
        at, symbol = at[order], symbol[order]
        slot = np.searchsorted(head * (1 << 32) + tail, symbol * (1 << 32) + at)
        moved = np.arange(len(sid)) + np.searchsorted(slot, np.arange(len(sid)), side="right")
        fresh = slot + np.arange(len(at))
        sid2, head2, tail2, lcp2, length2 = (np.empty(len(sid) + len(at), np.int64) for _ in range(5))
        for new, old, own in ((sid2, sid, sid[at]), (head2, head, symbol), (tail2, tail, at), (lcp2, lcp, 0), (length2, length, j)):
            new[moved] = old
            new[fresh] = own
        check = np.unique(np.concatenate((fresh, fresh + 1)))
        check = check[(check < len(sid2)) & (check > 0)]
        alike = check[(head2[check] == head2[check - 1]) & (head2[check] >= 0)]
        lcp2[check] = 0
        if len(alike):  # least common prefix between the two tails, in the previous column
            ranges = np.stack((tail2[alike - 1] + 1, tail2[alike] + 1), axis=1).ravel()
            lcp2[alike] = 1 + np.minimum.reduceat(np.append(lcp, 0), ranges)[::2]
        inner = head2 >= 0
        tail2[inner] = moved[tail2[inner]]
        sid, head, tail, lcp, length = sid2, head2, tail2, lcp2, length2
    return sid, length, lcp


#: Where a string comes from (group, piece, offset of its first window), its core, and the bytes left and right of it.
String = tuple[tuple[int, int, int], tuple[int, bytes], bytes, bytes]


def repeated(found: list[String], width: int) -> list[tuple[int, int, int]]:
    """(group, piece, offset) of windows, `width` symbols each, that occur twice or more in strings of one group."""
    names: dict[tuple[int, bytes], int] = {}
    ids = [names.setdefault(x[1], len(names)) for x in found]
    uses = np.bincount(ids) if ids else np.zeros(0, int)
    kept = sorted(((i, x) for i, x in zip(ids, found, strict=True) if uses[i] > 1), key=lambda x: x[0])
    out: list[tuple[int, int, int]] = []
    strings: list[np.ndarray] = []
    owners: list[tuple[int, int, int]] = []
    total, before = 0, -1

    def flush() -> None:
        nonlocal strings, owners, total
        if strings:
            sid, length, lcp = columns(strings)
            near = lcp >= width
            near[:-1] |= near[1:].copy()
            for s, n in zip(sid[near].tolist(), length[near].tolist(), strict=True):
                group, piece, first = owners[s]
                out.append((group, piece, first + len(strings[s]) - n))
        strings, owners, total = [], [], 0

    for i, (owner, _, left, right) in kept:
        if total >= SLICE and i != before:  # strings of one core stay together
            flush()
        before = i
        strings.append(np.concatenate((np.frombuffer(left, np.uint8).astype(np.int64), [256 + i], np.frombuffer(right, np.uint8).astype(np.int64))))
        owners.append(owner)
        total += len(strings[-1])
    flush()
    return out


def judge(groups: list[list[Piece]], width: int) -> list[tuple[int, int, int]]:
    size = WINDOW - width + 1
    found = []
    for g, group in enumerate(groups):
        for i, x in enumerate(group):
            for _, first, _, _, core, part in blocks(x.body, x.count, x.left, width, WINDOW):
                found.append(((g, i, first), (g, part[core : core + size]), part[:core], part[core + size :]))
    return repeated(found, width)


SPEC = Spec(WINDOW, GRAM, read, lambda body: body, bytes, (WIDTH, 4, 1), judge)


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[list] = [[] for _ in range(4)]
        for text, ranges in zip(b.column(1), b.column(2), strict=True):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            out = merged(ranges.as_py(), len(data))
            kept = b"".join(data[a:z] for a, z in gaps(out, len(data)))
            for column, value in zip(rows, (len(data), len(data) - len(kept), len(out), kept), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in rows[:3]), pa.array(rows[3], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes, which may cut a character)."""
    rows = tagged(docs.select("doc_id", "text"))
    joined = rows.join(spans(rows, SPEC, "suffixes"), ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def report(docs: DataFrame) -> DataFrame:
    return deduplicated(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
