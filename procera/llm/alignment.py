"""Alignment of two tokenizers' ids: which tokens of one stand where tokens of the other do.

Each text is encoded by a byte-level vocabulary (A, over space + text) and by one of pieces
(B, which puts a space in front). Byte offsets at which tokens of both end cut the tokens into
groups; every A and B token of one group are linked. An id pair counts the documents that hold it linked.

1. A task encodes documents and numbers them in parts of PART characters of text. A pair is one packed int64, A's id in the
   high half; np.unique over a part gives its keys and partial counts, and documents point into the part's keys. A row is a
   document; the first one of a part brings the part's keys.
2. The parts' keys are sorted by one range-partitioned global sort; adjacent equal keys are summed.
3. Each part meets its shard of the counts, finds its keys there by searchsorted, and its documents sum them up.

Only keys and counts are shuffled twice, never texts. A key has at most one row a part, so no key is hot. The highest count
of every A id is a table with a row an id of the vocabulary. No row is longer than what a document or a part's keys need,
and what is taken at a time is one part, however many of them a task has.

Encoding goes by chunks that repeat (see `chunks_of`): where no token of either vocabulary can go on, both end, so tokens and
groups of a text are those of its chunks in a row, and a chunk once seen is looked up. Where A is not of the byte-level kind, a text is one chunk.

Defined results: NULL and empty texts, and those that tokens do not spell byte for byte (U+2581 is read as a space by B), have no tokens: zeros
and the empty string. Special tokens' strings are plain text. Texts of any length are taken whole, in blocks of chunks.
Repeated rows count as documents each. An empty table gives no rows. Columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import string
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import batched, chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procera.llm.common import written

#: Where executors find the vocabularies.
FOLDER = "/opt/tokenizers"
BYTES_FILE, PIECES_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of text whose documents share a table of keys, and what a document counts for besides its text.
PART, ROW = 8 << 20, 64
#: Chunks taken at a time; chunks and characters of them that a worker remembers before it starts afresh.
BLOCK = 1 << 16
REMEMBERED, CHARACTERS = 250_000, 8 << 20
#: Letters and digits next to which a text may be cut; others are taken for marks that are not.
LETTERS = "0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u0481\u048a-\u052f"
#: Bits of B's id in a key.
SHIFT = 32


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 characters for themselves, the rest from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [x for x in range(256) if x not in set(visible)]
    return {chr(x): x for x in visible} | {chr(256 + i): x for i, x in enumerate(hidden)}


def chunks_of(pieces: list[str]) -> str:
    """Pattern of the stretches between places where no token of either vocabulary goes on.

    The byte-level pattern always ends a token between a character that isn't white space and white space, after a single tab or line
    feed that no white space follows, between letters or digits and a mark, and between a mark and letters or digits (but for the
    apostrophe, which it joins with some). Pieces are read: a character is used in a rule only if no piece has it there.
    """
    holds = lambda before, c, after: any(re.search(before + re.escape(c) + after, p) for p in pieces)
    set_ = lambda chars: "".join(map(re.escape, chars))
    opens = [c for c in " \t\n" if not holds(r"\S", c, "")]
    shuts = [c for c in "\t\n" if c in opens and not holds("", c, r"\S")]
    after = set_(c for c in string.punctuation if not holds(f"[{LETTERS}]", c, ""))
    ahead = set_(c for c in string.punctuation if c != "'" and not holds("", c, f"[{LETTERS}]"))
    if not opens:
        return r"(?s:.+)"
    mark, letter = rf"[^\s{LETTERS}]", f"[{LETTERS}]"
    marks = f"{mark}+(?:{f'(?<![{ahead}])' if ahead else ''}{letter}+)?"
    stretch = f"(?:{letter}+|{marks})(?:{f'(?![{after}])' if after else ''}{marks})*"
    alone = f"[{set_(shuts)}](?!\\s)|" if shuts else ""
    return rf"{alone}\s*{stretch}(?:(?![{set_(opens)}])\s+(?:{stretch})?)*|\s+"


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.held, self.n = np.zeros(1024, kind), 0

    def extend(self, x: np.ndarray) -> None:
        while self.n + len(x) > len(self.held):
            self.held = np.concatenate((self.held, np.zeros_like(self.held)))
        self.held[self.n : self.n + len(x)] = x
        self.n += len(x)


@dataclass(frozen=True)
class Document:
    """n_a, n_b, n_groups, n_links; hash of the groups; distinct keys and how often each is linked."""

    sizes: tuple[int, ...] = (0, 0, 0, 0)
    groups: str = ""
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


class Pair:
    """Both tokenizers, and the chunks seen so far: numbers of tokens, groups and links, keys of links, groups as text."""

    def __init__(self, bytes_file: str, pieces_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model_pb2
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(bytes_file)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        self.a_bytes = {i: bytes(letters[x] for x in entry) for entry, i in self.a.get_vocab(with_added_tokens=False).items() if all(x in letters for x in entry)}
        model = model_pb2.ModelProto()
        with open(pieces_file, "rb") as f:
            model.ParseFromString(f.read())
        kinds = model_pb2.ModelProto.SentencePiece
        spelt = lambda p: bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else p.piece.replace("▁", " ").encode()
        self.b_bytes = [spelt(p) for p in model.pieces]
        normal = [p.piece.replace("▁", " ") for p in model.pieces if p.type == kinds.NORMAL]
        # the space in front is put there by hand, so that a chunk inside a text gets none
        plain = model.normalizer_spec.name == "identity" and model.normalizer_spec.add_dummy_prefix and not model.normalizer_spec.remove_extra_whitespaces
        plain = plain and model.trainer_spec.model_type == model.trainer_spec.BPE and not any(p.type == kinds.USER_DEFINED for p in model.pieces)
        if not plain:
            raise ValueError(f"{pieces_file} is not a model of plain BPE pieces with a space in front")
        model.normalizer_spec.add_dummy_prefix = False
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        before = json.loads(self.a.to_str())
        known = before["normalizer"] is None and (before["pre_tokenizer"] or {}).get("type") == "ByteLevel" and before["pre_tokenizer"]["use_regex"]
        self.chunk = re.compile(chunks_of(normal) if known else r"(?s:.+)")
        self.a_length = np.zeros(1 + max(self.a_bytes), np.int64)
        self.a_length[list(self.a_bytes)] = [len(x) for x in self.a_bytes.values()]
        self.b_length = np.array([len(x) for x in self.b_bytes], np.int64)
        with_ = lambda n, *signs: np.array([[f"{i}{sign}" for i in range(n)] for sign in signs], object)
        self.a_text, self.b_text = with_(len(self.a_length), ",", "|"), with_(len(self.b_length), ",", ";", "")
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups_of: list[str] = []
        self.characters = 0
        self.sizes = Grown(np.int64)  # n_a, n_b, n_groups, n_links, whether both spell the chunk, by turns
        self.keys, self.ends = Grown(np.int64), Grown(np.int64)

    def learn(self, chunks: list[str]) -> None:
        a = [e.ids for e in self.a.encode_batch(chunks, add_special_tokens=False)]
        b = self.b.encode(chunks, num_threads=1)
        raw = [c.encode() for c in chunks]
        joint = lambda lists: np.array(list(chain.from_iterable(lists)), np.int64)
        spell_a, spell_b = (lambda ids: b"".join([self.a_bytes.get(x, b"") for x in ids])), (lambda ids: b"".join([self.b_bytes[x] for x in ids]))
        each = lambda lists, length: np.add.reduceat(np.append(length[joint(lists)], 0), np.cumsum([0, *map(len, lists[:-1])])) if all(lists) else np.zeros(0)
        size = np.array([len(c) for c in raw])
        whole = b"".join(raw)
        same = lambda lists, length, spell: np.array_equal(each(lists, length), size) and spell(joint(lists).tolist()) == whole
        spelt = np.ones(len(chunks), bool)
        if not (same(a, self.a_length, spell_a) and same(b, self.b_length, spell_b)):
            spelt[:] = [spell_a(a[i]) == raw[i] == spell_b(b[i]) for i in range(len(chunks))]
            for i in np.flatnonzero(~spelt):
                a[i], b[i] = [], []
        ids_a, ids_b = joint(a), joint(b)
        ends_a, ends_b = np.cumsum(self.a_length[ids_a]), np.cumsum(self.b_length[ids_b])
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        in_a, in_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        wide_a, wide_b = (np.bincount(x, minlength=len(both)) for x in (in_a, in_b))
        first_b = np.cumsum(wide_b) - wide_b
        times = wide_b[in_a]
        other = np.repeat(first_b[in_a], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        keys = np.repeat(ids_a, times) << SHIFT | ids_b[other]
        n_a, n_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
        last = np.cumsum(n_a)
        upto = lambda per_group: np.concatenate(([0], np.cumsum(per_group)))[np.concatenate(([0], in_a + 1))[last]]
        group_end = upto(np.ones(len(both), np.int64))
        link_end = upto(wide_a * wide_b)
        shift = lambda x: np.diff(x, prepend=0)
        # groups as text: a,a|b,b;a|b and so on, every token with the sign that follows it
        to_a, to_b = np.cumsum(wide_a), np.cumsum(wide_b)
        closes = np.ones(len(both), np.int64)
        closes[group_end[n_a > 0] - 1] = 2
        told = np.empty(len(ids_a) + len(ids_b), object)
        told[np.arange(len(ids_a)) + first_b[in_a]] = self.a_text[np.bincount(to_a - 1, minlength=len(ids_a)), ids_a]
        ending = np.zeros(len(ids_b), np.int64)
        ending[to_b - 1] = closes
        told[np.arange(len(ids_b)) + to_a[in_b]] = self.b_text[ending, ids_b]
        told = told.tolist()
        base = self.keys.n
        self.keys.extend(keys)
        self.ends.extend(base + link_end)
        self.sizes.extend(np.stack([n_a, n_b, shift(group_end), shift(link_end), spelt.astype(np.int64)], axis=1).ravel())
        low = 0
        for c, high in zip(chunks, np.cumsum(n_a + n_b).tolist(), strict=True):
            self.number[c] = len(self.groups_of)
            self.groups_of.append("".join(told[low:high]))
            self.characters += len(c)
            low = high

    def numbers(self, chunks: list[str]) -> np.ndarray:
        if len(self.number) > REMEMBERED or self.characters > CHARACTERS:
            self.forget()
        found = list(map(self.number.get, chunks))
        if None in found:
            self.learn(list(dict.fromkeys(c for c, x in zip(chunks, found, strict=True) if x is None)))
            found = list(map(self.number.__getitem__, chunks))
        return np.array(found, np.int64)

    def documents(self, texts: list[str]) -> Iterator[Document]:
        """Documents of texts that are not empty; short neighbours go through `numbers` together, long ones in blocks of chunks."""
        at = 0
        while at < len(texts):
            if len(texts[at]) > BLOCK:
                yield self.joined(map(self.numbers, map(list, batched((m[0] for m in self.chunk.finditer(" " + texts[at])), BLOCK))))
                at += 1
                continue
            lists, size = [], 0
            while at < len(texts) and (size := size + len(texts[at])) <= 4 * BLOCK and len(texts[at]) <= BLOCK:
                lists.append(self.chunk.findall(" " + texts[at]))
                at += 1
            edges = _edges(map(len, lists))
            names = self.numbers(list(chain.from_iterable(lists)))
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                yield self.joined([names[low:high]])

    def joined(self, blocks: Iterable[np.ndarray]) -> Document:
        sizes, told, keys, weights = np.zeros(5, np.int64), hashlib.sha256(), [], []
        for i, names in enumerate(blocks):
            used, often = np.unique(names, return_counts=True)
            here = self.sizes.held[: self.sizes.n].reshape(-1, 5)[used]
            if not here[:, 4].all():
                return Document()
            sizes += (here * often[:, None]).sum(0)
            told.update((";" * (i > 0) + ";".join([self.groups_of[x] for x in names.tolist()])).encode())
            n = here[:, 3]
            at = np.repeat(self.ends.held[used] - np.cumsum(n), n) + np.arange(n.sum())
            keys.append(self.keys.held[at])
            weights.append(np.repeat(often, n))
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        times = np.bincount(place, np.concatenate(weights), len(distinct)).astype(np.int64)
        return Document(tuple(sizes[:4].tolist()), told.hexdigest(), distinct, times)


@functools.lru_cache(maxsize=1)
def pair(bytes_file: str, pieces_file: str) -> Pair:
    return Pair(bytes_file, pieces_file)


SIZES = ("n_a", "n_b", "n_groups", "n_links")


def _lists(edges: np.ndarray, values: pa.Array, nulls: pa.Array | None = None) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values, mask=nulls)


def _edges(lengths: Iterable[int]) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(np.fromiter(lengths, np.int64))))


def _part(place: int, ids: list, found: list[Document], kind: pa.DataType) -> pa.RecordBatch:
    """A row a document; the first one has the part's keys, and in how many of its documents each is."""
    keys, at, n = np.unique(np.concatenate([f.keys for f in found]), return_inverse=True, return_counts=True)
    edges = _edges(len(f.keys) for f in found)
    first, others = np.repeat([0, len(keys)], [1, len(ids)]), pa.array(np.arange(len(ids)) > 0)
    row = [
        pa.array(np.full(len(ids), place)),
        pa.array(ids, kind),
        *(pa.array([f.sizes[i] for f in found], pa.int64()) for i in range(4)),
        pa.array([f.groups for f in found]),
        _lists(edges, pa.array(at, pa.int32())),
        _lists(edges, pa.array(np.concatenate([f.times for f in found]), pa.int64())),
        _lists(first, pa.array(keys), others),
        _lists(first, pa.array(n, pa.int64()), others),
    ]
    return pa.RecordBatch.from_arrays(row, ["place", "doc_id", *SIZES, "groups_sha256", "at", "times", "keys", "n"])


def _parts(files: tuple[str, str], part: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, none = pair(*files), Document()
        ids, texts, size, kind, places = [], [], 0, None, count()

        def out() -> pa.RecordBatch:
            told = both.documents([t for t in texts if t])
            return _part(next(places), ids, [next(told) if t else none for t in texts], kind)

        for b in batches:
            kind = b.schema.field(0).type
            for id_, text in zip(b.column(0), b.column(1), strict=True):
                ids.append(id_.as_py())
                texts.append(text.as_py())
                size += ROW + len(texts[-1] or "")
                if size >= part:
                    yield out()
                    ids, texts, size = [], [], 0
        if ids:
            yield out()

    return run


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, part, n) sorted by key: each with the sum over its key, and whether it is the key's first."""
    held: list[np.ndarray] = []

    def out(x: np.ndarray) -> pa.RecordBatch:
        first = np.concatenate(([True], x[1:, 0] != x[:-1, 0]))
        sums = np.add.reduceat(x[:, 2], np.flatnonzero(first))
        return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(sums[np.cumsum(first) - 1]), pa.array(first)], ["key", "part", "count", "first"])

    for b in batches:
        x = np.stack([b.column(i).to_numpy() for i in range(3)], axis=1)
        if not len(x):
            continue
        cut = int(np.searchsorted(x[:, 0], x[-1, 0]))  # the last key may go on in the next batch
        if cut or held and held[0][0, 0] != x[0, 0]:
            done = [*held, x[:cut]]
            held = []
            yield out(np.concatenate(done))
        held.append(x[cut:])
    if held:
        yield out(np.concatenate(held))


def _answered(docs: pa.Table, shard: pa.Table) -> pa.Table:
    """The documents of a part with its shard of the counts."""
    docs = docs.combine_chunks()
    one = lambda of, c: of.column(c).combine_chunks()
    keys, at = one(docs, "keys").flatten().to_numpy(), one(docs, "at")
    name, times, top = (one(shard, c).to_numpy(zero_copy_only=False) for c in ("key", "count", "top"))
    order = np.argsort(name)
    place = order[np.searchsorted(name, keys, sorter=order)] if len(keys) else np.zeros(0, np.int64)
    times, top = times[place], top[place].astype(np.int64)
    edges = at.offsets.to_numpy() - at.offsets[0].as_py()
    held, often = at.flatten().to_numpy(), one(docs, "times").flatten().to_numpy()
    upto = lambda x: pa.array(np.diff(np.concatenate(([0], np.cumsum(x)))[edges]), pa.int64())
    columns = [*(docs.column(x) for x in ("doc_id", *SIZES)), upto(often * top[held]), upto(often * times[held]), docs.column("groups_sha256")]
    return pa.Table.from_arrays(columns, ["doc_id", *SIZES, "n_best", "count_sum", "groups_sha256"])


def files_in(folder: str) -> tuple[str, str]:
    return f"{folder}/{BYTES_FILE}", f"{folder}/{PIECES_FILE}"


def parts(docs: DataFrame, files: tuple[str, str], part: int = PART) -> DataFrame:
    """Written documents, numbered by part; the first of each also has the part's keys and the documents with each of them (n)."""
    row = f"place bigint, doc_id {dict(docs.dtypes)['doc_id']}, {', '.join(f'{x} bigint' for x in SIZES)}, groups_sha256 string, at array<int>, times array<bigint>, keys array<bigint>, n array<bigint>"
    found = docs.select("doc_id", "text").mapInArrow(_parts(files, part), row)
    number = F.shiftleft(F.spark_partition_id().cast("bigint"), 33) + F.col("place")
    return written(found.select(number.alias("part"), "*").drop("place"), "alignment-parts")


def shards(of: DataFrame) -> DataFrame:
    """Written rows (key, part, count over all parts, first), sorted by key within ranges."""
    rows = of.where("keys IS NOT NULL").select("part", F.explode(F.arrays_zip("keys", "n")).alias("x")).select(F.col("x.keys").alias("key"), "part", F.col("x.n").alias("n"))
    dealt = rows.repartitionByRange("key").sortWithinPartitions("key", "part")
    return written(dealt.mapInArrow(_summed, "key bigint, part bigint, count bigint, first boolean"), "alignment-shards")


def counts(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """Per pair of ids (a, b): the number of documents that hold it linked."""
    one = shards(parts(docs, files_in(folder))).where("first")
    return one.select(F.shiftright("key", SHIFT).alias("a"), F.col("key").bitwiseAND((1 << SHIFT) - 1).alias("b"), "count")


def report(docs: DataFrame, folder: str = FOLDER, part: int = PART) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    kind = dict(docs.dtypes)["doc_id"]
    held = parts(docs, files_in(folder), part)
    counted = shards(held).withColumn("a", F.shiftright("key", SHIFT))
    best = F.broadcast(counted.groupBy("a").agg(F.max("count").alias("best")))  # a row an id of A's vocabulary
    shard = counted.join(best, "a").select("part", "key", "count", (F.col("count") == F.col("best")).alias("top"))
    met = held.drop("n").groupBy("part").cogroup(shard.groupBy("part"))
    return met.applyInArrow(_answered, f"doc_id {kind}, {', '.join(f'{x} bigint' for x in (*SIZES, 'n_best', 'count_sum'))}, groups_sha256 string")
