"""Line dedup with a log-template tree.

A line is parsed at fixed depth: by its number of tokens, then by its leading
DEPTH tokens, tokens with a digit standing as variable. Inside a leaf, lines with
at least SIMILAR of their tokens equal in place share a template, whose differing
positions are generalised. A template that recurs in many documents is
boilerplate, and all its lines are dropped.

What counts are different texts with content of their own. Every line has three sketches,
each the least of a hash over its 5-word shingles (over the whole of a shorter line); a line is a text's own if none of them
stands in any other text. So an edited line of a copied document still is no own line, as at least one of its
sketches mostly survives the edit, while a short body under a long licence is one. A text gives
evidence on its templates if its own lines make OWN percent of its words. Dropped: templates with
evidence from at least CONTEXTS texts, and from at least 1 / SPREAD of the different texts that
hold them. So copies of one document, edited ones too, keep their lines, however many they are,
and are left to document-level dedup. Equal texts weigh one, however many rows have them.

Leaves are only opened if rows enough have them, told by a sieve (see `repeats`; a leaf
let in by chance is judged like any other). A leaf with
more than MOST different lines is grown in slices, and the slices' templates are
grown again like lines, at the same depth and similarity, until they fit one task.
Where rounds no longer shrink a leaf, its templates are compared slice against slice,
and those linked are one template.

Defined results: NULL text is empty, with no lines; blank lines are never dropped nor
counted; a text all of whose lines go becomes empty. Lines end at \\n
only. Repeated rows are copies. Rows are told apart by doc_id and text. An empty table
stays empty. Extra columns stay as they are, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procera.llm.common import packed, written
from procera.llm.components import components
from procera.llm.repeats import Sieve, hit, tagged
from procera.llm.runs import mixed
from procera.llm.substring import word_ids, word_spans

DEPTH = 3
SIMILAR = 0.7
CONTEXTS = 10
SPREAD = 4
OWN = 5
SHINGLE = 5
MOST = 1000
ANY = "<*>"
SALTS = np.array([1, 0x14057B7EF767814F, 0x2545F4914F6CDD1D], np.uint64)
_BASE = np.uint64(0x5851F42D4C957F2D)
_ODD = mixed(np.arange(SHINGLE, dtype=np.uint64)) | np.uint64(1)
_ANY = ANY.encode()
_DIGITS = re.compile(rb"[0-9]")
_VARIABLE = re.compile(r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*")
_DIGIT = re.compile(r"[0-9]")
GROWN = "line bigint, template bigint, tokens binary"


def digest(data: bytes) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(data), "little", signed=True)


def leaf_of(count: int, leading: list[bytes]) -> int:
    return digest(b"%d %s" % (count, b" ".join(leading)))


def tokens(line: str) -> list[bytes]:
    """Tokens with variable ones generalised."""
    return (_VARIABLE.sub(ANY, line) if _DIGIT.search(line) else line).encode("utf-8", "surrogatepass").split()


def parsed(text: str | None) -> list[tuple[int, int, bytes] | None]:
    """(leaf, line name, generalised line) for each line of the text; None for blank ones."""
    out: list[tuple[int, int, bytes] | None] = []
    for line in (text or "").split("\n"):
        words = tokens(line)
        if words:
            whole = b" ".join(words)
            out.append((leaf_of(len(words), words[:DEPTH]), digest(whole), whole))
        else:
            out.append(None)
    return out


class Lines:
    """The lines with words of a text: their numbers, words, places of the first words, and sketches (one row each)."""

    def __init__(self, text: str | None):
        self.data = (text or "").encode("utf-8", "surrogatepass")
        raw = np.frombuffer(self.data, np.uint8)
        self.start, self.end = word_spans(raw)
        line = np.searchsorted(np.flatnonzero(raw == 10), self.start)
        self.first = np.flatnonzero(np.concatenate((np.ones(min(1, len(line)), bool), line[1:] != line[:-1])))
        self.line = line[self.first]
        self.words = np.diff(np.append(self.first, len(line)))
        if not len(line):
            self.sketches = np.zeros((0, len(SALTS)), np.int64)
            return
        ids = word_ids(raw, self.start, self.end)
        gram = ids.copy()
        for step in range(1, SHINGLE):
            gram *= _BASE
            gram[:-step] += ids[step:]
        left = np.repeat(self.first + self.words, self.words) - np.arange(len(line))
        whole = left >= SHINGLE  # a shingle within its line
        for i in np.flatnonzero(self.words < SHINGLE).tolist():
            at = self.first[i]
            whole[at] = True
            gram[at] = np.bitwise_xor.reduce(ids[at : at + self.words[i]] * _ODD[: self.words[i]])
        gram = mixed(gram)
        self.sketches = np.stack([np.minimum.reduceat(np.where(whole, gram * salt, ~np.uint64(0)), self.first) for salt in SALTS], axis=1).view(np.int64)

    def leaves(self) -> set[int]:
        """The leaves of all lines; words with a digit count as variable."""
        out = set()
        last = self.end[self.first + np.minimum(self.words, DEPTH) - 1]
        for a, z, n in zip(self.start[self.first].tolist(), last.tolist(), self.words.tolist(), strict=True):
            out.add(leaf_of(n, [_ANY if _DIGITS.search(w) else w for w in self.data[a:z].split()]))
        return out


LEAF, SKETCH = 0, 1


def _marks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves of a text, and its lines' sketches with the line's words and those of the text."""
    for b in batches:
        out: list[list[np.ndarray]] = [[] for _ in range(6)]
        for k2, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            lines = Lines(text.as_py())
            line, words = lines.line, lines.words
            if not len(line):
                continue
            leaves = np.fromiter(lines.leaves(), np.int64)
            values, at = np.unique(lines.sketches.ravel(), return_index=True)
            n, m = len(leaves), len(values)
            none = np.zeros(n, np.int64)
            of = at // len(SALTS)
            for column, part in zip(out, ((np.full(n, LEAF), np.full(m, SKETCH)), (leaves, values), (none + k2, np.full(m, k2)), (none, line[of]), (none, words[of]), (none, np.full(m, words.sum()))), strict=True):
                column += part
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], ["kind", "value", "k2", "line", "words", "total"])


def marks(docs: DataFrame) -> DataFrame:
    """Per leaf and sketch: rows, line, its words and the text's; `lo` and `hi` are equal if one text has it, and then the rest is that text's.

    A text gives a sketch once and its copies give it alike, so least values are those of one row, and need no sort as the least of a struct does.
    """
    rows = docs.select("k2", "text").mapInArrow(_marks, "kind bigint, value bigint, k2 bigint, line bigint, words bigint, total bigint")
    of = (F.min(c).alias(c) for c in ("line", "words", "total"))
    return rows.groupBy("kind", "value").agg(F.count("*").alias("n"), F.min("k2").alias("lo"), F.max("k2").alias("hi"), *of)


def evidence(marked: DataFrame) -> DataFrame:
    """(k2) of the texts whose own lines make OWN percent of their words."""
    alone = marked.where((F.col("kind") == SKETCH) & (F.col("lo") == F.col("hi"))).select(F.col("lo").alias("k2"), "line", "words", "total")
    own = alone.groupBy("k2", "line", "words", "total").agg(F.count("*").alias("n")).where(F.col("n") == len(SALTS))
    return own.groupBy("k2", "total").agg(F.sum("words").alias("own")).where(F.col("own") * 100 >= F.col("total") * OWN).select("k2")


def opened(docs: DataFrame, leaves: Sieve) -> DataFrame:
    """One row per document and different line in the chosen leaves."""
    kept = leaves.bits

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k1, k2, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                rows += [(k1, k2, *x) for x in {x[1]: x for x in parsed(text.as_py()) if x}.values()]
            if rows:
                columns = [pa.array(x, pa.binary() if i == 4 else pa.int64()) for i, x in enumerate(zip(*rows, strict=True))]
                batch = pa.RecordBatch.from_arrays(columns, ["k1", "k2", "leaf", "line", "tokens"])
                yield batch.filter(pa.array(hit(kept.value, batch.column(2).to_numpy())))

    rows = docs.select("k1", "k2", "text").mapInArrow(emit, "k1 bigint, k2 bigint, leaf bigint, line bigint, tokens binary")
    return leaves.behind(rows, "leaf")


def grown(lines: list[tuple[int, list[bytes]]]) -> list[tuple[int, int, bytes]]:
    """Templates of one leaf: (line name, template name, template), in the given order of lines. A generalised position is an empty token."""
    found: list[tuple[int, list[bytes]]] = []
    of: list[int] = []
    for line, words in lines:
        best, where = -1, -1
        for i, (_, t) in enumerate(found):
            equal = sum(a == b != b"" for a, b in zip(t, words, strict=True))
            if equal > best:
                best, where = equal, i
        if best >= SIMILAR * len(words):
            template = found[where][1]
            for i, (a, b) in enumerate(zip(template, words, strict=True)):
                if a != b:
                    template[i] = b""
        else:
            where = len(found)
            found.append((line, list(words)))
        of.append(where)
    merged = [b" ".join(t) for _, t in found]
    return [(line, found[i][0], merged[i]) for (line, _), i in zip(lines, of, strict=True)]


def _grow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for group in b.column(0):
            lines = sorted(((-x["n"], x["tokens"], x["line"]) for x in group.as_py()))
            rows += grown([(line, words.split(b" ")) for _, words, line in lines])
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], ["line", "template", "tokens"])


def _meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among the templates of one slice, or between those of two."""
    for b in batches:
        us: list[int] = []
        vs: list[int] = []
        for group in b.column(0):
            items = group.as_py()
            names = np.array([x["line"] for x in items], np.int64)
            words = [x["tokens"].split(b" ") for x in items]
            code: dict[bytes, int] = {b"": 0}
            codes = np.array([[code.setdefault(w, len(code)) for w in t] for t in words], np.int64)
            for i in range(len(items) - 1):
                equal = ((codes[i + 1 :] == codes[i]) & (codes[i] != 0)).sum(1)
                linked = names[i + 1 :][equal >= SIMILAR * codes.shape[1]]
                us += [int(names[i])] * len(linked)
                vs += linked.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


def met(crowded: DataFrame) -> DataFrame:
    """(line, template) for the linked ones of (leaf, line, tokens, n, size): every slice of a leaf is compared with every other."""
    count = F.ceil(F.col("size") * 2 / MOST).cast("int")
    own = crowded.select("leaf", F.struct("line", "tokens").alias("item"), count.alias("k"), F.pmod(F.xxhash64("line"), count).cast("int").alias("own"))
    pairs = own.select("leaf", "item", "own", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    at = (F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    groups = pairs.select("leaf", "item", *at).groupBy("leaf", "p", "q").agg(F.collect_list("item").alias("items")).select("items")
    star = components(groups.mapInArrow(_meet, "u bigint, v bigint"))
    return star.select(F.col("u").alias("line"), F.col("v").alias("template"))


def tree(lines: DataFrame) -> DataFrame:
    """(line, template) from distinct lines (line, tokens, n)."""
    words = F.split(F.col("tokens").cast("string"), " ")
    now = lines.withColumn("leaf", F.xxhash64(F.size(words), F.slice(words, 1, DEPTH)))
    # `of` leads from a line to the template, among `now`, that it has become; None: each is its own.
    of, done, left, turn = None, None, None, 0

    def named(part: DataFrame) -> DataFrame:
        return part if of is None else of.withColumnRenamed("template", "_item").join(part.withColumnRenamed("line", "_item"), "_item").select("line", "template")

    while True:
        size = now.groupBy("leaf").agg(F.count("*").alias("size"))
        placed = written(now.join(size, "leaf"), "template-leaves")
        group = F.collect_list(F.struct("line", "tokens", "n")).alias("lines")
        fits, crowded = placed.where(F.col("size") <= MOST), placed.where(F.col("size") > MOST)
        part = named(fits.groupBy("leaf").agg(group).select("lines").mapInArrow(_grow, GROWN).select("line", "template"))
        done = part if done is None else done.union(part)
        before, left = left, crowded.count()
        if not left:
            return done
        if before is not None and left * 10 > before * 9:
            linked = met(crowded.select("leaf", "line", "tokens", "size"))
            last = crowded.select("line").join(linked, "line", "left").select("line", F.coalesce("template", "line").alias("template"))
            return done.union(named(last))
        slice_ = F.pmod(F.xxhash64("line", F.lit(turn)), F.ceil(F.col("size") * 2 / MOST))
        step = written(crowded.groupBy("leaf", slice_.alias("slice")).agg(group).select("lines").mapInArrow(_grow, GROWN), "template-slices")
        of = written(named(step.select("line", "template")), "template-of")
        merged = step.join(crowded.select("line", "leaf", "n"), "line").groupBy("template", "leaf", "tokens").agg(F.sum("n").alias("n"))
        now, turn = merged.select(F.col("template").alias("line"), "tokens", "n", "leaf"), turn + 1


def recurring(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Opened rows (written) and the lines to drop: (line, template, texts, evidence)."""
    docs = tagged(rows)
    marked = written(marks(docs), "template-marks")
    leaves = Sieve(marked.where((F.col("kind") == LEAF) & (F.col("n") >= CONTEXTS)), "value")
    held = written(opened(docs, leaves), "template-lines")
    distinct = held.groupBy("line").agg(F.count("*").alias("n"), F.min("tokens").alias("tokens"))
    named = written(tree(written(distinct, "template-distinct")), "template-tree")
    per_text = written(held.select("line", "k2").join(named, "line").groupBy("template", "k2").agg(F.count("*").alias("lines")), "template-texts")
    told = written(evidence(marked).withColumn("own", F.lit(1)), "template-evidence")
    per = per_text.join(told, "k2", "left").groupBy("template").agg(F.count("*").alias("texts"), F.count("own").alias("evidence"))
    bad = per.where((F.col("evidence") >= CONTEXTS) & (F.col("evidence") * SPREAD >= F.col("texts")))
    return held, written(named.join(bad, "template"), "template-dropped")


def _stripped(docs: DataFrame) -> DataFrame:
    """`row` (all columns of `docs`, dropped lines taken out of `text`), n_lines, n_dropped."""
    held, bad = recurring(docs.select("doc_id", "text"))
    marks = held.join(bad.select("line"), "line").groupBy("k1", "k2").agg(F.collect_set("line").alias("gone"))
    at = docs.columns.index("text")

    def strip(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fields = b.column(0).flatten()
            texts, dropped = [], []
            for text, marked in zip(fields[at], b.column(2), strict=True):
                text, gone = text.as_py(), set(marked.as_py())
                lines = text.split("\n")
                kept = [line for line, x in zip(lines, parsed(text), strict=True) if x is None or x[1] not in gone]
                texts.append("\n".join(kept))
                dropped.append(len(lines) - len(kept))
            fields[at] = pa.array(texts, pa.string())
            row = pa.StructArray.from_arrays(fields, fields=list(b.column(0).type))
            yield pa.RecordBatch.from_arrays([row, b.column(1), pa.array(dropped, pa.int64())], ["row", "n_lines", "n_dropped"])

    lines = F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.size(F.split("text", "\n", -1))).cast("bigint")
    rows = packed(docs, "doc_id", "text").select("row", F.xxhash64("doc_id").alias("k1"), F.xxhash64("text").alias("k2"), lines.alias("n_lines"))
    joined = rows.join(marks, ["k1", "k2"], "left")
    touched = joined.where(F.col("gone").isNotNull()).select("row", "n_lines", "gone").mapInArrow(strip, f"row {rows.schema['row'].dataType.simpleString()}, n_lines bigint, n_dropped bigint")
    whole = joined.where(F.col("gone").isNull()).select("row", "n_lines", F.lit(0).cast("bigint").alias("n_dropped"))
    return whole.union(touched)


def cleaned(docs: DataFrame) -> DataFrame:
    """`docs` with dropped lines taken out of `text`, all other columns as they were."""
    return _stripped(docs).select("row.*")


def report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, text without dropped lines, n_lines, n_dropped."""
    return _stripped(docs.select("doc_id", "text")).select("row.*", "n_lines", "n_dropped")
