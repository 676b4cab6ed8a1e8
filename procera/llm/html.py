"""Main text of web pages, with site templates removed by subtree counts.

Every page is parsed into an element tree, and every block subtree with text gets two hashes: one of its
content, one of its slot (the chain of element names, classes, ids and roles that leads to it; what these say
does not matter). Spark counts contents and slots per host over pages with different main texts, so that copies
of a page don't make its article a template. Deleted are

- contents on at least SHARE percent of the host's pages, and at least MIN_PAGES;
- slots on at least MIN_PAGES pages and one in a hundred, if at least 1 / REPEATED of what stands in them recurs (on
  two pages and one in a hundred) and all their different contents make at most 1 / THIN of the host's text: menus,
  adverts and footers that are dealt out of a pool. An article's paragraphs are neither.

Only then rules that need no count take what counting can't see, such as reader comments (always new) and furniture of
hosts with few pages: elements and roles that are no article, and words of classes and ids. Inside <article> only words for
adverts and comments count, as other words may say what the article is about. What is left becomes text, one line per block.

A host has at most (blocks per page) * 100 template slots and (blocks per page) * 100 / SHARE template contents, so
its list is bounded by its pages' size and not by their number.

Defined results: NULL html is empty; a page without main text gives an empty text;
pages without a host have no template; repeated rows give equal rows. Inside
<article> or <main> only these are used if present. <br> is white space. Character references are decoded in each
piece of text by itself. Pages of any length and depth take linear time. An empty table gives no rows. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procera.llm.common import small, written

MIN_PAGES = 5
SHARE = 50
REPEATED, THIN = 3, 10
#: Parts that a host's pages are dealt to where template lists are too many to be broadcast.
SALT = 16
#: Tags with unclosed quotes that a page may have before quotes count no more.
BROKEN = 16

# Element names by role in HTML, and words that mark page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
DROPPED = frozenset("script style noscript template nav footer aside form button select input textarea iframe svg canvas head menu dialog object embed audio video title link meta noembed noframes xmp map math".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
UNSEEN = frozenset("script style noscript template iframe svg canvas head object embed audio video noembed noframes xmp map math".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CORES = frozenset("article main".split())
HEADS = frozenset("header banner masthead".split())
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption legend summary".split())
OWN_KIND = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tfoot", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th")}
SCOPE = frozenset("table ul ol dl div article section main body html aside nav header footer form blockquote td th".split())
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header menu modal nav navbar navigation newsletter notice notices overlay pagination popup promo promoted promotion recommended related share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets masthead disclaimer reply replies".split()
)
#: Of these words, the ones that also mean an element inside an article; any other may be what the article is about.
INTRUDERS = frozenset("ad ads advert adverts advertisement adsbygoogle comment comments commentlist disqus replies".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_BARE = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_OPEN = re.compile(r"<[/a-zA-Z!?]")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Node:
    __slots__ = ("tag", "marks", "children")

    def __init__(self, tag: str, marks: frozenset = frozenset()):
        self.tag, self.marks, self.children = tag, marks, []


def marks(source: str) -> frozenset:
    """What the attributes say of the element: lower-case words of class and id, role, and whether it is hidden."""
    if "=" not in source and "hidden" not in source.lower():
        return frozenset()
    out = set()
    for key, *values in _ATTRIBUTE.findall(source):
        key, value = key.lower(), "".join(values)
        if key in ("class", "id"):
            out |= {w.lower() for w in _WORD.findall(value)}
        elif key == "role":
            out |= {f"role:{w.lower()}" for w in value.split()}
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            out.add("hidden:")
    return frozenset(out)


class Stack:
    """Open elements, with the places of each kind, so that what a tag closes is found at once."""

    def __init__(self, root: Node):
        self.nodes: list[Node] = []
        self.at: dict[str, list[int]] = defaultdict(list)
        self.push(root)

    def push(self, node: Node) -> None:
        for kind in self.kinds(node.tag):
            self.at[kind].append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, size: int) -> None:
        while len(self.nodes) > size:
            for kind in self.kinds(self.nodes.pop().tag):
                self.at[kind].pop()

    @staticmethod
    def kinds(tag: str) -> tuple[str, ...]:
        return (tag, "scope:", "box:") if tag in SCOPE and tag not in ("td", "th") else (tag, "scope:") if tag in SCOPE else (tag,)

    def last(self, *kinds: str) -> int:
        return max((self.at[k][-1] for k in kinds if self.at[k]), default=0)

    def close(self, tag: str) -> None:
        """An end tag closes its element, through others; only a scope's own end, or that of a paragraph, passes a scope."""
        at = self.last(tag)
        if at and (tag in SCOPE or tag == "p" or at > self.last("scope:")):
            self.cut(at)

    def make_room(self, tag: str) -> None:
        """Close what `tag` ends by opening."""
        if tag in CLOSES_P and self.last("p") > self.last("scope:"):
            self.cut(self.last("p"))
        while tag in OWN_KIND and (at := self.last(*OWN_KIND[tag])) > self.last("box:"):
            self.cut(at)
            if tag not in ("tr", "tbody", "tfoot"):
                break


def tags(source: str) -> Iterator[re.Match]:
    """Markup in order. An end of a tag inside quotes is none, unless BROKEN quotes were never closed."""
    at, end, broken = 0, source.rfind(">"), 0
    while at <= end and (start := _OPEN.search(source, at)) and (start.start() <= end or source.startswith("<!--", start.start())):
        found = _TOKEN.match(source, start.start()) if broken < BROKEN else None
        if found is None:
            broken += 1
            found = _BARE.match(source, start.start())
        if found is None:
            at = start.end()
            continue
        at = (yield found) or found.end()


def parse(source: str) -> Node:
    """Element tree of possibly broken markup; unclosed elements end with their parent or where their kind demands."""
    root = Node("html")
    stack = Stack(root)
    at = 0
    found = next(markup := tags(source), None)
    while found is not None:
        if found.start() > at:
            stack.nodes[-1].children.append(entities.unescape(source[at : found.start()]))
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag or tag == "html":
            pass
        elif found[1]:
            stack.close(tag)
        else:
            stack.make_room(tag)
            attributes = found[3] or ""
            node = Node(tag, marks(attributes))
            stack.nodes[-1].children.append(node)
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
                node.children.append(source[at : close.start()] if close else source[at:])
                at = close.end() if close else len(source)
            elif tag not in VOID and not (attributes.endswith("/") and tag not in BLOCK):
                stack.push(node)
        try:
            found = markup.send(at)
        except StopIteration:
            break
    if at < len(source):
        stack.nodes[-1].children.append(entities.unescape(source[at:]))
    return root


def holding(root: Node, kinds: frozenset) -> set[int]:
    """Ids of the elements that have an element of `kinds` below them."""
    order, todo = [], [(root, None)]
    while todo:
        node, above = todo.pop()
        order.append((node, above))
        todo += [(x, node) for x in node.children if isinstance(x, Node)]
    found: set[int] = set()
    for node, above in reversed(order):
        if above is not None and (node.tag in kinds or id(node) in found):
            found.add(id(above))
    return found


def core(node: Node) -> bool:
    return node.tag in ("article", "main") or "role:main" in node.marks


def furniture(node: Node, inside: bool, article: bool, headed: set[int], cored: set[int]) -> bool:
    """What no count is needed for. `inside`: below a core; `article`: below <article>; `headed`, `cored`: elements with headings or cores below."""
    if node.tag in DROPPED or "hidden:" in node.marks:
        return True
    if node.tag in ("html", "body", "main") or "role:main" in node.marks:
        return False
    own_head = inside and id(node) in headed
    if node.tag == "header":
        return not own_head
    said = bool(node.marks & (FURNITURE & INTRUDERS if article else FURNITURE)) or any(f"role:{r}" in node.marks for r in ROLES)
    if said and own_head and node.marks & HEADS and not node.marks & (FURNITURE - HEADS):
        return False
    return said and not (node.tag != "article" and id(node) in cored)


def pruned(root: Node) -> list[Node]:
    """Furniture deleted; the outermost <article> or <main> elements, or the whole page if there is none."""
    headed, cored = holding(root, HEADINGS), holding(root, CORES)
    roots: list[Node] = []
    todo: list[tuple[Node, bool, bool]] = [(root, False, False)]
    while todo:
        node, inside, article = todo.pop()
        if core(node) and not inside:
            roots.append(node)
            inside = True
        article = article or node.tag == "article"
        node.children = [x for x in node.children if not (isinstance(x, Node) and furniture(x, inside, article, headed, cored))]
        todo += [(x, inside, article) for x in reversed(node.children) if isinstance(x, Node)]
    return roots or [root]


def digest(data: str) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(data.encode("utf-8", "surrogatepass")), "little", signed=True)


#: A block subtree: the element, the one above it, and the texts that stand in it.
Subtree = tuple[Node, Node, int, int]


def blocks(roots: list[Node]) -> tuple[list[str], list[Subtree]]:
    """Texts of the blocks in page order, and the block subtrees with text, inner ones first."""
    texts: list[str] = []
    found: list[Subtree] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            texts.append(text)
        line.clear()

    for root in roots:
        flush()
        frames = [(root, root, iter(root.children), len(texts))]
        while frames:
            node, above, rest, first = frames[-1]
            child = next(rest, None)
            if child is None:
                frames.pop()
                if node.tag in BLOCK:
                    flush()
                    if len(texts) > first and node is not root:
                        found.append((node, above, first, len(texts)))
            elif isinstance(child, str):
                line.append(child)
            elif child.tag == "br":
                line.append(" ")
            else:
                if child.tag in BLOCK:
                    flush()
                if child.children and child.tag not in UNSEEN:
                    frames.append((child, node, iter(child.children), len(texts)))
        flush()
    return texts, found


def slots(root: Node) -> dict[int, int]:
    """For the id of each element, a hash of the chain of elements and their marks that leads to it; numbers in marks are left out."""
    out = {id(root): 0}
    todo = [root]
    while todo:
        node = todo.pop()
        for x in node.children:
            if isinstance(x, Node):
                out[id(x)] = digest(f"{out[id(node)]} {x.tag} {' '.join(sorted(m for m in x.marks if not m.isdigit()))}")
                todo.append(x)
    return out


#: Modulus and base of the hashes of runs of texts.
PRIME, BASE = (1 << 61) - 1, 0x1D3F5A7B9C2E4861


class Contents:
    """Hashes of the block subtrees' contents, each at once from prefix hashes over the page's texts, however deep they nest."""

    def __init__(self, texts: list[str]):
        self.upto, self.power = [0], [1]
        for text in texts:
            self.upto.append((self.upto[-1] * BASE + digest(text)) % PRIME)
            self.power.append(self.power[-1] * BASE % PRIME)

    def of(self, subtree: Subtree) -> int:
        node, _, first, last = subtree
        return digest(f"{node.tag} {last - first} {(self.upto[last] - self.upto[first] * self.power[last - first]) % PRIME}")


def counted(subtree: Subtree) -> bool:
    return subtree[0].tag not in ("html", "body")


def without(root: Node, template: set[int] | frozenset) -> Node:
    """The tree without the block subtrees whose slot or content is in `template`."""
    if template:
        texts, found = blocks([root])
        named, contents = slots(root), Contents(texts)
        for x in found:
            if counted(x) and (named[id(x[0])] in template or contents.of(x) in template):
                x[0].children = []
    return root


def main_text(source: str | None, template: set[int] | frozenset = frozenset()) -> str:
    return "\n".join(blocks(pruned(without(parse(source or ""), template)))[0])


def _subtrees(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different (slot, content) of a page's block subtrees, and one row (0, page) with the page's length. A page is its main text."""
    for b in batches:
        rows: list[tuple] = []
        for host, source in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            root = parse(source.as_py() or "")
            texts, found = blocks([root])
            if texts:
                lengths = [0, *accumulate(map(len, texts))]
                named, contents = slots(root), Contents(texts)
                own = {(named[id(x[0])], contents.of(x)): lengths[x[3]] - lengths[x[2]] for x in found if counted(x)}
                page = digest("\n".join(blocks(pruned(root))[0] or texts))
                rows += [(host, slot, hash_, page, n) for (slot, hash_), n in own.items()]
                rows.append((host, 0, page, page, lengths[-1]))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.string(), *[pa.int64()] * 4), strict=True)], ["host", "slot", "hash", "page", "chars"])


def host(url) -> F.Column:
    found = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def templates(pages: DataFrame) -> DataFrame:
    """(host, template): hashes of each host's template contents and slots."""
    rows = pages.select(host(F.col("url")).alias("host"), "html").where("host IS NOT NULL")
    seen = rows.mapInArrow(_subtrees, "host string, slot bigint, hash bigint, page bigint, chars bigint")
    seen = seen.groupBy("host", "slot", "hash", "page").agg(F.max("chars").alias("chars"))  # a page once
    counts = written(seen.groupBy("host", "slot", "hash").agg(F.count("*").alias("n"), F.max("chars").alias("chars")), "html-subtrees")
    total = written(counts.where("slot = 0").groupBy("host").agg(F.count("*").alias("pages"), F.sum("chars").alias("length")).where(F.col("pages") >= MIN_PAGES), "html-hosts")
    parts = counts.where("slot <> 0").join(small(total), "host")
    same = parts.groupBy("host", "pages", "hash").agg(F.sum("n").alias("n")).where((F.col("n") >= MIN_PAGES) & (F.col("n") * 100 >= F.col("pages") * SHARE))
    recurs = (F.col("n") >= 2) & (F.col("n") * 100 >= F.col("pages"))
    per = parts.groupBy("host", "pages", "length", "slot").agg(F.sum("n").alias("n"), F.sum(F.when(recurs, F.col("n")).otherwise(0)).alias("again"), F.sum("chars").alias("chars"))
    dealt = per.where((F.col("n") >= MIN_PAGES) & (F.col("n") * 100 >= F.col("pages")) & (F.col("again") * REPEATED >= F.col("n")) & (F.col("chars") * THIN <= F.col("length")))
    gone = same.select("host", F.col("hash").alias("t")).union(dealt.select("host", F.col("slot").alias("t")))
    return written(gone.groupBy("host").agg(F.collect_set("t").alias("template")), "html-templates")


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(source.as_py(), set(gone.as_py() or ())) for source, gone in zip(b.column(2), b.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extracted(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    kinds = dict(pages.dtypes)
    named = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    lists = templates(pages)
    if small(lists) is lists:  # many hosts: join, a host's pages dealt to SALT tasks
        named = named.withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int"))
        lists = lists.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = named.join(lists, ["host", "part"], "left")
    else:
        joined = named.join(small(lists), "host", "left")
    text = joined.select("page_id", "url", "html", "template").mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return text.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
