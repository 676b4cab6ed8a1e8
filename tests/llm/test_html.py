import re
import time
from html import unescape

import pytest

from procera.llm import html
from procera.llm.registry import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain  &amp; simple", "plain & simple"),
        ("<p>a<p>b<br>c</p>d", "a\nb c\nd"),
        ("<article><h1>T &lt;x&gt;</h1><p>one <b>two</b>\n three</article><footer>f</footer>", "T <x>\none two three"),
        ("<nav>n</nav><div class='ad-box'>ad</div><div id=sidebar>s</div><p>body</p><form>f<p>g</p></form><script>if (a<b) '</p>'</script>", "body"),
        ("<main><header><h1>Title</h1></header><p>x</p><section class='comments'><p>c</p></section></main>", "Title\nx"),
        ("<div class='header'>h</div><ul><li>a<li>b</ul><table><tr><td>1<td>2</table>", "a\nb\n1\n2"),
        ("<p>unclosed <a href='x>y'>link</a> <!-- gone --> end", "unclosed link end"),
        ("<p title=\"a>b\">x</p><p hidden>y</p><p style='display: none'>z</p>", "x"),
        ("a &nbsp; b&#x41;&eacute; <3 c < d", "a bAé <3 c < d"),
        ("<p>" * 3000 + "deep" + "<div>" * 3000 + "er", "deep\ner"),
        ("<article>a<article class='comment'>b</article></article><article>c</article>", "a\nc"),
        ("<html><head><title>t</title><style>p{}</style></head><body class='nav-open'><p>x", "x"),
    ],
)
def test_main_text(source, text):
    assert html.main_text(source) == text


def test_whole_table(spark):
    """On these pages the article is what stands in <article>; no template is inside one."""
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in QUERIES["op5_html_text"](spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        pieces = re.split(r"</?(?:p|h1)[^>]*>", inner)
        lines = [" ".join(unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", x)).split()) for x in pieces]
        assert got[r.page_id].text == "\n".join(x for x in lines if x)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_site_template_goes_and_copies_stay(spark):
    page = lambda i: f"<div><p>Site motto of all pages</p></div><p>Own text number {i} {'abc'[i % 3] * i}, long enough to be the main passage.</p><p>Contact us today</p>"
    rows = [(i, f"https://a.example/{i}", page(i)) for i in range(12)] + [(100 + i, f"http://A.example:80/{i}", page(5)) for i in range(40)]
    rows += [(200 + i, f"https://b.example/{i}", page(5)) for i in range(30)] + [(None, None, page(3)), (300, "nonsense", None)]
    frame = spark.createDataFrame([(*r, "q", 4) for r in rows], "page_id long, url string, html string, template string, host int")
    got = {r.page_id: r.text for r in html.extracted(frame).collect()}
    own = lambda i: f"Own text number {i} {'abc'[i % 3] * i}, long enough to be the main passage."
    assert got[4] == own(4)
    assert got[110] == own(5)
    assert got[210] == f"Site motto of all pages\n{own(5)}\nContact us today"
    assert got[None].startswith("Site motto") and got[300] == ""
    assert html.extracted(frame.limit(0)).count() == 0


def test_a_template_longer_than_the_articles_goes(spark):
    legal = "All content of this site is provided as it is and may not be copied without leave. " * 4
    page = lambda i: f"<div><p>Site motto</p></div><p>Short text {'abc'[i % 3] * (i + 1)}</p><div><p>{legal}</p></div>"
    rows = [(i, f"https://a.example/{i}", page(i)) for i in range(12)] + [(100 + i, f"https://b.example/{i}", page(5)) for i in range(12)]
    got = {r.page_id: r.text for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Short text {'abc'[i % 3] * (i + 1)}" for i in range(12))
    assert all(got[100 + i].endswith(legal.strip()) for i in range(12))


def test_references_are_decoded_piece_by_piece():
    assert html.main_text("<p>x &<b>amp;</b> y &am<!-- -->p; z</p>") == "x &amp; y &amp; z"


@pytest.mark.parametrize(
    "source",
    ["<b>" * 150_000 + "</i>" * 150_000, "<i><div>" + "<b>" * 150_000 + "</i>" * 150_000, '<a "' * 250_000, "<a \"'>" * 160_000, '<div class="share">' * 40_000 + "<article>x</article>", "<table><tr><td>" * 70_000, "<p>&lt;" * 140_000, "<li>" * 250_000, "</script" * 120_000 + ">"],
)
def test_a_megabyte_of_broken_markup_takes_seconds(source):
    began = time.perf_counter()
    html.main_text(source)
    assert time.perf_counter() - began < 8


def nonsense(i, own, pool=7):
    """A page whose furniture has no telling name: a menu, a notice dealt out of a pool, a legal line."""
    return (
        "<body><div class='qux'><ul><li>Inicio<li>Mapa<li>Fundo</ul></div><div><div id='zzt9'>" + f"Oferta {'abcdefg'[i % pool]} de hoje" + "</div>"
        f"<div class='grault'><p>{own}</p><p>More of it, {own[::-1]}</p></div></div><div class='plugh'>Todos os direitos</div></body>"
    )


def test_furniture_without_telling_names_goes_by_its_count(spark, monkeypatch):
    own = lambda i: f"own text {'xyz'[i % 3] * (i + 1)} about {chr(97 + i % 26)}{i} and more of the same kind"
    want = lambda i: f"{own(i)}\nMore of it, {own(i)[::-1]}"
    rows = [(i, f"https://a.example/{i}", nonsense(i, own(i))) for i in range(40)] + [(100 + i, f"https://few.example/{i}", nonsense(i, own(i))) for i in range(3)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extracted(frame).collect()}
    assert all(got[i] == want(i) for i in range(40))
    assert all("Inicio" in got[100 + i] and want(i) in got[100 + i] for i in range(3))
    monkeypatch.setattr(html, "MIN_PAGES", 10**9)  # no counting
    assert all("Inicio" in r.text and "Oferta" in r.text for r in html.extracted(frame).collect())


def test_edited_copies_of_an_article_keep_it(spark):
    part = lambda k: f"Paragraph {'abcdef'[k]} of the story that many pages of this site tell in nearly the same words"
    rows = []
    for i in range(30):
        parts = [part(k) for k in range(6)]
        parts[i % 6] += f" with change {chr(97 + i)}"
        rows.append((i, f"https://a.example/{i}", "<nav>menu</nav><article>" + "".join(f"<p>{x}</p>" for x in parts) + "</article>", "\n".join(parts)))
    rows += [(30 + i, f"https://a.example/{30 + i}", f"<nav>menu</nav><article><p>{'other words ' * 40}{i}</p></article>", f"{'other words ' * 40}{i}") for i in range(40)]
    got = {r.page_id: r.text for r in html.extracted(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")).collect()}
    assert all(got[r[0]] == r[3] for r in rows)


def test_counting_decides_on_the_test_pages(spark, monkeypatch):
    """With all rules by name switched off, counts alone delete most of what is not the article, and nothing of it."""
    for name in ("DROPPED", "FURNITURE", "ROLES", "CORES"):
        monkeypatch.setattr(html, name, frozenset())
    monkeypatch.setattr(html, "core", lambda node: False)
    rows = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()
    lists = {r.host: set(r.template) for r in html.templates(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).collect()}
    outside = left = lost = total = 0
    for r in rows[::5]:
        gone = lists.get(re.match(r"\w+://([^/]+)", r.url)[1].lower(), set())
        before, after = html.main_text(r.html), html.main_text(r.html, gone)
        inner = "\n".join(html.blocks([html.parse(re.search(r"<article>(.*)</article>", r.html, re.S)[1])])[0])
        outside += len(before) - len(inner)
        total += len(inner)
        left += max(0, len(after) - len(inner))
        lost += max(0, len(inner) - len(after))
    print("outside", outside, "left", left, "article", total, "lost", lost)
    assert left < 0.6 * outside and lost < 0.01 * total


def test_words_of_classes_do_not_delete_what_an_article_says():
    parts = "<p class='notice'>a</p><section class='related-work'><p>b</p></section><div class='promoted-gene'>c</div><table class='menu-prices'><tr><td>d</table>"
    assert html.main_text(f"<article>{parts}<div class='comments'>e</div><div class='ad-box'>f</div><nav>g</nav><div role='search'>h</div></article>") == "a\nb\nc\nd"
    assert html.main_text(f"<main>{parts}<p>x</p></main>") == "x"


@pytest.mark.parametrize("size", [100, 17_000, 200_000])
def test_furniture_of_any_length_is_counted(spark, size):
    legal = "legal words " * (size // 12)
    page = lambda i: f"<div><p>Own {'abc'[i % 3] * (i + 1)} text</p></div><div class='x'><div><p>{legal}</p><p>end</p></div></div>"
    frame = spark.createDataFrame([(i, f"https://a.example/{i}", page(i)) for i in range(12)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.extracted(frame).collect()} == {i: f"Own {'abc'[i % 3] * (i + 1)} text" for i in range(12)}


def test_counts_by_definition(spark):
    """Template contents and slots of every host of the table, counted in plain Python on subtrees spelt out in full."""
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    pages = {}
    for r in rows:
        name = (re.match(r"\w+://([^/:]+)", r.url) or [None, None])[1]
        root = html.parse(r.html or "")
        texts, found = html.blocks([root])
        if name and texts:
            chains = {id(root): ()}
            todo = [root]
            while todo:
                node = todo.pop()
                for x in node.children:
                    if isinstance(x, html.Node):
                        chains[id(x)] = (*chains[id(node)], (x.tag, tuple(sorted(m for m in x.marks if not m.isdigit()))))
                        todo.append(x)
            own = {(chains[id(x[0])], (x[0].tag, *texts[x[2] : x[3]])): sum(map(len, texts[x[2] : x[3]])) for x in found if x[0].tag not in ("html", "body")}
            whole = sum(map(len, texts))
            page = tuple(html.blocks(html.pruned(root))[0] or texts)
            kept = pages.setdefault(name.lower(), {}).setdefault(page, [own, whole])
            kept[0] = own | kept[0]
    want = {}
    for name, of in pages.items():
        if len(of) < html.MIN_PAGES:
            continue
        counts, chars, length = {}, {}, sum(whole for _, whole in of.values())
        for own, _ in of.values():
            for key, n in own.items():
                counts[key] = counts.get(key, 0) + 1
                chars[key] = max(chars.get(key, 0), n)
        by_content, by_slot = {}, {}
        for (slot, content), n in counts.items():
            by_content[content] = by_content.get(content, 0) + n
            by_slot.setdefault(slot, []).append((n, chars[slot, content]))
        same = [c for c, n in by_content.items() if n >= html.MIN_PAGES and n * 100 >= len(of) * html.SHARE]
        dealt = []
        for slot, held in by_slot.items():
            n = sum(x for x, _ in held)
            again = sum(x for x, _ in held if x >= 2 and x * 100 >= len(of))
            if n >= html.MIN_PAGES and n * 100 >= len(of) and again * html.REPEATED >= n and sum(c for _, c in held) * html.THIN <= length:
                dealt.append(slot)
        want[name] = len(same) + len(dealt)
    got = {r.host: len(r.template) for r in html.templates(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    assert got == {k: n for k, n in want.items() if n} and got
