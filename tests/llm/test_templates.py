"""Main text of pages whose parts are known, by host."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from marquee.llm import templates
from marquee.llm.common import prepare
from marquee.llm.markup import blocks
from marquee.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def texts(page):
    return [b.text for b in blocks(page) if b.kind == "text"]


def test_blocks():
    page = """<!DOCTYPE html><p>a &amp; b<br>c<p>d <b>e</b>f<!-- x <p>y --><script>if (a<b) "</p>"</script>
    <ul><li>one<li>two &#233;&nbsp;&lt;p&gt;</ul></section>5 < 6<div title="a>b">end"""
    assert texts(page) == ["a & b c", "d ef", "one", "two é <p>", "5 < 6", "end"]
    assert texts("") == [] and texts("<") == ["<"] and texts("<p") == []
    paths = [b.path for b in blocks("<div id=x1><p>a</div><p>b") if b.kind == "text"]
    assert paths == [("div.x0", "p"), ("p",)]


def test_only_whole_names_are_dropped():
    for name in ("svg-icon", "button-group", "select-box", "template-part", "title-bar"):
        assert texts(f'<article><{name} name="x"></{name}><p>whole</p></article>') == ["whole"]
    for name in ("svg", "object", "iframe", "math", "button", "script", "svg width='9' "):
        assert texts(f"<article><{name}/><p>whole</p></article>") == ["whole"]
    for name in ("svg", "select", "button", "iframe", "template", "noscript"):
        assert texts(f"<article><{name} a=b>x</{name.upper()}><p>whole</p></article>") == ["whole"]
        assert texts(f"<article><{name}><p>whole</p></article>") == ["whole"]
    for name in ("script", "style", "textarea", "title"):
        assert texts(f"<p>a<{name} x>b<p>c") == ["a"]
    formula = "<math><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow></math>"
    assert texts(f"<p>As {formula} holds<p><object data=o><p>instead</p></object>") == ["As x = 2 holds", "instead"]
    assert texts("<button>" * 100_000 + "x" * 100_000) == ["x" * 100_000]


def test_very_long_and_broken_pages_end():
    assert texts("<p>" * 3000 + "x") == ["x"]
    assert texts("<div " + 'a="' * 2000) == []
    assert len(texts("<i>" + "word " * 300_000)[0]) == 1_500_000 - 1


def article(draw):
    words = lambda n: " ".join(f"w{draw.randrange(10**6)}" for _ in range(n))
    return [words(4), *[words(draw.randrange(5, 40)) for _ in range(draw.randrange(1, 6))]]


LAYOUTS = {
    # Named elements, menus and notices; comments below and a form inside the article.
    "a.example": """<html><head><title>t{i}</title></head><body><header>Site {r}</header><nav><ul>{menu}</ul></nav>
      <div class="cookie-notice">We use cookies {r}</div><article><h1>{title}</h1>{body}<form>Mail {r}</form>
      <div class="notice">Share this story with all your friends</div></article><section id="comments"><p>Nice {r}</p>
      </section><aside>See also {r}</aside><footer>(c) {r}</footer></body></html>""",
    # No telling names at all: the frame and what is constant in it must do.
    "b.example": """<html><body><div><ul>{menu}</ul></div><div><div><h2>{title}</h2>{body}
      <div>Follow us for more stories</div></div></div></body>""",
}


def pages(draw, n):
    rows, expected = [], {}
    for i in range(n):
        host = list(LAYOUTS)[i % len(LAYOUTS)]
        title, *body = article(draw)
        menu = "".join(f"<li><a href=/{k}>m{draw.randrange(9)}</a>" for k in range(draw.randrange(3, 7)))
        html = LAYOUTS[host].format(
            i=i, r=draw.randrange(10**6), menu=menu, title=title, body="".join(f"<p>{b}</p>" for b in body)
        )
        rows.append((i, f"https://{host}/p{i}", html))
        expected[i] = "\n\n".join([title, *body])
    return rows, expected


def test_parts_of_known_pages(spark):
    rows, expected = pages(random.Random(3), 80)
    df = prepare(spark).createDataFrame(rows, "page_id long, url string, html string")
    for row in templates.extract(df).collect():
        if "a.example" in row.url:
            assert row.text == expected[row.page_id]
        else:
            assert expected[row.page_id] in row.text
            assert "Follow us" not in row.text


WRAPPED = [
    '<body class="has-sidebar"><nav>m</nav><article>{}</article></body>',
    '<body class="search"><nav>m</nav><article>{}</article></body>',
    '<body><div class="menu"><article>{}</article></div><nav>m</nav></body>',
    '<body><article class="post has-comments">{}<div class="comments"><p>Nice</p></div></article></body>',
    '<body><article class="post sponsored">{}</article><aside>a</aside></body>',
    '<body><main class="search-results">{}</main><footer>f</footer></body>',
    '<body><article><div class="article-header"><h1>Own title {{}}</h1></div>{}</article></body>',
    '<body><article>{}<div class="share-buttons">Send {{}}</div><p class="ad-text">Buy {{}}</p></article></body>',
    '<body><div class="no-sidebar"><div>{}</div></div><nav>m</nav></body>',
    '<body><div class="modal"><div>{}</div></div><nav>m</nav></body>',
]


def test_names_of_wrappers_are_no_furniture(spark):
    rows = []
    for number, layout in enumerate(WRAPPED):
        for host, n in ((f"few{number}", 1), (f"many{number}", 4)):
            for i in range(n):
                html = layout.format("<p>One {}</p><p>Two {}</p>").replace("{}", f"w{i}")
                rows.append((number, f"http://{host}/{i}", f"<html>{html}</html>"))
    df = prepare(spark).createDataFrame(rows, "page_id long, url string, html string")
    for row in templates.extract(df).collect():
        i = row.url[-1]
        title = [f"Own title w{i}"] if row.page_id == 6 else []
        assert row.text.split("\n\n") == [*title, f"One w{i}", f"Two w{i}"], row


def test_repeated_parts_of_unnamed_layouts(spark):
    """Unnamed share rows, notices and item labels that repeat on a page; layouts few pages have."""
    draw = random.Random(9)
    rows, expected = [], {}
    share = "<ul><li>Send by mail<li>Print<li>Copy link</ul>"
    for i in range(40):
        title, *body = article(draw)
        menu = "".join(f"<li>m{draw.randrange(99)}" for _ in range(draw.randrange(2, 5)))
        text = f"<h2>{title}</h2><p>All rights are ours</p>{''.join(f'<p>{b}</p>' for b in body)}"
        items = [article(draw)[0] for _ in range(draw.randrange(1, 4))]
        boxes = "".join(f"<section><p>Fact</p><p>{x}</p></section>" for x in items)
        rows.append((i, f"http://x/{i}", f"<body><div><ul>{menu}</ul></div><div><div>{text}{share}{boxes}</div></div></body>"))
        expected[i] = "\n\n".join([title, *body, *items])
    for i in range(40, 320):  # seven layouts of 40 pages each
        title, *body = article(draw)
        outer, inner = [("div", "section"), ("section", "div"), ("center", "div"), ("div", "center"),
                        ("center", "section"), ("section", "center"), ("main-part", "div")][i % 7]
        text = f"<h2>{title}</h2>{''.join(f'<p>{b}</p>' for b in body)}"
        menu = f"<{inner}><b>Home {draw.randrange(99)}</b></{inner}>"
        rows.append((i, f"http://hot/{i}", f"<body>{menu}<{outer}><{inner}>{text}</{inner}><p>Ours {i % 7}</p></{outer}></body>"))
        expected[i] = "\n\n".join([title, *body])
    df = prepare(spark).createDataFrame(rows, "page_id long, url string, html string")
    for row in templates.extract(df).collect():
        assert row.text == expected[row.page_id], row


def test_unnamed_layout_equals_its_article(spark):
    rows, expected = pages(random.Random(5), 80)
    df = prepare(spark).createDataFrame(rows, "page_id long, url string, html string")
    found = templates.extract(df).where("url like '%b.example%'").collect()
    assert len(found) == 40 and all(row.text == expected[row.page_id] for row in found)


def test_near_copies_keep_their_article(spark):
    same = "".join(f"<p>Paragraph {k} of a text that all pages share</p>" for k in range(4))
    rows = [(i, f"http://x/{i}", f"<article><h1>Title {i}</h1>{same}<p>End {i}</p></article>") for i in range(9)]
    df = prepare(spark).createDataFrame(rows, "page_id long, url string, html string")
    for row in templates.extract(df).collect():
        assert row.text.count("Paragraph") == 4


def test_copies_keep_their_article(spark):
    rows, expected = pages(random.Random(4), 1)
    df = prepare(spark).createDataFrame(
        [(i, rows[0][1], rows[0][2]) for i in range(20)], "page_id long, url string, html string"
    )
    for row in templates.extract(df).collect():
        assert expected[0] in row.text and "cookies" not in row.text


def test_registered_query(spark):
    source = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    rows = QUERIES["op4_html"](spark, SMALL).collect()
    assert len(rows) == len(source)
    for row in rows:
        whole = source[row.page_id]
        own = whole[whole.index("<article>") : whole.index("</article>")]
        assert row.text == "\n\n".join(texts(own)) and row.n_chars == len(row.text) > 0


def test_odd_rows(spark):
    rows = [
        (1, None, None), (2, None, ""), (3, "no url", "plain text only"), (4, "http://x/", "<p>a</p><nav>b</nav>"),
        (4, "http://x/", "<p>a</p><nav>b</nav>"), (None, "http://y/", "<footer>c</footer>"), (5, "http://x/", "<<>><p"),
        (6, "http://x/", "<p>" + "word " * 100_000),
    ]
    df = prepare(spark).createDataFrame(rows, "page_id long, url string, html string")
    df = df.withColumn("text", F.lit(1)).withColumn("host", F.lit(2)).withColumn("template", F.lit(3))
    out = templates.extract(df)
    assert set(out.columns) == set(df.columns)
    found = {(r.page_id, r.text[:20]) for r in out.collect()}
    assert found == {(1, ""), (2, ""), (3, "plain text only"), (4, "a"), (None, ""), (5, "<<>>"), (6, "word word word word ")}
    assert templates.extract(df.where("false")).collect() == []


def test_pages_without_names(spark):
    """Names and telling tags taken away, the classes alone find the same articles."""
    from collections import Counter

    pages = prepare(spark).read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    bare = F.regexp_replace("html", r"(?i)<(/?)(?:article|nav|footer|header|aside|main|section)\b[^>]*>", "<$1div>")
    bare = F.regexp_replace(bare, r"""(?i)\s(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", "")
    nameless = pages.withColumn("html", bare)
    named = {r.page_id: r.text for r in templates.extract(pages).collect()}
    found = {r.page_id: r.text for r in templates.extract(nameless).collect()}
    said = lambda text: Counter(t for t in text.split("\n\n") if t)
    common = sum(sum((said(named[k]) & said(found[k])).values()) for k in named)
    assert common >= 0.95 * sum(sum(said(t).values()) for t in found.values())
    assert common >= 0.95 * sum(sum(said(t).values()) for t in named.values())
    # Without the classes of its host a page keeps its menu, advert and footer.
    alone = templates.Template([], 0)
    whole = [alone.text(templates.parsed(r.html)) for r in nameless.limit(40).collect()]
    assert all(a not in named.values() for a in whole)


def test_elements_are_told_apart_by_their_turn():
    page = "<div><div><p>a</p><p>b</p></div><div><div>c</div></div><div><div>e</div></div></div><div>d</div>"
    at = [(b.text, ">".join(b.path)) for b in templates.parsed(page) if b.kind == "text"]
    assert at == [
        ("a", "div.~0>div.~0>p"), ("b", "div.~0>div.~0>p"), ("c", "div.~0>div.~1>div.~0"),
        ("e", "div.~0>div.~1>div.~0"), ("d", "div.~1"),
    ]
    named = "<div><div class='x'>a</div><article><p>b</p></article></div>"
    assert [">".join(b.path) for b in templates.parsed(named) if b.kind == "text"] == ["div>div.x", "div>article>p"]
