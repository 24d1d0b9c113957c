"""Main text of web pages by deducing the template of each host from equivalence classes.

Tokens are the block tags of a page, told apart by their path, and its short texts, told apart by
path and words. The occurrence vector of a token holds how often it occurs on each page of the
host; tokens with the same vector form an equivalence class. Vectors are compared by their number
of pages, their sum and a hash that adds up over pages, so one aggregation by (host, token) finds
the classes, however many pages a host has. A class is used if it is on enough pages and has
several tokens. Layouts that few of a host's pages have are hosts of their own.

The class whose tokens occur once on each page is the frame of the template; its tokens cut a
page into slots, and must come in the class's order on a page. Slots in parts that are never
article (menus, forms, notices and so on) are left out, as are slots that say the same on all
pages; the frame's element that holds the article gives the text. A text in the class of an
element around it, which may repeat on a page, is part of the template as well: it is left out
where each such element of the page holds it once. Hosts with fewer than LEAST_PAGES pages show
no template of their own and share the one of all such hosts.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, store, unused
from .markup import Block, blocks

#: Pages of a host from which on it has a template of its own.
LEAST_PAGES = 3
#: Share of a host's pages that a token is on to belong to its template: bounds a template by
#: the tokens of a page times the inverse.
LEAST_SHARE = 0.2
#: Pages from which on a layout that less than LEAST_SHARE of its host's pages have is on its own.
LAYOUT_PAGES = 20
#: Stands for the pages of a host whose layout is not on its own.
OTHERS = -1
#: Share of a host's pages that a text must be on, and share of a page's article that the texts of
#: a class may be, to belong to its template: what is more are copies of an article.
TEXT_PAGES, TEXT_SHARE = 0.5, 0.4
#: A slot that says the same everywhere is part of the template up to so many characters a page.
CONSTANT_CHARS = 400
#: Share of the text outside furniture that the article's element holds at least.
MAIN_SHARE = 0.6
#: Parts that are never article, by tag or by the words of a class, id or role (fixed values).
FURNITURE_TAGS = set("nav footer aside form head dialog menu fieldset".split())
FURNITURE_WORDS = set(
    "ad ads advert advertisement adverts banner sponsored promo cookie cookies consent notice "
    "alert popup modal sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header "
    "masthead comment comments reply replies discussion respond share sharing social related "
    "recommended newsletter subscribe subscription widget toolbar pagination pager login signup "
    "search complementary contentinfo skip".split()
)
#: Words that tell furniture in any class they are part of. The others tell it as a whole class or
#: beside words for a mere holder: "share-buttons", but not "article-header" or "search-results".
TELLING_WORDS = set(
    "ad ads advert advertisement adverts sponsored promo cookie cookies consent popup newsletter "
    "breadcrumb breadcrumbs navbar masthead pagination".split()
)
HOLDER_WORDS = set(
    "site top bottom left right primary secondary global area bar block body box button buttons "
    "container form icons inner item items link links list outer panel section thread tools wrap "
    "wrapper posts articles stories".split()
)
#: First words of classes that say what an element has or lacks, not what it is.
STATE_WORDS = set("has have no not with without is hide show".split())
#: Names of elements that hold the article.
MAIN_TAGS = ("article", "main")
#: Elements of text and lists, which hold no article by themselves.
LEAF_TAGS = set("p h1 h2 h3 h4 h5 h6 ul ol dl li dt dd table tr td th pre blockquote".split())
MAIN_WORDS = set("article content post entry story main body-text maincontent".split())
_WORD = re.compile(r"[a-z]+")


def _tells_furniture(name: str) -> bool:
    """Whether one class, id or role is that of a part that is never article."""
    words = _WORD.findall(name)
    if not words or (len(words) > 1 and words[0] in STATE_WORDS):
        return False
    told = FURNITURE_WORDS.intersection(words)
    return bool(told) and (bool(told & TELLING_WORDS) or set(words) <= FURNITURE_WORDS | HOLDER_WORDS)


def _furniture(key: tuple[str, bool]) -> bool:
    name, by_name = key
    tag, *names = name.split(".")
    if tag in FURNITURE_TAGS:
        return True
    return by_name and tag not in ("html", "body") and any(map(_tells_furniture, names))


def _is_main(key: tuple[str, bool]) -> bool:
    name, by_name = key
    tag, *names = name.split(".")
    if is_furniture(name, by_name) or tag in ("html", "body"):
        return False
    return tag in MAIN_TAGS or bool({w for n in names for w in _WORD.findall(n)} & MAIN_WORDS)


_FURNITURE, _MAIN = Memo(_furniture, 1 << 13), Memo(_is_main, 1 << 13)


def is_furniture(name: str, by_name: bool = True) -> bool:
    """Whether an element is never article, by its tag or, if ``by_name``, its names.

    Names of the root and the body say what the page has.
    """
    return _FURNITURE[name, by_name]


def is_main(name: str, by_name: bool = True) -> bool:
    """Whether an element is named as holding the article."""
    return _MAIN[name, by_name]


def in_furniture(path: tuple[str, ...], below: int = 0, by_name: bool = True) -> bool:
    """Whether an element of the path, from the place ``below`` on, is no article.

    A page's own header is none either, but the header of an article is part of it.
    """
    main = False
    for i, name in enumerate(path):
        main = main or is_main(name, by_name)
        if i >= below and (is_furniture(name, by_name) or (not main and name.split(".")[0] == "header")):
            return True
    return False


def _key(block: Block) -> str:
    """Token of a block: path of an element, ``/`` and path of its end, ``=``, path, # and hash of a text."""
    path = ">".join(block.path)
    if block.kind == "text":
        return f"={path}#{hashlib.blake2b(block.text.encode(errors='replace'), digest_size=8).hexdigest()}"
    return f"/{path}" if block.kind == "close" else path


def parsed(markup: str | None) -> list[Block]:
    """The blocks of a page, told apart by their place where no name tells the article.

    There, an element that may hold others is told from those of its name beside it by its turn in
    the element around them, so that each is a token of its own and the parts of a page are slots
    of their own. Neighbours that hold elements of the same names are records of one kind and take
    the same turn; elements of text and lists repeat as articles have them, and stay alike.
    """
    page = list(blocks(markup or ""))
    if any(_holds(b.path, by_name) for b in page if b.kind == "open" for by_name in (True, False)):
        return page
    inside: list[set[str]] = []  # names right below each opened element, in the order of opening
    around: list[int] = []
    for block in page:
        if block.kind == "open":
            if around:
                inside[around[-1]].add(block.path[-1])
            around.append(len(inside))
            inside.append(set())
        elif block.kind == "close":
            around.pop()
    out: list[Block] = []
    path: list[str] = []
    turns: list[dict[str, tuple[int, set[str] | None]]] = [{}]
    opened = 0
    for block in page:
        if block.kind == "open":
            name, below = block.path[-1], inside[opened]
            opened += 1
            if name.split(".")[0] not in LEAF_TAGS:
                turn, before = turns[-1].get(name, (-1, None))
                turn += before is None or before != below
                turns[-1][name] = turn, below
                name = f"{name}.~{turn}"
            path.append(name)
            turns.append({})
        out.append(Block(block.kind, tuple(path), block.text))
        if block.kind == "close":
            path.pop()
            turns.pop()
    return out


def layout_of(page: list[Block]) -> int:
    """A number for the elements of a page that may hold others, wherever they repeat."""
    opened = {b.path for b in page if b.kind == "open"}
    held = [p for p in opened if p[-1].split(".")[0] not in LEAF_TAGS]
    return zlib.crc32("\n".join(sorted(map(">".join, held))).encode(errors="replace"))


class _Seen:
    """What one batch says about a token of a host."""

    __slots__ = ("pages", "times", "mark", "place", "chars", "least", "most")

    def __init__(self):
        self.pages = self.times = self.mark = self.place = self.chars = 0
        self.least, self.most = 1 << 40, -1


def _mark(page: int, times: int) -> int:
    """A number of 40 bits for how often a token is on a page: sums of many fit a long."""
    return zlib.crc32(f"{page}:{times}".encode()) << 8 | times & 255


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each batch says about the tokens of a host's layouts; the empty token counts pages."""
    for batch in batches:
        seen: dict[tuple[str, int, str], _Seen] = {}
        columns = (batch.column(c).to_pylist() for c in ("host", "page", "html"))
        for host, page, markup in zip(*columns):
            own: dict[str, list] = {"": [1, 0, []]}
            all_blocks = parsed(markup)
            layout = layout_of(all_blocks)
            for place, block in enumerate(all_blocks):
                if block.kind == "text":
                    key = ">".join(block.path)
                    if key in own:
                        own[key][2].append(block.text)
                    if not key or len(block.text) > CONSTANT_CHARS:
                        continue
                one = own.setdefault(_key(block), [0, place, []])
                one[0] += 1
                if block.kind == "text":
                    one[2].append(block.text)
            for key, (times, place, texts) in own.items():
                one = seen.setdefault((host, layout, key), _Seen())
                said = zlib.crc32("\n".join(texts).encode(errors="replace")) if texts else 0
                one.pages += 1
                one.times += times
                one.mark += _mark(page, times)
                one.place += place
                one.chars += sum(map(len, texts))
                one.least, one.most = min(one.least, said), max(one.most, said)
        names = ["host", "layout", "token", *_Seen.__slots__]
        rows = [(*key, *(getattr(one, s) for s in _Seen.__slots__)) for key, one in seen.items()]
        values = zip(*rows) if rows else [()] * len(names)
        kinds = [pa.string(), pa.int64(), pa.string(), *[pa.int64()] * len(_Seen.__slots__)]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names)


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, empty if there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(found)


def _added_up(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("host", "layout", "token").agg(
        *[F.sum(s).alias(s) for s in ("pages", "times", "mark", "place", "chars")],
        F.min("least").alias("least"),
        F.max("most").alias("most"),
    )


def deduce(pages: DataFrame) -> DataFrame:
    """Templates of (host, page, html): (host, layout, n_pages, template), the last as JSON.

    ``layout`` is OTHERS but for layouts on their own. A template is a list of classes, the frame
    first: pages, times in all, and the tokens in order with their characters of text and whether
    they always say the same.
    """
    kinds = "host string, layout long, token string, " + ", ".join(f"{s} long" for s in _Seen.__slots__)
    observed = store(_added_up(pages.mapInArrow(_observe, kinds)), "template-tokens")
    layouts = observed.where("token = ''").select("host", "layout", "pages")
    total = layouts.groupBy("host").agg(F.sum("pages").alias("total"))
    rare = (F.col("pages") >= LAYOUT_PAGES) & (F.col("pages") < LEAST_SHARE * F.col("total"))
    alone = layouts.join(total, "host").where(rare).select("host", "layout", F.lit(True).alias("alone"))
    alone = store(alone, "template-layouts")
    tokens = observed.join(alone, ["host", "layout"], "left")
    tokens = _added_up(tokens.withColumn("layout", F.when(F.col("alone"), F.col("layout")).otherwise(OTHERS)))
    counted = (
        layouts.join(alone, ["host", "layout"], "left")
        .groupBy("host", F.when(F.col("alone"), F.col("layout")).otherwise(OTHERS).alias("layout"))
        .agg(F.sum("pages").alias("n_pages"))
    )
    counted = store(counted, "template-pages")
    described = F.struct(
        (F.col("place") / F.col("pages")).alias("place"),
        "token",
        "chars",
        (F.col("least") == F.col("most")).alias("constant"),
    )
    by_vector = (
        tokens.where((F.col("token") != "") & (F.col("pages") > 1))
        .join(counted, ["host", "layout"])
        .where(F.col("pages") >= F.greatest(F.lit(2.0), LEAST_SHARE * F.col("n_pages")))
        .groupBy("host", "layout", "n_pages", "pages", "times", "mark")
        .agg(F.array_sort(F.collect_list(described)).alias("tokens"))
        .where((F.size("tokens") > 1) & F.exists("tokens", lambda t: ~t["token"].startswith("=")))
    )
    return by_vector.groupBy("host", "layout", "n_pages").agg(
        F.to_json(
            F.array_sort(
                F.collect_list(
                    F.struct((-F.col("pages")).alias("order"), "pages", "times", F.col("tokens").alias("tokens"))
                )
            )
        ).alias("template")
    )


class Template:
    """What a host's classes say about where its article is."""

    def __init__(self, classes: list[dict], n_pages: int):
        self.frame = {}  # tokens of classes that occur once on a page, with their class and order
        opened = {}
        self.chars = {}  # of each element, repeated ones too
        for number, one in enumerate(classes):
            tags = [t for t in one["tokens"] if t["token"][0] != "="]
            self.chars |= {t["token"]: t["chars"] for t in tags if t["token"][0] != "/"}
            if one["pages"] != one["times"]:
                continue
            for order, token in enumerate(tags):
                self.frame[token["token"]] = (number, order)
                opened[token["token"]] = token
        paths = {k: t for k, t in opened.items() if f"/{k}" in opened}
        self.main = self._main(paths)
        inside = [t for k, t in paths.items() if self.main and k.startswith(self.main)]
        short = [t for t in inside if t["constant"] and 0 < t["chars"] <= CONSTANT_CHARS * n_pages]
        says_more = any(not t["constant"] for t in inside)
        self.constant = {t["token"] for t in short} if says_more and n_pages >= LEAST_PAGES else set()
        self.said = self._said(classes, n_pages) if self.main and n_pages >= LEAST_PAGES else {}
        self.said_in = {k[1:].rsplit("#", 1)[0] for k in self.said}

    def _said(self, classes: list[dict], n_pages: int) -> dict[str, str]:
        """Texts of the template in the article, with the innermost element around of their class."""
        said = {}
        article = sum(n for k, n in self.chars.items() if f"{k}>".startswith(f"{self.main}>"))
        for one in classes:
            opens = {t["token"] for t in one["tokens"] if t["token"][0] not in "=/"}
            own, chars = {}, 0
            for token in one["tokens"]:
                path = token["token"][1:].rsplit("#", 1)[0]
                if token["token"][0] != "=" or not f"{path}>".startswith(f"{self.main}>"):
                    continue
                names = path.split(">")
                outer = (">".join(names[:n]) for n in range(len(names), 0, -1))
                if found := next((o for o in outer if o in opens), None):
                    own[token["token"]] = found
                    chars += token["chars"]
            few = chars * n_pages <= TEXT_SHARE * article * one["pages"]
            if few and one["pages"] >= TEXT_PAGES * n_pages:
                said |= own
        return said

    def repeated(self, page: list[Block]) -> set[int]:
        """Places of the texts of a page that are part of the template."""
        if not self.said:
            return set()
        times: dict[str, int] = {}
        found: dict[str, list[tuple[int, int]]] = {}
        for place, block in enumerate(page):
            path = ">".join(block.path)
            if block.kind == "open":
                times[path] = times.get(path, 0) + 1
            elif block.kind == "text" and path in self.said_in and (outer := self.said.get(key := _key(block))):
                found.setdefault(key, []).append((place, times.get(outer, 0)))
        out = set()
        for key, at in found.items():
            if [n for _, n in at] == list(range(1, times.get(self.said[key], 0) + 1)):
                out.update(place for place, _ in at)
        return out

    def _main(self, paths: dict[str, dict]) -> str | None:
        """Path of the frame's element that holds the article."""
        split = {k: tuple(k.split(">")) for k in paths}
        for by_name in (True, False):  # wrappers with a name of furniture may hold an article
            named = [k for k, path in split.items() if _holds(path, by_name)]
            if named:
                return min(named, key=lambda k: (not split[k][-1].startswith(MAIN_TAGS), k.count(">"), k))
        free = {k: t for k, t in paths.items() if not in_furniture(split[k])}
        holders = [k for k in free if split[k][-1].split(".")[0] not in LEAF_TAGS]
        every = {k: n for k, n in self.chars.items() if not in_furniture(tuple(k.split(">")))}
        for chars in (every, {k: t["chars"] for k, t in free.items()}):
            within = {k: sum(n for j, n in chars.items() if f"{j}>".startswith(f"{k}>")) for k in holders}
            total = sum(chars.values())
            holding = [k for k, n in within.items() if total and n >= MAIN_SHARE * total]
            if holding:
                return max(holding, key=lambda k: (k.count(">"), k))
        return None

    def valid(self, page: list[Block]) -> bool:
        """Whether the frame's tokens come in order and no more than once on the page."""
        last: dict[int, int] = {}
        for block in page:
            if block.kind != "text" and (at := self.frame.get(_key(block))):
                if last.get(at[0], -1) >= at[1]:
                    return False
                last[at[0]] = at[1]
        return True

    def text(self, page: list[Block]) -> str:
        """The article: texts of the main element, or of all that is no furniture without one.

        Only what is below the main element can be furniture in it. Where names of furniture
        leave nothing, they are names of wrappers, and tags alone tell.
        """
        main = tuple(self.main.split(">")) if self.main and self.valid(page) else ()
        if main and not any(b.path[: len(main)] == main for b in page):
            main = ()
        found = main or _own_main(page, True)
        own = bool(found) and ">".join(found) == self.main
        said = _texts(page, found, True, self.constant if own else set(), self.repeated(page) if own else set())
        if not said:
            found = found or _own_main(page, False)
            said = _texts(page, found, True) or _texts(page, found, False)
        return "\n\n".join(said)


def _holds(path: tuple[str, ...], by_name: bool) -> bool:
    """Whether an element is named as holding the article."""
    named = is_main(path[-1], by_name) and path[-1].split(".")[0] not in LEAF_TAGS
    return named and not in_furniture(path, 0, by_name)


def _own_main(page: list[Block], by_name: bool) -> tuple[str, ...]:
    """Path of the outermost element of a page that is named as holding the article."""
    opened = (b.path for b in page if b.kind == "open")
    return min((p for p in opened if is_main(p[-1], by_name) and not in_furniture(p, 0, by_name)), key=len, default=())


def _texts(
    page: list[Block],
    main: tuple[str, ...],
    by_name: bool,
    constant: set[str] = frozenset(),
    repeated: set[int] = frozenset(),
) -> list[str]:
    n = len(main)
    return [
        b.text
        for place, b in enumerate(page)
        if b.kind == "text"
        and b.path[:n] == main
        and place not in repeated
        and not in_furniture(b.path, n, by_name)
        and ">".join(b.path) not in constant
    ]


def _template(key: tuple[str | None, int]) -> Template:
    described, n_pages = key
    return Template(json.loads(described) if described else [], n_pages)


def extract(df: DataFrame, html: str = "html", url: str = "url", out: str = "text") -> DataFrame:
    """Add the main text of each page as ``out``; all other columns stay.

    Blocks are joined by an empty line; character references are decoded, white space inside a
    block is one space. A null or empty page has an empty text. Pages without a URL are one host
    (the empty one). Repeated pages count as often as they come, and say the same: where all pages
    of a host are copies, nothing of the article is taken for template. Pages are read whole. A
    column named ``out`` is replaced; an empty table stays empty.
    """
    df = df.drop(out)
    host, of, layout, template, n_pages = unused(df, "host", "of", "layout", "template", "n_pages")
    split, own_template, own_pages = unused(df, "split", "own_template", "own_pages")
    seen = df.select(
        host_of(F.col(url)).alias("host"),
        F.xxhash64(*[df[c] for c in (url, html)]).alias("page"),
        F.col(html).alias("html"),
    )
    own = seen.groupBy("host").agg((F.count("*") >= LEAST_PAGES).alias("own"))
    own = store(own, "template-hosts")
    small = own.where("not own").select("host", F.lit(True).alias("small"))
    grouped = seen.join(small, "host", "left").withColumn(
        "host", F.when(F.col("small"), F.lit("*")).otherwise(F.col("host"))
    )
    found = store(deduce(grouped.select("host", "page", "html")), "templates")
    found = found.withColumnRenamed("host", "of")
    alone = found.where(F.col("layout") != OTHERS)
    several = alone.select("of", F.lit(True).alias(split)).distinct()
    named = own.select("host", F.when(F.col("own"), F.col("host")).otherwise("*").alias("of"))
    by_host = store(
        named.join(found.where(F.col("layout") == OTHERS), "of", "left").join(several, "of", "left").select(
            F.col("host").alias(host),
            F.col("of").alias(of),
            F.col(split),
            F.col("template").alias(template),
            F.col("n_pages").alias(n_pages),
        ),
        "templates-by-host",
    )
    joined = df.withColumn(host, host_of(F.col(url))).join(by_host, host, "left").drop(host)
    if not alone.isEmpty():
        joined = _with_layout(joined, html, split, layout)
        alone = alone.select(
            F.col("of").alias(of),
            F.col("layout").alias(layout),
            F.col("template").alias(own_template),
            F.col("n_pages").alias(own_pages),
        )
        joined = (
            joined.join(alone, [of, layout], "left")
            .withColumn(template, F.coalesce(own_template, template))
            .withColumn(n_pages, F.coalesce(own_pages, n_pages))
        )
    joined = joined.select(*df.columns, template, n_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Memo(_template, 1024)
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in (html, template, n_pages))
            texts = [templates[t, n or 0].text(parsed(h)) for h, t, n in zip(*columns)]
            rest = batch.drop_columns([template, n_pages])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array(texts, pa.string())], [*rest.schema.names, out]
            )

    return joined.mapInArrow(run, T.StructType([*df.schema, T.StructField(out, T.StringType())]))


def _with_layout(df: DataFrame, html: str, split: str, out: str) -> DataFrame:
    """Add the layout of the pages that ``split`` says it matters for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = zip(batch.column(html).to_pylist(), batch.column(split).to_pylist())
            layouts = [layout_of(parsed(h)) if wanted else None for h, wanted in pages]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(layouts, pa.int64())], [*batch.schema.names, out]
            )

    return df.mapInArrow(run, T.StructType([*df.schema, T.StructField(out, T.LongType())]))
