"""Static html to text, links and nodes: the one place where a page needs a stack."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.menu_text import tidy
from ..functions.rules import matches

# Fixed values.
SKIPPED = frozenset("script style noscript template svg head nav footer aside form button select iframe".split())
BLOCK = frozenset("p div br li ul ol tr td th table section article header dt dd dl h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i img input kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
UNSEEN = frozenset("head script style noscript template svg select iframe".split())
CHROME_TAGS, CHROME_ROLES = frozenset("nav header footer aside".split()), frozenset("navigation banner contentinfo".split())
ZERO_WIDTH = re.compile("[\u200b\u200c\u200d\ufeff]")
BOILERPLATE = re.compile(r"\b(cookie|consent|gdpr|newsletter|subscribe|social|breadcrumb|skip-link|modal|popup)\b", re.I | re.A)
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "mdash": "—", "ndash": "–", "hellip": "…", "rsquo": "’", "lsquo": "‘", "ldquo": "“", "rdquo": "”", "middot": "·", "bull": "•"}
ENTITY = re.compile(r"&(#x?[0-9a-fA-F]+|[a-zA-Z]+);")
LINK_TEXT = r"\b(menu|nutrition|download|view menu|full menu)\b"


def decode_entities(text: str) -> str:
    """The named references of menus and numeric ones; others stay as they are."""

    def one(m: re.Match) -> str:
        body = m[1]
        if body[0] != "#":
            return ENTITIES.get(body.lower(), m[0])
        try:
            code = int(body[2:], 16) if body[1] in "xX" else int(body[1:])
            return chr(code) if code > 0 else m[0]
        except (ValueError, OverflowError):
            return m[0]

    return ENTITY.sub(one, text)


class Reader(HTMLParser):
    """Text with line breaks, title and links; with `tree`, every element with its place, too.

    All work is linear in the page: an element notes where its text begins and ends in that of the page, what its
    ancestors hold isn't copied to them.
    """

    def __init__(self, tree: bool = False) -> None:
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []
        self.title: str | None = None
        self.links: list[tuple[str, str]] = []
        self.anchor: tuple[str, list[str]] | None = None
        self.stack: list[tuple[str, bool, bool, int]] = []
        self.open: Counter[str] = Counter()
        self.skipped = self.unseen = 0
        self.in_title = False
        self.tree = tree
        self.nodes: list[Node] = []
        self.flat: list[str] = []
        self.size = 0
        self.line: list[str] = []
        self.line_at = -1

    def put(self, text: str) -> None:
        self.flat.append(text)
        self.size += len(text)

    def end_line(self) -> None:
        if self.line and (text := " ".join("".join(self.line).split())) and self.line_at >= 0:
            self.nodes[self.line_at].lines.append(text)
        self.line, self.line_at = [], -1

    def found(self, text: str) -> None:
        if self.in_title:
            self.title = (self.title or "") + text
        if self.tree:
            text_ = ZERO_WIDTH.sub("", text)
            self.put(text_)
            if not self.unseen:
                if self.line_at < 0 and self.stack and text_.strip():
                    self.line_at = self.stack[-1][3]
                self.line.append(text_)
        if not self.skipped:
            self.out.append(re.sub(r"\s+", " ", text) if text.strip() else " ")
            if self.anchor:
                self.anchor[1].append(text)

    def handle_data(self, data: str) -> None:
        self.found(data)

    def handle_entityref(self, name: str) -> None:
        self.found(decode_entities(f"&{name};"))

    def handle_charref(self, name: str) -> None:
        self.found(decode_entities(f"&#{name};"))

    def boundary(self, tag: str) -> None:
        self.out.append("\n" if tag in BLOCK else " ")
        if self.tree:
            self.put(" ")
            if tag in BLOCK or tag not in INLINE:
                self.end_line()
            else:
                self.line.append(" ")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        named = {k: v or "" for k, v in attrs}
        self.boundary(tag)
        at = len(self.nodes)
        if self.tree:
            up = self.nodes[self.stack[-1][3]] if self.stack else None
            chrome = tag in CHROME_TAGS or named.get("role", "").lower() in CHROME_ROLES or bool(up and up.chrome)
            self.nodes.append(Node(at, at, up.pre if up else -1, up.depth + 1 if up else 0, tag, named.get("class", ""), named.get("data-testid", ""), named.get("role", ""), named.get("alt", ""), chrome, self.size, self.size, []))
        if tag == "a":
            self.anchor = (named.get("href", ""), [])
        if tag in VOID:
            return
        skip = tag in SKIPPED or bool(BOILERPLATE.search(named.get("class", ""))) or bool(BOILERPLATE.search(named.get("id", "")))
        self.stack.append((tag, skip, tag in UNSEEN, at))
        self.open[tag] += 1
        self.skipped += skip
        self.unseen += tag in UNSEEN
        self.in_title = self.in_title or (tag == "title" and self.title is None)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def shut(self) -> str:
        """Close the innermost open element."""
        tag, skip, unseen, at = self.stack.pop()
        self.open[tag] -= 1
        self.skipped -= skip
        self.unseen -= unseen
        if self.tree:
            self.nodes[at].last, self.nodes[at].end = len(self.nodes) - 1, self.size
        return tag

    def handle_endtag(self, tag: str) -> None:
        if tag == "a" and self.anchor:
            self.links.append((self.anchor[0], "".join(self.anchor[1]).strip()))
            self.anchor = None
        if tag == "title":
            self.in_title = False
        if self.open[tag]:
            while self.shut() != tag:
                pass
        self.boundary(tag)

    def close(self) -> None:
        super().close()
        self.end_line()
        while self.stack:
            self.shut()


@dataclass(slots=True)
class Node:
    pre: int
    last: int
    parent: int
    depth: int
    tag: str
    classes: str
    testid: str
    role: str
    alt: str
    chrome: bool
    begin: int
    end: int
    lines: list[str]


def read_page(html: str, tree: bool = False) -> Reader:
    reader = Reader(tree)
    reader.feed(html)
    reader.close()
    return reader


#: Pages whose results are held at a time; a batch of Spark's has up to 10,000.
MOST_PAGES = 32


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most `MOST_PAGES` rows, so that what Python makes of a page is let go of soon."""
    for batch in batches:
        for at in range(0, batch.num_rows, MOST_PAGES):
            yield batch.slice(at, MOST_PAGES)


def html_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, title, links): one row per page, in Arrow batches; null html gives an empty text.

    links is array<struct<pos, href, text>>.
    """
    schema = "k long, url string, text string, title string, links array<struct<pos:int,href:string,text:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("pos", pa.int32()), ("href", pa.string()), ("text", pa.string())]))
        for part in slices(batches):
            texts, titles, links = [], [], []
            for x in part.column(2):
                r = read_page(x.as_py() or "")
                texts.append("".join(r.out))
                titles.append(r.title.strip() if r.title else None)
                links.append([{"pos": i, "href": h, "text": t} for i, (h, t) in enumerate(r.links)])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(titles, pa.string()), pa.array(links, kind)], ["k", "url", "text", "title", "links"])

    read = pages.select(F.col(key).cast("long"), F.col(url).cast("string"), F.col(html).cast("string")).mapInArrow(run, schema)
    return read.withColumn("text", tidy(F.col("text"))).withColumnRenamed("k", key)


def restaurant_name(title: Column) -> Column:
    """The title up to its first separator, without menu, official site and home; null if nothing is left."""
    first = F.element_at(F.split(title, r"\s+[|–—-]\s+"), 1)
    return F.nullif(F.trim(F.regexp_replace(first, r"(?i)(?<![A-Za-z0-9_])(menu|official site|home)(?![A-Za-z0-9_])", "")), F.lit(""))


#: Scheme, authority with its slashes, path, query with its mark, fragment with its mark (RFC 3986, appendix B).
ADDRESS = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"


def absolute(base: Column, href: Column) -> Column:
    """`href` as seen from `base`, as in RFC 3986, 5.2; an address of its own, and any without a base, stays as it is.

    A scheme that is the base's own, without slashes after it, counts as none. Empty segments of a path stay.
    """
    b, h = ([F.regexp_extract(x, ADDRESS, i) for i in range(1, 6)] for x in (base, href))
    scheme, own = F.lower(b[0]), F.lower(h[0])
    merged = F.when(h[2].startswith("/"), h[2]).when(b[2] == "", F.concat(F.lit("/"), h[2])).otherwise(F.concat(F.regexp_replace(b[2], "[^/]*$", ""), h[2]))
    none = F.array().cast("array<string>")
    steps = F.split(merged, "/", -1)
    up = lambda out: F.when(F.size(out) > 1, F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(1)))).otherwise(out)
    kept = F.aggregate(steps, none, lambda out, s: F.when(s == "..", up(out)).when(s == ".", out).otherwise(F.concat(out, F.array(s))))
    kept = F.when(F.element_at(steps, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    path = F.when(h[2] == "", b[2]).otherwise(F.array_join(kept, "/"))
    query = F.when((h[2] == "") & (h[3] == ""), b[3]).otherwise(h[3])
    colon = F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise("")
    relative = F.when(h[1] != "", F.concat(colon, h[1], h[2], h[3], h[4])).otherwise(F.concat(colon, b[1], path, query, h[4]))
    return F.when((F.coalesce(base, F.lit("")) == "") | ((own != "") & (own != scheme)), href).when(href == "", base).otherwise(relative)


def menu_links(read: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, pos, href, text, confident) from `html_text`: links to a PDF are confident, menu-like texts candidates.

    Addresses are made absolute; of equal ones the confident, then the first, stays.
    """
    links = read.select(key, url, F.explode("links").alias("l")).select(key, url, "l.*")
    links = links.where((F.col("href") != "") & ~F.col("href").startswith("#") & ~F.col("href").rlike("(?i)^(javascript|mailto|tel):"))
    links = links.withColumn("confident", matches(F.col("href"), r"\.pdf(?:$|[?#])")).where(F.col("confident") | matches(F.col("text"), LINK_TEXT))
    links = links.withColumn("href", absolute(F.col(url), F.col("href")))
    # partial aggregation: of equal links, a task sends one
    first = F.min(F.struct((~F.col("confident")).alias("unsure"), "pos", "text")).alias("l")
    return links.groupBy(key, "href").agg(first).select(key, "l.pos", "href", "l.text", (~F.col("l.unsure")).alias("confident"))


#: How many ancestors a path names at most; browsers nest no deeper.
MOST_DEPTH = 512


def html_nodes(pages: DataFrame, key: str = "page_id", html: str = "html", most_text: int = 2000, path_tags: tuple[str, ...] = ("article",), path_words: tuple[str, ...] = ("item", "product", "dish", "card")) -> DataFrame:
    """(key, pre, last, parent, depth, tag, class, testid, role, alt, chrome, text, length, lines, path) of each element, in document order.

    `pre` is its number, `last` the largest number in its subtree. `chrome`: it is or stands in a page's
    navigation, header, footer or aside. `text` is flat and cut at one more than `most_text` characters, which
    keeps a large page's rows small; `length` is whole. `lines` are the lines of text that begin in it and in none
    of its descendants. `path` are its ancestors, the nearest first, where its tag is one of `path_tags` or its class or test id
    holds one of `path_words`; null elsewhere, so that paths stay few. A page costs time in proportion to its length.
    """
    kinds = {"k": "long", "pre": "int", "last": "int", "parent": "int", "depth": "int", "tag": "string", "class": "string", "testid": "string", "role": "string", "alt": "string", "chrome": "boolean", "text": "string", "length": "int", "lines": "array<string>", "path": "array<int>"}
    arrow = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}
    schema = pa.schema([(n, arrow[t]) for n, t in kinds.items()])
    wanted = re.compile("|".join(map(re.escape, path_words)), re.I)

    def rows_of(k: int, html: str) -> Iterator[tuple]:
        read = read_page(html, tree=True)
        words = [(m.start(), m[0]) for m in re.finditer(r"\S+", "".join(read.flat))]
        begins = [at for at, _ in words]
        sizes = [0, *accumulate(len(w) + 1 for _, w in words)]
        for n in read.nodes:
            i, j = bisect_left(begins, n.begin), bisect_left(begins, n.end)
            length = max(0, sizes[j] - sizes[i] - 1)
            cut = min(j, bisect_left(sizes, sizes[i] + most_text + 2, i))
            path = None
            if n.tag in path_tags or wanted.search(n.classes) or wanted.search(n.testid):
                path, up = [], n.parent
                while up >= 0 and len(path) < MOST_DEPTH:
                    path.append(up)
                    up = read.nodes[up].parent
            yield k, n.pre, n.last, n.parent, n.depth, n.tag, n.classes, n.testid, n.role, n.alt, n.chrome, " ".join(w for _, w in words[i:cut])[: most_text + 1], length, n.lines, path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for k, x in zip(batch.column(0), batch.column(1), strict=True):
                for row in rows_of(k.as_py(), x.as_py() or ""):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return pages.select(F.col(key).cast("long"), F.col(html).cast("string")).mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in kinds.items())).withColumnRenamed("k", key)
