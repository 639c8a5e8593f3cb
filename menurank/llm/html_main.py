"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
NAMES = re.compile(r"(?:^|\s)(?:class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.I)
#: Text in these is never shown or never part of an article.
DROPPED = frozenset("script style noscript template head title iframe object svg math canvas select option button textarea input nav footer aside form dialog menu fieldset label audio video map".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
KEEP_P = frozenset("article aside blockquote body button caption dd details div dl dt fieldset figure footer form header html li main nav ol section table tbody td tfoot th thead tr ul".split())
#: Names that mark furniture around an article when they are a whole class, id or role.
FURNITURE = re.compile(
    r"(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banners?|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|overlay|newsletter|subscri\w+|signup|login|menus?|nav\w*|breadcrumbs?|sidebars?|side|widgets?|footers?|foot|masthead|toolbar|search\w*|share|sharing|social\w*|related|recommend\w*|comments?|commentlist|respond|replies|reply|disqus|discussion|reviews?|pagination|pager|copyright|legal|disclaimer|complementary|contentinfo|navigation|skip|hidden|tags?)",
    re.I,
)
#: A name that says what the page has or is filed under, not what the element is.
ABOUT = re.compile(r"(?:has|no|not|non|with|without|is|tag|type|category|cat|format|status|postid)[_-]", re.I)
#: Factors of a path's score: in an article, else in main; in a doubtful element.
IN_ARTICLE, IN_MAIN, DOUBTFUL = 1.5, 1.25, 0.5
DOUBT = "?"
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")


def furniture(names: str) -> str:
    """"whole" if a class, id or role is a name of furniture, "part" if only a part of one is, "" if none."""
    found = ""
    for name in names.split():
        if FURNITURE.fullmatch(name):
            return "whole"
        if not ABOUT.match(name) and any(FURNITURE.fullmatch(x) for x in re.split(r"[_-]", name)):
            found = "part"
    return found


class Page:
    """Text nodes of a page in order, with the tag path of each, the block it is in, and the named elements around it.

    Names: elements whose class, id or role is, or has, a name of furniture, numbered in `kinds`; `holders` are
    those that are, or hold, an article or main.
    """

    def __init__(self, source: str) -> None:
        self.paths: list[tuple[str, ...]] = []
        self.texts: list[str] = []
        self.blocks: list[int] = []
        self.named: list[tuple[int, ...]] = []
        self.kinds: list[str] = []
        self.holders: set[int] = set()
        self.around: list[int] = []
        self.stack: list[str] = []
        self.tags: list[str] = []
        self.dropped = 0
        self.marks: list[bool] = []
        self.block = 0
        self.read(source)

    def pop(self, to: int) -> None:
        while len(self.stack) > to:
            self.stack.pop()
            if self.tags.pop() not in INLINE:
                self.block += 1
            self.dropped -= self.marks.pop()
            self.around.pop()

    def text(self, found: str) -> None:
        if found and not self.dropped:
            self.paths.append(tuple(self.stack))
            self.texts.append(entities.unescape(found))
            self.blocks.append(self.block)
            self.named.append(tuple(x for x in self.around if x >= 0))

    def open(self, tag: str, rest: str) -> None:
        if tag not in INLINE:
            self.block += 1
            ends = CLOSES.get(tag, frozenset())
            for i in range(len(self.tags) - 1, -1, -1):
                if self.tags[i] in ends or self.tags[i] == "p" or (self.tags[i] in INLINE and tag == "p"):
                    if self.tags[i] in ends or "p" in self.tags[i:]:
                        self.pop(i)
                elif self.tags[i] in KEEP_P:
                    break
        if tag in VOID:
            return
        names = " ".join(next((x for x in m if x), "") for m in NAMES.findall(rest)) if rest else ""
        inner = bool({"article", "main", "body"} & {*self.tags, tag})
        hidden = bool(rest) and re.search(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", rest, re.I)
        mark = tag in DROPPED or bool(hidden) or (tag == "header" and not ({"article", "main"} & {*self.tags}) and inner)
        self.stack.append(tag + ("." + names.split()[0] if names.split() else ""))
        self.tags.append(tag)
        self.marks.append(mark)
        self.dropped += mark
        kind = furniture(names) if tag not in ("html", "body") else ""
        self.around.append(len(self.kinds) if kind else -1)
        if kind:
            self.kinds.append(kind)
        if tag in ("article", "main") and not self.dropped:
            self.holders.update(x for x in self.around if x >= 0)

    def close(self, tag: str) -> None:
        for i in range(len(self.tags) - 1, -1, -1):
            if self.tags[i] == tag:
                self.pop(i)
                return
        if tag not in INLINE:
            self.block += 1

    def read(self, source: str) -> None:
        at = 0
        while at < len(source):
            m = TOKEN.search(source, at)
            if m is None:
                self.text(source[at:])
                break
            self.text(source[at : m.start()])
            at = max(m.end(), m.start() + 1)
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self.close(tag)
                continue
            self.open(tag, m[3])
            if tag in RAW and tag not in VOID:
                end = re.compile(rf"</{tag}[\s/>]", re.I).search(source, at)
                at = end.start() if end else len(source)


def path_scores(paths: list[tuple[str, ...]], texts: list[str], radius: int = 2) -> np.ndarray:
    """Fused score per node: text length and punctuation per tag path, over the path's nodes, smoothed along the page."""
    chars, marks, nodes = defaultdict(int), defaultdict(int), defaultdict(int)
    for path, found in zip(paths, texts, strict=True):
        chars[path] += len(found)
        marks[path] += len(PUNCTUATION.findall(found))
        nodes[path] += 1
    ratios = np.array([[chars[p] / nodes[p], marks[p] / nodes[p]] for p in paths], dtype=np.float64)
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / 1.0) ** 2)
    kernel /= kernel.sum()
    smooth = np.stack([np.convolve(np.pad(ratios[:, k], radius, mode="edge"), kernel, mode="valid") for k in (0, 1)], axis=1)
    return np.log1p(smooth[:, 0]) * np.log1p(1 + smooth[:, 1])


def shown(page: Page) -> tuple[list[int], list[tuple[str, ...]]]:
    """The nodes with text that aren't in furniture, and their paths; those of doubtful nodes start with DOUBT.

    A whole name makes furniture, unless the element is or holds an article or main or has most
    of the page's text and nodes; then it is doubtful, as one is that has the name as a part.
    """
    full = [i for i, t in enumerate(page.texts) if t.strip()]
    size, nodes = [0] * len(page.kinds), [0] * len(page.kinds)
    for i in full:
        for x in page.named[i]:
            size[x] += len(page.texts[i])
            nodes[x] += 1
    total = sum(len(page.texts[i]) for i in full)
    wraps = {x for x in range(len(page.kinds)) if 2 * size[x] > total and 2 * nodes[x] > len(full)} | page.holders
    out = {x for x, kind in enumerate(page.kinds) if kind == "whole" and x not in wraps}
    doubtful = {x for x, kind in enumerate(page.kinds) if x not in out and (kind == "whole" or x not in page.holders)}
    keep = [i for i in full if out.isdisjoint(page.named[i])]
    return keep, [page.paths[i] if doubtful.isdisjoint(page.named[i]) else (DOUBT, *page.paths[i]) for i in keep]


def factor(path: tuple[str, ...]) -> float:
    if path[:1] == (DOUBT,):
        return DOUBTFUL
    tags = {x.partition(".")[0] for x in path}
    return IN_ARTICLE if "article" in tags else IN_MAIN if "main" in tags else 1.0


def main_text(source: str) -> str:
    """The article of one page.

    Nodes in furniture (menus, footers, adverts, forms, comments, by tag or class) are
    out. Of the others, paths whose mean fused score reaches the mean less the deviation
    of the page's best container are content; what stands in the same section of the
    page as content, such as headings, comes with it. A path's score is raised in an
    article or main and lowered in what may be furniture; an article (or else main)
    comes as a whole only if it holds the best container and most of its text is content.
    """
    page = Page(source)
    keep, paths = shown(page)
    if not keep:
        return ""
    texts = [page.texts[i] for i in keep]
    scores = path_scores(paths, texts) * np.array([factor(p) for p in paths])
    by_path = defaultdict(list)
    for p, s, t in zip(paths, scores, texts, strict=True):
        by_path[p].append((s, len(t)))
    fused = {p: sum(s for s, _ in v) / len(v) for p, v in by_path.items()}
    mass = defaultdict(float)
    for p, v in by_path.items():
        mass[section(p)] += fused[p] * sum(n for _, n in v)
    best = max(mass, key=lambda s: (mass[s], len(s)))
    level = max(0.0, max(fused[p] for p in fused if section(p) == best) - 1.5 * float(np.std(scores)))
    content = {section(p) for p, s in fused.items() if s >= level and mass[section(p)] >= 0.1 * mass[best]} | {best}
    # body is no section of the page: what has a section of its own in it is judged by that
    inside = lambda p, c: section(p) == c if c[-1:] and c[-1].partition(".")[0] in ("body", "html") else p[: len(c)] == c
    taken = {p: any(inside(p, c) for c in content) for p in fused}
    for tag in ("article", "main"):
        at = next((i for i, x in enumerate(best) if x.partition(".")[0] == tag), None)
        if at is not None:
            size = {p: sum(n for _, n in by_path[p]) for p in fused if p[: at + 1] == best[: at + 1]}
            if 2 * sum(n for p, n in size.items() if taken[p]) > sum(size.values()):
                taken.update(dict.fromkeys(size, True))
            break
    chosen = {i for i, p in zip(keep, paths, strict=True) if taken[p]}
    blocks: dict[int, list[str]] = {}
    for i in sorted(chosen):
        blocks.setdefault(page.blocks[i], []).append(i)
    out = []
    for nodes in blocks.values():
        # white space between two inline nodes is part of the block, though no node of its own
        span = range(nodes[0], nodes[-1] + 1)
        out.append(" ".join("".join(page.texts[i] for i in span if i in chosen or not page.texts[i].strip()).split()))
    return " ".join(x for x in out if x)


def section(path: tuple[str, ...]) -> tuple[str, ...]:
    """The path down to its innermost section, division or body."""
    for i in range(len(path) - 1, -1, -1):
        if path[i].partition(".")[0] in ("div", "section", "article", "main", "body", "td", "html"):
            return path[: i + 1]
    return path[: path[:1] == (DOUBT,)]


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars): the main text of every row's whole html.

    White space within a block is one space, blocks are joined by one space in page
    order. Null, empty and text-free pages give ''; html without tags is its own text;
    markup that ends in the middle of a tag loses that tag only. A very long page is one row's work.
    Repeated rows are rows of their own, the id may be of any type, other columns are ignored, an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [main_text(x) if x else "" for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], [id_col, url_col, "text", "n_chars"])

    rows = pages.select(F.col(id_col), F.col(url_col).cast("string").alias(url_col), F.col(html_col).cast("string").alias("__html"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, `{url_col}` string, text string, n_chars long")
