"""Normalising menu text and testing single lines, as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from functools import reduce
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rules import any_match, java, matches, words

# Fixed values.
PRICE = r"\$?\d{1,3}(?:\.\d{1,2})?"
BOILERPLATE_STARTS = [
    r"(v|vg|gf|df|n)\s*[=:-]",
    r"(join|sign up|scan|follow us|visit us|please visit|order online|call us|book|reserve|download|subscribe)\b",
    r"get \d{1,2}%",
    r"@[\w.]+$",
    r"www\.[\w.-]+",
    r"est\.?\s*\d{4}$",
    r"\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}$",
]
#: With what a line must hold to match, in lower case, for each: found much faster. They have no i, k and s, as which signs beyond ASCII count, too.
BOILERPLATE = [
    (r"consuming raw or undercooked", ["raw or undercoo"]),
    (r"foodborne illness", ["foodborne"]),
    (r"prices? (are )?(subject to change|may vary)", ["to change", "may vary"]),
    (r"\bgratuity\b", ["gratu"]),
    (r"please (inform|notify|alert) (your|the) server", ["plea"]),
    (r"before placing your order", ["ng your order"]),
    (r"\ballerg(y|en|ies)\b", ["allerg"]),
    (r"substitutions? (may be )?(charged|extra)", ["tut"]),
    (r"\bcopyright\b|©\s*\d{4}", ["copyr", "©"]),
    (r"all rights reserved", ["all r"]),
    (r"add (chicken|steak|shrimp|salmon|tofu|protein|bacon)\b.{0,24}\$?\d", ["add "]),
    (r"\b\d{1,2}% off\b", ["% off"]),
    (r"\b(rewards club|gift cards?)\b", ["reward", "ft card"]),
    (r"\bqr code\b", ["qr code"]),
    (r"\bhttps?://", ["http"]),
]
NAME_STOPWORDS = "and or of with the a an in on for to de la el our your my at by w".split()
MOST_NAME_WORDS, MOST_SECTION_WORDS, LEAST_DESCRIPTION_WORDS = 10, 5, 5
#: White space as menus have it, beyond ASCII too.
WHITE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
WHITE_SIGNS = "\t\n\x0b\f\r \u00A0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202F\u205F\u3000\uFEFF"
BULLETS = " \t\n\x0b\f\r*•·‣▪◦⁃∙-–—"
#: Signs that a plain text has others for; first of all no ASCII, which is quickly passed over.
UNPLAIN = r"[[^\x00-\x7F]&&[\u00A0\u2000-\u200D‘’“”\u202F\u205F\u3000\uFEFF]]"


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def made_once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x computed once, however often f names it: as the element of an array."""
    return F.transform(F.array(x), f)[0]


def holds(text: Column, signs: Iterable[str]) -> Column:
    """Has the text one of these? Far faster than a pattern."""
    return reduce(lambda a, b: a | b, [text.contains(s) for s in signs])


def normalize_text(text: Column) -> Column:
    """Compatibility forms composed, line ends, spaces and quotes plain, zero-width signs gone; null is ''.

    Only texts with other than ASCII characters go through Python, and only what is there is replaced.
    """
    text = F.coalesce(text, F.lit(""))
    text = F.coalesce(nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)
    text = F.when(text.contains("\r"), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text)

    def plain(x: Column) -> Column:
        out = F.regexp_replace(x, r"[\u00A0\u2000-\u200A\u202F\u205F\u3000]", " ")
        out = F.regexp_replace(out, r"[\u200B\u200C\u200D\uFEFF]", "")
        return F.when(x.rlike(UNPLAIN), F.translate(out, "“”‘’", "\"\"''")).otherwise(x)

    return made_once(text, plain)


#: (what a line must hold, pattern, by what it is replaced)
LINE_STEPS = [
    (lambda x: x.contains(".."), r"\.{2,}", " "),
    (lambda x: holds(x, [w + "." for w in " \t\n\x0b\f\r"]), r"(?:\s*\.\s*){3,}", " "),  # two points are never next to each other here
    (lambda x: holds(x, "–—_"), r"[–—_]{2,}", " "),
    (lambda x: x.contains("$"), r"\$\s+(?=\d)", r"\$"),
    (lambda x: x.rlike(r"\d\s*\.\s*\d"), r"(\d)\s*\.\s*(\d{2})(?![A-Za-z0-9_])", "$1.$2"),
    (lambda x: holds(x, "·|"), r"\s*[·|]\s*", " "),
    (lambda x: holds(x, ["\t", "  "]), r"[\t ]+", " "),
]


def normalize_lines(lines: Column) -> Column:
    """The lines of an array with leaders, rules, bullets and separators to spaces; prices in one piece; single spaces.

    A step after the other for the whole array, so that a line is made once for each; what is not there is not searched for.
    """

    def step(lines: Column, may: Callable[[Column], Column], pattern: str, by: str) -> Column:
        return F.transform(lines, lambda x: F.when(may(x), F.regexp_replace(x, pattern, by)).otherwise(x))

    for i, (may, pattern, by) in enumerate(LINE_STEPS):
        lines = step(lines, may, pattern, by)
        if i == 2:
            lines = F.transform(lines, lambda x: F.ltrim(x, F.lit(BULLETS)))
    # a pattern's end is before a last line end, too, of which one is no white space
    return F.transform(lines, lambda x: F.when(x.contains("\x85"), F.regexp_replace(x, rf"^{WHITE}+|{WHITE}+$", "")).otherwise(F.trim(x, F.lit(WHITE_SIGNS))))


def normalize_line(line: Column) -> Column:
    """`normalize_lines` of one line."""
    return normalize_lines(F.array(line))[0]


def is_boilerplate(line: Column) -> Column:
    patterns, needed = zip(*BOILERPLATE, strict=True)
    may = made_once(F.lower(line), lambda low: holds(low, chain(*needed)))
    return ~line.rlike("[a-zA-Z0-9]") | matches(line, "^(?:" + "|".join(BOILERPLATE_STARTS) + ")") | (may & any_match(line, patterns))


def has_letter(line: Column) -> Column:
    return F.coalesce(line.rlike("[a-zA-Z]"), F.lit(False))


def is_price_only(line: Column) -> Column:
    return F.coalesce(F.trim(line).rlike(f"^{PRICE}$"), F.lit(False))


def parse_price(token: Column) -> Column:
    return F.regexp_replace(token, "[^0-9.]", "").try_cast("double")


TRAILING = rf"(?:^|\s)({PRICE})(?:\s*[/|]\s*{PRICE})?\s*$"


def split_price(line: Column) -> Column:
    """struct<text, price>: a price at the end, the first of a pair; a bare integer only from 5 to 99."""
    token = F.regexp_extract(line, TRAILING, 1)
    price = parse_price(token)
    found = (token != "") & price.isNotNull() & (token.contains("$") | token.contains(".") | price.between(5, 99))
    found = F.coalesce(found, F.lit(False))
    rest = F.trim(F.regexp_replace(line, TRAILING, ""))
    return F.struct(F.when(found, rest).otherwise(line).alias("text"), F.when(found, price).alias("price"))


def word_count(line: Column) -> Column:
    return F.size(words(line))


def is_all_caps(line: Column) -> Column:
    return F.coalesce(~line.rlike("[a-z]") & line.rlike("[A-Z]") & (line == F.upper(line)), F.lit(False))


def capital_ratio(line: Column) -> Column:
    """Share of the words, without stop words, that start with a capital."""
    own = F.filter(words(line), lambda w: w.rlike("[a-zA-Z]") & ~F.lower(F.regexp_replace(w, "[^a-zA-Z]", "")).isin(NAME_STOPWORDS))
    return F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.filter(own, lambda w: w.rlike("^[^a-zA-Z]*[A-Z]"))) / F.size(own))


def is_name(line: Column, all_caps: Column) -> Column:
    """Could the line be a dish's name."""
    plain = has_letter(line) & (word_count(line) <= MOST_NAME_WORDS) & ~line.contains("$") & ~line.rlike(r"\d+\.\d{2}") & ~line.rlike("[.!?]$") & ~line.contains(",") & ~line.rlike(r'\d\s*"')
    return F.coalesce(plain & ((all_caps & is_all_caps(line)) | (capital_ratio(line) >= 0.5)), F.lit(False))


def is_description(line: Column) -> Column:
    n = word_count(line)
    return has_letter(line) & F.when(line.contains(","), n >= 2).otherwise(line.rlike(r"\.$") | (n >= LEAST_DESCRIPTION_WORDS))


def text_quality(text: Column) -> Column:
    """Why a text can't be a menu, or null: length, broken characters, white space, letters, prices and short lines."""
    size = F.length(text)
    count = lambda p: F.regexp_count(text, F.lit(p))
    solid = size - count(WHITE)
    short = F.size(F.filter(F.split(text, "\n"), lambda x: F.size(words(x)).between(2, 10)))
    price = text.rlike(java(r"\$?\d{1,3}\.\d{2}\b"))
    return (
        F.when(text.isNull() | (size < 200), F.concat(F.lit("only "), F.coalesce(size, F.lit(0)).cast("string"), F.lit(" characters extracted")))
        .when(count("�") > size * 0.01, "many characters decoded as replacement characters")
        .when(count(WHITE) / size > 0.6, "text is mostly whitespace")
        .when((solid > 0) & (count("[A-Za-z]") / solid < 0.5), "text is mostly unreadable characters")
        .when(~price & (short < 3), "no price or dish-like patterns found")
    )


def tidy(text: Column) -> Column:
    """Control signs gone, lines trimmed, at most one blank line in a row."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"[\t ]+", " "), rf"^{WHITE}+|{WHITE}+$", ""))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def likely_menu(text: Column) -> Column:
    return (F.regexp_count(text, F.lit(r"\$\d{1,3}(?:\.\d{2})?")) >= 3) & any_match(text, [r"\b(menu|entrees?|appetizers?|bowls?|sandwiches|burgers?|salads?)\b"])
