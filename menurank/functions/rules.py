"""Ordered text rules as column expressions: the first that matches wins."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


#: A word boundary by ASCII letters, digits and _, whatever the engine takes \\b for.
BOUNDARY = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def java(pattern: str) -> str:
    """The pattern for Spark: case-insensitive, with ASCII word boundaries."""
    return "(?iu)" + pattern.replace(r"\b", BOUNDARY)


def matches(text: Column, pattern: str) -> Column:
    """Case-insensitive search; null text doesn't match."""
    return F.coalesce(text.rlike(java(pattern)), F.lit(False))


def any_match(text: Column, patterns: Iterable[str]) -> Column:
    return matches(text, "|".join(f"(?:{p})" for p in patterns))


def first_match(text: Column, rules: Iterable[tuple[str, str]], otherwise: Column | None = None) -> Column:
    """The result of the first (result, pattern) whose pattern is found in the text, or null."""
    out = None
    for result, pattern in rules:
        out = F.when(matches(text, pattern), F.lit(result)) if out is None else out.when(matches(text, pattern), F.lit(result))
    return out if otherwise is None else out.otherwise(otherwise)


def first_indexed(text: Column, rules: Sequence[tuple[str, str]], index: Sequence[str]) -> Column:
    """`first_match` for many rules: `index` holds per rule the words (a to z, digits, _) of which every match has one.

    The words of the text are looked up once; only patterns that have one of theirs there are searched, in order. A rule
    with no words in the index is always searched.
    """
    leads = [words_of.split() for words_of in index]
    known = sorted({w for lead in leads for w in lead})
    tokens = F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda w: w.isin(known))

    def one_of(found: Column, lead: list[str]) -> Column:
        return F.exists(found, lambda w: w.isin(lead))

    def decide(bound: Column) -> Column:
        said, found, out = bound["said"], bound["found"], None
        for (result, pattern), lead in zip(rules, leads, strict=True):
            hit = one_of(found, lead) & matches(said, pattern) if lead else matches(said, pattern)
            out = F.when(hit, F.lit(result)) if out is None else out.when(hit, F.lit(result))
        return out if not all(leads) else F.when(F.size(found) > 0, out)

    # an array of one element, so that text and words are made once for all rules
    return F.transform(F.array(F.struct(text.alias("said"), tokens.alias("found"))), decide)[0]


def any_indexed(text: Column, patterns: Sequence[str], index: Sequence[str]) -> Column:
    """`any_match` by `first_indexed`."""
    return first_indexed(text, [("x", p) for p in patterns], index).isNotNull()


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounding by floor(x + 0.5), for negative numbers too."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def clamp01(x: Column) -> Column:
    """Between 0 and 1; null, NaN and infinite count as 0."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def blank_to_null(x: Column) -> Column:
    return F.when(F.trim(x) != "", x)


def words(x: Column) -> Column:
    """The words of a text, by any white space."""
    return F.filter(F.split(F.coalesce(x, F.lit("")), r"\s+"), lambda w: w != "")
