"""How sure a parsed dish and an estimate are, as sums of signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .classify import is_vague
from .rules import clamp01, half_up, words

MIN_CONFIDENCE, MAX_CONFIDENCE, PUBLISHED_CONFIDENCE = 0.3, 0.85, 0.95


def when(condition: Column, yes: float, no: float = 0.0) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), yes).otherwise(no)


def given(text: Column) -> Column:
    return F.coalesce(text != "", F.lit(False))


def name_quality(name: Column) -> Column:
    n = F.size(words(name))
    return F.when(n == 0, 0.0).otherwise(clamp01(1.0 - when(n == 1, 0.4) - when(n > 6, 0.3) - when(n > 8, 0.3) - when(name.rlike("[0-9]"), 0.3)))


def parse_confidence(name: Column, description: Column, price: Column, section: Column) -> Column:
    score = 0.3 + 0.16 * name_quality(name) + when(given(description), 0.15) + when(price.isNotNull(), 0.15) + when(given(section), 0.1) - when(is_vague(name), 0.15)
    return half_up(clamp01(score), 2)


def many_unknown(matched: Column, total: Column) -> Column:
    return F.coalesce((total > 0) & (matched / total < 0.5), F.lit(False))


def macro_confidence(name: Column, kind: Column, description: Column, protein: Column, ingredients: Column, core: Column, supports: Column, matched: Column, total: Column) -> Column:
    score = F.lit(0.3) + when(kind != "unknown", 0.15, -0.1) + when(protein, 0.15) + when(given(description), 0.1, -0.1) + when(ingredients >= 3, 0.1) + when(core, 0.1) + when(supports, 0.05)
    score = score - when(many_unknown(matched, total), 0.1) - when(is_vague(name), 0.15)
    return half_up(F.least(clamp01(score), F.lit(MAX_CONFIDENCE)), 2)


def bucket(confidence: Column) -> Column:
    return F.when(confidence >= 0.7, "high").when(confidence >= 0.45, "medium").otherwise("low")
