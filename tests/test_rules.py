"""The words by which rules are looked up, against the rules' patterns."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from menurank.functions import classify as C
from menurank.functions.rules import first_indexed, first_match
from menurank.plans.rule_cases import HEADINGS, NAMES, SAYINGS

LISTS = {
    "dish": ([*C.DISH_RULES, C.NAME_RULE], [*C.DISH_WORDS, C.NAME_WORDS]),
    "section type": (C.SECTION_TYPES, C.SECTION_TYPE_WORDS),
    "excluded section": (C.EXCLUDED_SECTIONS, C.EXCLUDED_SECTION_WORDS),
    "included section": ([("", p) for p in C.INCLUDED_SECTIONS], C.INCLUDED_SECTION_WORDS),
    "section name": ([("", p) for p in C.SECTION_NAMES], C.SECTION_NAME_WORDS),
    "excluded item": (C.EXCLUDED_ITEMS, C.EXCLUDED_ITEM_WORDS),
    "vague name": ([("", p) for p in C.VAGUE_NAMES], C.VAGUE_WORDS),
}


@pytest.mark.parametrize("kind", LISTS)
def test_every_match_holds_a_word_of_its_rule(kind):
    rules, index = LISTS[kind]
    assert len(rules) == len(index)
    for (_, pattern), words in zip(rules, index, strict=True):
        if words:
            holds(re.compile(pattern, re.IGNORECASE | re.ASCII), set(words.split()))


def test_every_shared_portion_has_its_hint():
    holds(re.compile(C.SHARED, re.IGNORECASE | re.ASCII), None)


def test_rules_by_index_equal_rules_one_by_one(spark):
    texts = spark.createDataFrame([(t,) for t in [None, *NAMES, *SAYINGS, *HEADINGS]], "t string")
    t, numbered = F.col("t"), {k: ([(str(i), p) for i, (_, p) in enumerate(rules)], index) for k, (rules, index) in LISTS.items()}
    both = [F.struct(first_indexed(t, rules, index).alias("got"), first_match(t, rules).alias("want")).alias(k) for k, (rules, index) in numbered.items()]
    hit = set()
    for row in texts.select("t", *both).collect():
        for k in LISTS:
            assert row[k]["got"] == row[k]["want"], (k, row["t"])
            hit |= {(k, row[k]["got"])} if row["t"] and row[k]["got"] else set()
    assert len(hit) > 80


def holds(pattern: re.Pattern, words: set[str] | None) -> None:
    @settings(max_examples=40, database=None, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(pattern, fullmatch=True))
    def found(text):
        assert words is None or set(re.split("[^a-z0-9_]+", text.lower())) & words, text
        assert words is not None or re.search(C.SHARED_HINT, text.lower()), text

    found()
