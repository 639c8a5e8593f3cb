"""Blocks of a page (name, description, section, text) to dishes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import menu_text as M
from ..functions.confidence import parse_confidence

# Fixed values.
NAME, DESCRIPTION, SECTION, TEXT = 90, 400, 60, 4000
MACRO_LABEL = r"(?i)^(?:calories|calorie|kcals?|cals?|cal|protein|carbs?|carbohydrates?|(?:total )?fat)$"
ALLERGENS = r"(?i)^\s*(?:contains|allergens?|may contain)\b"
PRICE_IN_TEXT = r"\$\s*(\d{1,3}(?:\.\d{1,2})?)(?!\d)"


def clean(text: Column, most: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), M.WHITE + "+", " ")), 1, most)


def usable_name(name: Column) -> Column:
    return (F.length(name) >= 3) & name.rlike("[A-Za-z]{3,}") & ~name.rlike("[.!?]$") & ~name.rlike(MACRO_LABEL) & (M.word_count(name) <= 12)


def exploded_blocks(pages: DataFrame, key: str = "page_id", blocks: str = "blocks") -> DataFrame:
    """(key, pos, name, description, section, text) from an array of structs; pages without blocks give no rows."""
    b = pages.select(key, F.posexplode(blocks).alias("pos", "b"))
    return b.select(key, "pos", *[F.col(f"b.{c}").alias(c) for c in ("name", "description", "section", "text")])


def block_items(blocks: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, item_pos, section, dish_name, description, price, text, parse_confidence): usable blocks, the first of equal ones."""
    b = blocks.withColumns({"text": clean(F.col("text"), TEXT), "__name": M.split_price(clean(F.col("name"), NAME)), "description": clean(F.col("description"), DESCRIPTION), "section": F.nullif(clean(F.col("section"), SECTION), F.lit(""))})
    b = b.withColumn("dish_name", F.trim(F.regexp_replace(F.trim("__name.text"), r"[*†‡+^]+$", "")))
    b = b.where(usable_name(F.col("dish_name"))).withColumn("description", F.when(~F.col("description").rlike(ALLERGENS), F.nullif(F.col("description"), F.lit(""))))
    b = b.withColumn("price", F.coalesce("__name.price", F.regexp_extract("text", PRICE_IN_TEXT, 1).try_cast("double")))
    # partial aggregation: of equal blocks, a task sends the first alone
    same = F.lower(F.concat_ws("|", "dish_name", F.coalesce("description", F.lit("")))).alias("__same")
    b = b.groupBy(key, same).agg(F.min(F.struct("pos", "section", "dish_name", "description", "price", "text")).alias("b")).select(key, "b.*")
    b = b.withColumn("parse_confidence", parse_confidence(F.col("dish_name"), F.col("description"), F.col("price"), F.col("section")))
    return b.select(key, F.col("pos").alias("item_pos"), "section", "dish_name", "description", "price", "text", "parse_confidence")
