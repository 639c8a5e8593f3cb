"""Menus whose dishes are written in many forms, some menus in capitals throughout, with SQL on the columns they came from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lines import menu_items, menu_lines
from .bridge import MENU_PARTS, table

#: How a dish N with price P is written, line by line, by its part's key: a sentence after the price; the price below and six lines, of
#: which four are taken; two prices; the price after the second line; a size and its price; bullet, leader, spaces in the
#: price and a notice between; a number too small for a price; a price line after the description, which ends it.
FORMS = [
    "N $P.95\nserved with seasonal greens and bread.",
    "N\nP\none, two\nthree, four\nfive, six\nseven, eight\nnine, ten\nlast, least",
    "N P.95 / 99.95",
    "N\nsmoked corn, lime\nrice, beans P.50",
    "N\n2 P.50\nherbs, butter",
    "• N ....... $ P . 95\nPlease inform your server\nolives, feta",
    "N 3",
    "N\nred wine, fries\n- P.50\nmore, of it",
]
#: What such a dish is, by the same key: the end of its name, description and price.
TRUTH = [
    ("", "served with seasonal greens and bread.", "P.95"),
    ("", "one, two three, four five, six seven, eight", "P.00"),
    ("", None, "P.95"),
    ("", "smoked corn, lime rice, beans", "P.50"),
    ("", "herbs, butter", "P.50"),
    ("", "olives, feta", "P.95"),
    (" 3", None, None),
    ("", "red wine, fries", None),
]
PICKS = "WEEKEND PICKS"


def form_menus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, p_brand, menu, text): a menu per brand and thousand part keys; every third is in capitals.

    A line in capitals between the two halves is a heading in other menus, and a dish in those.
    """
    k, half = F.col("p_partkey"), MENU_PARTS // 2
    d = table(spark, sf_dir, "part").select(k, "p_brand", F.floor(k / MENU_PARTS).cast("long").alias("menu"), (k % MENU_PARTS >= half).alias("second"), F.concat(F.initcap("p_name"), F.lit(" Dish")).alias("name"), (F.col("p_size") % 40 + 5).cast("string").alias("price"))
    said = F.element_at(F.array(*map(F.lit, FORMS)), (k % len(FORMS) + 1).cast("int"))
    entry = F.replace(F.regexp_replace(said, r"\bP\b", F.col("price")), F.lit("N"), F.col("name"))
    m = d.withColumn("e", F.struct("p_partkey", "second", entry.alias("text"))).groupBy("p_brand", "menu").agg(F.array_sort(F.collect_list("e")).alias("e"))
    part = lambda second: F.array_join(F.transform(F.filter("e", lambda x: x["second"] == second), lambda x: x["text"]), "\n\n\n")
    text = F.concat(F.lit("LUNCH\n\nDINNER\n\n"), part(False), F.lit(f"\n\n{PICKS}\n\n"), part(True), F.lit("\n\nAll rights reserved"))
    capitals = (F.substring("p_brand", 7, 9).cast("long") + F.col("menu")) % 3 == 0
    return m.select(F.xxhash64("p_brand", "menu").alias("page_id"), "p_brand", "menu", F.when(capitals, F.upper(text)).otherwise(text).alias("text"))


def menu_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dishes of these menus."""
    m = form_menus(spark, sf_dir)
    items = menu_items(menu_lines(m)).join(m.select("page_id", "p_brand", "menu"), "page_id")
    return items.select("p_brand", "menu", "item_pos", "section", "dish_name", "description", "price")


def form_sql(value: str) -> str:
    said = [t[("name", "description", "price").index(value)] for t in TRUTH]
    return "CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN " + ("NULL" if s is None else "'" + s + "'") for i, s in enumerate(said)) + " END"


QUERIES = {"menu_forms": menu_forms}
SQL = {
    "menu_forms": f"""WITH d AS (
  SELECT p_partkey, p_brand, p_partkey // {MENU_PARTS} AS menu, CASE WHEN p_partkey % {MENU_PARTS} >= {MENU_PARTS // 2} THEN 2 ELSE 0 END AS place, (substr(p_brand, 7)::INTEGER + p_partkey // {MENU_PARTS}) % 3 = 0 AS capitals,
    array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' Dish' || {form_sql("name")} AS name, {form_sql("description")} AS description,
    replace({form_sql("price")}, 'P', (p_size % 40 + 5)::VARCHAR)::DOUBLE AS price
  FROM part
), r AS (
  SELECT * FROM d UNION ALL SELECT DISTINCT 0, p_brand, menu, 1, capitals, '{PICKS}', NULL, NULL::DOUBLE FROM d WHERE capitals
)
SELECT p_brand, menu, row_number() OVER (PARTITION BY p_brand, menu ORDER BY place, p_partkey) AS item_pos, CASE WHEN place = 2 AND NOT capitals THEN '{PICKS}' ELSE 'DINNER' END AS section,
  CASE WHEN capitals THEN upper(name) ELSE name END AS dish_name, CASE WHEN capitals THEN upper(description) ELSE description END AS description, price FROM r""",
}
