"""Costing of dishes whose names say how they are prepared: weights, halves, doubled, added and left-out portions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.costing import estimate_macros
from .bridge import chosen, sql_list, table
from .costing_sql import costed
from .rules_sql import KIND_CTE

BEFORE = ["", "1/2 ", "Half ", "½ ", "8 oz ", "14.5 oz. ", "50 oz ", "3oz ", "Half Pound "]
CUTS = ["Sirloin", "Blackened Salmon", "Turkey Club", "Cheeseburger", "Roast Chicken", "Rack of Ribs", "Steak Fries Plate", "Quesadilla", "Chicken Bowl", "Fish Tacos", "Pepperoni Pizza"]
HOW = [
    "", "with extra cheese", "double cheese and bacon", "keto", "low-carb, grilled shrimp", "no rice, black beans", "chili caramel glazed, brown rice", "gochujang pork, honey", "char siu, noodles", "honey glazed, cheddar", "extra shrimp, sticky soy",
    "lettuce wrapped, double chicken", "crispy, no bun, extra cheese", "12 oz, 6 oz fries", "6 oz butter, 10 oz prime ribeye",
]


def prepared_dishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dish a part: what stands before the cut, the cut, and how it is made, each at a pace of its own."""
    k = F.col("p_partkey")
    name = F.concat(chosen(BEFORE, k), chosen(CUTS, F.floor(k / 2).cast("long")))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("dish_name"), F.nullif(chosen(HOW, F.floor(k / 3).cast("long")), F.lit("")).alias("description"), F.lit(None).cast("string").alias("section"), F.lit(None).cast("double").alias("price"))


PREPARED_CTE = f"""d AS (SELECT p_partkey, {sql_list(BEFORE)}[(p_partkey % {len(BEFORE)} + 1)::INTEGER] || {sql_list(CUTS)}[((p_partkey // 2) % {len(CUTS)} + 1)::INTEGER] AS dish_name,
  nullif({sql_list(HOW)}[((p_partkey // 3) % {len(HOW)} + 1)::INTEGER], '') AS description, NULL::VARCHAR AS section FROM part)"""


def preparation_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macros, confidence, ingredients and assumptions of these dishes."""
    out = estimate_macros(prepared_dishes(spark, sf_dir), ["p_partkey"])
    found = F.array_join(F.transform("detected_ingredients", lambda x: x["normalized_name"]), ",")
    return out.select("p_partkey", "dish_name", "dish_type", "calories", "protein_g", "carbs_g", "fat_g", "macro_confidence", found.alias("ingredients"), F.array_join("assumptions", " ").alias("assumptions"))


QUERIES = {"preparation_costs": preparation_costs}
SQL = {
    "preparation_costs": f"""WITH {PREPARED_CTE}, {KIND_CTE}, i AS (SELECT p_partkey AS item, dish_name, description, dish_type, matched_on IN ('name', 'description') AND coalesce(by_section = dish_type, false) AS supports FROM t), {costed("i")}
SELECT item AS p_partkey, dish_name, dish_type, calories, protein_g, carbs_g, fat_g, macro_confidence, array_to_string(ingredients, ',') AS ingredients, assumptions FROM e"""
}
