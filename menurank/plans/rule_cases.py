"""The rules over names, descriptions and headings that reach each of them, with SQL of their own lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from .bridge import REASON_SQL, chosen, sql_list, table
from .pipeline import decide
from .rules_sql import KIND_CTE, OUT_CTE, SECTION_NAME, SIDE, VAGUE_NAME

NAMES = [
    "Patty Melt Deluxe", "Smashburger", "Double Cheeseburgers", "Fish Tacos", "Steak Fajita", "Margherita Flatbread", "Calzone", "Mac & Cheese", "Mac and Cheese", "Penne Alla Vodka", "Chimichanga",
    "Turkey Wrap", "Veal Parm", "Eggplant Parmesan", "Chicken Parmigiana", "Turkey Club", "Banh Mi", "BLT", "Wedge Salad", "Poke", "Rice Bowls", "Texas Chili", "Chili Garlic Shrimp", "Chili  Oil Dumplings", "Chili, Oil", "Chili Glazed Wings",
    "Clam Chowder", "Ramen", "Omakase", "Hand Roll", "Dragon Roll", "Spicy Tuna & Crab Roll", "Tuna, Roll", "Egg Roll", "Roll of Salmon", "Salmon", "Ribeye", "Rib-Eye", "NY Strip", "T Bone", "Entrée du Jour", "ENTRÉE Combo", "Chicken Katsu",
    "Iced Tea", "Tea", "Coffee", "Coffee Rub", "Lemonade", "Orange Juice", "IPA Flight", "Beer-Battered Cod", "Ice Cream", "Milk Shake", "Lava Cake", "Lava Cake Bites", "Key Lime Pie", "Pie", "Fries", "Sweet Potato Fries", "Loaded Fries",
    "Pita Chips", "Fish and Chips", "Onion Rings", "Rice", "Side of Bacon", "Sideof Bacon", "Add Avocado", "Extra Bacon", "Extras", "Kid's Plate", "Kids Quesadilla", "Kidney Beans", "Ranch", "Hot Sauce", "House Special Sauce", "Very Hot House Made Sauce", "Sauce on Sauce", "(gluten free)",
    "Choice of Two", "Build Your Own Pizza", "Chef's Special", "Chefs Choice", "Chef’s Selection", "House Specialty", "Today's Catch", "Seasonal Plate", "Market Fish", "Catch of the Day", "Ask Your Server", "Quinoa", "Crème Brûlée", "Burgerville", "éburger", "7", "",
]
SAYINGS = ["", "served with noodles", "feeds 4", "serves 1", "Serves 12 guests", "family style", "for two", "our family pack", "a soup of the day", "chili crisp on top", "with salmon and rice", "grilled shrimp, veal parmesan on it"]
HEADINGS = [
    "", "Bowls", "RICE BOWLS:", "Salads.", "Side Salads", "Handhelds", "Smash Burgers", "Wraps", "Burritos", "Tacos", "Pastas", "Pizza", "Hand Rolls", "Rolls", "Protein Plates", "Steaks", "Soups", "Small Plates", "Soft Drinks", "Coffee & Tea",
    "Happy Hour", "Wine", "Desserts", "Sweets", "Side Dishes", "A La Carte", "Apps", "Shareables", "Kids Menu", "Children's Menu", "Children", "Dips", "Add-Ons", "Addons", "Extras", "Catering", "Family Meals", "Party Trays:", "Enhancements", "Elevate It",
    "Steak Toppers", "Make It a Meal", "Premium Sides", "For the Table", "Limited Time", "Entrées", "Entrees", "Main Courses", "From the Grill", "House Favorites", "Lunch", "Deli Sides & Soups", "Chef's Corner", "Inside", "Upgrades",
]


def rule_dishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two dishes a part, whose names, descriptions and headings run through the lists at paces of their own."""
    k = F.col("k")
    d = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("twin")).withColumn("k", 2 * F.col("p_partkey") + F.col("twin"))
    return d.select(
        "p_partkey", "twin", chosen(NAMES, k).alias("dish_name"), F.nullif(chosen(SAYINGS, F.floor(k / 5).cast("long")), F.lit("")).alias("description"), F.nullif(chosen(HEADINGS, F.floor(k / 3).cast("long")), F.lit("")).alias("section")
    )


RULE_CTE = f"""d AS (SELECT p_partkey, twin, {sql_list(NAMES)}[(k % {len(NAMES)} + 1)::INTEGER] AS dish_name, nullif({sql_list(SAYINGS)}[((k // 5) % {len(SAYINGS)} + 1)::INTEGER], '') AS description,
  nullif({sql_list(HEADINGS)}[((k // 3) % {len(HEADINGS)} + 1)::INTEGER], '') AS section FROM (SELECT p_partkey, twin, 2 * p_partkey + twin AS k FROM part, (VALUES (0), (1)) AS v(twin)))"""


def rule_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type of every such dish, and what it was told by."""
    d = rule_dishes(spark, sf_dir)
    return d.withColumn("kind", C.dish_type(F.col("dish_name"), F.col("description"), F.col("section"))).select("p_partkey", "twin", "dish_name", "kind.*")


def rule_inclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every such dish is in, else why not; whether it is a side, its heading a known one, its name vague."""
    d = decide(rule_dishes(spark, sf_dir))
    return d.select("p_partkey", "twin", "dish_name", "section", "is_side", "exclusion_reason", C.is_section_name(F.col("section")).alias("is_section_name"), C.is_vague(F.col("dish_name")).alias("is_vague"))


QUERIES = {f.__name__: f for f in (rule_kinds, rule_inclusion)}
SQL = {
    "rule_kinds": f"WITH {RULE_CTE}, {KIND_CTE} SELECT p_partkey, twin, dish_name, dish_type, matched_on, matched_on IN ('name', 'description') AND coalesce(by_section = dish_type, false) AS section_supports FROM t",
    "rule_inclusion": f"""WITH {RULE_CTE}, {KIND_CTE}, {OUT_CTE}
SELECT p_partkey, twin, dish_name, section, dish_type = 'unknown' AND {SIDE} AS is_side, {REASON_SQL} AS exclusion_reason, {SECTION_NAME} AS is_section_name, {VAGUE_NAME} AS is_vague FROM x""",
}
