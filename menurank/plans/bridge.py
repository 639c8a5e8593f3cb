"""Inputs for the operators, derived from the given tables, and the queries over them.

The tables hold no menus, so menus are rendered from their columns: the truth about each
rendered text is known from the columns, and the SQL of a query works on those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import confidence as K
from ..functions import menu_text as M
from ..functions.published import read_macros
from ..operators.blocks import block_items
from ..operators.cards import page_cards
from ..operators.costing import estimate_macros
from ..operators.lines import menu_items, menu_lines
from ..operators.scoring import displayed, each_goal, rank_meals, score_meals, top_meals
from ..sources.html import html_nodes, html_text, menu_links, restaurant_name
from ..sources.pages import resolve_source, source_kind
from .costing_sql import costed
from .pipeline import decide, extract, linked_pdfs, recommend
from .rules_sql import INCLUDED, KIND_CTE, OUT_CTE, SECTION_NAME, SIDE, VAGUE_NAME

# What the renderings are made of.
SECTIONS = ["Bowls", "Salads", "Burgers", "Tacos", "Plates", "Pastas", "Soups", "Drinks", "Desserts", "Sides", "Kids", "Catering", "Small Plates", "Elevate Your Plate", "Dinner", "House Favorites", "Starters", "Add-ons", "Wine", ""]
DISHES = ["Grilled Chicken Bowl", "Salmon Plate", "Steak Tacos", "Caesar Salad", "Veggie Wrap", "Classic Cheeseburger", "Pasta Alfredo", "House Lemonade", "Lobster Tail", "Chef's Special", "Half Turkey Club", "Double Chicken Burrito", "Crispy Fish Sandwich", "Bunless Burger", "12 oz Ribeye Steak", "Market Salmon"]
SAID = ["grilled chicken, brown rice, black beans, avocado and pico de gallo", "romaine, parmesan, croutons with caesar dressing", "beef patty, cheddar, bacon, lettuce, tomato", "", "tofu, quinoa, broccoli over kale", "fettuccine, shrimp, garlic butter, parmesan", "pulled pork, slaw, bbq sauce on a brioche bun", "corn tortilla, carne asada, salsa verde, onion", "truffle butter lettuce, rice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chosen(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate"]


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meals of restaurants (suppliers) from order lines."""
    o, q = F.col("l_orderkey"), F.col("l_quantity")
    category = F.when(F.col("l_partkey") % 10 == 0, "drink").when(F.col("l_partkey") % 10 < 3, "side").otherwise("entree")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("page_id"), *LINE_KEYS, category.alias("category"), (150 + (o * 37) % 1050).cast("double").alias("calories"),
        (5 + q).cast("double").alias("protein_g"), (F.col("l_partkey") % 120).cast("double").alias("carbs_g"), ((o * 11 + F.col("l_linenumber")) % 60).cast("double").alias("fat_g"),
    )


LISTINGS = """listings AS (
  SELECT l_suppkey AS page_id, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate,
    CASE WHEN l_partkey % 10 = 0 THEN 'drink' WHEN l_partkey % 10 < 3 THEN 'side' ELSE 'entree' END AS category,
    (150 + (l_orderkey * 37) % 1050)::DOUBLE AS calories, (5 + l_quantity)::DOUBLE AS protein_g, (l_partkey % 120)::DOUBLE AS carbs_g, ((l_orderkey * 11 + l_linenumber) % 60)::DOUBLE AS fat_g
  FROM lineitem
), goals(goal, ideal, tolerance, over_, under_, least_p, extreme) AS (
  VALUES ('cut', 450.0::DOUBLE, 250.0::DOUBLE, 1.4::DOUBLE, 0.6::DOUBLE, 30.0::DOUBLE, 1.2::DOUBLE), ('maintain', 600.0, 250.0, 1.0, 1.0, 25.0, 1.5), ('bulk', 750.0, 300.0, 0.6, 1.5, 30.0, 1.8)
), r AS (
  SELECT *, CASE WHEN calories > 0 THEN protein_g / calories ELSE 0 END AS ratio, CASE WHEN protein_g > 0 THEN fat_g / protein_g ELSE 1e300 END AS fr,
    CASE WHEN 4 * protein_g + 4 * carbs_g + 9 * fat_g > 0 THEN 4 * protein_g / (4 * protein_g + 4 * carbs_g + 9 * fat_g) ELSE 0 END AS ps,
    CASE WHEN 4 * protein_g + 4 * carbs_g + 9 * fat_g > 0 THEN 4 * carbs_g / (4 * protein_g + 4 * carbs_g + 9 * fat_g) ELSE 0 END AS cs,
    CASE WHEN 4 * protein_g + 4 * carbs_g + 9 * fat_g > 0 THEN 9 * fat_g / (4 * protein_g + 4 * carbs_g + 9 * fat_g) ELSE 0 END AS fs
  FROM listings, goals
), parts AS (
  SELECT *, least(1, ratio / 0.16) AS efficiency, least(1, protein_g / 50) AS total_p,
    greatest(0, least(1, 1 - abs(calories - ideal) * CASE WHEN calories >= ideal THEN over_ ELSE under_ END / (tolerance * 2))) AS fit,
    CASE WHEN ps = 0 AND cs = 0 AND fs = 0 THEN 0 ELSE greatest(0, least(1, 1 - (greatest(0, 1 / 3.0::DOUBLE - ps) + greatest(0, cs - 1 / 3.0::DOUBLE) + greatest(0, fs - 1 / 3.0::DOUBLE)) / 3 / (1 / 3.0::DOUBLE))) END AS balance
  FROM r
), g AS (
  SELECT *, CASE goal WHEN 'cut' THEN fit WHEN 'bulk' THEN 0.75::DOUBLE * (fit * least(1, protein_g / least_p)) + 0.25::DOUBLE * least(1, cs / 0.3::DOUBLE)
    ELSE 0.6::DOUBLE * fit + 0.4::DOUBLE * (0.5::DOUBLE * greatest(0, least(1, (0.55::DOUBLE - greatest(cs, fs)) / (0.55::DOUBLE - 0.4::DOUBLE))) + 0.5::DOUBLE * least(1, ps / 0.25::DOUBLE)) END AS goal_fit
  FROM parts
), b AS (
  SELECT *, (0.5::DOUBLE * efficiency + 0.25::DOUBLE * goal_fit + 0.125::DOUBLE * total_p + 0.125::DOUBLE * balance) * 100
    * CASE WHEN calories >= 800 AND ratio < 0.05 THEN 0.75::DOUBLE ELSE 1 END * CASE WHEN ratio < 0.04 THEN 0.8::DOUBLE ELSE 1 END
    * CASE WHEN fr > extreme THEN 1 - least(0.125::DOUBLE, (fr - extreme) * 0.125::DOUBLE) ELSE 1 END AS reduced
  FROM g
), scored AS (
  SELECT *, floor(least(1, greatest(0, least(
      100 * pow(greatest(0, least(1, reduced / 100)), 0.65), CASE WHEN protein_g < 15 THEN 45 WHEN protein_g < 20 THEN 65 ELSE 1e9 END, CASE WHEN calories < 300 AND protein_g < 30 THEN 75 ELSE 1e9 END) / 100)) * 100 + 0.5)::INTEGER AS score
  FROM b
)"""


def meal_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_meals(each_goal(listings(spark, sf_dir)))
    # halves of the last place go up on both sides, whatever the last bits of a sum are
    parts = [(F.floor(F.col(f"components.{c}") * 1e6 + 0.5001) / 1e6).alias(c) for c in ("protein_efficiency", "goal_fit", "total_protein", "balance")]
    return scored.select("page_id", *LINE_KEYS, "goal", "score", *parts, F.array_join("penalties", ",").alias("penalties"), F.array_join("caps", ",").alias("caps"))


def meal_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = {"protein_efficiency": 0.25, "goal_fit": 0.25, "total_protein": 0.25, "balance": 0.25}
    scored = score_meals(each_goal(listings(spark, sf_dir)), weights)
    return scored.groupBy("goal", "category").agg(F.count(F.lit(1)).alias("meals"), F.sum("score").alias("score_sum"), F.min("score").alias("score_min"), F.max("score").alias("score_max"))


def meal_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = displayed(score_meals(each_goal(listings(spark, sf_dir))))
    return scored.select("page_id", *LINE_KEYS, "goal", F.array_join("badges", ",").alias("badges"), "explanation", "protein_text", "calories_text", "score_text")


def meal_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = rank_meals(score_meals(each_goal(listings(spark, sf_dir))), ["page_id"], LINE_KEYS)
    return ranked.select("page_id", *LINE_KEYS, "goal", "category", "score", "rank", F.array_join("badges", ",").alias("badges"))


def meal_ranks_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranks of `meal_ranks`, in ranges of a page's meals."""
    ranked = rank_meals(score_meals(each_goal(listings(spark, sf_dir))), ["page_id"], LINE_KEYS, by_range=True)
    return ranked.select("page_id", *LINE_KEYS, "goal", "category", "score", "rank", F.array_join("badges", ",").alias("badges"))


def meal_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = top_meals(score_meals(each_goal(listings(spark, sf_dir))), ["page_id"], LINE_KEYS, 5)
    return top.select("page_id", *LINE_KEYS, "goal", "category", "score", "rank")


def dishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dishes of restaurants (brands) from parts: a dish of a list, or the part's own name."""
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.initcap("p_name")).otherwise(chosen(DISHES, k))
    return table(spark, sf_dir, "part").select(
        "p_partkey", name.alias("dish_name"), F.nullif(chosen(SAID, (k / 2).cast("long")), F.lit("")).alias("description"), F.nullif(chosen(SECTIONS, F.col("p_size").cast("long")), F.lit("")).alias("section"),
        F.when(k % 4 != 0, F.col("p_retailprice")).alias("price"),
    )


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


DISH_CTE = f"""d AS (
  SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') ELSE {sql_list(DISHES)}[(p_partkey % {len(DISHES)} + 1)::INTEGER] END AS dish_name,
    nullif({sql_list(SAID)}[((p_partkey // 2) % {len(SAID)} + 1)::INTEGER], '') AS description, nullif({sql_list(SECTIONS)}[(p_size % {len(SECTIONS)} + 1)::INTEGER], '') AS section,
    CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice END AS price
  FROM part
)"""


def dish_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dishes(spark, sf_dir).withColumn("k", C.dish_type(F.col("dish_name"), F.col("description"), F.col("section")))
    return d.select("p_partkey", "dish_name", "section", "k.*")


def dish_inclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decide(dishes(spark, sf_dir))
    return d.select("p_partkey", "dish_type", "is_side", "exclusion_reason", C.is_section_name(F.col("section")).alias("is_section_name"), C.is_vague(F.col("dish_name")).alias("is_vague"))


def dish_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dishes(spark, sf_dir)
    parse = K.parse_confidence(F.col("dish_name"), F.col("description"), F.col("price"), F.col("section"))
    return d.select("p_partkey", K.name_quality(F.col("dish_name")).alias("name_quality"), parse.alias("parse_confidence"), K.bucket(parse).alias("bucket"))


def dish_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = estimate_macros(dishes(spark, sf_dir), ["p_partkey"])
    found = F.array_join(F.transform("detected_ingredients", lambda x: x["normalized_name"]), ",")
    return out.select("p_partkey", "dish_type", "calories", "protein_g", "carbs_g", "fat_g", "macro_confidence", found.alias("ingredients"), F.array_join("assumptions", " ").alias("assumptions"))


def macro_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that state the macros of a listing, values first or labels first, with decoys."""
    o = F.col("l_orderkey")
    p, c, f = (5 + F.col("l_quantity")).cast("int"), (F.col("l_partkey") % 120).cast("int"), ((o * 11 + F.col("l_linenumber")) % 60).cast("int")
    cal = (4 * p + 4 * c + 9 * f).cast("int")
    t = table(spark, sf_dir, "lineitem").select("l_suppkey", *LINE_KEYS, p.alias("p"), c.alias("c"), f.alias("f"), cal.alias("cal"), (o % 4).alias("form"))
    text = (
        F.when(F.col("form") == 0, F.format_string("Bowl $12.50 %d Calories %dG Protein %dG Carbs %dG Fat (2 g saturated fat)", "cal", "p", "c", "f"))
        .when(F.col("form") == 1, F.format_string("Plate, 9.95. Calories: %d Protein: %d g Total Carbohydrate: %d g Total Fat: %d g, sugars 3 g", "cal", "p", "c", "f"))
        .when(F.col("form") == 2, F.format_string("%d cal, %d grams protein", "cal", "p"))
        .otherwise(F.lit("nothing stated, feeds 4"))
    )
    return t.withColumn("text", text)


def published_macros(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_macros(macro_texts(spark, sf_dir), F.col("text")).drop("text", "p", "c", "f", "cal", "form")


#: Headings of menus, as written; a menu has two, one after the other.
HEADINGS = ["BOWLS", "Salads:", "DRINKS", "Catering"]
MENU_PARTS = 1000


def menus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A menu per brand and thousand part keys: two headings, dishes with prices, descriptions, blank lines, a footer.

    So menus don't grow with the table; there are more of them.
    """
    k = F.col("p_partkey")
    d = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_size", F.floor(k / MENU_PARTS).cast("long").alias("menu"), (k % MENU_PARTS >= MENU_PARTS // 2).alias("second"), F.nullif(chosen(SAID, k), F.lit("")).alias("say"))
    price = F.format_string("%d.95", (F.col("p_size") % 40 + 5).cast("int"))
    entry = F.concat(F.initcap("p_name"), F.lit(" Number "), F.col("p_size").cast("string"), F.lit(" ...... $"), price, F.when(F.col("say").isNull(), "").otherwise(F.concat(F.lit("\n"), F.col("say"))))
    m = d.withColumn("e", F.struct("p_partkey", "second", entry.alias("text"))).groupBy("p_brand", "menu").agg(F.array_sort(F.collect_list("e")).alias("e"))
    brand = F.substring("p_brand", 7, 9).cast("long") + F.col("menu")
    half = lambda second: F.array_join(F.transform(F.filter("e", lambda x: x["second"] == second), lambda x: x["text"]), "\n\n\n")
    text = F.concat(chosen(HEADINGS, brand), F.lit("\r\n\r\n"), half(False), F.lit("\n\n"), chosen(HEADINGS, brand + 1), F.lit("\n\n"), half(True), F.lit("\n\nAll rights reserved"))
    return m.select(F.xxhash64("p_brand", "menu").alias("page_id"), "p_brand", "menu", text.alias("text"))


def menu_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = menus(spark, sf_dir)
    items = menu_items(menu_lines(m)).join(m.select("page_id", "p_brand", "menu"), "page_id")
    return items.select("p_brand", "menu", "item_pos", "section", "dish_name", "description", "price")


def menu_segments_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dishes of `menu_segments`, with menus taken in blocks of 64 lines, as very long pages are."""
    m = menus(spark, sf_dir)
    items = menu_items(menu_lines(m, block_lines=64), block_lines=64).join(m.select("page_id", "p_brand", "menu"), "page_id")
    return items.select("p_brand", "menu", "item_pos", "section", "dish_name", "description", "price")


def menu_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = menus(spark, sf_dir)
    lines = menu_lines(m).join(m.select("page_id", "p_brand", "menu"), "page_id")
    return lines.groupBy("p_brand", "menu").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("line") == "").alias("blank"), F.count_if(M.split_price(F.col("line"))["price"].isNotNull()).alias("priced"), F.sum(F.length("line")).alias("chars"))


def event_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of users' pages from events; the same dish comes again and again."""
    e = table(spark, sf_dir, "events")
    name = F.concat(chosen(["Grilled Chicken Bowl", "Salmon Plate*", "Ab", "Protein", "Is this good?", "Steak Tacos $14.50"], F.col("event_id")))
    say = chosen(["Rice and beans", "May contain nuts", ""], F.col("event_id"))
    b = e.select(F.col("user_id").alias("page_id"), F.col("event_id").alias("pos"), name.alias("name"), say.alias("description"), F.col("event_type").alias("section"), F.concat(name, F.lit(" $"), (F.col("event_id") % 20 + 5).cast("string"), F.lit(".25")).alias("text"))
    return block_items(b).select("page_id", "item_pos", "section", "dish_name", "description", "price", "parse_confidence")


def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", M.text_quality(F.col("text")).alias("reason"), M.likely_menu(F.col("text")).alias("likely_menu"))


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = menu_lines(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "text"))
    return lines.groupBy("page_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(M.is_all_caps(F.col("line"))).alias("capital_lines"), F.sum(M.word_count(F.col("line"))).alias("words"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = html_text(table(spark, sf_dir, "pages"))
    return t.select("page_id", "url", restaurant_name(F.col("title")).alias("restaurant_name"), "text", F.size("links").alias("links"), M.likely_menu(F.col("text")).alias("likely_menu"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Menu links of pages: the tables' pages with a rendered link each to their menu as PDF and as page."""
    pages = table(spark, sf_dir, "pages")
    more = F.concat(F.lit('<p><a href="/menu.pdf?id='), F.col("page_id").cast("string"), F.lit('">Our food</a><a href="menu">View menu</a><a href="/menu.pdf?id='), F.col("page_id").cast("string"), F.lit('">Again</a><a href="#top">menu</a></p></article>'))
    return menu_links(html_text(pages.withColumn("html", F.regexp_replace("html", "</article>", more))))


def page_work_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to fetch, in two crawls of the same pages, of which every fourth has dishes by the second: no link is given out twice."""
    pages = table(spark, sf_dir, "pages")
    link = lambda name: F.concat(F.lit(f'<a href="../{name}/./menu.pdf?id='), F.col("page_id").cast("string"), F.lit(f'">{name}</a>'))
    more = F.concat(F.lit("<p>"), link("food"), link("wine"), F.when(F.col("page_id") % 3 == 0, "").otherwise(link("food")), F.lit("</p></article>"))
    links = menu_links(html_text(pages.withColumn("html", F.regexp_replace("html", "</article>", more))))
    first = linked_pdfs(links, pages.where("false"))
    second = linked_pdfs(links, pages.where("page_id % 4 = 0"), first)
    return first.withColumn("crawl", F.lit(1)).unionByName(second.withColumn("crawl", F.lit(2)))


def page_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("html", F.when(F.col("page_id") % 5 != 0, F.col("html")))
    pages = pages.withColumns({"text": F.when(F.col("page_id") % 7 == 0, "Soup 4.50"), "content": F.when(F.col("page_id") % 3 == 0, F.lit(b"%PDF-1.7"))})
    return resolve_source(pages).select("page_id", "source_type", "source_warning", source_kind(F.col("url"))["kind"].alias("url_kind"), source_kind(F.concat("url", F.lit("/m.pdf")))["is_pdf_url"].alias("pdf_url"))


def page_card_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_cards(html_nodes(table(spark, sf_dir, "pages")))


def menu_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dish of the rendered menus: kept with macros, or excluded with a reason."""
    m = menus(spark, sf_dir)
    found = extract(m.select("page_id", "text"))
    kept = found.items.select("page_id", "item_pos", "dish_name", "dish_type", "calories", "protein_g", "carbs_g", "fat_g", "macro_confidence", F.lit(None).cast("string").alias("exclusion_reason"))
    out = found.excluded.select("page_id", "item_pos", "dish_name", "dish_type", "exclusion_reason")
    return kept.unionByName(out, allowMissingColumns=True).join(m.select("page_id", "p_brand", "menu"), "page_id").drop("page_id")


def menu_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = menus(spark, sf_dir)
    report = extract(m.select("page_id", "text")).report.join(m.select("page_id", "p_brand", "menu"), "page_id")
    return report.select("p_brand", "menu", "source_type", "items", "excluded", "suppressed", F.array_join("warnings", " ").alias("warnings"), "empty_reason")


def menu_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = menus(spark, sf_dir)
    top = recommend(m.select("page_id", "text")).join(m.select("page_id", "p_brand", "menu"), "page_id")
    return top.select("p_brand", "menu", "item_pos", "goal", "rank", "name", "category", "score", "calories", "protein_g", "confidence", F.array_join("badges", ",").alias("badges"), "explanation")


def case_list(cases: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {w} THEN '{s}'" for w, s in cases) + f" ELSE '{other}' END"


KEY_SQL = "page_id, " + ", ".join(LINE_KEYS)
BADGE_SQL = """list_filter([CASE WHEN protein_g >= 40 THEN 'High Protein' END, CASE WHEN ratio >= 0.085 THEN 'Protein Efficient' END, CASE WHEN calories <= 500 AND fs <= 0.3 THEN 'Lean Pick' END,
  CASE WHEN balance >= 0.85 THEN 'Balanced' END, CASE WHEN goal <> 'bulk' AND calories >= 700 AND protein_g >= 30 THEN 'Better for Bulk' END, CASE WHEN calories >= 750 THEN 'Calorie Dense' END], lambda x: x IS NOT NULL)[1:3]"""
RANK_SQL = f"row_number() OVER (PARTITION BY page_id, goal ORDER BY category = 'side', score DESC, protein_g DESC, calories, {', '.join(LINE_KEYS)})"
SAY_SQL = case_list(
    [
        ("protein_g < 20 AND calories >= 800", "Calorie dense, with lower protein than ideal for this goal."),
        ("protein_g < 20", "Lower protein than ideal for this goal."),
        ("calories < 300", "Light for a full meal — good protein, but you may want more with it."),
        ("ratio < 0.04 AND calories > ideal + tolerance / 2", "Higher-calorie choice with a weak protein-to-calorie ratio."),
        ("ratio < 0.04", "Modest protein for the calories it carries."),
        ("goal = ''cut'' AND efficiency >= 0.85".replace("''", "'"), "High protein with a strong protein-to-calorie ratio."),
        ("goal = 'cut' AND fs > 0.45", "Solid protein, though it''s fat-forward for a cut."),
        ("goal = 'cut' AND calories > ideal + tolerance / 2", "Good protein, but a higher-calorie choice for a cut."),
        ("goal = 'cut'", "Lean pick with calories in a comfortable range for a cut."),
        ("goal = 'bulk' AND calories >= ideal - tolerance / 2 AND protein_g >= 35", "Good bulk option with higher calories and strong protein."),
        ("goal = 'bulk' AND calories >= ideal - tolerance / 2", "Good bulk option with plenty of calories and adequate protein."),
        ("goal = 'bulk' AND efficiency >= 0.85", "Lean and protein-dense — pair it with a side to fuel a bulk."),
        ("goal = 'bulk'", "Solid protein, but light on calories for a bulk."),
        ("efficiency >= 0.85", "High protein with a strong protein-to-calorie ratio."),
        ("balance >= 0.85", "Balanced macros with solid protein for maintaining."),
        ("fs > 0.45", "Solid protein, though the macros lean toward fat."),
        ("cs > 0.5", "Solid protein with a carb-forward mix."),
        ("fit >= 0.8", "Calories sit near your baseline with solid protein."),
        ("balance >= 0.6", "Reasonable maintain option with adequate protein."),
    ],
    "Reasonable maintain option, though the macros lean in one direction.",
)
REASON_SQL = f"""CASE WHEN x_section = 'catering section' AND x_shared THEN 'Shared or family-sized portion in the "' || coalesce(section, '') || '" section'
  WHEN x_section IS NOT NULL AND x_section <> 'catering section' THEN 'Listed under the "' || coalesce(section, '') || '" ' || x_section WHEN x_item IS NOT NULL THEN 'Item looks like a ' || x_item
  WHEN x_shared THEN 'Shared or family-sized portion' WHEN NOT ({INCLUDED} OR dish_type <> 'unknown') THEN 'Could not identify this as an entree or meal' END"""
QUALITY_SQL = "greatest(0, least(1, 1.0::DOUBLE - CASE WHEN n = 1 THEN 0.4::DOUBLE ELSE 0 END - CASE WHEN n > 6 THEN 0.3::DOUBLE ELSE 0 END - CASE WHEN n > 8 THEN 0.3::DOUBLE ELSE 0 END - CASE WHEN regexp_matches(dish_name, '[0-9]') THEN 0.3::DOUBLE ELSE 0 END))"
MENU_CTE = f"""m AS (
  SELECT p_partkey, p_brand, p_partkey // {MENU_PARTS} AS menu, row_number() OVER (PARTITION BY p_brand, p_partkey // {MENU_PARTS} ORDER BY p_partkey) AS item_pos,
    ['BOWLS', 'Salads', 'DRINKS', 'Catering'][((substr(p_brand, 7)::INTEGER + p_partkey // {MENU_PARTS} + CASE WHEN p_partkey % {MENU_PARTS} >= {MENU_PARTS // 2} THEN 1 ELSE 0 END) % 4 + 1)::INTEGER] AS section,
    array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' Number ' || p_size AS dish_name,
    nullif({sql_list(SAID)}[(p_partkey % {len(SAID)} + 1)::INTEGER], '') AS description, ((p_size % 40 + 5) || '.95')::DOUBLE AS price
  FROM part
)"""
JUDGED_CTE = f"""{MENU_CTE}, d AS (SELECT * FROM m), {KIND_CTE},
{OUT_CTE},
w AS (SELECT *, {REASON_SQL} AS why FROM x),
i AS (SELECT p_partkey AS item, dish_name, description, dish_type, matched_on IN ('name', 'description') AND coalesce(by_section = dish_type, false) AS supports FROM w WHERE why IS NULL), {costed("i")},
judged AS (
  SELECT w.p_brand, w.menu, w.item_pos, w.dish_name, w.dish_type, e.calories, e.protein_g, e.carbs_g, e.fat_g, e.macro_confidence, coalesce(e.macro_confidence < 0.3::DOUBLE, false) AS unsure,
    coalesce(w.why, CASE WHEN e.macro_confidence < 0.3::DOUBLE THEN 'Not enough information to estimate macros (confidence ' || printf('%.2f', e.macro_confidence) || ', minimum 0.3)' END) AS exclusion_reason
  FROM w LEFT JOIN e ON e.item = w.p_partkey
)"""
MENU_SCORES = f"""listings AS (SELECT *, 'entree' AS category FROM judged WHERE exclusion_reason IS NULL), goals({LISTINGS.split("), goals(", 1)[1]}"""
PUBLISHED_SQL = """
WITH t AS (
  SELECT *, (5 + l_quantity)::INTEGER AS p, (l_partkey % 120)::INTEGER AS c, ((l_orderkey * 11 + l_linenumber) % 60)::INTEGER AS f, l_orderkey % 4 AS form FROM lineitem
), u AS (SELECT *, 4 * p + 4 * c + 9 * f AS cal FROM t), v AS (SELECT *, form < 2 AND cal BETWEEN 20 AND 3000 AS ok FROM u)
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate,
  CASE WHEN ok THEN cal::DOUBLE END AS published_calories, CASE WHEN ok THEN p::DOUBLE END AS published_protein_g, CASE WHEN ok THEN c::DOUBLE END AS published_carbs_g, CASE WHEN ok THEN f::DOUBLE END AS published_fat_g,
  CASE WHEN form = 2 THEN cal::DOUBLE END AS partial_calories, CASE WHEN form = 2 THEN p::DOUBLE END AS partial_protein_g, NULL::DOUBLE AS partial_carbs_g, NULL::DOUBLE AS partial_fat_g
FROM v"""
BLOCK_SQL = f"""
WITH b AS (
  SELECT user_id AS page_id, event_id AS pos, event_type AS section, {sql_list(["Grilled Chicken Bowl", "Salmon Plate", "Ab", "Protein", "Is this good?", "Steak Tacos"])}[(event_id % 6 + 1)::INTEGER] AS dish_name,
    {sql_list(["Rice and beans", "", ""])}[(event_id % 3 + 1)::INTEGER] AS say, CASE WHEN event_id % 6 = 5 THEN 14.5 ELSE (event_id % 20 + 5) + 0.25 END::DOUBLE AS price FROM events
), f AS (SELECT *, row_number() OVER (PARTITION BY page_id, dish_name, say ORDER BY pos) AS n FROM b WHERE dish_name IN ('Grilled Chicken Bowl', 'Salmon Plate', 'Steak Tacos'))
SELECT page_id, pos AS item_pos, section, dish_name, nullif(say, '') AS description, price,
  floor((0.3::DOUBLE + 0.16::DOUBLE * 1.0 + CASE WHEN say <> '' THEN 0.15::DOUBLE ELSE 0 END + 0.15::DOUBLE + 0.1::DOUBLE) * 100 + 0.5) / 100 AS parse_confidence
FROM f WHERE n = 1"""

QUERIES = {f.__name__: f for f in (meal_scores, meal_weights, meal_badges, meal_ranks, meal_ranks_by_range, meal_top5, dish_types, dish_inclusion, dish_confidence, dish_costs, published_macros, menu_segments, menu_segments_in_blocks, menu_line_counts, event_blocks, text_quality, text_lines, page_text, page_links, page_work_lists, page_sources, page_card_blocks, menu_extraction, menu_report, menu_recommendations)}

SQL = {
    "meal_scores": f"""WITH {LISTINGS} SELECT {KEY_SQL}, goal, score, floor(efficiency * 1e6::DOUBLE + 0.5001::DOUBLE) / 1e6::DOUBLE AS protein_efficiency, floor(goal_fit * 1e6::DOUBLE + 0.5001::DOUBLE) / 1e6::DOUBLE AS goal_fit, floor(total_p * 1e6::DOUBLE + 0.5001::DOUBLE) / 1e6::DOUBLE AS total_protein, floor(balance * 1e6::DOUBLE + 0.5001::DOUBLE) / 1e6::DOUBLE AS balance,
  array_to_string(list_filter([CASE WHEN calories >= 800 AND ratio < 0.05 THEN 'highCalorieWeakProtein' END, CASE WHEN ratio < 0.04 THEN 'poorProteinRatio' END, CASE WHEN fr > extreme THEN 'extremeFatToProtein' END], lambda x: x IS NOT NULL), ',') AS penalties,
  array_to_string(list_filter([CASE WHEN protein_g < 15 THEN 'veryLowProtein' WHEN protein_g < 20 THEN 'lowProtein' END, CASE WHEN calories < 300 AND protein_g < 30 THEN 'lowCalorieForEntree' END], lambda x: x IS NOT NULL), ',') AS caps FROM scored""",
    "meal_weights": "WITH " + LISTINGS.replace("0.5::DOUBLE * efficiency + 0.25::DOUBLE * goal_fit + 0.125::DOUBLE * total_p + 0.125::DOUBLE * balance", "0.25::DOUBLE * efficiency + 0.25::DOUBLE * goal_fit + 0.25::DOUBLE * total_p + 0.25::DOUBLE * balance") + " SELECT goal, category, count(*) AS meals, sum(score)::BIGINT AS score_sum, min(score) AS score_min, max(score) AS score_max FROM scored GROUP BY goal, category",
    "meal_badges": f"WITH {LISTINGS} SELECT {KEY_SQL}, goal, array_to_string({BADGE_SQL}, ',') AS badges, {SAY_SQL} AS explanation, floor(protein_g + 0.5)::BIGINT || 'g' AS protein_text, floor(calories + 0.5)::BIGINT || ' cal' AS calories_text, score || '/100' AS score_text FROM scored",
    "meal_ranks": f"""WITH {LISTINGS}, ranked AS (SELECT *, {RANK_SQL} AS rank, {BADGE_SQL} AS own FROM scored WHERE category IN ('entree', 'side'))
SELECT {KEY_SQL}, goal, category, score, rank::INTEGER AS rank, array_to_string(CASE WHEN category = 'side' THEN (['Side dish'] || own)[1:3] WHEN rank = 1 THEN (['Best Match'] || own)[1:3] ELSE own END, ',') AS badges FROM ranked""",
    "meal_top5": f"WITH {LISTINGS}, ranked AS (SELECT *, {RANK_SQL} AS rank FROM scored WHERE category IN ('entree', 'side')) SELECT {KEY_SQL}, goal, category, score, rank::INTEGER AS rank FROM ranked WHERE rank <= 5",
    "dish_types": f"WITH {DISH_CTE}, {KIND_CTE} SELECT p_partkey, dish_name, section, dish_type, matched_on, matched_on IN ('name', 'description') AND coalesce(by_section = dish_type, false) AS section_supports FROM t",
    "dish_inclusion": f"""WITH {DISH_CTE}, {KIND_CTE}, {OUT_CTE}
SELECT p_partkey, dish_type, dish_type = 'unknown' AND {SIDE} AS is_side, {REASON_SQL} AS exclusion_reason, {SECTION_NAME} AS is_section_name, {VAGUE_NAME} AS is_vague FROM x""",
    "dish_confidence": f"""WITH {DISH_CTE}, n AS (SELECT *, len(list_filter(regexp_split_to_array(dish_name, '\\s+'), lambda w: w <> '')) AS n FROM d), q AS (SELECT *, {QUALITY_SQL} AS q FROM n),
c AS (SELECT *, floor(greatest(0, least(1, 0.3::DOUBLE + 0.16::DOUBLE * q + CASE WHEN description IS NOT NULL THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN price IS NOT NULL THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN section IS NOT NULL THEN 0.1::DOUBLE ELSE 0 END
  - CASE WHEN {VAGUE_NAME} THEN 0.15::DOUBLE ELSE 0 END)) * 100 + 0.5) / 100 AS s FROM q)
SELECT p_partkey, q AS name_quality, s AS parse_confidence, CASE WHEN s >= 0.7 THEN 'high' WHEN s >= 0.45 THEN 'medium' ELSE 'low' END AS bucket FROM c""",
    "dish_costs": f"""WITH {DISH_CTE}, {KIND_CTE}, i AS (SELECT p_partkey AS item, dish_name, description, dish_type, matched_on IN ('name', 'description') AND coalesce(by_section = dish_type, false) AS supports FROM t), {costed("i")}
SELECT item AS p_partkey, dish_type, calories, protein_g, carbs_g, fat_g, macro_confidence, array_to_string(ingredients, ',') AS ingredients, assumptions FROM e""",
    "published_macros": PUBLISHED_SQL,
    "menu_segments": f"WITH {MENU_CTE} SELECT p_brand, menu, item_pos, section, dish_name, description, price FROM m",
    "menu_line_counts": f"""WITH {MENU_CTE}, s AS (SELECT *, dish_name || ' $' || format('{{:.2f}}', price) AS head FROM m), c AS (
  SELECT p_brand, menu, count(*) AS n, count(description) AS said, sum(length(head)) + coalesce(sum(length(description)), 0) AS chars, (substr(p_brand, 7)::INTEGER + menu) % 4 AS head_ FROM s GROUP BY p_brand, menu)
SELECT p_brand, menu, (2 + n * 2 + said + 1)::BIGINT AS lines, (n + 1)::BIGINT AS blank, n::BIGINT AS priced,
  (chars + [5, 7, 6, 8][(head_ + 1)::INTEGER] + [5, 7, 6, 8][((head_ + 1) % 4 + 1)::INTEGER])::BIGINT AS chars FROM c""",
    "menu_extraction": f"""WITH {JUDGED_CTE} SELECT p_brand, menu, item_pos, dish_name, dish_type, exclusion_reason, CASE WHEN exclusion_reason IS NULL THEN calories END AS calories, CASE WHEN exclusion_reason IS NULL THEN protein_g END AS protein_g,
  CASE WHEN exclusion_reason IS NULL THEN carbs_g END AS carbs_g, CASE WHEN exclusion_reason IS NULL THEN fat_g END AS fat_g, CASE WHEN exclusion_reason IS NULL THEN macro_confidence END AS macro_confidence FROM judged""",
    "menu_report": f"""WITH {JUDGED_CTE}, c AS (SELECT p_brand, menu, count(*) FILTER (WHERE exclusion_reason IS NULL) AS items, count(*) FILTER (WHERE exclusion_reason IS NOT NULL) AS excluded, count(*) FILTER (WHERE unsure) AS suppressed FROM judged GROUP BY p_brand, menu)
SELECT p_brand, menu, 'raw_text' AS source_type, items, excluded, suppressed, CASE WHEN items = 0 THEN 'No entree-like menu items were found in this source.' END AS empty_reason,
  array_to_string(list_filter([CASE WHEN items > 0 THEN 'Macros are estimated from common assumptions and are not restaurant-provided.' END,
    CASE WHEN suppressed > 0 THEN suppressed || ' item(s) were left out because there was too little information to estimate their macros.' END,
    CASE WHEN items = 0 THEN 'No entree-like menu items were found in this source.' END], lambda x: x IS NOT NULL), ' ') AS warnings FROM c""",
    "menu_recommendations": f"""WITH {JUDGED_CTE}, {MENU_SCORES}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY p_brand, menu, goal ORDER BY score DESC, protein_g DESC, calories, item_pos) AS rank, {BADGE_SQL} AS own FROM scored)
SELECT p_brand, menu, item_pos, goal, rank::INTEGER AS rank, dish_name AS name, category, score, calories, protein_g, CASE WHEN macro_confidence >= 0.7 THEN 'high' WHEN macro_confidence >= 0.45 THEN 'medium' ELSE 'low' END AS confidence,
  array_to_string(CASE WHEN rank = 1 THEN (['Best Match'] || own)[1:3] ELSE own END, ',') AS badges, {SAY_SQL} AS explanation FROM ranked WHERE rank <= 5""",
    "page_links": r"""WITH p AS (
  SELECT page_id, regexp_extract(url, '^https?://[^/?#]+') AS host, regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') AS folder, len(regexp_extract_all(split_part(html, '</article>', 1), '<a\s[^>]*href')) AS n FROM pages WHERE contains(html, '</article>')
)
SELECT page_id, n::INTEGER AS pos, host || '/menu.pdf?id=' || page_id AS href, 'Our food' AS text, true AS confident FROM p
UNION ALL SELECT page_id, (n + 1)::INTEGER, folder || 'menu', 'View menu', false FROM p""",
    "event_blocks": BLOCK_SQL,
    "text_quality": rf"""WITH t AS (
  SELECT doc_id, text, length(text) AS n, length(text) - length(regexp_replace(text, '[\s\x{{0B}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{FEFF}}]', '', 'g')) AS w,
    length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS a, length(text) - length(replace(text, chr(65533), '')) AS r,
    len(list_filter(string_split(text, chr(10)), lambda x: len(list_filter(regexp_split_to_array(x, '[\s\x{{0B}}]+'), lambda y: y <> '')) BETWEEN 2 AND 10)) AS short FROM documents)
SELECT doc_id, CASE WHEN text IS NULL OR n < 200 THEN 'only ' || coalesce(n, 0) || ' characters extracted' WHEN r > n * 0.01::DOUBLE THEN 'many characters decoded as replacement characters' WHEN w / n > 0.6 THEN 'text is mostly whitespace'
  WHEN n - w > 0 AND a / (n - w) < 0.5 THEN 'text is mostly unreadable characters' WHEN NOT regexp_matches(text, '\$?\d{{1,3}}\.\d{{2}}\b') AND short < 3 THEN 'no price or dish-like patterns found' END AS reason,
  len(regexp_extract_all(text, '\$\d{{1,3}}(?:\.\d{{2}})?')) >= 3 AND regexp_matches(text, '\b(menu|entrees?|appetizers?|bowls?|sandwiches|burgers?|salads?)\b', 'i') AS likely_menu FROM t""",
    "page_sources": """SELECT page_id, CASE WHEN page_id % 7 = 0 AND page_id % 3 = 0 THEN 'pdf_text' WHEN page_id % 7 = 0 THEN 'raw_text' WHEN page_id % 3 = 0 THEN 'pdf_ocr_needed' ELSE 'html' END AS source_type,
  CASE WHEN page_id % 5 = 0 AND page_id % 7 <> 0 AND page_id % 3 <> 0 THEN 'Could not download ' || url || '.' END AS source_warning, 'url' AS url_kind, NOT contains(url, '#') AS pdf_url FROM pages""",
}
SQL |= {
    "meal_ranks_by_range": SQL["meal_ranks"],
    "menu_segments_in_blocks": SQL["menu_segments"],
    "page_work_lists": r"""WITH p AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', ''), '^(https?://[^/]+(?:/.*)?)/[^/]+/$', '\1/') AS above FROM pages WHERE contains(html, '</article>')
)
SELECT page_id, above || 'food/menu.pdf?id=' || page_id AS href, 1::INTEGER AS crawl FROM p
UNION ALL SELECT page_id, above || 'wine/menu.pdf?id=' || page_id, 2::INTEGER FROM p WHERE page_id % 4 <> 0""",
}
