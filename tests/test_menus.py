import pytest
from pyspark.sql import functions as F

from menurank import dims
from menurank.functions import classify as C
from menurank.functions import menu_text as M
from menurank.functions.published import read_macros
from menurank.operators.blocks import block_items
from menurank.operators.costing import estimate_macros
from menurank.operators.lines import menu_items, menu_lines
from menurank.plans.pipeline import extract, recommend

MENU = """BOWLS

Baja Chicken Bowl 15.95
Grilled chicken, brown rice, black beans, avocado, pico de gallo, chipotle crema

Crispy Chicken Sandwich 14.50
Fried chicken, brioche bun, slaw, pickles, spicy aioli

SIDES

French Fries 6.00

DRINKS

House Lemonade 4.00
"""


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "page_id long, text string")


def test_lines(spark):
    rows = menu_lines(texts(spark, "A1\n\n\n\nB1", "\n\nBaja Chicken Bowl.......$ 15.95\n\n", "Alaskan Halibut . . . . . . . . 45\nAll rights reserved\n***", None, "")).orderBy("page_id", "pos").collect()
    by = {}
    for r in rows:
        by.setdefault(r["page_id"], []).append(r["line"])
    assert by == {0: ["A1", "", "B1"], 1: ["Baja Chicken Bowl $15.95"], 2: ["Alaskan Halibut 45"]}


def test_prices(spark):
    rows = texts(spark, "Steak $28", "Chicken Bowl 15.95", "Salad 12.95 / 16.95", "Tacos 3", "6 oz Sirloin").select(M.split_price(F.col("text"))["price"]).collect()
    assert [r[0] for r in rows] == [28.0, 15.95, 12.95, None, None]


def test_items(spark):
    rows = menu_items(menu_lines(texts(spark, MENU))).orderBy("item_pos").collect()
    assert [(r["section"], r["dish_name"], r["price"]) for r in rows] == [("BOWLS", "Baja Chicken Bowl", 15.95), ("BOWLS", "Crispy Chicken Sandwich", 14.5), ("SIDES", "French Fries", 6.0), ("DRINKS", "House Lemonade", 4.0)]
    assert rows[0]["description"].startswith("Grilled chicken, brown rice")


def test_price_below_annotation_and_four_lines(spark):
    text = "Garden Plate\n17\none, two\nthree, four\nfive, six\nseven, eight\nnine, ten\n\nSteak Frites\nred wine, fries\n- 28.50\nmore, of it\n"
    rows = menu_items(menu_lines(texts(spark, text))).orderBy("item_pos").collect()
    assert [(r["dish_name"], r["price"], r["description"]) for r in rows] == [("Garden Plate", 17.0, "one, two three, four five, six seven, eight"), ("Steak Frites", None, "red wine, fries")]  # a line of a price alone, not right under the name, ends the description


@pytest.mark.parametrize(
    ("text", "full"),
    [
        ("Picnic Bowl 580 Calories 29G Protein 39G Carbs 32G Fat", (580, 29, 39, 32)),
        ("Calories: 620 Protein: 41 g Total Carbohydrate: 45 g Total Fat: 28 g", (620, 41, 45, 28)),
        ("500 calories 30 grams protein 40 grams carbs 20 grams fat", (500, 30, 40, 20)),
        ("Steak Frites $28.00 810 Calories 52G Protein 41G Carbs 48G Fat", (810, 52, 41, 48)),
        ("580 Calories 29 Protein 39 Carbs 32 Fat", None),
        ("100 Calories 90G Protein 90G Carbs 90G Fat", None),
        ("a fine plate", None),
    ],
)
def test_published(spark, text, full):
    r = read_macros(texts(spark, text), F.col("text")).first()
    assert (tuple(r[f"published_{m}"] for m in ("calories", "protein_g", "carbs_g", "fat_g")) if r["published_calories"] is not None else None) == full


def test_partial(spark):
    r = read_macros(texts(spark, "480 Calories, 31 g protein"), F.col("text")).first()
    assert (r["published_calories"], r["partial_calories"], r["partial_protein_g"], r["partial_fat_g"]) == (None, 480, 31, None)


DISHES = [
    ("Steak Plate", "", "Plates", None), ("Steak Plate", "", "Small Plates", "out"), ("Garden Salad", "", "Side Salads", "out"), ("House Lemonade", "", "Entrees", "out"), ("Chef's Special", "", None, "out"), ("Chef's Special", "", "Entrees", None),
    ("Fish and Chips", "", "Entrees", None), ("Crab Cakes", "", "Entrees", None), ("Shepherd's Pie", "", "Entrees", None), ("Coffee Crusted Prime NY Strip", "", None, None), ("Chicken Bowl Family Pack", "", "Catering", "out"), ("Chicken Bowl", "", "Catering", None),
    ("Pot Roast", "", "DINNER & SUNDAY LUNCH ENTREES", None), ("Turkey Club", "", "SANDWICHES & SIDES", "out"), ("Marinara Sauce", "", "Pasta", "out"), ("Spaghetti with Meat Sauce", "", "Pasta", None), ("Lobster Tail", "", "Elevate Your Plate", None), ("Steak Frites", "", "Elevate Your Plate", None),
]


def test_inclusion(spark):
    d = spark.createDataFrame([(i, *x) for i, x in enumerate(DISHES)], "i int, n string, d string, s string, want string")
    kind = C.dish_type(F.col("n"), F.col("d"), F.col("s"))["dish_type"]
    rows = d.withColumn("k", kind).withColumns({"why": C.exclusion_reason(F.col("n"), F.col("d"), F.col("s"), F.col("k")), "side": C.is_side(F.col("s"), F.col("k"))}).orderBy("i").collect()
    assert [(r["n"], r["why"] is None) for r in rows] == [(x[0], x[3] is None) for x in DISHES]
    assert [r["n"] for r in rows if r["side"]] == ["Lobster Tail"]
    assert rows[3]["why"] == "Item looks like a drink"
    kinds = spark.createDataFrame([("Entrée du jour", "plate"), ("Chili Garlic Shrimp", "unknown"), ("Texas Chili", "soup"), ("Dragon Roll", "sushi")], "n string, want string").select("want", C.dish_type(F.col("n"), F.lit(None).cast("string"), F.lit(None).cast("string"))["dish_type"]).collect()
    assert all(a == b for a, b in kinds)


def cost(spark, *dishes):
    d = spark.createDataFrame([(i, *x) for i, x in enumerate(dishes)], "i int, dish_name string, description string, section string")
    return estimate_macros(d, ["i"]).orderBy("i").collect()


def test_costing(spark):
    r = cost(spark, ("Baja Chicken Bowl", "Grilled chicken, brown rice, black beans, avocado, pico de gallo, chipotle crema", "Bowls"), ("Mystery", None, None), ("Chicken Bowl", "low carb, chicken", None), ("Half Turkey Club", "turkey, bacon", None), ("Turkey Club", "turkey, bacon", None), ("12 oz Ribeye Steak", None, None))
    assert [x["normalized_name"] for x in r[0]["detected_ingredients"]] == ["chicken breast", "brown rice", "black beans", "avocado", "pico de gallo", "crema"]
    assert (r[0]["calories"], r[0]["protein_g"], r[0]["carbs_g"], r[0]["fat_g"]) == (680, 38, 75, 26)
    assert r[1]["dish_type"] == "unknown" and r[1]["assumptions"][0].startswith("Dish type not recognized")
    assert any("Removed the carb portion" in x for x in r[2]["assumptions"])
    assert abs(r[3]["calories"] * 2 - r[4]["calories"]) <= 5
    assert any(x == "Used the 12 oz protein portion stated on the menu." for x in r[5]["assumptions"])


def test_ingredient_names(spark):
    assert len(dims.alias_rows()) == 321 and {r[5] for r in dims.alias_rows()} <= {r[0] for r in dims.nutrition_rows()}
    r = cost(spark, ("Chicken Milanese", None, None), ("Veal Parmesan", None, None), ("Bowl", "pickled fresnos, salsa verde, snap peas, little gem", None))
    found = [[x["normalized_name"] for x in row["detected_ingredients"]] for row in r]
    assert found == [["fried chicken"], ["fried chicken"], ["pickles", "salsa", "vegetables", "lettuce"]]


def test_blocks(spark):
    b = spark.createDataFrame(
        [(1, 0, "Grilled Chicken Club*", "", "handhelds", "Grilled Chicken Club* 26.75"), (1, 1, "Grilled Chicken Club", None, "handhelds", "x"), (1, 2, "Protein", "", "", ""), (1, 3, None, None, None, None), (1, 4, "Soup $9.50", "Contains nuts", "Soups", "")],
        "page_id int, pos int, name string, description string, section string, text string",
    )
    rows = block_items(b).orderBy("item_pos").collect()
    assert [(r["item_pos"], r["dish_name"], r["price"], r["description"]) for r in rows] == [(0, "Grilled Chicken Club", None, None), (4, "Soup", 9.5, None)]


PAGE = """<html><head><title>The Corner Kitchen | Menu</title><style>x</style></head><body><nav>Home</nav><div class="cookie-banner">We use cookies</div>
<h2>Bowls</h2><div class="item"><h3>Baja Chicken Bowl</h3><span>Grilled chicken, brown rice, black beans</span> <span>$15.95</span></div>
<h2>Drinks</h2><div class="item"><h3>House Lemonade</h3><span class="price">$4.00</span></div><script>var a = "<p>";</script><footer>&copy; us</footer><a href="/m.pdf">Menu</a></body></html>"""


def test_extract(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.b/c", PAGE, None), (2, None, None, MENU), (3, None, None, None), (4, "http://a.b/", "<p>nothing to eat here <a href='x/menu.pdf'>Menu</a></p>", None), (5, None, None, "Entrees\nSkate Grenobloise\nChef's Special\nBaja Chicken Bowl 15.95\nchicken, rice, beans and more\n")],
        "page_id long, url string, html string, text string",
    )
    found = extract(pages)
    names = {(r["page_id"], r["dish_name"]) for r in found.items.collect()}
    assert {(2, "Baja Chicken Bowl"), (2, "Crispy Chicken Sandwich"), (1, "Baja Chicken Bowl"), (5, "Baja Chicken Bowl")} <= names
    out = {(r["page_id"], r["dish_name"]): r["exclusion_reason"] for r in found.excluded.collect()}
    assert "House Lemonade" in {n for _, n in out} and not set(out) & names
    report = {r["page_id"]: r for r in found.report.collect()}
    assert report[1]["restaurant_name"] == "The Corner Kitchen" and report[3]["warnings"][0] == "No menu source was provided."
    assert report[4]["empty_reason"] == "No menu items were found on this page."
    assert [tuple(r) for r in found.links.collect()] == [(4, "http://a.b/x/menu.pdf")]
    first = recommend(pages.where("page_id = 2")).where("goal = 'cut' AND rank = 1").first()
    assert first["name"] == "Baja Chicken Bowl"
