import pyarrow as pa
from pyspark.sql import functions as F

from menurank.operators.cards import page_cards
from menurank.sources.html import absolute, decode_entities, html_nodes, html_text
from menurank.streaming.meals import MEALS, read_meals, scored_stream, write_scores
from tests.test_menus import PAGE


def test_entities():
    assert decode_entities("a &amp; b &#8212; &#x41; &zzz; &copy;") == "a & b — A &zzz; &copy;"


def test_text(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, "u", None), (3, "u", "")], "page_id long, url string, html string")
    rows = {r["page_id"]: r for r in html_text(pages).collect()}
    text = rows[1]["text"]
    assert not any(x in text for x in ("Home", "cookies", "var a", "©")) and "Baja Chicken Bowl" in text.split("\n")
    assert rows[1]["title"] == "The Corner Kitchen | Menu" and rows[2]["text"] == "" == rows[3]["text"]


def test_cards(spark):
    page = """<html><body><nav><div class="item"><h3>Not A Dish At All</h3>text and more text</div></nav><div><h2>Bowls</h2>
    <div class="wrap"><div class="menu-item"><h3>Baja Bowl, Large</h3><p class="description">rice and beans here</p></div></div>
    <div class="card"><img alt="Salmon Plate"><p>salmon, rice, and a bit of kale</p></div></div><div class="item"></div></body></html>"""
    rows = page_cards(html_nodes(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string"))).orderBy("pos").collect()
    assert [(r["name"], r["section"], r["description"]) for r in rows] == [("Baja Bowl, Large", "Bowls", "rice and beans here"), ("Salmon Plate", "Bowls", "salmon, rice, and a bit of kale")]


def test_stream(spark, tmp_path):
    meal = (1, 0, "a", "A", "", "entree", 480.0, 44.0, 42.0, 14.0, "", "high", True)
    spark.createDataFrame([meal], MEALS).write.parquet(str(tmp_path / "in"))
    write_scores(scored_stream(read_meals(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(60)
    assert {(r["goal"], r["score"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("cut", 83), ("maintain", 82), ("bulk", 75)}


def cards_of(spark, *pages, **options):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    rows = page_cards(html_nodes(df), **options).orderBy("page_id", "pos").collect()
    return [(r["page_id"], r["pos"], r["name"], r["section"], r["description"]) for r in rows]


def test_card_grows_to_the_widest_container_of_one_dish(spark):
    card = '<div class="c-menu-card"><div class="c-card-bottom"><div class="c-card-title"><h3>{}</h3></div><p class="c-card-summary">greens and grains with beans</p></div><ul class="panel"><li>730 Calories</li></ul></div>'
    page = "<body><main><div class='list'>" + card.format("Tokyo Greens, Tofu") + card.format("Tokyo Greens, Chicken") + "</div></main></body>"
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    rows = page_cards(html_nodes(df)).orderBy("pos").collect()
    assert [r["name"] for r in rows] == ["Tokyo Greens, Tofu", "Tokyo Greens, Chicken"] and all("730 Calories" in r["text"] for r in rows)


def test_card_stops(spark):
    deep = lambda n: "<body>" + "<div>" * n + '<div class="item"><h3>Deep Bowl Of Rice</h3>and some more text</div>' + "</div>" * n + "</body>"
    first, second = cards_of(spark, deep(3), "<body><div><div class='item'><h3>Deep Bowl Of Rice</h3>and some more text</div>" + "filler " * 400 + "</div></body>")
    assert (first[2], second[2]) == ("Deep Bowl Of Rice", "Deep Bowl Of Rice")
    df = spark.createDataFrame([(1, deep(12))], "page_id long, html string")
    nodes = html_nodes(df)
    assert page_cards(nodes).count() == 1 and nodes.where("path IS NOT NULL").count() == 1
    # all names equal count as one; a container that holds another card is none; most_cards counts what is left
    twice = "<body><div><div class='item'><h3>Same Bowl Here</h3>one text of it</div><div class='item'><h3>Same Bowl Here</h3>another text</div></div></body>"
    assert len(cards_of(spark, twice)) == 1
    many = "<body>" + "".join(f"<div class='item'><h3>Bowl Number {i}</h3>and its text</div>" for i in range(6)) + "</body>"
    assert [c[1] for c in cards_of(spark, many, most_cards=4)] == [1, 2, 3, 4] and len(cards_of(spark, many, most_cards=None)) == 6


def test_no_card_of_a_long_page_is_left_out(spark, tmp_path):
    from menurank.plans.bridge import page_card_blocks

    page = "<body><h2>Bowls</h2>" + "".join(f"<div class='item'><h3>Bowl Number {i}</h3>and its text</div>" for i in range(450)) + "</body>"
    spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    rows = page_card_blocks(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r["pos"], r["name"], r["section"]) for r in rows] == [(i + 1, f"Bowl Number {i}", "Bowls") for i in range(450)]


def test_sections(spark):
    item = "<div class='item'><h3>Bowl Number {}</h3>and its own text</div>"
    page = f"""<body><h1>Our Menu</h1><section><div class="head"><h2>Warm Bowls</h2></div><div><div>{item.format(1)}</div><p>x</p>{item.format(2)}</div></section>
    <section><h2>Title</h2><h2></h2>{item.format(3)}<div><h2></h2><h4>Late Title</h4></div>{item.format(4)}<h3>a heading of far too many words to be a section</h3>{item.format(5)}</section>{item.format(6)}</body>"""
    assert [(c[2][-1], c[3]) for c in cards_of(spark, page)] == [("1", "Warm Bowls"), ("2", "Warm Bowls"), ("3", "Title"), ("4", "Title"), ("5", "Title"), ("6", "Our Menu")]


def test_description_from_lines(spark):
    page = "<body><div class='card'><h3>Bowl Of Things</h3>short, not long<br>rice, <b>beans</b>, corn and <i>more</i><button>Add, remove and keep this</button><p>$12</p></div></body>"
    ((_, _, name, _, description),) = cards_of(spark, page)
    assert (name, description) == ("Bowl Of Things", "rice, beans , corn and more")
    page = "<body><div class='card'><h3>Bowl Of Things</h3><p class='detail'>Bowl Of Things</p><p class='summary'>only two</p><p class='caption'>three whole words</p></div></body>"
    assert cards_of(spark, page)[0][4] == "three whole words"


def test_nodes_of_broken_and_large_pages(spark):
    import time

    from menurank.sources.html import read_page

    read = read_page("<div>a<p>b<p>c</div></b>d<img alt=x><span>e", tree=True)
    assert [(n.tag, n.last, n.parent) for n in read.nodes] == [("div", 2, -1), ("p", 2, 0), ("p", 2, 1), ("img", 3, -1), ("span", 4, -1)]
    took = []
    for n in (4_000, 40_000):
        began = time.time()
        assert len(read_page("<div class=item>" * n + "x" + "</b></div>" * n, tree=True).nodes) == n
        took.append(time.time() - began)
    assert took[1] < 40 * took[0] + 1
    wide = "<body>" + "".join(f"<section><h2>Part {i}</h2>" + "".join(f"<div class='item'><h3>Bowl {i} by {j}</h3>and its text</div>" for j in range(20)) + "</section>" for i in range(50)) + "</body>"
    found = cards_of(spark, wide, None, "", most_cards=None)
    assert len(found) == 1000 and found[999][1:4] == (1000, "Bowl 49 by 19", "Part 49")


def test_card_joins_are_on_equal_keys(spark):
    df = spark.createDataFrame([(1, "<p>x</p>")], "page_id long, html string")
    plan = page_cards(html_nodes(df))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_addresses(spark):
    from urllib.parse import urljoin

    base = "http://a/b/c/d;p?q"
    cases = ["g:h", "g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "g;x?y#s", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "../../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g", "./g/.", "g/./h", "g/../h"]
    cases += ["g;x=1/./y", "g;x=1/../y", "g?y/./x", "g?y/../x", "g#s/./x", "g#s/../x", "http:g", "HTTP://Other/x", "https://z/../y", "menu:x", "a b.pdf", "é.pdf?ü=1#ß", "mailto:x@y", "//h/p?q#f", "x\ny", "3d:menu.pdf"]
    rows = [(b, h) for b in (base, "https://host", "https://host?x=1", "https://host/m/", "https://host/m#f", "https://host/a/../b/", "", None) for h in cases]
    rows += [(base, "")]
    found = spark.createDataFrame(rows, "b string, h string").select("b", "h", absolute(F.col("b"), F.col("h")).alias("r")).collect()
    for r in found:
        if r["b"] and r["h"] in (";x", "x\ny"):  # a name that begins with ; is one to RFC 3986; line ends stay
            continue
        assert r["r"] == (urljoin(r["b"], r["h"]) if r["b"] else r["h"]), (r["b"], r["h"])
    assert {r["r"] for r in found if r["b"] == base and r["h"] == ";x"} == {"http://a/b/c/;x"}


def test_elements_are_not_broadcast(spark):
    from menurank.operators.cards import page_cards

    pages = spark.createDataFrame([(1, "<main><h2>Bowls</h2><div class='item'><h3>Grilled Chicken Bowl</h3>rice and beans</div></main>")], "page_id long, html string")
    cards = page_cards(html_nodes(pages))
    plan = cards._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("MapInArrow") <= 6
    assert [tuple(r) for r in cards.collect()] == [(1, 1, "Grilled Chicken Bowl", None, "Bowls", "Grilled Chicken Bowl rice and beans")]


def test_pages_in_slices():
    from menurank.sources.html import MOST_PAGES, slices

    whole = pa.RecordBatch.from_pydict({"k": list(range(2 * MOST_PAGES + 3))})
    parts = list(slices([whole, whole.slice(0, 0), whole.slice(0, 1)]))
    assert [p.num_rows for p in parts] == [MOST_PAGES, MOST_PAGES, 3, 1]
    assert [k for p in parts for k in p.column(0).to_pylist()] == [*range(2 * MOST_PAGES + 3), 0]
