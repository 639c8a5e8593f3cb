"""Item cards on a page, from the table of its elements.

Elements are numbered in document order, so a subtree is a run of numbers. What a subtree holds is told by
running counts at its two ends; what stands above an element by its path, exploded as far as it is needed. So every join is on
equal numbers, and all work grows with the number of elements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.menu_text import word_count
from ..functions.rules import any_match
from .blocks import MACRO_LABEL

# Fixed values.
LEAST_TEXT, MOST_TEXT, MOST_LEVELS = 20, 2000, 8
ITEM_CLASSES = ["menu-item", "menuitem", "item", "product", "dish", "card"]
ITEM_TESTIDS = ["menu-item", "item", "product", "dish", "card"]
TITLE_CLASSES = ["title", "font-heading", "heading", "item-name", "item_name", "itemname", "product-name", "product_name", "productname", "dish-name", "dish_name", "dishname"]
DESCRIPTION_CLASSES = ["description", "ingredient", "summary", "detail", "caption"]
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]


def name_like(text: Column, comma: bool) -> Column:
    plain = F.length(text).between(3, 90) & text.rlike("[A-Za-z]{3,}") & ~text.rlike("[.!?]$") & ~text.rlike(MACRO_LABEL) & (word_count(text) <= 12)
    return F.coalesce(plain if comma else plain & ~text.contains(","), F.lit(False))


def section_like(text: Column) -> Column:
    return (text != "") & (F.length(text) <= 60) & (word_count(text) <= 6)


def marked(nodes: DataFrame, key: str) -> DataFrame:
    """What each element may be (item, name of which tier, heading, description), and running numbers of its page, without long texts.

    titles, names: how many elements up to here have a name, of headings and title classes, and of pictures too;
    changes: how often a title's text differs from that of the title before; next_changes: this count at the next title;
    head: a section's heading, if this is one or holds nothing else.
    """
    text = F.col("text")
    heading = F.col("tag").isin(HEADINGS)
    alt = F.trim(F.regexp_replace("alt", r"\s+", " "))
    tier = F.when(heading & name_like(text, True), 1).when(any_match(F.col("class"), TITLE_CLASSES) & name_like(text, False), 2).when((F.col("tag") == "img") & name_like(alt, False), 3)
    item = any_match(F.col("class"), ITEM_CLASSES) | any_match(F.col("testid"), ITEM_TESTIDS) | (F.col("tag") == "article")
    n = nodes.select(
        key, "pre", "last", "parent", "tag", "chrome", "length", item.alias("is_item"), "path", tier.alias("tier"),
        F.when(heading | (F.col("length") <= 60), F.substring(text, 1, 61)).alias("short"), heading.alias("is_heading"),
        F.when(any_match(F.col("class"), DESCRIPTION_CLASSES) & (word_count(text) >= 3), text).alias("told"),
        F.filter("lines", lambda x: x.contains(",") & (word_count(x) >= 3)).alias("told_lines"), text.alias("name_text"), alt.alias("alt"),
    )
    n = n.withColumn("name_text", F.when(F.col("tier") == 3, F.col("alt")).when(F.col("tier").isNotNull(), F.col("name_text"))).drop("alt")
    down = W.partitionBy(key).orderBy("pre")
    upto, before = down.rowsBetween(W.unboundedPreceding, 0), down.rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy(key).orderBy(F.desc("pre")).rowsBetween(W.unboundedPreceding, -1)
    title = F.coalesce(F.col("tier") < 3, F.lit(False))
    other = title & ~F.coalesce(F.last(F.when(title, F.col("name_text")), True).over(before) == F.col("name_text"), F.lit(False))
    n = n.withColumns({"titles": F.count_if(title).over(upto), "names": F.count("tier").over(upto), "other": other})
    n = n.withColumn("changes", F.count_if("other").over(upto)).drop("other")
    n = n.withColumns({"next_changes": F.last(F.when(title, F.col("changes")), True).over(later), "next_heading": F.last(F.when(F.col("is_heading"), F.struct("pre", F.col("short").alias("text"))), True).over(later)})
    alone = (F.col("next_heading.pre") <= F.col("last")) & (F.col("next_heading.text") == F.col("short")) & (F.col("length") <= 60)
    return n.withColumn("head", F.when(F.when(F.col("is_heading"), F.col("length") <= 60).otherwise(alone) & section_like(F.col("short")), F.col("short"))).drop("short", "next_heading", "is_heading")


def shuffled(elements: DataFrame) -> DataFrame:
    """`elements` for a join that must not broadcast them: what Spark takes their size for comes from the pages' files, of which they are many times the size."""
    return elements.hint("merge")


def single_dish_containers(n: DataFrame, key: str) -> DataFrame:
    """(key, pre, last, path) of the widest container of each candidate: at most eight levels up, up to the first that isn't shown, is too long, or has not one name."""
    own = n.where(F.col("is_item") & ~F.col("chrome") & F.col("length").between(LEAST_TEXT, MOST_TEXT) & F.col("path").isNotNull())
    line = own.select(key, F.col("pre").alias("own"), "path", F.posexplode(F.array_prepend(F.slice("path", 1, MOST_LEVELS), F.col("pre"))).alias("level", "at"))
    line = line.join(shuffled(n.select(key, F.col("pre").alias("at"), F.col("last").alias("at_last"), "tag", "chrome", "length", "titles", "names", "next_changes")), [key, "at"])
    ends = n.select(key, F.col("pre").alias("at_last"), F.col("titles").alias("titles_in"), F.col("names").alias("names_in"), F.col("changes").alias("changes_in"))
    line = line.join(shuffled(ends), [key, "at_last"])
    single = (F.col("titles_in") > F.col("titles")) & (F.col("changes_in") == F.col("next_changes"))
    stop = F.col("tag").isin("body", "html") | F.col("chrome") | (F.col("length") > MOST_TEXT) | ~F.coalesce(single, F.lit(False))
    stop = F.when(F.col("level") == 0, F.col("names_in") == F.col("names")).otherwise(stop)  # the candidate itself must hold a name
    line = line.groupBy(key, "own").agg(F.array_sort(F.collect_list(F.struct("level", "at", "at_last", stop.alias("stop")))).alias("line"), F.first("path").alias("path"))
    wide = F.array_position(F.transform("line", lambda x: x["stop"]), True)
    wide = line.withColumn("wide", F.when(wide == 0, F.size("line")).otherwise(wide - 1).cast("int")).where("wide > 0")
    wide = wide.select(key, "own", F.element_at("line", F.col("wide")).alias("at"), F.slice("path", F.col("wide"), F.greatest(F.size("path"), F.lit(1))).alias("path"))
    return wide.groupBy(key, F.col("at.at").alias("pre")).agg(F.first("at.at_last").alias("last"), F.min_by("path", "own").alias("path"))


def innermost(cards: DataFrame, key: str, most_cards: int | None) -> DataFrame:
    """The cards that hold no other, numbered: one that does holds the next one, as subtrees are runs."""
    order = W.partitionBy(key).orderBy("pre")
    cards = cards.withColumn("next", F.lead("pre").over(order)).where("next IS NULL OR next > last").drop("next").withColumn("pos", F.row_number().over(order))
    return cards.where(F.col("pos") <= most_cards) if most_cards else cards


def named_cards(cards: DataFrame, n: DataFrame, key: str) -> DataFrame:
    """`cards` that have a name, with (name, description): the best name in each card, its first description or else its longest line with a comma."""
    card = F.struct(*[c for c in cards.columns if c != key])
    facts = n.where("tier IS NOT NULL OR told IS NOT NULL OR size(told_lines) > 0").select(key, "pre", F.lit(1).alias("fact"), "tier", "name_text", "told", "told_lines")
    starts = cards.select(key, "pre", F.lit(0).alias("fact"), card.alias("card"))
    order = W.partitionBy(key).orderBy("pre", "fact").rowsBetween(W.unboundedPreceding, 0)
    f = facts.unionByName(starts, allowMissingColumns=True).withColumn("card", F.last("card", True).over(order)).where("fact = 1 AND pre <= card.last").withColumn("own", F.col("card.pre"))
    inside = F.col("pre") > F.col("own")
    best = F.min_by(F.when(inside, F.col("name_text")), F.when(inside & F.col("tier").isNotNull(), F.struct("tier", "pre")))
    f = f.withColumn("name", best.over(W.partitionBy(key, "own"))).where("name IS NOT NULL")
    said = F.when(inside & (F.col("told") != F.col("name")), F.col("told"))
    lines = F.transform(F.filter("told_lines", lambda x: x != F.col("name")), lambda x: F.struct((-F.length(x)).alias("o"), x.alias("line")))
    f = f.withColumns({"said": said, "line": F.array_min(F.transform(lines, lambda x, i: F.struct(x["o"].alias("o"), F.col("pre").alias("p"), i.alias("i"), x["line"].alias("line"))))})
    f = f.groupBy(key, "own").agg(F.first("card").alias("card"), F.first("name").alias("name"), F.min_by("said", F.when(F.col("said").isNotNull(), F.col("pre"))).alias("said"), F.min("line").alias("line"))
    return f.select(key, "card.*", "name", F.coalesce("said", "line.line").alias("description"))


def with_sections(cards: DataFrame, n: DataFrame, key: str) -> DataFrame:
    """`cards` with section: of a card and its ancestors below the body, the nearest that has a heading before it among its siblings; the last such heading."""
    before = W.partitionBy(key, "parent").orderBy("pre").rowsBetween(W.unboundedPreceding, -1)
    under = n.select(key, F.col("pre").alias("at"), "tag", F.last("head", True).over(before).alias("head")).where(F.col("head").isNotNull() & ~F.col("tag").isin("body", "html")).drop("tag")
    # only the first line of a card carries it
    card = F.when(F.col("level") == 0, F.struct(*[c for c in cards.columns if c not in (key, "path")]))
    line = cards.select("*", F.posexplode(F.array_prepend("path", F.col("pre"))).alias("level", "at")).select(key, F.col("pre").alias("own"), "level", "at", card.alias("card"))
    line = line.join(shuffled(under), [key, "at"], "left")
    found = line.groupBy(key, "own").agg(F.first("card", True).alias("card"), F.min_by("head", F.when(F.col("head").isNotNull(), F.col("level"))).alias("section"))
    return found.select(key, "card.*", "section")


def parsed_once(nodes: DataFrame, key: str) -> DataFrame:
    """`nodes`, dealt out by page in one array column: as no use can prune columns of it, all uses share this exchange, and pages are parsed once."""
    packed = nodes.select(key, F.array(F.struct(*[c for c in nodes.columns if c != key])).alias("node")).repartition(key)
    return packed.select(key, F.inline("node"))


def page_cards(nodes: DataFrame, key: str = "page_id", most_cards: int | None = None) -> DataFrame:
    """(key, pos, name, description, section, text): all cards of each page, or its first `most_cards`, as blocks.

    A candidate is an item-like element outside the page's chrome, of 20 to 2000 characters,
    that holds a name. It grows to its outermost ancestor, of at most eight, that still
    holds exactly one name; containers of other containers are dropped. Pages without cards give no rows.
    """
    nodes = parsed_once(nodes, key)
    n = marked(nodes, key)
    # one line of steps: none is used twice
    cards = with_sections(named_cards(innermost(single_dish_containers(n, key), key, most_cards), n, key), n, key)
    texts = nodes.where(F.col("length").between(LEAST_TEXT, MOST_TEXT) & ~F.col("chrome")).select(key, "pre", "text")
    return cards.join(shuffled(texts), [key, "pre"]).select(key, "pos", "name", "description", "section", "text")
