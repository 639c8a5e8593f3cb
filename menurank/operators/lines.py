"""Menu text to lines, lines to dishes: running values over a page's lines instead of a scan with state."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import menu_text as M
from ..functions.classify import is_section_name
from ..functions.confidence import parse_confidence
from .scan import dealt, running

MOST_DESCRIPTION_LINES = 4


def blocks_of(lines: int | None) -> list[Column] | None:
    return None if lines is None else [F.floor(F.col("pos") / lines)]


def menu_lines(pages: DataFrame, key: str = "page_id", text: str = "text", block_lines: int | None = None) -> DataFrame:
    """(key, pos, line): normalised lines without boilerplate; one blank line between content, none at the ends.

    With `block_lines` a page's lines are taken in blocks of so many, each in a task of its own, with the same result.
    """
    # dealt out as whole texts, for all that follows by page; after the step in Python, which Spark takes to lose the order of tasks
    whole = dealt(pages.select(key, M.normalize_text(F.col(text)).alias("__text")), [key])
    if block_lines:
        lines = whole.select(key, F.posexplode(F.split("__text", "\n")).alias("pos", "line"))
        lines = lines.repartition(F.col(key), *blocks_of(block_lines))  # before the lines are worked on
        lines = lines.withColumn("line", F.explode_outer(M.normalize_lines(F.array("line"))))
    else:
        # as an array, which is made once, however often its lines are named after it
        lines = whole.select(key, F.posexplode_outer(M.normalize_lines(F.split("__text", "\n"))).alias("pos", "line"))
    lines = lines.where((F.col("line") == "") | ~M.is_boilerplate(F.col("line")))
    some = F.col("line") != ""
    lines = running(lines, [key], ["pos"], blocks_of(block_lines), sums={"sofar": some}, befores={"before": some}, totals={"all": some})
    return lines.where(some | (F.coalesce("before", F.lit(False)) & (F.col("sofar") < F.col("all")))).select(key, "pos", "line")


def menu_items(lines: DataFrame, key: str = "page_id", block_lines: int | None = None) -> DataFrame:
    """(key, item_pos, section, dish_name, description, price, parse_confidence) from `menu_lines`.

    Whether a line starts a dish depends on the line and the next one alone, so dishes are
    a running count of starts; a dish's description is the run of lines after it up to the
    first that ends it, at most MOST_DESCRIPTION_LINES: a line belongs to it if the last line that
    ends one stands before the dish's start. All of this are running sums and last values, so with `block_lines` no
    task takes more of a page than a block; else all windows share one partitioning by the key.
    """
    line, scan = F.col("line"), partial(running, groups=[key], order=["pos"], block=blocks_of(block_lines))
    lettered = M.has_letter(line)
    t = lines.withColumns({"split": M.split_price(line), "only": M.is_price_only(line)})
    t = scan(t, nexts={"next": line}, totals={"lettered": lettered, "upper": lettered & M.is_all_caps(line)})
    t = t.withColumn("caps", F.coalesce((F.col("lettered") >= 4) & (F.try_divide("upper", "lettered") > 0.8), F.lit(False)))
    following = M.split_price(F.col("next"))
    priced = F.coalesce(following["price"].isNotNull() & M.is_description(following["text"]), F.lit(False))
    plain = ~F.col("only") & F.col("split.price").isNull() & ~line.contains(",") & ~line.rlike("[.!?]$") & (M.word_count(line) <= M.MOST_SECTION_WORDS)
    header = (line != "") & plain & ~M.is_price_only(F.col("next")) & ~priced & (is_section_name(line) | (~F.col("caps") & M.is_all_caps(line)))
    t = t.withColumn("header", F.coalesce(header, F.lit(False)))
    t = t.withColumn("start", F.coalesce((line != "") & ~F.col("header") & (F.col("split.text") != "") & M.is_name(F.col("split.text"), F.col("caps")), F.lit(False)))
    title = F.when(F.col("header"), F.trim(F.regexp_replace(line, "[:.]+$", "")))
    t = scan(t, sums={"item_pos": F.col("start")}, lasts={"section": title, "begin": F.when(F.col("start"), F.col("pos"))}, befores={"unpriced": F.col("start") & F.col("split.price").isNull()})
    t = t.where("item_pos > 0")

    below = ~F.col("start") & F.coalesce("unpriced", F.lit(False)) & F.col("only")
    note = F.col("split.price").isNotNull() & ~M.has_letter(F.col("split.text")) & ~F.col("only")
    said = ~F.col("start") & ~F.col("only") & ~note & ~F.col("header") & M.is_description(F.col("split.text"))
    t = t.withColumns({"below": below, "said": said, "stop": ~F.col("start") & ~below & ((line == "") | F.col("header") | F.col("only") | (~note & ~said))})
    t = scan(t, sums={"told": F.col("said")}, lasts={"end": F.when(F.col("stop"), F.col("pos"))})
    t = scan(t, lasts={"base": F.when(F.col("start"), F.col("told"))})
    # told before the line, but for what earlier dishes have
    sofar = F.col("told") - F.col("said").cast("long") - F.col("base")
    t = t.where(F.col("start") | ((F.coalesce("end", F.lit(-1)) < F.col("begin")) & (sofar < MOST_DESCRIPTION_LINES)))
    own = F.sort_array(F.collect_list(F.when(F.col("said"), F.struct("pos", F.col("split.text").alias("text")))))
    found = t.groupBy(key, "item_pos").agg(
        F.max(F.when(F.col("start"), F.col("section"))).alias("section"),
        F.trim(F.max(F.when(F.col("start"), F.col("split.text")))).alias("dish_name"),
        F.array_join(F.transform(own, lambda x: x["text"]), " ").alias("description"),
        F.max(F.when(F.col("start"), F.col("split.price"))).alias("inline"),
        F.max(F.when(F.col("below"), M.parse_price(line))).alias("under"),
        F.min_by("split.price", F.when(~F.col("start") & ~F.col("below") & F.col("split.price").isNotNull(), F.col("pos"))).alias("run"),
    )
    found = found.withColumn("price", F.coalesce("inline", "under", "run")).withColumn("description", F.when(F.trim("description") != "", F.trim("description")))
    found = found.withColumn("parse_confidence", parse_confidence(F.col("dish_name"), F.col("description"), F.col("price"), F.col("section")))
    return found.select(key, "item_pos", "section", "dish_name", "description", "price", "parse_confidence")
