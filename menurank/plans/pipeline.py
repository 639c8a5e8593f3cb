"""From pages to kept and excluded dishes, page reports, and ranked meals."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import dish_type, exclusion_reason, is_side
from ..functions.confidence import MIN_CONFIDENCE, PUBLISHED_CONFIDENCE, bucket
from ..functions.published import read_macros
from ..operators.blocks import block_items, exploded_blocks
from ..operators.costing import MACROS, estimate_macros
from ..operators.lines import menu_items, menu_lines
from ..operators.scoring import each_goal, score_meals, top_meals
from ..sources.html import html_text, menu_links, restaurant_name
from ..sources.pages import read_results, resolve_source, write_batch

#: Fixed value.
ESTIMATED = "Macros are estimated from common assumptions and are not restaurant-provided."


class Extraction(NamedTuple):
    items: DataFrame
    excluded: DataFrame
    report: DataFrame
    links: DataFrame
    judged: DataFrame

    def release(self) -> None:
        """Let go of the judged dishes that the four tables share, once these have been used or written."""
        self.judged.unpersist()


KEYS = ["page_id", "item_pos"]
DISH = [*KEYS, "source_type", "section", "dish_name", "description", "price", "parse_confidence"]


def kind_of() -> Column:
    return dish_type(F.col("dish_name"), F.col("description"), F.col("section"))


def decide(dishes: DataFrame, kind: Column | None = None) -> DataFrame:
    """Add dish_type, is_side and exclusion_reason (null: kept) to dishes; `kind` is what `dish_type` gives, where it is known already."""
    d = dishes.withColumn("dish_type", (kind_of() if kind is None else kind)["dish_type"])
    why = exclusion_reason(F.col("dish_name"), F.col("description"), F.col("section"), F.col("dish_type"))
    return d.withColumns({"is_side": is_side(F.col("section"), F.col("dish_type")), "exclusion_reason": why})


def with_macros(dishes: DataFrame, text: Column, least: float = MIN_CONFIDENCE) -> DataFrame:
    """All dishes with their macros or, in exclusion_reason, why they are out; `text` is where macros may be published.

    One pass: dishes that are out by rule, and those with published macros, go along without
    being searched for ingredients. Of the others, those that are estimated with less
    confidence than `least` are out too.
    """
    d = decide(dishes.withColumn("__kind", kind_of()), F.col("__kind")).withColumn("__text", F.when(F.col("exclusion_reason").isNull(), text))
    d = read_macros(d, F.col("__text")).withColumn("__why", F.col("exclusion_reason"))
    guess = F.col("__why").isNull() & F.col("published_calories").isNull()
    d = estimate_macros(d.drop("dish_type"), KEYS, active=guess, kind=F.col("__kind"))
    unsure = guess & (F.col("macro_confidence") < least)
    say = F.format_string(f"Not enough information to estimate macros (confidence %.2f, minimum {least:g})", F.col("macro_confidence"))
    stated = F.col("published_calories").isNotNull()
    none = F.array().cast("array<string>")
    return d.select(
        *DISH, "dish_type", "is_side", F.coalesce("__why", F.when(unsure, say)).alias("exclusion_reason"), F.when(F.col("__why").isNotNull(), "rule").when(unsure, "confidence").alias("excluded_by"),
        *[F.when(F.col("__why").isNull(), F.coalesce(f"published_{m}", m)).alias(m) for m in MACROS], F.when(F.col("__why").isNull(), F.when(stated, "published").otherwise("estimated")).alias("macro_source"),
        F.when(F.col("__why").isNull(), F.when(stated, PUBLISHED_CONFIDENCE).otherwise(F.col("macro_confidence"))).alias("macro_confidence"), F.when(guess, F.col("assumptions")).otherwise(none).alias("assumptions"), F.when(guess, F.col("detected_ingredients")).alias("detected_ingredients"),
    )


def block_dishes(blocks: DataFrame) -> DataFrame:
    """Blocks (page_id, pos, name, description, section, text; pos from 0) to dishes, for `with_macros`; `read` is where macros may be published."""
    return block_items(blocks).withColumn("source_type", F.lit("dom")).select(*DISH, F.col("text").alias("read"))


def extract(pages: DataFrame, least: float = MIN_CONFIDENCE, block_lines: int | None = None) -> Extraction:
    """Kept dishes, excluded dishes with reasons, a report per page, and PDF links of pages without dishes.

    All four come from one table of judged dishes, which is persisted until `release()`: Spark spills it and
    computes lost parts again. `block_lines`: take pages' lines in blocks of so many, for corpora with pages too long for a task.
    """
    p = resolve_source(pages)
    from_html = html_text(p.where("source_type = 'html' AND html IS NOT NULL"))
    names = from_html.select("page_id", restaurant_name(F.col("title")).alias("restaurant_name"))
    texts = p.where("source_type IN ('raw_text', 'pdf_text')").select("page_id", "source_type", "text").unionByName(from_html.select("page_id", F.lit("html").alias("source_type"), "text"))
    by_line = menu_items(menu_lines(texts, block_lines=block_lines), block_lines=block_lines).join(texts.select("page_id", "source_type"), "page_id")
    by_line = by_line.select(*DISH, F.concat_ws(" ", "dish_name", "description").alias("read"))
    by_block = block_dishes(exploded_blocks(p.where("source_type = 'dom'")))
    dishes = by_line.unionByName(by_block)
    judged = with_macros(dishes, F.col("read"), least).persist()
    items = judged.where("exclusion_reason IS NULL").drop("exclusion_reason", "excluded_by")
    excluded = judged.where("exclusion_reason IS NOT NULL").select(*DISH, "dish_type", "exclusion_reason", "excluded_by")

    counts = items.groupBy("page_id").agg(F.count(F.lit(1)).alias("items"), F.max(F.col("macro_source") == "estimated").alias("estimated"))
    out = excluded.groupBy("page_id").agg(F.count(F.lit(1)).alias("excluded"), F.count_if(F.col("excluded_by") == "confidence").alias("suppressed"))
    report = p.select("page_id", "url", "source_type", "source_warning").join(names, "page_id", "left").join(counts, "page_id", "left").join(out, "page_id", "left")
    report = report.na.fill(0, ["items", "excluded", "suppressed"])
    few = F.concat(F.col("suppressed").cast("string"), F.lit(" item(s) were left out because there was too little information to estimate their macros."))
    nothing = (F.col("items") == 0) & (F.col("source_type") != "pdf_ocr_needed")
    warnings = F.array_compact(F.array(F.when(F.col("estimated"), ESTIMATED), F.col("source_warning"), F.when(F.col("suppressed") > 0, few), F.when(nothing, "No entree-like menu items were found in this source.")))
    some = F.when(nothing, "No entree-like menu items were found in this source.").otherwise("I found items on this page, but none look like meals.")
    empty = F.when((F.col("items") == 0) & (F.col("excluded") > 0), some).when(F.col("items") == 0, "No menu items were found on this page.")
    report = report.select("page_id", "url", "source_type", "restaurant_name", "items", "excluded", "suppressed", warnings.alias("warnings"), empty.alias("empty_reason"))
    work = linked_pdfs(menu_links(from_html), items)
    return Extraction(items, excluded, report, work, judged)


def linked_pdfs(links: DataFrame, items: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """(page_id, href): for pages without a dish, the first confident link to a PDF that isn't in `given`
    (page_id, href), for a crawler to fetch."""
    sure = links.where("confident").join(items.select("page_id"), "page_id", "left_anti")
    if given is not None:
        sure = sure.join(given.select("page_id", "href"), ["page_id", "href"], "left_anti")
    return sure.groupBy("page_id").agg(F.min_by("href", "pos").alias("href"))


def give_out(links: DataFrame, items: DataFrame, folder: str, batch: str) -> DataFrame:
    """Write a batch's work list under `folder` and return it: what no earlier batch has given out.

    The lists written so far are the state, with a manifest. A batch that was lost or is run again
    replaces its own list, and doesn't see that as given out.
    """
    try:
        given = read_results(links.sparkSession, folder, "work", but=batch, manifest="work_manifest")
    except AnalysisException as e:  # the first batch
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        given = None
    write_batch({"work": linked_pdfs(links, items, given)}, folder, batch, manifest="work_manifest")
    return links.sparkSession.read.parquet(f"{folder}/work/batch={batch}")


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def to_meals(items: DataFrame) -> DataFrame:
    """Dishes in the shape that is scored and ranked."""
    published = F.col("macro_source") == "published"
    return items.select(
        *KEYS, slug(F.col("dish_name")).alias("slug"), F.col("dish_name").alias("name"), F.coalesce("description", F.lit("")).alias("description"),
        F.when(F.col("is_side"), "side").otherwise("entree").alias("category"), *MACROS,
        F.when(published, "From the restaurant").otherwise("Estimated from common assumptions").alias("source"), bucket(F.col("macro_confidence")).alias("confidence"), (~published).alias("estimated"),
    )


def recommend(pages: DataFrame, k: int = 5, weights: dict[str, float] | None = None, least: float = MIN_CONFIDENCE) -> DataFrame:
    """The first k meals per page and goal."""
    meals = to_meals(extract(pages, least).items)
    return top_meals(score_meals(each_goal(meals), weights), ["page_id"], ["item_pos"], k)
