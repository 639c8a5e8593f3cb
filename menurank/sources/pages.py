"""What a page row holds, and which of it is read."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import matches

PAGE_SCHEMA = "page_id long, url string, html string, text string, content binary, blocks array<struct<name:string,description:string,section:string,text:string>>"
PDF_PATH = r"\.pdf(?:$|[?#])"


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One page per file: page_id (a hash of the path), url and text."""
    files = spark.read.text(path, wholetext=True).withColumn("url", F.col("_metadata.file_path"))
    return files.select(F.xxhash64("url").alias("page_id"), "url", F.col("value").alias("text"))


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """One page per file: page_id (a hash of the path), url and content; nothing is decoded."""
    return spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("page_id"), F.col("path").alias("url"), "content")


def is_pdf(content: Column) -> Column:
    """By the first bytes, whatever name or content type say."""
    return F.coalesce(F.substring(content, 1, 5) == F.lit(b"%PDF-"), F.lit(False))


def is_pdf_url(url: Column, content_type: Column | None = None) -> Column:
    path, query = F.try_parse_url(url, F.lit("PATH")), F.try_parse_url(url, F.lit("QUERY"))
    by_name = F.when(path.isNull(), matches(url, PDF_PATH)).otherwise(matches(path, PDF_PATH) | matches(F.coalesce(query, F.lit("")), PDF_PATH))
    return by_name if content_type is None else by_name | matches(content_type, "application/pdf")


def source_kind(value: Column) -> Column:
    """struct<kind, is_pdf_url, url> of a free value: one token that is an http address is an address."""
    value = F.trim(F.coalesce(value, F.lit("")))
    address = matches(value, r"^https?://\S+$")
    return F.struct(F.when(address, "url").otherwise("raw_text").alias("kind"), (address & is_pdf_url(value)).alias("is_pdf_url"), F.when(address, value).alias("url"))


def with_columns_of_a_page(pages: DataFrame) -> DataFrame:
    """`pages` with those columns of a page that it lacks, as nulls."""
    kinds = {"url": "string", "html": "string", "text": "string", "content": "binary", "blocks": "array<struct<name:string,description:string,section:string,text:string>>"}
    return pages.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in pages.columns}) if set(kinds) - set(pages.columns) else pages


def resolve_source(pages: DataFrame) -> DataFrame:
    """Add source_type and source_warning: blocks before text, before a PDF's bytes, before html, before an address alone.

    A PDF isn't decoded here: it stands as pdf_text if text was extracted upstream into
    `text`, else as pdf_ocr_needed.
    """
    p = with_columns_of_a_page(pages)
    some = lambda c: F.coalesce(F.trim(F.regexp_replace(c, r"\s+", " ")) != "", F.lit(False))
    kind = (
        F.when(F.coalesce(F.size("blocks") > 0, F.lit(False)), "dom")
        .when(some("text") & is_pdf(F.col("content")), "pdf_text")
        .when(some("text"), "raw_text")
        .when(is_pdf(F.col("content")), "pdf_ocr_needed")
        .when(F.col("html").isNotNull(), "html")
        .when(some("url") & is_pdf_url(F.col("url")), "pdf_ocr_needed")
        .when(some("url"), "html")
        .otherwise("raw_text")
    )
    nothing = ~some("text") & F.col("html").isNull() & F.col("content").isNull() & ~some("url") & ~F.coalesce(F.size("blocks") > 0, F.lit(False))
    missing = some("url") & ~some("text") & F.col("html").isNull() & F.col("content").isNull() & ~F.coalesce(F.size("blocks") > 0, F.lit(False))
    warning = F.when(nothing, "No menu source was provided.").when(missing, F.concat(F.lit("Could not download "), F.col("url"), F.lit(".")))
    return p.withColumns({"source_type": kind, "source_warning": warning})


RESULTS = ("items", "excluded", "page_report")


def write_batch(tables: dict[str, DataFrame], folder: str, batch: str, manifest: str = "manifest") -> None:
    """Tables of a batch of pages as Parquet, partitioned by batch; a batch is a name of letters, digits, - and _.

    A table's partition of the batch is replaced as a whole, and only when all tables have theirs does the manifest name the batch. So a job
    that is lost between tables, or run again, leaves every page of the batch in the results once: `read_results` takes
    the batches that the manifest names.
    """
    if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
        raise ValueError(f"not a batch's name: {batch}")
    spark = next(iter(tables.values())).sparkSession
    for name, table in tables.items():
        # a partition of its own path, so that an empty table replaces what an earlier run has left
        table.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")
    spark.createDataFrame([(list(tables),)], "tables array<string>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/{manifest}/batch={batch}")


def write_results(items: DataFrame, excluded: DataFrame, report: DataFrame, folder: str, batch: str) -> None:
    """Items, excluded dishes and page reports, as `write_batch` does it."""
    write_batch(dict(zip(RESULTS, (items, excluded, report), strict=True)), folder, batch)


def read_results(spark: SparkSession, folder: str, name: str, but: str | None = None, manifest: str = "manifest") -> DataFrame:
    """A table of `write_batch`, of the batches that were written whole, without the batch `but`."""
    done = spark.read.parquet(f"{folder}/{manifest}").select(F.col("batch").cast("string").alias("batch")).distinct()
    table = spark.read.parquet(f"{folder}/{name}").withColumn("batch", F.col("batch").cast("string"))
    return (table if but is None else table.where(F.col("batch") != but)).join(done, "batch", "left_semi").drop("batch")
