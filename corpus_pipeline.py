"""Toxicity, line dedup, near-dedup, decontamination and mixing, one after the other, over `documents`.

Every stage works on all rows that the one before has kept, and all but the last return
the columns of `documents`. `run` writes each stage's result as Parquet in the shared
folder that spark.checkpoint.dir names and reads it again for the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from menurank.llm import decontaminate, lines, minhash, mixing, toxicity
from menurank.llm.jobs import durable, fresh, id_crc_mod, read, shared_folder

#: SQL can't express the classifier and the alignment; tests/llm hold each stage against a plain version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5, by a classifier trained on labelled documents.

    Every row is judged by its own whole text, so rows of equal or null ids and repeated rows are judged apart and
    alike; null and empty texts get the score of a text without features. An empty table stays empty.
    """
    labels = read(spark, sf_dir, "labels").where(id_crc_mod("doc_id", 5) != 0)
    model = toxicity.train(read(spark, sf_dir, "documents"), labels)
    (toxic,) = fresh(docs.columns, "toxic")
    return toxicity.score(docs, model, score_col=toxic).where(F.col(toxic) < 0.5).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sites share; all rows stay, n_chars follows the text.

    A line's first place, by id and position, keeps it; null texts and their n_chars stay as they are, empty texts stay empty.
    """
    out = lines.drop_boilerplate_lines(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates: five words, similarity 0.8.

    Rows are told apart by a hash of id and text, so rows that share an id are grouped each by its own text; of rows of
    one id and text, one stays. Null ids come after all others. Texts without words, null ones too, link with nothing, and all of
    their rows stay.
    """
    key, flag, held = fresh(docs.columns, "row_key", "no_id", "held")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    some = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    worded = keyed.where(some)
    groups = minhash.near_duplicates(worded, key, "text", shingle=5, percent=80).select(key, "component_id").distinct()
    groups = durable(groups.join(worded.select(key, "doc_id").distinct(), key))
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias(flag), "doc_id", F.col(key).alias(held))).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    losers = groups.join(first, "component_id").where(F.col(key) != F.col(f"first.{held}")).select(key)
    once = worded.groupBy(key).agg(F.min(F.struct(*docs.columns)).alias(held))
    kept = once.join(losers, key, "left_anti").select(*[F.col(f"{held}.{c}").alias(c) for c in docs.columns])
    return kept.unionByName(keyed.where(~some).select(*docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, not even an edited one.

    Every row is judged by its own whole text, whatever its id; null and empty texts stay, and so does everything where there is no benchmark.
    """
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of the sources takes: a row for each row.

    Null texts have size 0; null sources are one source, the last; rows of equal ids count each.
    """
    return mixing.mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
