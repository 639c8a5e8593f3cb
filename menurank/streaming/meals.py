"""The stages that need no other row, on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scoring import each_goal, score_meals
from ..plans.pipeline import decide

MEALS = "page_id long, item_pos int, slug string, name string, description string, category string, calories double, protein_g double, carbs_g double, fat_g double, source string, confidence string, estimated boolean"


def read_meals(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of meals from Parquet files that arrive in a folder."""
    return spark.readStream.schema(MEALS).parquet(folder)


def scored_stream(meals: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Each meal of a stream with its score for every goal; ranking is for the batch reader of the result."""
    return score_meals(each_goal(meals), weights)


def decided_stream(dishes: DataFrame) -> DataFrame:
    """Each dish of a stream with its type and, where it is out, the reason."""
    return decide(dishes)


def write_scores(scored: DataFrame, folder: str, checkpoint: str):  # noqa: ANN201
    """Append scores to a Parquet table, each meal once even if the stream restarts; one pass over what is there."""
    return scored.withColumn("scored_at", F.current_timestamp()).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
