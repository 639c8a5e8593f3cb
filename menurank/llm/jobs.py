"""Small Spark helpers that the operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names; only a local master may have none, and gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or tempfile.mkdtemp(prefix="spark-", dir="/tmp")).rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` with a reliable checkpoint in the cluster's shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each lengthened until no column has it in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_crc_mod(doc_id: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo `modulus`."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def text_bytes(df: DataFrame, text_col: str) -> tuple[int, int]:
    """Rows and bytes of text, from one scan; sizes the blocks of a job."""
    row = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long"))).first()
    return int(row[0]), int(row[1] or 0)
