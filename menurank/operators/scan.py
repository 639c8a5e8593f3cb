"""Running values over groups of any size."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Named = dict[str, Column]


def cut(rows: DataFrame) -> DataFrame:
    """`rows` checkpointed in the session's shared folder, so that what reads them twice does not compute them twice."""
    context = rows.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return rows.checkpoint()


def dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` by `keys` in as many tasks as the session shuffles to, for steps that take long for each row.

    Few bytes can be much work: left alone, a small file is one task, and small shuffles are drawn together to a few.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def running(
    rows: DataFrame, groups: list[str], order: list[str | Column], block: list[Column] | None = None, *, sums: Named | None = None, lasts: Named | None = None, befores: Named | None = None, nexts: Named | None = None, totals: Named | None = None
) -> DataFrame:
    """Add values that depend on a row's place in its group; `order` must leave no ties.

    sums: the sum up to and with the row. lasts: the last value that isn't null up to and with
    the row. befores, nexts: the value of the row before, or after; null at the ends. totals:
    the sum over the group. Sums count nulls as 0.

    Without `block` these are windows over whole groups. With it (columns that rise with
    the order, so that a group is a sequence of blocks) no task takes more than a block:
    each block's rows are run through apart, their ends are gathered into one row per
    block, those rows are run through per group, and what a block inherits is joined
    to its rows. The rows are checkpointed once for that, so that scans on scans do not run the first
    ones over and over. Null keys form a group in both forms.
    """
    sums, lasts, befores, nexts, totals = sums or {}, lasts or {}, befores or {}, nexts or {}, totals or {}
    asked = [*sums, *lasts, *befores, *nexts, *totals]
    values = {f"__{n}": F.coalesce(c.cast("long"), F.lit(0)) for n, c in (sums | totals).items()} | {f"__{n}": c for n, c in (lasts | befores | nexts).items()}
    inputs = [c for c in rows.columns if c not in asked]
    blocks = [f"__block{i}" for i in range(len(block or []))]
    rows = rows.withColumns(values | dict(zip(blocks, block or [], strict=True)))
    keys = [*groups, *blocks]
    here, sofar = W.partitionBy(*keys).orderBy(*order), W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = (
        {n: F.sum(f"__{n}").over(sofar) for n in sums}
        | {n: F.last(f"__{n}", ignorenulls=True).over(sofar) for n in lasts}
        | {n: F.lag(f"__{n}").over(here) for n in befores}
        | {n: F.lead(f"__{n}").over(here) for n in nexts}
        | {n: F.sum(f"__{n}").over(W.partitionBy(*keys)) for n in totals}
    )
    if not block:
        return rows.withColumns(local).select(*inputs, *asked)

    rows = cut(rows.withColumns(local | {"__first": F.lag(F.lit(1)).over(here).isNull(), "__final": F.lead(F.lit(1)).over(here).isNull()}))
    at = lambda mark, c: F.first(F.when(F.col(mark), F.col(c)), ignorenulls=True)
    ends = rows.where("__first OR __final").groupBy(*keys).agg(
        F.lit(1).alias("__one"), *[at("__final", n).alias(n) for n in [*sums, *lasts, *totals]], *[at("__final", f"__{n}").alias(n) for n in befores], *[at("__first", f"__{n}").alias(n) for n in nexts]
    )
    line = W.partitionBy(*groups).orderBy(*blocks)
    earlier = line.rowsBetween(W.unboundedPreceding, -1)
    inherited = (
        {n: F.sum(n).over(earlier) for n in sums}
        | {n: F.last(n, ignorenulls=True).over(earlier) for n in lasts}
        | {n: F.lag(n).over(line) for n in befores}
        | {n: F.lead(n).over(line) for n in nexts}
        | {n: F.sum(n).over(W.partitionBy(*groups)) for n in totals}
    )
    carry = ends.select(*[F.col(k).alias(f"__k{k}") for k in keys], *[c.alias(f"__c{n}") for n, c in inherited.items()])
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(carry[f"__k{k}"]) for k in keys])
    joined = rows.join(carry, same, "left")
    whole = (
        {n: F.col(n) + F.coalesce(f"__c{n}", F.lit(0)) for n in sums}
        | {n: F.coalesce(n, f"__c{n}") for n in lasts}
        | {n: F.when(F.col("__first"), F.col(f"__c{n}")).otherwise(F.col(n)) for n in befores}
        | {n: F.when(F.col("__final"), F.col(f"__c{n}")).otherwise(F.col(n)) for n in nexts}
        | {n: F.col(f"__c{n}") for n in totals}
    )
    return joined.select(*inputs, *[c.alias(n) for n, c in whole.items()])
