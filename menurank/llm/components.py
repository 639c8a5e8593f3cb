"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import durable


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that occurs in `links`; component is its smallest node.

    Each round hangs every neighbour of a node on the smallest node of the
    neighbourhood, first the larger ones, then the smaller; the number of rounds
    grows with the logarithm of the longest chain. Only grouped minima and
    equi-joins are used: no neighbourhood is gathered in one place, and the driver
    sees one row a round, whether each node hangs on a root. Self links and links with a
    null end are ignored; no links give no rows.
    """
    e = durable(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct())
    for _ in range(most_rounds):
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("root")))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up > 1 OR (up > 0 AND root > 0)").isEmpty():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = durable(small.where("u != v").distinct())
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
