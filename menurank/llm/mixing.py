"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .jobs import durable

WORD = r"[^\x20\x09-\x0D]+"
SALTS = 64


def targets(totals: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Add rank, weight and target to (skey, source, source_size), one row per source.

    Water filling: with sources ordered by what they can hold per weight, a source
    is full when the level that the others would reach is at least that much.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(x)) for x in weights])
    t = totals.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("fill", F.col("cap") / F.col("weight"))
    everything = W.partitionBy()
    before = W.orderBy("fill", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("budget", F.least(F.lit(float(share)) * F.sum("source_size").over(everything), F.sum("cap").over(everything)))
    t = t.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    t = t.withColumn("full", F.col("fill") <= F.col("level"))
    t = t.withColumn("common", F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(W.orderBy("fill", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return t.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * F.col("common"))).select("skey", "source_size", "target", "cap")


def balance(groups: DataFrame, goals: DataFrame, tilt: float, most: float, steps: int = 60, within: float = 1e-7) -> DataFrame:
    """(skey, lam): the dual solution of each source, by safeguarded Newton steps.

    The rates minimise sum(omega * (r * log(r) - r)) under sum(size * r) = target and
    r <= most, with omega = size^(1 - tilt): r = min(most, exp(lam * x)), where
    x = (size / mean)^tilt. A step is one aggregation over all (source, size)
    groups for all sources at once, with sums in exact decimals, so that reruns agree.
    lam is null where the target is the most that the source can give.
    """
    x = F.pow(F.col("size") / F.col("mean"), F.lit(float(tilt)))
    rate = F.least(F.lit(float(most)), F.exp(F.least(F.col("lam") * F.col("x"), F.lit(60.0))))
    state = goals.join(groups.groupBy("skey").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean")), "skey")
    state = state.where("target < cap AND source_size > 0").select("skey", "target", "mean", F.log(F.greatest(F.col("target"), F.lit(1e-9)) / F.col("source_size")).alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(False).alias("done"))
    state = durable(state)
    for _ in range(steps):
        at = groups.join(state.select("skey", "mean", "lam"), "skey").withColumn("x", x).withColumn("r", rate)
        words = F.col("n") * F.col("size") * F.col("r")
        sums = at.groupBy("skey").agg(
            F.sum(words.cast("decimal(34,8)")).cast("double").alias("got"),
            F.sum(F.when(F.col("r") < most, words * F.col("x")).otherwise(F.lit(0.0)).cast("decimal(34,8)")).cast("double").alias("slope"),
        )
        s = state.join(sums, "skey").withColumn("under", F.col("got") < F.col("target"))
        s = s.withColumn("lo", F.when(F.col("under"), F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("under"), F.col("hi")).otherwise(F.col("lam")))
        newton = F.col("lam") - F.when((F.col("slope") > 0) & (F.col("got") > 0), F.log(F.col("got") / F.col("target")) * F.col("got") / F.col("slope"))
        inside = (F.col("lo").isNull() | (newton > F.col("lo"))) & (F.col("hi").isNull() | (newton < F.col("hi")))
        halved = F.when(F.col("lo").isNull(), F.col("hi") - 2 * F.abs("hi") - 1).when(F.col("hi").isNull(), F.col("lo") + 2 * F.abs("lo") + 1).otherwise((F.col("lo") + F.col("hi")) / 2)
        close = (F.abs(F.col("got") - F.col("target")) <= within * F.col("target")) | F.coalesce(F.col("hi") - F.col("lo") < 1e-12, F.lit(False))
        s = s.withColumn("done", F.col("done") | close).withColumn("lam", F.when(F.col("done"), F.col("lam")).otherwise(F.when(F.coalesce(inside, F.lit(False)), newton).otherwise(halved)))
        state = durable(s.select("skey", "target", "mean", "lam", "lo", "hi", "done"))
        if state.where("NOT done").isEmpty():
            break
    else:
        raise RuntimeError(f"rates did not converge in {steps} steps")
    return state.select("skey", "mean", "lam")


def whole_copies(groups: pd.DataFrame) -> pd.DataFrame:
    """Round one source's rates to copies, from its longest sizes down, carrying what is over or short.

    The rows are the source's distinct sizes, not its documents.
    """
    groups = groups.sort_values("size", ascending=False)
    carry, out = 0.0, []
    for size, n, rate, most in zip(groups["size"], groups["n"], groups["rate"], groups["most"], strict=True):
        want = n * rate * size + carry
        copies = min(max(math.floor(want / size + 0.5), 0), int(most) * n)
        carry = want - copies * size
        out.append(copies)
    return pd.DataFrame({"skey": groups["skey"], "size": groups["size"], "n": groups["n"], "copies": out})


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, tilt: float = 0.5) -> DataFrame:
    """How many words of each document a mix of the sources takes.

    Returns a row per row of `docs`: id, source, size (words), source_size, target (words
    the mix wants of the source), copies and taken (copies * size). Sources in code
    point order, null last, have `weights` in turn and share `share` times all words;
    a source gives at most `most` times its words, the excess goes to the others.

    Within a source the rates are tilted exponentially in size^tilt (0: even rates,
    1: plain entropy balancing by tokens), at most `most`, so that the words meet the
    target. Rates become copies per (source, size), from the longest down with the
    remainder carried on, so that a source misses its target by a few words only; in a
    group of equal sizes the additional copies go to ids in the order of their hash.

    Null, empty and blank texts have size 0 and are never taken. Null is a source of
    its own. Repeated rows are rows of their own. An empty table gives an empty result;
    other columns are ignored.
    """
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    d = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"))
    d = durable(d.withColumn("skey", F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source")))))
    goals = durable(targets(d.groupBy("skey", "source").agg(F.sum("size").alias("source_size")), weights, share, most))
    groups = durable(d.where("size > 0").groupBy("skey", "size").agg(F.count(F.lit(1)).alias("n")))
    solved = balance(groups, goals, tilt, most)
    x = F.pow(F.col("size") / F.col("mean"), F.lit(float(tilt)))
    rates = groups.join(solved, "skey", "left").join(goals.select("skey", "target"), "skey")
    rate = F.when(F.col("target") <= 0, F.lit(0.0)).when(F.col("lam").isNull(), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.exp(F.least(F.col("lam") * x, F.lit(60.0)))))
    rates = rates.select("skey", "size", "n", rate.alias("rate"), F.lit(most).alias("most"))
    copies = rates.groupBy("skey").applyInPandas(whole_copies, "skey string, size long, n long, copies long")

    salt = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(SALTS))
    d = d.withColumn("salt", salt)
    parts = d.where("size > 0").groupBy("skey", "size", "salt").agg(F.count(F.lit(1)).alias("m")).join(copies, ["skey", "size"])
    before = F.coalesce(F.sum("m").over(W.partitionBy("skey", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("skey", "size", "salt", F.floor(F.col("copies") / F.col("n")).alias("base"), (F.col("copies") % F.col("n") - before).alias("more"))
    place = F.row_number().over(W.partitionBy("skey", "size", "salt").orderBy(F.xxhash64("id"), "id"))
    out = d.withColumn("place", place).join(parts, ["skey", "size", "salt"], "left").join(goals.select("skey", "source_size", "target"), "skey")
    out = out.withColumn("copies", F.coalesce(F.col("base") + F.when(F.col("place") <= F.col("more"), 1).otherwise(0), F.lit(0)).cast("long"))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
