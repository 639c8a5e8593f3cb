"""Quality: ordinal cumulative-link regression on graded ratings over hashed text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text
from .jobs import durable
from .linear import bounded_sample, fit, sparse_dot

BITS = 17
KINDS = np.arange(256, dtype=np.uint8)
KINDS[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 0x100)]] = ord("a")
KINDS[[*range(ord("0"), ord("9") + 1)]] = ord("0")


def quality_features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, bounds, value) per text: hashed words, shapes and repetitions, of Euclidean length 1 per kind.

    Shapes are 4-grams of bytes by kind (letter, digit, or the sign itself); a repetition
    is a word equal to one of the three before it. Values are square roots of counts, so
    that a long text isn't one count.
    """
    n = len(offsets) - 1
    words = text.split(data, offsets)
    owner = np.repeat(np.arange(n, dtype=np.int64), words.counts)
    parts = [(owner, (words.hashes >> np.uint64(64 - bits)).astype(np.int64), 0)]
    for lag in (1, 2, 3):
        if len(owner) > lag:
            again = (words.hashes[lag:] == words.hashes[:-lag]) & (owner[lag:] == owner[:-lag])
            parts.append((owner[lag:], np.where(again, 11 + lag, 1).astype(np.int64), 1))
    base = int(offsets[0])
    kinds = KINDS[data[base : int(offsets[-1])]].astype(np.uint32)
    at = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    if len(kinds) > 3:
        h = np.uint32(7)
        for i in range(4):
            h = (h ^ kinds[i : len(kinds) - 3 + i]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        same = at[:-3] == at[3:]
        parts.append((at[:-3][same], (h[same] >> np.uint32(32 - bits)).astype(np.int64), 2))
    keys, values = [], []
    for owners, index, _ in parts:
        found, counts = np.unique((owners << bits) | index, return_counts=True)
        value = np.sqrt(counts.astype(np.float64))
        norm = np.sqrt(np.bincount(found >> bits, weights=value * value, minlength=n))
        keys.append(found)
        values.append(value / norm[found >> bits])
    keys, values = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    return (keys & ((1 << bits) - 1)).astype(np.int32), np.searchsorted(keys, np.arange(n + 1, dtype=np.int64) << bits), values.astype(np.float32)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def thresholds(free: np.ndarray) -> np.ndarray:
    """Increasing thresholds from free parameters: the first, then logs of the gaps."""
    return np.cumsum(np.concatenate((free[:1], np.exp(np.clip(free[1:], -8, 5)))))


def cumulative_link(scores: np.ndarray, y: np.ndarray, free: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log likelihood of grades under P(grade <= k) = sigmoid(theta_k - score), and its slopes."""
    theta, y = thresholds(free), y.astype(np.int64)
    edges = np.concatenate(([-np.inf], theta, [np.inf]))
    upper = np.where(y < len(theta), sigmoid(edges[y + 1] - scores), 1.0)
    lower = np.where(y > 0, sigmoid(edges[y] - scores), 0.0)
    p = np.maximum(upper - lower, 1e-9)
    du, dl = upper * (1 - upper), lower * (1 - lower)
    slope = (du - dl) / p
    by_theta = np.bincount(np.minimum(y, len(theta) - 1), weights=np.where(y < len(theta), -du / p, 0), minlength=len(theta)) + np.bincount(np.maximum(y - 1, 0), weights=np.where(y > 0, dl / p, 0), minlength=len(theta))
    later = np.cumsum(by_theta[::-1])[::-1]
    more = later.copy()
    more[1:] *= np.exp(np.clip(free[1:], -8, 5))
    return float(-np.log(p).sum()), slope, more


def grade_column(quality: Column, toxic: Column) -> Column:
    """Grades from two ratings: 0 poor, 1 good but toxic, 2 good and clean; null without a quality rating."""
    return F.when(quality == 0, 0).when(quality > 0, F.when(F.coalesce(toxic, F.lit(0)) > 0, 1).otherwise(2))


def train(docs: DataFrame, graded: DataFrame, grades: int, id_col: str = "doc_id", text_col: str = "text", *, most_rows: int = 24_000, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) from at most about `most_rows` rows of `graded` (id, grade), picked per grade by a hash of the id.

    An id counts once, however many rows or ratings share it: with its greatest grade and
    text. All grades share the weights; with no rows they are 0 and the thresholds even.
    """
    gold = graded.where(F.col("grade").isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col("grade").cast("double").alias("y"))
    gold = bounded_sample(gold.groupBy("id").agg(F.max("y").alias("y")), "y", "id", most_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).join(F.broadcast(gold), "id")
    rows = rows.groupBy("id").agg(F.first("y").alias("y"), F.max("t").alias("t")).select("y", "t").repartition(12)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text.raw(batch.column(1))
            for begin, end in text.slices(offsets):
                index, bounds, value = quality_features(data, offsets[begin : end + 1])
                bounds = pa.array(bounds.astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.ListArray.from_arrays(bounds, pa.array(index)), pa.ListArray.from_arrays(bounds, pa.array(value))], ["y", "index", "value"])

    sample = durable(rows.mapInArrow(features, "y double, index array<int>, value array<float>"))
    counts = {int(r[0]): r[1] for r in sample.groupBy("y").count().collect()}
    below = np.cumsum([counts.get(k, 0) + 0.5 for k in range(grades)])
    share = below[:-1] / below[-1]
    theta = np.log(share / (1 - share))
    free = np.concatenate((theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))))
    if sum(v > 0 for v in counts.values()) < 2:
        return np.zeros(1 << BITS, dtype=np.float32), theta
    weights, free = fit(sample, 1 << BITS, free, cumulative_link, steps=steps, rate=0.15, l2=1e-5)
    return weights.astype(np.float32), thresholds(free)


def grade(docs: DataFrame, graded: DataFrame, grades: int = 3, id_col: str = "doc_id", text_col: str = "text", *, held_out: Column | None = None, at_least: int = 1, tail: float = 0.5, most_rows: int = 24_000) -> DataFrame:
    """Expected grade and tail probability of every text, from ratings of some.

    Returns id, held_out, expected_grade, tail_probability (of grade >= at_least), predicted
    (most probable grade) and keep (tail_probability >= tail), a row per row of `docs`.

    `graded` has id and grade (0 .. grades-1); rows for which `held_out`, a condition on the
    id, is true aren't learned from. Null texts count as empty, and an empty text gets the
    grade that the thresholds alone give. Null grades and unknown ids are ignored; repeated rows are rows of
    their own, and an id is learned from once. Other columns are ignored. An
    empty table gives an empty result.
    """
    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    weights, theta = train(docs, graded.where(~held), grades, id_col, text_col, most_rows=most_rows)
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            data, offsets = text.raw(batch.column(2))
            z = np.zeros(batch.num_rows)
            for begin, end in text.slices(offsets):
                index, bounds, value = quality_features(data, offsets[begin : end + 1])
                z[begin:end] = sparse_dot(index, bounds, w, value)
            below = np.concatenate((np.zeros((len(z), 1)), sigmoid(theta[None, :] - z[:, None]), np.ones((len(z), 1))), axis=1)
            p = np.diff(below, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p @ np.arange(grades)), pa.array(1 - below[:, at_least]), pa.array(p.argmax(axis=1).astype(np.int32))], [id_col, "held_out", "expected_grade", "tail_probability", "predicted"])

    rows = docs.select(F.col(id_col), held.alias("held_out"), F.col(text_col).cast("string").alias("t"))
    schema = rows.schema.fields[0].simpleString().replace(":", " ") + ", held_out boolean, expected_grade double, tail_probability double, predicted int"
    return rows.mapInArrow(run, schema).withColumn("keep", F.col("tail_probability") >= tail)
