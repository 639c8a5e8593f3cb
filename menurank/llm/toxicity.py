"""Toxicity: logistic regression on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import text
from .jobs import durable, fresh
from .linear import Loss, bounded_sample, fit, sparse_dot

BITS = 19
GRAMS = (4, 6, 8)


def char_grams(data: np.ndarray, offsets: np.ndarray, bits: int = BITS, grams: tuple[int, ...] = GRAMS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of lower-cased bytes per text, and the bounds of the texts.

    White space of any kind is one byte value, and each text starts and ends with it.
    """
    n = len(offsets) - 1
    base = int(offsets[0])
    low = text.LOWER[data[base : int(offsets[-1])]]
    low = np.where(text.SPACE[low], np.uint8(32), low)
    lengths = np.diff(offsets)
    padded = np.full(len(low) + 2 * n, 32, dtype=np.uint8)
    owner = np.repeat(np.arange(n), lengths)
    padded[np.arange(len(low)) + 2 * owner + 1] = low
    owner = np.repeat(np.arange(n, dtype=np.int64), lengths + 2)
    keys = []
    for g in grams:
        size = len(padded) - g + 1
        if size <= 0:
            continue
        h = np.full(size, g, dtype=np.uint32)
        for i in range(g):
            h = (h ^ padded[i : i + size]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        inside = owner[:size] == owner[g - 1 :]
        keys.append((owner[:size][inside] << bits) | (h[inside] >> np.uint32(32 - bits)).astype(np.int64))
    keys = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
    keys.sort()
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    keys = keys[new]
    return (keys & ((1 << bits) - 1)).astype(np.int32), np.searchsorted(keys, np.arange(n + 1, dtype=np.int64) << bits)


def log_count_ratios(rows: DataFrame, bits: int = BITS, alpha: float = 1.0, informative: float = 3.0) -> np.ndarray:
    """log of the features' smoothed shares in toxic and in other texts of `rows` (y, t), counted in the tasks.

    A ratio of fewer than `informative` standard deviations is 0: chance, not a sign.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, (1 << bits) + 1))
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False) > 0.5
            data, offsets = text.raw(batch.column(1))
            for begin, end in text.slices(offsets):
                index, bounds = char_grams(data, offsets[begin : end + 1], bits)
                is_toxic = np.repeat(y[begin:end], np.diff(bounds))
                sums[1, :-1] += np.bincount(index[is_toxic], minlength=1 << bits)
                sums[0, :-1] += np.bincount(index[~is_toxic], minlength=1 << bits)
            sums[1, -1] += y.sum()
            sums[0, -1] += (~y).sum()
        yield pa.RecordBatch.from_arrays([pa.array([pa.compress(sums.astype(np.uint32).tobytes(), codec="zstd", asbytes=True)], pa.binary())], ["s"])

    size = 4 * 2 * ((1 << bits) + 1)
    parts = rows.select("y", "t").mapInArrow(count, "s binary").collect()
    sums = sum(np.frombuffer(pa.decompress(bytes(r[0]), decompressed_size=size, codec="zstd"), dtype=np.uint32).astype(np.float64) for r in parts)
    sums = sums.reshape(2, -1) if np.ndim(sums) else np.zeros((2, (1 << bits) + 1))
    p, q = sums[1, :-1] + alpha, sums[0, :-1] + alpha
    ratios = np.log(p / (sums[1, -1] + 2 * alpha)) - np.log(q / (sums[0, -1] + 2 * alpha))
    return np.where(np.abs(ratios) >= informative * np.sqrt(1 / p + 1 / q), ratios, 0.0).astype(np.float32)


def logistic(toxic_weight: float) -> Loss:
    """Logistic loss in which a toxic row counts `toxic_weight` times."""

    def loss(scores: np.ndarray, y: np.ndarray, extra: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        z = np.clip(scores + extra[0], -40, 40)
        times = np.where(y > 0, toxic_weight, 1.0)
        slope = times * (1 / (1 + np.exp(-z)) - y)
        return float(np.sum(times * (np.logaddexp(0, z) - y * z))), slope, np.array([np.sum(slope)])

    return loss


class Model(NamedTuple):
    """Weights by feature (already times the ratios), squares of the ratios, and the intercept."""

    weights: np.ndarray
    squares: np.ndarray
    intercept: float

    def logits(self, index: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """A text's ratios are a vector of length 1; a text without a known feature has the intercept."""
        size = np.sqrt(np.maximum(sparse_dot(index, bounds, self.squares), 0))
        return sparse_dot(index, bounds, self.weights) / np.where(size > 1e-6, size, 1.0) + self.intercept


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, most_rows: int = 24_000, informative: float = 3.0, balance: float = 0.5, steps: int = 40) -> Model:
    """The classifier from the labelled rows of `docs`.

    Fitted on at most about `most_rows` labels, picked per class by a hash of the id; so
    few ids that they are sent to the scan of `docs`, whose other texts aren't shuffled. An id
    counts once, however many rows or labels share it: with its greatest label and text.
    Features whose log-count ratio is within `informative` standard deviations of 0 are left
    out; the others have it as their value, scaled so that a text's values have the length 1. A toxic row counts as
    `balance` times as many as there are clean ones for each, and once at least. Without both classes the weights are 0 and the intercept is the
    log odds of what there is.
    """
    gold = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("double").alias("y"))
    gold = bounded_sample(gold.groupBy("id").agg(F.max("y").alias("y")), "y", "id", most_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).join(F.broadcast(gold), "id")
    rows = rows.groupBy("id").agg(F.first("y").alias("y"), F.max("t").alias("t"))
    rows = durable(rows.select("y", "t").repartition(12))
    seen = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    prior = float(np.log((seen.get(1.0, 0) + 0.5) / (seen.get(0.0, 0) + 0.5)))
    if len(seen) < 2:
        return Model(np.zeros(1 << BITS, dtype=np.float32), np.zeros(1 << BITS, dtype=np.float32), prior)
    ratios = log_count_ratios(rows, informative=informative)
    used = np.flatnonzero(ratios)
    place = np.zeros(1 << BITS, dtype=np.int32)
    place[used] = np.arange(len(used))
    sent = rows.sparkSession.sparkContext.broadcast((ratios, place))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, to = sent.value
        for batch in batches:
            data, offsets = text.raw(batch.column(1))
            for begin, end in text.slices(offsets):
                index, bounds = char_grams(data, offsets[begin : end + 1])
                use = r[index] != 0
                bounds = np.concatenate(([0], np.cumsum(use)))[bounds].astype(np.int32)
                index = index[use]
                size = np.sqrt(sparse_dot(index, bounds, r * r))
                value = r[index] / np.repeat(size, np.diff(bounds)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.ListArray.from_arrays(pa.array(bounds), pa.array(to[index])), pa.ListArray.from_arrays(pa.array(bounds), pa.array(value))], ["y", "index", "value"])

    sample = durable(rows.select("y", "t").mapInArrow(features, "y double, index array<int>, value array<float>"))
    sent.destroy()
    toxic_weight = max(1.0, balance * seen[0.0] / seen[1.0])
    weights, extra = fit(sample, len(used), np.array([prior]), logistic(toxic_weight), steps=steps, rate=0.1, l2=1e-4)
    out = np.zeros(1 << BITS, dtype=np.float32)
    out[used] = weights * ratios[used]
    return Model(out, ratios * ratios, float(extra[0]))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with the probability of being toxic; the model, of fixed size, is sent to the tasks.

    Every text is scored whole; null counts as empty. Rows, repeated ones too, and columns stay, a column
    named `score_col` is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(score_col)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text.raw(batch.column(batch.num_columns - 1))
            z = np.zeros(batch.num_rows)
            for begin, end in text.slices(offsets):
                index, bounds = char_grams(data, offsets[begin : end + 1])
                z[begin:end] = sent.value.logits(index, bounds)
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p)], [*columns, score_col])

    schema = StructType([*docs.schema.fields, StructField(score_col, DoubleType())])
    return docs.select("*", F.col(text_col).cast("string").alias(fresh(columns, "text_again")[0])).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, held_out: Column | None = None, most_rows: int = 24_000) -> DataFrame:
    """Score `docs` with a classifier trained on their labelled rows for which `held_out` is not true.

    Adds held_out, score (0 to 1) and predicted (score >= 0.5) to id and text columns.
    `held_out` is a condition on the id. Only the text enters a score. Labels that
    are null or of unknown ids are ignored; an id is learned from once;
    null texts count as empty; repeated rows are rows of their own. Without labels every score is the same. An empty table
    gives an empty result.
    """
    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    model = train(docs, labels.where(~held), id_col, text_col, label_col, most_rows=most_rows)
    out = score(docs.select(F.col(id_col), F.col(text_col), held.alias("held_out")), model, text_col)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
