"""Hashed linear models fitted by full-batch gradient steps over a distributed sample."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: loss(scores, labels, extra) -> (loss sum, d loss / d score, d loss sum / d extra)
Loss = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[float, np.ndarray, np.ndarray]]


def bounded_sample(rows: DataFrame, label: str, id_col: str, most: int) -> DataFrame:
    """At most `most` rows in all classes together, each class in its own share, picked by a hash of the id.

    The share is a threshold on the hash, so the choice needs no sort; the number is
    `most` up to the chance of hashing, and all rows where there are fewer.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if sum(counts.values()) <= most:
        return rows
    each = most / max(1, len(counts))
    unit = F.pmod(F.xxhash64(id_col, F.lit(11)), F.lit(1_000_003)) / 1_000_003
    spare = sum(max(0.0, each - n) for n in counts.values())
    large = [k for k, n in counts.items() if n > each]
    keep = F.lit(False)
    for k, n in counts.items():
        keep = keep | ((F.col(label) == k) & (unit < min(1.0, (each + spare / max(1, len(large))) / n)))
    return rows.where(keep)


def sparse_dot(index: np.ndarray, bounds: np.ndarray, weights: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
    """Sum of weights (times values) over each row's indices."""
    picked = weights[index] if values is None else weights[index] * values
    total = np.concatenate(([0.0], np.cumsum(picked, dtype=np.float64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def fit(sample: DataFrame, size: int, extra: np.ndarray, loss: Loss, *, steps: int = 40, rate: float = 0.1, l2: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and extra parameters (intercepts, thresholds) that minimise the mean loss.

    `sample`: (y double, index array<int>, value array<float>) in few partitions. A step
    sends each task the parameters, of fixed size, and gets back one gradient a
    task; the driver takes an Adam step on their sum.
    """
    spark = sample.sparkSession
    w = np.zeros(size + len(extra))
    w[size:] = extra
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        sent = spark.sparkContext.broadcast(w)

        def gradient(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            now, out, n = sent.value, np.zeros(size + len(extra)), 0
            for batch in batches:
                y = batch.column(0).to_numpy(zero_copy_only=False)
                at = np.asarray(batch.column(1).offsets) - batch.column(1).offsets[0].as_py()
                index, value = np.asarray(batch.column(1).flatten()), np.asarray(batch.column(2).flatten())
                _, slope, more = loss(sparse_dot(index, at, now[:size], value), y, now[size:])
                out[:size] += np.bincount(index, weights=np.repeat(slope, np.diff(at)) * value, minlength=size)
                out[size:] += more
                n += len(y)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([out.astype(np.float32).tobytes()], pa.binary())], ["n", "g"])

        parts = sample.mapInArrow(gradient, "n long, g binary").collect()
        sent.destroy()
        if not parts:
            break
        g = sum(np.frombuffer(r["g"], dtype=np.float32).astype(np.float64) for r in parts) / sum(r["n"] for r in parts)
        g[:size] += l2 * w[:size]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w[:size], w[size:]
