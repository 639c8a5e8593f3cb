"""Whitening of embeddings: leading eigenvectors of their covariance by Chebyshev-filtered subspace iteration."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import durable

SEED = 20250311
BLOCK_ROWS = 1 << 15
#: Eigenvalues under this part of the largest count as zero.
RANK = 1e-11
#: Natural logarithm of how much a filter may raise one direction over another.
GROWTH = 23.0


class Whitener(NamedTuple):
    """n vectors of the fit list, sums of their entries, falling eigenvalues, unit eigenvectors (columns), trace, largest error of the identity."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float
    passes: int


def whole_entries(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x) of the rows whose vector has no null and only finite entries: x = floor(64 c) + 1000000 as longs."""
    c = F.col(vector_col).cast("array<double>")
    fine = c.isNotNull() & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e * 64) < 2.0**62))
    rows = vectors.where(F.coalesce(fine, F.lit(False)))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(c, lambda e: F.floor(e * 64).cast("long") + 1_000_000).alias("x"))


def packed(fit: DataFrame, dim: int) -> DataFrame:
    """Blocks of vectors of one length: (x binary), longs row by row, so that a pass is one matrix product a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(0).flatten(), dtype=np.int64)
            step = max(1, BLOCK_ROWS * 64 // dim) * dim
            parts = [x[i : i + step].tobytes() for i in range(0, len(x), step)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], ["x"])

    return fit.mapInArrow(run, "x binary")


def summed(blocks: DataFrame, part: Callable[[np.ndarray], np.ndarray], dim: int, width: int, kind: str = "double") -> np.ndarray:
    """The sum over all blocks of part(x), a matrix of `dim` rows: each task adds up its blocks, rows are summed by number, and the driver gets `dim` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for block in batch.column(0):
                own = part(np.frombuffer(block.as_buffer(), dtype=np.int64).reshape(-1, dim))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(list(total))], ["i", "v"])

    rows = blocks.mapInArrow(run, f"i int, v array<{kind}>").groupBy("i").agg(F.array(*[F.sum(F.col("v")[j]) for j in range(width)]).alias("v")).collect()
    out = np.zeros((dim, width), dtype=np.int64 if kind == "long" else np.float64)
    for r in rows:
        out[r["i"]] = r["v"]
    return out


def centred(x: np.ndarray, whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """x - S/n: the whole part of the mean is taken off in longs, so nothing of x is rounded away."""
    return (x - whole).astype(np.float64) - rest


def lanczos(apply: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int, enough: float | None = None) -> tuple[float, float]:
    """(lower, upper): the extreme Ritz values of at most `steps` passes over one vector, each moved outwards by its residual.

    With `enough` it stops, from the sixth pass on, as soon as the upper one is under that.
    """
    basis, a, b = [start / np.linalg.norm(start)], [], []
    while True:
        w = apply(basis[-1][:, None])[:, 0]
        a.append(float(basis[-1] @ w))
        for _ in range(2):
            w = w - np.array(basis).T @ (np.array(basis) @ w)
        b.append(float(np.linalg.norm(w)))
        if b[-1] <= 1e-12 * max(map(abs, a)):
            b[-1] = 0.0
        t, s = np.linalg.eigh(np.diag(a) + np.diag(b[:-1], 1) + np.diag(b[:-1], -1))
        lower, upper = t[0] - b[-1] * abs(s[-1, 0]), t[-1] + b[-1] * abs(s[-1, -1])
        if not b[-1] or len(basis) == steps or enough is not None and len(basis) >= 6 and upper <= enough:
            return float(lower), float(upper)
        basis.append(w / b[-1])


def leading(covariance: Callable[[np.ndarray], np.ndarray], dim: int, trace: float, count: int, *, guard: int, degree: int, most_rounds: int, tolerance: float = 1e-13) -> tuple[np.ndarray, np.ndarray, int]:
    """(values, vectors, passes): the `count` largest eigenpairs of the matrix that `covariance` multiplies with.

    Each round filters the block of `count` and `guard` vectors by a Chebyshev polynomial that stays within
    one on the unwanted part of the spectrum, from Lanczos' lower bound to the block's smallest Ritz value, and grows fast above it;
    one pass a degree, of which there are no more than keep the strongest direction from drowning the others. QR makes the block orthonormal, and a Rayleigh-Ritz step, whose pass also gives the residuals, turns it.
    It ends when every wanted residual is under `tolerance` times the largest value, and a Lanczos run over
    the rest of the space finds no value above the wanted ones; else what it has found joins the block.
    """
    rng, width, passes = np.random.default_rng(SEED), min(dim, count + guard), 0

    def apply(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return covariance(q)

    low = max(0.0, lanczos(apply, rng.standard_normal(dim), 10)[0]) if width < dim else 0.0
    q = np.linalg.qr(rng.standard_normal((dim, width)))[0]
    for _ in range(most_rounds):
        vq = apply(q)
        values, turn = np.linalg.eigh((h := q.T @ vq) / 2 + h.T / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        wanted = int(np.count_nonzero(values[:count] > RANK * max(values[0], 0.0)))
        residuals = np.linalg.norm(vq - q * values, axis=0)
        worst = float(residuals[:wanted].max(initial=0.0))
        if width == dim:
            return values[:wanted], q[:, :wanted], passes
        if worst <= tolerance * values[0]:
            start = rng.standard_normal(dim)
            start -= q @ (q.T @ start)
            rest = lambda v: (w := apply(v)) - q @ (q.T @ w)
            most = values[count - 1] + 1e-8 * values[0]
            if lanczos(rest, start, dim - width, most)[1] <= most:
                return values[:wanted], q[:, :wanted], passes
            q = np.linalg.qr(np.column_stack([q[:, :-1], start]))[0]
            continue
        held = int(np.argmax(residuals > tolerance * values[0]))  # leading vectors that are done stay, and the rest is filtered without them
        done, q = q[:, :held], q[:, held:]
        top = max(float(values[-1]), low, 1e-12 * float(values[0]))
        bottom = min(low, 0.9 * top)
        c, h = (top + bottom) / 2, (top - bottom) / 2
        far = max((values[held] - c) / h, 1 + 1e-12)
        steps = int(min(degree, max(1, GROWTH / math.acosh(far))))
        step = lambda x: ((w := apply(x)) - done @ (done.T @ w) - c * x) / h
        first = ratio = 1 / far  # scaled so that the strongest direction stays near one
        before, now = q, step(q) * first
        for _ in range(steps - 1):
            after = 1 / (2 / first - ratio)
            before, now = now, step(now) * (2 * after) - before * (ratio * after)
            ratio = after
        q = np.linalg.qr(np.column_stack([done, now]))[0]
    raise RuntimeError(f"residual {worst} after {most_rounds} rounds")


def fit_whitener(blocks: DataFrame, dim: int, count: int = 16, *, guard: int = 32, degree: int = 6, most_rounds: int = 40) -> Whitener:
    """The whitening of the vectors in `blocks`: all its matrices come from passes over them, the driver holds `dim` rows of the block at most."""
    totals = summed(blocks, lambda x: np.column_stack([x.sum(axis=0), np.full(dim, len(x))]), dim, 2, "long")
    n, sums = int(totals[0, 1]), totals[:, 0]
    whole, rest = sums // n, (sums % n) / n
    trace = float(summed(blocks, lambda x: np.square(centred(x, whole, rest)).sum(axis=0)[:, None], dim, 1).sum() / n)
    if trace == 0:
        return Whitener(n, sums, np.zeros(0), np.zeros((dim, 0)), 0.0, 0.0, 2)

    def covariance(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            y = centred(x, whole, rest)
            return y.T @ (y @ q)

        return summed(blocks, part, dim, q.shape[1]) / n

    values, vectors, passes = leading(covariance, dim, trace, min(count, dim), guard=guard, degree=degree, most_rounds=most_rounds)
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    scaled = vectors / np.sqrt(values)
    error = float(np.abs(scaled.T @ covariance(scaled) - np.eye(len(values))).max(initial=0.0))
    return Whitener(n, sums, values, vectors, trace, error, passes + 3)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum of (n x - S)^2 of each row, exact; None past the range of a long."""
    off = n * (x - sums // n) - sums % n if n * float(np.abs(x - sums // n).max(initial=0)) < 2.0**61 else None
    if off is not None and float(np.abs(off).max(initial=0)) ** 2 * x.shape[1] < 2.0**62:
        return np.square(off).sum(axis=1).tolist()
    exact = [sum((n * int(e) - int(s)) ** 2 for e, s in zip(row, sums, strict=True)) for row in x]
    return [e if e < 1 << 63 else None for e in exact]


OUT = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, count: int = 16, block_mb: int = 64) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each vector and each of its leading components.

    The fit list is every different vector of whole entries once; it is dealt into partitions of about `block_mb`
    and checkpointed in blocks, and each pass multiplies the centred blocks with a narrow matrix.
    Components are numbered by falling eigenvalue, each with its largest entry positive.

    Rows whose vector is null or holds null or non-finite entries (or entries too large for a long) are left out,
    rows of equal ids or vectors all stay, a null id stays null. Vectors of each length are whitened apart. Where vectors
    have fewer than `count` directions of variance (eigenvalue over 1e-11 of the largest), there are only these components,
    and none for one vector or equal ones, or of length 0. deviation is null past the range of a long. An empty table gives
    no rows; other columns are ignored.
    """
    rows = whole_entries(vectors, id_col, vector_col)
    fit = rows.select("x").distinct()
    sizes = sorted((r["d"], r["n"]) for r in fit.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).where("d > 0").collect())
    parts = []
    for dim, n in sizes:
        even = fit.where(F.size("x") == dim).repartition(max(8, math.ceil(n * dim * 8 / (block_mb << 20))))
        parts.append(whitened(rows.where(F.size("x") == dim), dim, fit_whitener(durable(packed(even, dim)), dim, count)))
    out = parts[0] if parts else rows.sparkSession.createDataFrame([], OUT)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumnRenamed("id", id_col)


def whitened(rows: DataFrame, dim: int, model: Whitener) -> DataFrame:
    """The rows of `whiten` for vectors of one length."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        k = len(m.values)
        whole, rest, scaled = m.sums // m.n, (m.sums % m.n) / m.n, m.vectors / np.sqrt(m.values)
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), dtype=np.int64).reshape(-1, dim)
            if not len(x) or not k:
                continue
            each = lambda v: np.repeat(v, k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each(np.arange(len(x))))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(k * len(x), m.n)),
                    pa.array(deviations(x, m.n, m.sums), pa.int64()).take(pa.array(each(np.arange(len(x))))), pa.array((centred(x, whole, rest) @ scaled).reshape(-1)),
                    pa.array(np.tile(m.values / m.trace if m.trace else m.values, len(x))), pa.array(np.full(k * len(x), m.identity_error)),
                ],
                [c.split()[0] for c in OUT.split(", ")],
            )

    return rows.mapInArrow(run, OUT)
