"""Near-duplicate embeddings: rotated binary codes with correction factors, bounds, exact recomputation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .jobs import durable

SEED = 20240517
MEMBERS = 512


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def tables_for(rows: int, cosine: float, miss: float) -> tuple[int, int]:
    """(bits, tables) of the candidate buckets: 4 bits, or as many as make about 256 rows a bucket; at most `miss` pairs at `cosine` in none."""
    bits = min(30, max(4, math.ceil(math.log2(max(1, rows) / 256))))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - same)))


def estimate(codes: np.ndarray, corrections: np.ndarray, rotated: np.ndarray, slack: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased inner products of coded rows (unit vectors) with rotated unit vectors, and the half width of their bounds.

    A row's code is the signs of its rotation, so codes / sqrt(d) is a unit vector whose inner
    product with the row is the stored correction factor c. Then <code, q> / c has mean
    <row, q>, and its deviation is sqrt((1 - c^2) / (c^2 (d - 1))) at most. `slack` is what
    the rotated vectors may be off by, as they are stored in one byte a component.
    """
    d = codes.shape[1]
    c = np.maximum(corrections, 1e-6)[:, None]
    return codes @ rotated.T / (math.sqrt(d) * c), epsilon * np.sqrt((1 - c * c).clip(0) / (c * c * max(1, d - 1))) + slack[None, :] / c + 1e-5


CODED = "node long, code binary, factor double, query binary, step double, keys array<int>"


def encode(vectors: DataFrame, dims: list[int], bits: int, tables: int) -> DataFrame:
    """(node, code, factor, query, step, keys) of (node, v, d), once per vector.

    code and factor: signs of the rotated unit vector, packed, and the correction factor; query and
    step: the rotated vector in whole steps of one byte; keys: a bucket per table.
    """
    turns = {d: (rotation(d), np.concatenate([rotation(d, SEED + 1 + i) for i in range(-(-bits * tables // d))])[: bits * tables]) for d in dims}
    sent = vectors.sparkSession.sparkContext.broadcast(turns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_dims = batch.column(2).to_numpy()
            for d in np.unique(all_dims):
                turn, hands = sent.value[int(d)]
                own = batch.filter(pa.array(all_dims == d))
                x = np.asarray(own.column(1).flatten()).reshape(-1, d)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                turned = x @ turn.T
                step = np.abs(turned).max(axis=1) / 127
                binary = lambda rows: pa.array([r.tobytes() for r in rows], pa.binary())
                key = ((x @ hands.T > 0).reshape(len(x), tables, bits) << np.arange(bits)).sum(axis=2).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, key.size + 1, tables, dtype=np.int32)), pa.array(key.reshape(-1)))
                columns = [own.column(0), binary(np.packbits(turned > 0, axis=1)), pa.array(np.abs(turned).sum(axis=1) / math.sqrt(d)), binary(np.rint(turned / step[:, None]).astype(np.int8)), pa.array(step), keys]
                yield pa.RecordBatch.from_arrays(columns, ["node", "code", "factor", "query", "step", "keys"])

    return vectors.select("node", "v", "d").mapInArrow(run, CODED)


def undecided(group: pa.Table, key: tuple, cosine: float, epsilon: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows, from parts p and q, that share no earlier table and whose upper bound reaches `cosine`, in slices."""
    d, table, _, p, q = (x.as_py() for x in key)
    node, part, factor, step = (group[c].to_numpy() for c in ("node", "part", "factor", "step"))
    matrix = lambda c: np.frombuffer(b"".join(group[c].to_pylist()), dtype=np.uint8).reshape(len(node), -1)
    keys = np.asarray(group["keys"].combine_chunks().flatten()).reshape(len(node), -1)[:, :table]
    codes = np.unpackbits(matrix("code"), axis=1)[:, :d].astype(np.float32) * 2 - 1
    queries = matrix("query").view(np.int8).astype(np.float32) * step[:, None].astype(np.float32)
    a, b = np.flatnonzero(part == p), np.flatnonzero(part == q)
    for at in range(0, len(a), 64):
        own = a[at : at + 64]
        inner, width = estimate(codes[own], factor[own], queries[b], step[b] * math.sqrt(d) / 2, epsilon)
        i, j = np.nonzero(inner + width >= cosine)
        i, j = own[i], b[j]
        use = node[i] < node[j] if p == q else node[i] != node[j]
        i, j = i[use], j[use]
        first = (keys[i] != keys[j]).all(axis=1)
        yield i[first], j[first]


def near_embeddings(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, cosine: float = 0.9, miss: float = 1e-4, epsilon: float = 4.5) -> DataFrame:
    """(id, n_links, component_id, kept) for each row: how many others have a cosine of at least `cosine`.

    * Equal vectors collapse to one, with their number.
    * Each vector is rotated and coded once: signs, correction factor, and its components in
      one byte each. Candidates share a bucket of some table; a bucket is a run of signs of another
      rotation. The number of signs follows the logarithm of the rows, so that a bucket's
      size stays; the number of tables is such that a pair at the threshold is missed by all with
      probability `miss` at most, and closer pairs far less.
    * Only codes travel to the buckets. There, estimates with their bounds (`epsilon` deviations) reject
      the pairs whose upper bound is under the threshold. Vectors are then joined to the rows
      that have an undecided pair, and those pairs are recomputed in double precision; nothing else decides a link.
    * A bucket of many rows is dealt into parts of about 512, and pairs of parts are the
      groups; a pair that shares several tables counts in the first. Groups return rows or sums of
      links per row and a spanning forest, not pairs.

    Vectors that are null, empty, zero or hold null or non-finite components have no links and
    are components of their own; vectors of different length don't link. Rows with equal
    ids and vectors count as one: they don't link with each other, nor twice with others. A null id has component null and is
    kept. Ids are whole numbers (or texts of such). An empty table gives an empty result; other columns are ignored.
    """
    v = F.col(vector_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))
    bad = F.col("v").isNull() | (F.size("v") == 0) | F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | F.forall("v", lambda x: x == 0)
    rows = durable(rows.withColumn("ok", F.col("id").isNotNull() & ~F.coalesce(bad, F.lit(True))).withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64("v", F.lit(1))))
    same = rows.where("ok").groupBy("k1", "k2").agg(F.min("id").alias("node"), F.count_distinct("id").alias("copies"), F.first("v").alias("v"))
    same = durable(same.withColumn("d", F.size("v")))
    sizes = {r["d"]: r["n"] for r in same.groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()}
    bits, tables = tables_for(sum(sizes.values()), cosine, miss)

    coded = durable(encode(same, list(sizes), bits, tables).join(same.select("node", "d"), "node"))
    entries = coded.select("*", F.posexplode("keys").alias("table", "key"))
    members = entries.groupBy("d", "table", "key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    entries = entries.join(members, ["d", "table", "key"]).withColumn("parts", F.ceil(F.col("members") / MEMBERS).cast("int")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    entries = entries.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    entries = entries.withColumns({"p": F.least("part", "other"), "q": F.greatest("part", "other")}).drop("members", "parts", "other")
    place = ["d", "table", "key", "p", "q"]

    def pick(key: tuple, group: pa.Table) -> pa.Table:
        some = np.zeros(len(group), dtype=bool)
        for i, j in undecided(group, key, cosine, epsilon):
            some[i] = some[j] = True
        return group.filter(pa.array(some)).select([*place, "part", "node"])

    def link(key: tuple, group: pa.Table) -> pa.Table:
        node, copies = group["node"].to_numpy(), group["copies"].to_numpy()
        x = np.asarray(group["v"].combine_chunks().flatten()).reshape(len(node), -1)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        sums, root = np.zeros(len(node), dtype=np.int64), np.arange(len(node))
        touched = np.zeros(len(node), dtype=bool)
        for u, w in undecided(group, key, cosine, epsilon):
            exact = np.einsum("ij,ij->i", x[u], x[w]) >= cosine
            u, w = u[exact], w[exact]
            sums += np.bincount(u, weights=copies[w], minlength=len(node)).astype(np.int64) + np.bincount(w, weights=copies[u], minlength=len(node)).astype(np.int64)
            touched[u] = touched[w] = True
            while len(u):  # hang the larger root of each link on the smaller, and shorten the ways
                ru, rw = root[u], root[w]
                np.minimum.at(root, np.maximum(ru, rw), np.minimum(ru, rw))
                while (root != root[root]).any():
                    root = root[root]
                apart = root[u] != root[w]
                u, w = u[apart], w[apart]
        return pa.table({"node": node[touched], "links": sums[touched], "root": node[root[touched]]}, schema=pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())]))

    picked = entries.groupBy(*place).applyInArrow(pick, "d int, table int, key int, p int, q int, part int, node long")
    picked = picked.join(coded.drop("d"), "node").join(same.select("node", "copies", "v"), "node")
    found = durable(picked.groupBy(*place).applyInArrow(link, "node long, links long, root long"))
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = same.select("k1", "k2", "node", "copies").join(sums, "node", "left").join(groups, "node", "left")
    nodes = nodes.select("k1", "k2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    linked = rows.where("ok").join(nodes, ["k1", "k2"]).select("id", "n_links", "component_id")
    alone = rows.where("NOT ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
