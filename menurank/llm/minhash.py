"""Near-duplicate documents: min-max hashing, banding, exact confirmation, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text
from .components import components
from .jobs import durable

SEED = 20240611
#: Most rows and shingles, about, of a part of a family.
BLOCK_ROWS, BLOCK_SHINGLES = 256, 150_000


def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of `count` hash permutations of the 64-bit ring."""
    rng = np.random.default_rng(SEED)
    a = rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, count, dtype=np.uint64)


def min_max_signatures(grams: np.ndarray, bounds: np.ndarray, count: int) -> np.ndarray:
    """One row per set: `count` minima followed by `count` maxima.

    Each permutation is evaluated once and gives two values; both agree between
    two sets with probability equal to their Jaccard similarity. Rows of empty
    sets are 0.
    """
    rows = np.flatnonzero(np.diff(bounds) > 0)
    out = np.zeros((len(bounds) - 1, 2 * count), dtype=np.uint64)
    if len(rows):
        a, b = permutations(count)
        for k in range(count):
            h = grams * a[k] + b[k]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            out[rows, k] = np.minimum.reduceat(h, bounds[rows])
            out[rows, count + k] = np.maximum.reduceat(h, bounds[rows])
    return out


def band_keys(signatures: np.ndarray, count: int, rows: int) -> np.ndarray:
    """One hash per band of `rows` values; minima and maxima go to different bands."""
    bands = []
    for part in (signatures[:, :count], signatures[:, count:]):
        for k in range(0, count - rows + 1, rows):
            key = np.full(len(part), np.uint64(len(bands) + 1), dtype=np.uint64)
            for j in range(k, k + rows):
                key = text.mix(key * np.uint64(0xD6E8FEB86659FD93) + part[:, j])
            bands.append(key)
    return np.stack(bands, axis=1).view(np.int64)


def features(docs: DataFrame, id_col: str, text_col: str, shingle: int, count: int, rows: int) -> DataFrame:
    """(id, n, k1, k2, bands) per row: size of the shingle set, its fingerprint in 128 bits, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text.raw(batch.column(1))
            for begin, end in text.slices(offsets):
                grams, bounds = text.shingles(text.split(data, offsets[begin : end + 1]), shingle)
                owner = np.repeat(np.arange(end - begin), np.diff(bounds))
                order = np.lexsort((grams, owner))
                grams, owner = grams[order], owner[order]
                new = np.ones(len(grams), dtype=bool)
                new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
                grams, n = grams[new], np.bincount(owner[new], minlength=end - begin)
                bounds = np.concatenate(([0], np.cumsum(n)))
                prints = [np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(text.mix(grams ^ np.uint64(salt)), dtype=np.uint64))) for salt in (0x51ED270B, 0xA24BAED4963EE407)]
                prints = [(s[bounds[1:]] - s[bounds[:-1]]).view(np.int64) for s in prints]
                keys = band_keys(min_max_signatures(grams, bounds, count), count, rows)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(n.astype(np.int64)), pa.array(prints[0]), pa.array(prints[1]), bands], ["id", "n", "k1", "k2", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id long, n long, k1 long, k2 long, bands array<long>")


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those of `pairs` (a, b) whose full shingle sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            data_a, offsets_a = text.raw(batch.column(2))
            data_b, offsets_b = text.raw(batch.column(3))
            for begin, end in text.slices(offsets_a + offsets_b - offsets_b[0]):
                ga, ba = text.shingles(text.split(data_a, offsets_a[begin : end + 1]), shingle)
                gb, bb = text.shingles(text.split(data_b, offsets_b[begin : end + 1]), shingle)
                for i in range(end - begin):
                    x, y = np.unique(ga[ba[i] : ba[i + 1]]), np.unique(gb[bb[i] : bb[i + 1]])
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[begin + i] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    joined = pairs.join(texts.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b").join(texts.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a")
    return joined.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def link_families(members: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) between rows of different `comp` in the same `family`, by full comparison in blocks.

    `members`: (family, comp, node, n, t). A family's rows are dealt into parts of about
    BLOCK_ROWS rows and BLOCK_SHINGLES shingles, those of its largest component apart from the
    others; two parts of the largest aren't compared. Each row returns one link per component
    that it links with, not its pairs.
    """
    sizes = members.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    sizes = sizes.groupBy("family").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max(F.struct("c", "comp", "s")).alias("m"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    parts = lambda c, s: F.ceil(F.greatest(c / BLOCK_ROWS, s / BLOCK_SHINGLES, F.lit(1.0))).cast("int")
    sizes = sizes.select("family", "main", parts(F.col("m.c"), F.col("m.s")).alias("km"), parts(F.col("c") - F.col("m.c"), F.col("s") - F.col("m.s")).alias("ks"))
    t = members.join(sizes, "family")
    main = F.col("comp") == F.col("main")
    own = F.when(main, F.pmod(F.xxhash64("node"), F.col("km"))).otherwise(F.col("km") + F.pmod(F.xxhash64("node"), F.col("ks"))).cast("int")
    t = t.withColumn("part", own).withColumn("other", F.explode(F.sequence(F.when(main, F.col("km")).otherwise(F.lit(0)), F.col("km") + F.col("ks") - 1)))
    t = t.select("family", "comp", "node", "t", "part", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))

    def run(key: tuple, group: pa.Table) -> pa.Table:
        p, q = key[1].as_py(), key[2].as_py()
        node, comp, part = (group[c].to_numpy() for c in ("node", "comp", "part"))
        sets, at = [], [0]
        data, offsets = text.raw(group["t"])
        for begin, end in text.slices(offsets):
            grams, bounds = text.shingles(text.split(data, offsets[begin : end + 1]), shingle)
            sets += [np.unique(grams[bounds[i] : bounds[i + 1]]) for i in range(end - begin)]
        at = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        n = np.diff(at)
        there = np.flatnonzero(part == q)
        columns = np.concatenate([ids[at[j] : at[j + 1]] for j in there]) if len(there) else ids[:0]
        starts = np.concatenate(([0], np.cumsum(n[there])))
        has = np.zeros(len(ids), dtype=np.int32)
        a, b = [], []
        for i in np.flatnonzero(part == p):
            mine = ids[at[i] : at[i + 1]]
            has[mine] = 1
            both = np.concatenate(([0], np.cumsum(has[columns])))
            both = both[starts[1:]] - both[starts[:-1]]
            has[mine] = 0
            good = (100 * both >= percent * (n[i] + n[there] - both)) & (both > 0) & (comp[there] != comp[i])
            if good.any():
                linked = there[good]
                linked = linked[np.unique(comp[linked], return_index=True)[1]]
                a += [node[i]] * len(linked)
                b += node[linked].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return t.groupBy("family", "p", "q").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, percent: int = 80, permutations: int = 60, band_rows: int = 5) -> DataFrame:
    """Groups of documents whose word-shingle sets have a Jaccard similarity of at least percent/100.

    Returns a row for each row of `docs`: id, n_shingles, component_id (smallest id
    reachable over links, its own included) and kept (id = component_id).

    * Rows with equal sets collapse to one node first, so a group of copies of any
      size costs one grouped minimum.
    * Each node gets minima and maxima of `permutations` hash functions, banded by
      `band_rows`: 24 bands of 5 miss a pair at similarity 0.85 once in a million.
    * In a bucket, members are compared with its smallest node, confirmed on full sets,
      and confirmed links are contracted.
    * Nodes that buckets tie together are a family. Where a family still has several
      components, all that isn't in the largest is compared in full with all of the family, in
      blocks of bounded size; blocks return links, never pairs. So no link between
      components is lost, and within a component none is looked for.

    Empty, null and blank texts have n_shingles 0 and link with nothing. A null id
    makes its row a component of its own (component_id null, kept true). Rows that
    share an id are grouped each by its own text. Ids are whole numbers (or texts of such); others raise. An empty table gives an empty result;
    other columns are ignored.
    """
    feats = durable(features(docs, id_col, text_col, shingle, permutations, band_rows))
    real = feats.where("n > 0 AND id IS NOT NULL")
    nodes = real.groupBy("k1", "k2", "n").agg(F.min(F.struct("id", "bands")).alias("s"))
    nodes = durable(nodes.select("k1", "k2", "n", F.col("s.id").alias("node"), F.col("s.bands").alias("bands")))
    entries = nodes.select("node", F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("other")).where("leader != other").select("key", "leader")
    pairs = durable(entries.join(shared, "key").where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct())
    families = components(pairs)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    texts = durable(texts.join(families.select(F.col("node").alias("id")), "id", "left_semi").dropDuplicates())

    links = durable(confirm(pairs, texts, shingle, percent))
    groups = components(links)
    members = families.withColumnRenamed("component", "family").join(groups, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    several = members.groupBy("family").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("family")
    members = members.join(several, "family").join(nodes.groupBy("node").agg(F.max("n").alias("n")), "node").join(texts.withColumnRenamed("id", "node"), "node")
    more = durable(link_families(members, shingle, percent))
    if not more.isEmpty():
        groups = components(links.unionByName(more))

    named = nodes.select("k1", "k2", "n", "node")
    named = named.join(groups, "node", "left").select("k1", "k2", "n", F.coalesce("component", "node").alias("component_id"))
    linked = real.join(named, ["k1", "k2", "n"]).select("id", "n", "component_id")
    alone = feats.where("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
