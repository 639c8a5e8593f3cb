"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment on words."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import text
from .jobs import durable, fresh, text_bytes

FILTER_BITS = 20
MATCH, MISMATCH, GAP = 2, -1, -1


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word sequences, and the end of it in the passage."""
    best, at = 0, 0
    ramp = -GAP * np.arange(len(passage) + 1)
    row = np.zeros(len(passage) + 1, dtype=np.int64)
    for word in item:
        new = np.zeros_like(row)
        new[1:] = row[:-1] + np.where(passage == word, MATCH, MISMATCH)
        new = np.maximum(np.maximum(new, row + GAP), 0)
        row = np.maximum.accumulate(new + ramp) - ramp
        top = int(row.argmax())
        if row[top] > best:
            best, at = int(row[top]), top
    return best, at


class Block(NamedTuple):
    """A bounded part of the benchmark: word hashes per item, and its n-grams by length."""

    items: list
    words: list[np.ndarray]
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def block_of(rows: list, n: int) -> Block:
    """Of (id, text) rows: an item of fewer than n words has its whole sequence as its one n-gram; one without words has none."""
    found = text.split(*text.raw(pa.array([t for _, t in rows], pa.string()))) if rows else None
    words = [found.hashes[found.first[i] : found.first[i + 1]] for i in range(len(rows))] if found else []
    by_length: dict[int, list] = {}
    for i, w in enumerate(words):
        if len(w):
            g = text.chain(w, min(n, len(w)))
            by_length.setdefault(min(n, len(w)), []).append((g, np.full(len(g), i), np.arange(len(g))))
    return Block([i for i, _ in rows], words, {k: tuple(np.concatenate([x[j] for x in v]) for j in range(3)) for k, v in by_length.items()})


def bitmap(grams: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << FILTER_BITS, dtype=bool)
    out[(grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    return out


def hits(runs: np.ndarray, known: np.ndarray, few: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in `runs` of n-grams that are in sorted `known`, and which they are."""
    at = np.flatnonzero(few[(runs >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
    which = np.minimum(np.searchsorted(known, runs[at]), len(known) - 1)
    same = known[which] == runs[at]
    return at[same], which[same]


def seeds(block: Block) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Every n-gram of every item, in sorted order: an edited copy may share any of them, and no others."""
    out = {}
    for k, (grams, item, pos) in block.grams.items():
        order = np.argsort(grams, kind="stable")
        out[k] = (grams[order], item[order], pos[order])
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, n: int = 3, least: float = 0.6, block_bytes: int = 4_000_000) -> DataFrame:
    """(id, item, score, at): every text that holds a copy, possibly edited, of a benchmark item.

    * Seeds are all n-grams of words of an item, however common.
    * Where a text shares a seed, the passage around it (as long as the item, and half as
      much on both sides; passages that meet are one) is aligned with the item, unless it
      has so few of the item's words that no alignment could reach `least`; score is the alignment's score over
      that of the item with itself, and pairs from `least` on are returned; `at` is the
      number of words up to the end of the best alignment.

    The benchmark is sent to the scan of `docs` in blocks of about `block_bytes` of text, as
    many scans as that takes; texts are never shuffled and each is read whole. Items
    without words match nothing, items of fewer words than n match as a whole. Null
    and empty texts match nothing; a very long text is searched in one piece. Repeated items or rows match each for itself, and of the
    matches of one pair of ids the best, then the first, is returned; null ids of texts and items stay null. Where both ids have one name, the
    item's gets a _ at its end. An
    empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    (item_col,), item_source = fresh([id_col, "score", "at"], item_col), item_col
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).where("t IS NOT NULL")
    kind = rows.schema["id"].dataType.simpleString()
    items = benchmark.select(F.col(item_source).alias("id"), F.col(item_text_col).cast("string").alias("t")).where("t IS NOT NULL")
    item_type = items.schema["id"].dataType
    item_kind, item_arrow = item_type.simpleString(), to_arrow_type(item_type)
    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind}, score double, at long"
    blocks = max(1, -(-text_bytes(items, "t")[1] // block_bytes))
    out = None
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == b)
        block = block_of([(r["id"], r["t"]) for r in part.collect()], n)
        if not block.grams:
            continue
        sent = spark.sparkContext.broadcast((block, {k: (*v, np.unique(v[0]), bitmap(v[0])) for k, v in seeds(block).items()}))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            held, by_length = sent.value
            for batch in batches:
                data, offsets = text.raw(batch.column(1))
                doc, item, score, place = [], [], [], []
                for begin, end in text.slices(offsets):
                    words = text.split(data, offsets[begin : end + 1])
                    found = []
                    for k, (grams, of, pos, known, few) in by_length.items():
                        at, which = hits(text.chain(words.hashes, k), known, few)
                        owner = np.searchsorted(words.first[1:], at, side="right")
                        inside = at + k <= words.first[owner + 1]
                        at, which, owner = at[inside], which[inside], owner[inside]
                        lo, hi = np.searchsorted(grams, known[which], "left"), np.searchsorted(grams, known[which], "right")
                        times = hi - lo
                        seed = np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                        found.append(np.stack([np.repeat(owner, times), of[seed], np.repeat(at, times) - pos[seed]], axis=1))
                    found = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), dtype=np.int64)
                    if not len(found):
                        continue
                    length = np.array([len(w) for w in held.words])[found[:, 1]]
                    lo = np.maximum(found[:, 2] - length // 2 - 2, words.first[found[:, 0]])
                    hi = np.minimum(found[:, 2] + length + length // 2 + 2, words.first[found[:, 0] + 1])
                    # lo and hi rise with the place, so a passage ends where the next starts behind it
                    parts = np.flatnonzero(np.append(True, (found[1:, :2] != found[:-1, :2]).any(axis=1) | (lo[1:] > hi[:-1])))
                    for i, last in zip(parts, np.append(parts[1:], len(found)) - 1, strict=True):
                        own, passage = held.words[found[i, 1]], words.hashes[lo[i] : hi[last]]
                        need = least * MATCH * len(own)
                        if MATCH * np.isin(own, passage).sum() < need:
                            continue
                        got, where = align(own, passage)
                        if got >= need:
                            doc.append(begin + int(found[i, 0]))
                            item.append(int(found[i, 1]))
                            score.append(got / (MATCH * len(own)))
                            place.append(int(lo[i] - words.first[found[i, 0]] + where))
                if doc:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array([held.items[i] for i in item], item_arrow), pa.array(score), pa.array(place, pa.int64())], [id_col, item_col, "score", "at"])

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], schema)
    best = F.max(F.struct("score", (-F.col("at")).alias("back")))
    return out.groupBy(id_col, item_col).agg(best.alias("b")).select(id_col, item_col, F.col("b.score").alias("score"), (-F.col("b.back")).alias("at"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kind) -> DataFrame:
    """The rows of `docs` whose own text holds no benchmark item; rows of equal ids are judged each by its text, null texts stay."""
    (key,) = fresh(docs.columns, "row_key")
    keyed = docs.withColumn(key, F.xxhash64(id_col, text_col))
    found = durable(contaminated(keyed, benchmark, key, text_col, **kind).select(key).distinct())
    return keyed.join(found, key, "left_anti").select(*docs.columns)
