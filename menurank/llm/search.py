"""Ranked lexical search: a document-partitioned index, term-pair lists with joint maxima, and MaxScore over pairs.

Three tables, each made once and written in the shared folder:

* the index has a row per block of documents: its terms, and for each the documents that hold it with their counts;
* the impact index keeps, for a block of items, what their terms add to each document, the
  largest such value of each term, and for pairs of terms the list of documents that hold both, with the
  largest joint value;
* the hits, at most k for each item and task.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .jobs import shared_folder
from .text import raw, slices, split

#: What ends a term: ASCII but letters and digits.
BREAKS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
SEEDS = 256

INDEX = "docs binary, sizes binary, terms binary, lengths binary, posts binary, counts binary, n_docs long, n_terms long"
IMPACTS = "docs binary, terms binary, lengths binary, posts binary, values binary, tops binary, pairs binary, pair_lengths binary, pair_posts binary, joint binary"


def narrow(a: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes each as the largest needs, which the first byte says."""
    most = int(a.max()) if len(a) else 0
    size = next(s for s in (1, 2, 4, 8) if most < 1 << 8 * s)
    return bytes([size]) + a.astype(f"<u{size}").tobytes()


def widen(b: bytes) -> np.ndarray:
    return np.frombuffer(b, dtype=f"<u{b[0]}", offset=1).astype(np.int64)


def starts_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths)))


def inverted(ids: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> tuple:
    """A row of the index from documents, their numbers of terms, and all terms in the documents' order."""
    order = np.argsort(hashes, kind="stable")
    term, doc = hashes[order], np.repeat(np.arange(len(sizes)), sizes)[order]
    fresh_term = np.concatenate(([True], term[1:] != term[:-1]))
    at = np.flatnonzero(fresh_term | np.concatenate(([True], doc[1:] != doc[:-1])))
    lengths = np.diff(np.append(np.flatnonzero(fresh_term[at]), len(at)))
    return ids, narrow(sizes), term[fresh_term].tobytes(), narrow(lengths), narrow(doc[at]), narrow(np.diff(np.append(at, len(term)))), len(sizes), len(term)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df`, written in the shared folder and read again: lineage ends there, and columns can be read apart."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def build_index(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, block_terms: int = 1 << 20) -> DataFrame:
    """One row per block of about `block_terms` terms: documents with a term, and each term's documents and counts. No shuffle.

    Terms are kept as 64-bit hashes. Whole texts are indexed; a longer one makes a larger block. Documents without a term
    are in no block; a null id stays null, rows of equal ids stay apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        sizes: list[np.ndarray] = []
        terms: list[np.ndarray] = []
        held = 0

        def block() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            kept = pa.RecordBatch.from_arrays([pa.concat_arrays(ids)], ["id"])
            with pa.ipc.new_stream(sink, kept.schema) as out:
                out.write_batch(kept)
            row = inverted(sink.getvalue().to_pybytes(), np.concatenate(sizes), np.concatenate(terms))
            ids.clear(), sizes.clear(), terms.clear()
            kinds = [pa.binary()] * 6 + [pa.int64()] * 2
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [c.split()[0] for c in INDEX.split(", ")])

        for batch in batches:
            data, offsets = raw(batch.column(1))
            for begin, end in slices(offsets):
                words = split(data, offsets[begin : end + 1], BREAKS)
                some = np.flatnonzero(words.counts)
                if not len(some):
                    continue
                ids.append(batch.column(0).take(pa.array(begin + some)))
                sizes.append(words.counts[some])
                terms.append(words.hashes)
                held += len(words.hashes)
                if held >= block_terms:
                    yield block()
                    held = 0
        if held:
            yield block()

    return stored(documents.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, INDEX), "index")


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, terms, n): each different item once, its terms in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw(batch.column(1))
            found = []
            for begin, end in slices(offsets):
                words = split(data, offsets[begin : end + 1], BREAKS)
                found += [np.sort(words.hashes[words.first[i] : words.first[i + 1]]) for i in range(end - begin)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in found], pa.binary()), pa.array([len(x) for x in found], pa.int64())], ["item_id", "terms", "n"])

    return items.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "item_id long, terms binary, n long").where("n > 0").distinct()


class Items(NamedTuple):
    """A bounded block of items: vocabulary, weights, pairs, and each item's units, which are pairs or single terms.

    Unit u has the terms a[u] and b[u] (-1: none), how often the item has them, and its pair; `first[i]:first[i + 1]` are item i's.
    """

    ids: list
    words: np.ndarray
    weights: np.ndarray
    pairs: np.ndarray
    first: np.ndarray
    a: np.ndarray
    b: np.ndarray
    times_a: np.ndarray
    times_b: np.ndarray
    pair: np.ndarray


def plan_items(ids: list, terms: list[np.ndarray], words: np.ndarray, weights: np.ndarray) -> Items:
    """Each item's terms by falling weight, paired with the next: rare ones meet rare ones, whose lists seldom share a document."""
    first, a, b, ta, tb = [0], [], [], [], []
    for own in terms:
        w, times = np.unique(own, return_counts=True)
        at = np.searchsorted(words, w)
        order = np.lexsort((at, -weights[at]))
        at, times = at[order].tolist(), times[order].tolist()
        for i in range(0, len(at), 2):
            two = i + 1 < len(at)
            a.append(at[i])
            b.append(at[i + 1] if two else -1)
            ta.append(times[i])
            tb.append(times[i + 1] if two else 0)
        first.append(len(a))
    a, b, ta, tb = (np.array(x, dtype=np.int64) for x in (a, b, ta, tb))
    low, high = np.minimum(a, b), np.maximum(a, b)
    key = np.where(b < 0, -1, low * len(words) + high)
    different = np.unique(key[key >= 0])
    pairs = np.stack([different // max(1, len(words)), different % max(1, len(words))], axis=1)
    return Items(ids, words, weights, pairs, np.array(first), a, b, ta, tb, np.where(key < 0, -1, np.searchsorted(different, key)))


def lookup(terms: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indexes of `words`, their places in the sorted `terms`) for those that occur."""
    if not len(terms):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.searchsorted(terms, words).clip(max=len(terms) - 1)
    found = np.flatnonzero(terms[at] == words)
    return found, at[found]


def gather(starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the lists `at`, one after the other, and their lengths)."""
    lengths = starts[at + 1] - starts[at]
    shift = np.repeat(starts[at] - starts_of(lengths)[:-1], lengths)
    return np.arange(len(shift)) + shift, lengths


def saturation(counts: np.ndarray, sizes: np.ndarray, all_docs: int, all_terms: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 12 m), m = 75 + (25 n N) div L; the products of N are taken in whole numbers of any size."""
    different, at = np.unique(sizes, return_inverse=True)
    m = np.array([75 + 25 * int(n) * all_docs // all_terms for n in different], dtype=np.int64)[at]
    return (1_000_000_000 * counts) // (1000 * counts + 12 * m)


def block_impacts(row: dict, items: Items, all_docs: int, all_terms: int) -> tuple | None:
    """A row of the impact index from a row of the index; None if no term of the items occurs."""
    found, at = lookup(np.frombuffer(row["terms"], dtype=np.uint64), items.words)
    if not len(found):
        return None
    take, lengths = gather(starts_of(widen(row["lengths"])), at)
    posts, counts, sizes = widen(row["posts"])[take], widen(row["counts"])[take], widen(row["sizes"])
    values = saturation(counts, sizes[posts], all_docs, all_terms) * np.repeat(items.weights[found], lengths)
    starts = starts_of(lengths)
    place = np.full(len(items.words), -1)
    place[found] = np.arange(len(found))
    held, pair_lists, joint = [], [], []
    seen = np.full(len(sizes), -1)
    near = place[items.pairs]
    near = np.column_stack([np.arange(len(near)), near])[(near >= 0).all(axis=1)]
    for p, x, y in near[np.argsort(near[:, 1], kind="stable")].tolist():
        own, other = slice(starts[x], starts[x + 1]), slice(starts[y], starts[y + 1])
        seen[posts[own]] = values[own]
        also = seen[posts[other]]
        both = np.flatnonzero(also >= 0)
        if len(both):
            held.append(p)
            pair_lists.append(posts[other][both])
            joint.append(int((also[both] + values[other][both]).max()))
        seen[posts[own]] = -1
    of = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.int64)
    return (
        row["docs"], narrow(found), narrow(lengths), narrow(posts), narrow(values), narrow(np.maximum.reduceat(values, starts[:-1])),
        narrow(np.array(held, dtype=np.int64)), narrow(np.array([len(x) for x in pair_lists], dtype=np.int64)), narrow(of(pair_lists)), narrow(np.array(joint, dtype=np.int64)),
    )


class Block:
    """A row of the impact index, opened."""

    def __init__(self, row: dict, items: Items) -> None:
        self.ids = pa.ipc.open_stream(row["docs"]).read_all()["id"].combine_chunks()
        terms, self.posts, self.values = widen(row["terms"]), widen(row["posts"]), widen(row["values"])
        starts = starts_of(widen(row["lengths"]))
        self.begin, self.end, self.top = (np.zeros(len(items.words) + 1, dtype=np.int64) for _ in range(3))  # the last, -1, is no term
        self.begin[terms], self.end[terms], self.top[terms] = starts[:-1], starts[1:], widen(row["tops"])
        pairs, starts = widen(row["pairs"]), starts_of(widen(row["pair_lengths"]))
        self.both = widen(row["pair_posts"])
        self.pair_begin, self.pair_end, self.joint = (np.zeros(len(items.pairs) + 1, dtype=np.int64) for _ in range(3))
        self.pair_begin[pairs], self.pair_end[pairs], self.joint[pairs] = starts[:-1], starts[1:], widen(row["joint"])
        self.size = len(self.ids)

    def docs(self, term: int) -> np.ndarray:
        return self.posts[self.begin[term] : self.end[term]]

    def worth(self, term: int, docs: np.ndarray) -> np.ndarray:
        """What the term adds to each of `docs`."""
        own = self.docs(term)
        if not len(own):
            return np.zeros(len(docs), dtype=np.int64)
        at = np.searchsorted(own, docs).clip(max=len(own) - 1)
        return np.where(own[at] == docs, self.values[self.begin[term] + at], 0)


def unit_bounds(block: Block, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What each unit adds at most to a document with its first term alone, its second alone, both, or any of these.

    Apart from the joint maximum, a document with both could have the sum of both maxima; where no document has both, the
    larger of them is all that the unit adds.
    """
    alone_a, alone_b = block.top[items.a] * items.times_a, block.top[items.b] * items.times_b
    both = np.minimum(block.joint[items.pair] * np.maximum(items.times_a, items.times_b), alone_a + alone_b)
    return alone_a, alone_b, both, np.maximum(np.maximum(alone_a, alone_b), both)


def hits(block: Block, items: Items, i: int, bounds: tuple, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents that can be among the item's first k, with their scores: all whose score is `least` or more, or of the k-th found.

    Units go by falling bound. A document whose first unit is u has at most what it takes of u and the
    bounds of all later units; so units from where the rest is under the threshold give no candidates,
    and of an earlier unit its terms' lists do, or only the list of its pair, as far as these sums reach the threshold.
    """
    order = items.first[i] + np.argsort(-bounds[3][items.first[i] : items.first[i + 1]], kind="stable")
    alone_a, alone_b, both, most = (x[order] for x in bounds)
    rest = np.append(np.cumsum(most[::-1])[::-1], 0)
    units = [(int(items.a[u]), int(items.b[u]), int(items.times_a[u]), int(items.times_b[u]), int(items.pair[u])) for u in order]

    def score(docs: np.ndarray, total: np.ndarray, since: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        for u in range(since, len(units)):
            if most[u] == 0:
                break
            keep = total + rest[u] >= floor
            if not keep.all():
                docs, total = docs[keep], total[keep]
            a, b, ta, tb, _ = units[u]
            total = total + block.worth(a, docs) * ta + (block.worth(b, docs) * tb if b >= 0 else 0)
        return docs, total

    # a first threshold from some documents that hold the strongest unit
    pair = units[0][4]
    some = block.both[block.pair_begin[pair] : block.pair_end[pair]] if pair >= 0 else block.both[:0]
    some = some if len(some) >= k else block.docs(units[0][0] if alone_a[0] >= alone_b[0] else units[0][1])
    if len(some) >= k:
        some = some[:SEEDS]
        _, total = score(some, np.zeros(len(some), dtype=np.int64), 0, 0)
        least = max(least, int(np.partition(total, len(total) - k)[len(total) - k]))

    essential = int(np.count_nonzero(rest[:-1] >= least))
    mark = np.zeros(block.size, dtype=bool)
    total = np.zeros(block.size, dtype=np.int64)
    for u in range(essential):
        a, b, ta, tb, pair = units[u]
        for term, times, alone in ((a, ta, alone_a[u]), (b, tb, alone_b[u])):
            if alone:
                docs = block.docs(term)
                total[docs] += block.values[block.begin[term] : block.end[term]] * times
                if alone + rest[u + 1] >= least:
                    mark[docs] = True
        if pair >= 0 and both[u] and both[u] + rest[u + 1] >= least:
            mark[block.both[block.pair_begin[pair] : block.pair_end[pair]]] = True
    docs = np.flatnonzero(mark)
    docs, total = score(docs, total[docs], essential, least)
    keep = total >= least
    return docs[keep], total[keep]


class Best:
    """The k best documents of an item so far: highest score first, then smallest id, nulls last."""

    def __init__(self, k: int) -> None:
        self.k, self.found, self.least = k, [], 1

    def add(self, ids: pa.Array, docs: np.ndarray, total: np.ndarray) -> None:
        if len(docs) > self.k:  # all of the k-th score stay, for their ids
            keep = total >= np.partition(total, len(total) - self.k)[len(total) - self.k]
            docs, total = docs[keep], total[keep]
        some = ids.take(pa.array(docs)).to_pylist()
        self.found = sorted([*self.found, *((-int(t), d is None, d or 0) for d, t in zip(some, total, strict=True))])[: self.k]
        if len(self.found) == self.k:
            self.least = -self.found[-1][0]


def search_block(row: dict, items: Items, best: list[Best], k: int) -> None:
    block = Block(row, items)
    bounds = unit_bounds(block, items)
    most = np.add.reduceat(bounds[3], items.first[:-1])
    for i in np.flatnonzero(most >= np.array([b.least for b in best])).tolist():
        docs, total = hits(block, items, i, bounds, best[i].least, k)
        if len(docs):
            best[i].add(block.ids, docs, total)


def search(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", *, k: int = 20, block_items: int = 4096, block_words: int = 1 << 18) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the k documents of highest score above 0, of equal scores those of smallest id.

    Items come in blocks of about `block_items` or `block_words` terms, which is what tasks are sent;
    each block reads the index once for its terms' document counts and once for the impact index. A
    task walks its blocks of documents with one threshold per item, and leaves out an item's block, list or document
    whose bound stays under it. Bounds add up pairs of terms, by joint maxima.

    Items that are null, or have no term, and items of which no document has a term of weight above 0 give no rows; equal rows
    (id and terms) are one item, rows of one id with other terms are ranked apart, a null item id stays null.
    Documents without a term are never found; rows of equal document ids are ranked apart, a null id comes after others of its score.
    An empty index or no items give no rows; other columns are ignored.
    """
    spark = index.sparkSession
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    totals = index.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
    own = stored(item_terms(items, id_col, text_col), "items")
    count, words = own.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not totals["docs"] or not count:
        return out
    blocks = max(1, math.ceil(max(count / block_items, words / block_words)))
    for b in range(blocks):
        rows = own.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == b).select("item_id", "terms").collect()
        if rows:
            out = out.unionByName(search_items(index, [r["item_id"] for r in rows], [np.frombuffer(r["terms"], dtype=np.uint64) for r in rows], int(totals["docs"]), int(totals["terms"]), k))
    return out


def search_items(index: DataFrame, ids: list, terms: list[np.ndarray], all_docs: int, all_terms: int, k: int) -> DataFrame:
    """`search` for one block of items."""
    context = index.sparkSession.sparkContext
    words = np.unique(np.concatenate(terms))
    sent_words = context.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(sent_words.value), dtype=np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                w, at = lookup(np.frombuffer(row["terms"], dtype=np.uint64), sent_words.value)
                found[w] += widen(row["lengths"])[at]
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], ["w", "n"])

    held = np.zeros(len(words), dtype=np.int64)
    for r in index.select("terms", "lengths").mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).collect():
        held[r["w"]] = r["n"]
    weights = np.array([math.floor(1000 * math.log((2 * all_docs + 2) / (2 * n + 1))) for n in held.tolist()], dtype=np.int64)
    sent = context.broadcast(plan_items(ids, terms, words, weights))

    def impacts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if made := block_impacts(row, sent.value, all_docs, all_terms):
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in made], [c.split()[0] for c in IMPACTS.split(", ")])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in sent.value.ids]
        for batch in batches:
            for row in batch.to_pylist():
                search_block(row, sent.value, best, k)
        found = [(i, sent.value.ids[i], None if null else d, -t) for i, own in enumerate(best) for t, null, d in own.found]
        columns = list(zip(*found, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "item_id", "doc_id", "score"])

    ready = stored(index.drop("n_docs", "n_terms").mapInArrow(impacts, IMPACTS), "impacts")
    found = stored(ready.mapInArrow(find, "item long, item_id long, doc_id long, score long"), "hits")
    first = W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
