"""Language-model scores: a weighted backoff automaton over smoothed word n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text
from .jobs import text_bytes

#: The end of a text; it is also the state in which a text starts.
END = np.uint64(0x2545F4914F6CDD1D)
BLOCK_BYTES = 6_000_000
#: Tokens of a text that one walker takes; further walkers take the rest, from the state that the words before lead to.
PIECE = 512
#: Weight of the shorter context's probabilities, by the context's length; of a grid the best on held-out texts.
STRENGTHS = (300.0, 10.0)


def sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, bounds, place): END w1 .. wn END for each text; place counts from the text's first END."""
    data, offsets = text.raw(column)
    hashes, counts = [], []
    for begin, end in text.slices(offsets):
        words = text.split(data, offsets[begin : end + 1])
        hashes.append(words.hashes)
        counts.append(words.counts)
    counts = np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)
    bounds = np.concatenate(([0], np.cumsum(counts + 2)))
    symbols = np.full(bounds[-1], END, dtype=np.uint64)
    place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], counts + 2)
    inner = (place > 0) & (place <= np.repeat(counts, counts + 2))
    if inner.any():
        symbols[inner] = np.concatenate(hashes)
    return symbols, bounds, place


def gram_ends(symbols: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which an n-gram of k symbols ends (the first END only starts one), and the n-grams' hashes."""
    runs = text.chain(symbols, k)
    ends = np.arange(k - 1, len(symbols))
    inside = place[ends] >= max(1, k - 1)
    return ends[inside], runs[inside] if len(runs) else runs


def pack(x: np.ndarray) -> bytes:
    """The bytes of x by place, first bytes first: the empty high bytes of small numbers stand together and compress."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: pa.Buffer, kind: type) -> np.ndarray:
    size, n = np.dtype(kind).itemsize, int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=n * size, codec="zstd"), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).reshape(-1)


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(data: pa.Buffer) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def spread(hashes: np.ndarray, shards: int, bits: int) -> np.ndarray:
    """Bounds of the shards in sorted hashes of `bits` bits; shards are even ranges of the hash."""
    edges = [(i << bits) // shards for i in range(shards)]
    return np.append(np.searchsorted(hashes, np.array(edges, dtype=np.uint64)), len(hashes))


def vocabulary(docs: DataFrame, shards: int) -> tuple[int, int]:
    """(tokens, distinct tokens) of the texts `t`, each with its END."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols, _, place = sequences(batch.column(0))
            symbols = symbols[place > 0]
            found = np.unique(symbols)
            edges = spread(found, shards, 64)
            total = np.zeros(shards, dtype=np.int64)
            total[0] = len(symbols)
            some = np.flatnonzero((np.diff(edges) > 0) | (total > 0))
            payload = [pack_sorted(found[edges[i] : edges[i + 1]]) for i in some]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some]), pa.array(payload, pa.binary())], ["shard", "n", "h"])

    def merge(group: pa.Table) -> pa.Table:
        found = np.unique(np.concatenate([unpack_sorted(x.as_buffer()) for x in group["h"]]))
        return pa.table({"n": [int(np.sum(group["n"].to_numpy()))], "v": [len(found)]}, schema=pa.schema([("n", pa.int64()), ("v", pa.int64())]))

    row = docs.select("t").mapInArrow(distinct, "shard long, n long, h binary").groupBy("shard").applyInArrow(merge, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    return int(row[0] or 0), int(row[1] or 0)


class Automaton:
    """The states and arcs that the texts of one block can reach, by the counts of the block's n-grams.

    State 0 is the root; the others are the n-grams of up to order-1 symbols seen in training.
    `keys` (state * symbols + symbol, sorted) are the arcs, with log10 weights and next states;
    the root has one for every symbol of the block. `fail` and `fail_weight` are the failure
    arcs. Symbols are the block's unigrams by number, in `symbol` at each position.
    """

    def __init__(self, symbols: np.ndarray, bounds: np.ndarray, grams: list[tuple[np.ndarray, np.ndarray, np.ndarray]], counts: list[np.ndarray], total: int, strengths: tuple[float, ...]) -> None:
        order = len(grams)
        at = []  # the number of the n-gram that ends at a position, by its length
        for ends, _, inverse in grams:
            own = np.full(len(symbols), -1, dtype=np.int32)
            own[ends] = inverse
            at.append(own)
        if len(bounds) > 1:
            at[0][bounds[:-1]] = at[0][bounds[1:] - 1]  # a text starts with END
        self.symbol, self.width = at[0], np.int64(max(1, len(counts[0])))
        states, begin = [], 1
        for k in range(order - 1):
            seen = counts[k] > 0
            states.append(np.where(seen, begin + np.cumsum(seen) - 1, -1).astype(np.int32))
            begin += int(seen.sum())
        self.fail, self.fail_weight = np.zeros(begin, dtype=np.int32), np.zeros(begin)
        p = (counts[0] + 1) / total
        follow = np.maximum(states[0], 0) if states else np.zeros(len(p), dtype=np.int32)
        keys, weights, nexts = [np.arange(len(p))], [np.log10(p)], [follow]
        for k in range(1, order):
            ends, first, _ = grams[k]
            where = ends[first]
            context, lower = at[k - 1][where - 1], at[k - 1][where]
            mass = counts[k - 1].astype(np.float64)
            own = states[k - 1]
            self.fail_weight[own[own > 0]] = np.log10(strengths[k - 1] / (mass[own > 0] + strengths[k - 1]))
            if k > 1:  # a state falls back to the one without its first symbol
                before, where_before = states[k - 2], grams[k - 1][0][grams[k - 1][1]]
                self.fail[own[own > 0]] = np.maximum(before[at[k - 2][where_before]], 0)[own > 0]
            here = (counts[k] + strengths[k - 1] * p[lower]) / (mass[context] + strengths[k - 1])
            seen = counts[k] > 0
            keys.append(own[context][seen].astype(np.int64) * self.width + at[0][where][seen])
            weights.append(np.log10(here[seen]))
            nexts.append((states[k] if k < order - 1 else np.maximum(states[k - 1], 0)[lower])[seen])
            p = here
        self.keys, self.weights, self.nexts = np.concatenate(keys), np.concatenate(weights), np.concatenate(nexts)
        if len(keys) > 1:
            turn = np.argsort(self.keys)
            self.keys, self.weights, self.nexts = self.keys[turn], self.weights[turn], self.nexts[turn]

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next state of each walker, and the log10 weight of its arc and of the failure arcs before it."""
        out, weight, left, now = np.zeros_like(state), np.zeros(len(state)), np.arange(len(state)), state
        while len(left):
            key = now * self.width + symbol[left]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[place] == key
            out[left[there]] = self.nexts[place[there]]
            weight[left[there]] += self.weights[place[there]]
            left, now = left[~there], now[~there]
            weight[left] += self.fail_weight[now]
            now = self.fail[now]
        return out, weight

    def walk(self, bounds: np.ndarray, order: int) -> np.ndarray:
        """log10 weights by position. Walkers go from left to right in step, each through up to PIECE
        tokens, after the order-1 symbols before them, which lead from the root to the state there."""
        sizes = np.diff(bounds) - 1
        pieces = -(-sizes // PIECE)
        text_of = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(len(text_of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = bounds[:-1][text_of] + 1 + nth * PIECE
        end = np.minimum(begin + PIECE, bounds[1:][text_of])
        warm = np.minimum(begin - bounds[:-1][text_of], order - 1)
        turn = np.argsort(begin - end - warm, kind="stable")
        begin, end, warm = begin[turn], end[turn], warm[turn]
        steps = end - begin + warm
        state, out = np.zeros(len(steps), dtype=np.int32), np.zeros(bounds[-1])
        for t in range(int(steps.max()) if len(steps) else 0):
            m = int(np.searchsorted(-steps, -t, side="left"))
            place = begin[:m] - warm[:m] + t
            state[:m], weight = self.step(state[:m], self.symbol[place])
            if t >= order - 1:
                out[place] = weight
            else:
                real = t >= warm[:m]
                out[place[real]] = weight[real]
        return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, held_out: Column, order: int = 3, strengths: tuple[float, ...] = STRENGTHS, block_bytes: int = BLOCK_BYTES, spare_bits: int = 20) -> DataFrame:
    """log10 probabilities of all texts under a model of those for which `held_out` is not true.

    Returns id, held_out, n_tokens, n_known, train_tokens, base_score and score per row.

    The automaton has a state for each n-gram of up to order-1 words seen in training. From
    state h, word w has the arc of weight (c(hw) + s * p(w | h')) / (c(h) + s) if hw
    was seen; if not, the failure arc of weight s / (c(h) + s) leads to the shorter h'; the
    root has (c(w) + 1) / (N + V + 1), which also serves unknown words. s is the entry of `strengths` for
    the length of h. All probabilities of a state add up to 1. A text is walked from left to right from
    its start state to its end, and the logs of the weights are added.

    The model isn't bounded, so it is never sent whole: texts are dealt into blocks; a
    block asks, per range of the hash, for the counts of its distinct n-grams, and that range
    adds up what all blocks have and answers; so a block gets the part of the automaton
    that its texts can reach, builds its states and arcs, and walks it. Both exchanges hold packed arrays, one row per
    block and range that has any of its n-grams, so that there are never more rows than n-grams. Single words
    have hashes of 64 bits, so n_known and base_score don't depend on the input's size; those of longer n-grams
    have `spare_bits` more bits than the number of n-grams takes, up to 64: one in
    2^spare_bits shares its counts with another.

    Null texts count as empty: one token, the end. Null `held_out` counts as false. Without
    training texts N and V are 0. Repeated rows are rows of their own. A very long text is
    a block of its own. The id may be of any type; other columns are ignored. An empty table
    gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    kind = rows.schema["id"].dataType.simpleString()
    count, size = text_bytes(rows, "t")
    blocks = max(1, -(-(size + 20 * count) // block_bytes))
    spared = max(1, min(64, max(1, order * (size + count)).bit_length() + spare_bits))
    bits_of = lambda k: 64 if k == 1 else spared
    n_train, n_types = vocabulary(rows.where("NOT held_out"), blocks)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "t"), F.lit(blocks))).repartition(blocks, "block")

    def numbered(symbols: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ends of the n-grams of k symbols, their distinct hashes, the first place of each, the number at each end."""
        ends, grams = gram_ends(symbols, place, k)
        found, first, inverse = np.unique(grams >> np.uint64(64 - bits_of(k)), return_index=True, return_inverse=True)
        return ends.astype(np.int32), found, first.astype(np.int32), inverse.astype(np.int32)

    def ask(key: tuple, group: pa.Table) -> pa.Table:
        out = []
        symbols, bounds, place = sequences(group["t"].combine_chunks())
        training = np.repeat(~group["held_out"].combine_chunks().to_numpy(zero_copy_only=False), np.diff(bounds))
        for k in range(1, order + 1):
            ends, found, _, inverse = numbered(symbols, place, k)
            counts = np.bincount(inverse, weights=training[ends], minlength=len(found)).astype(np.uint32)
            edges = spread(found, blocks, bits_of(k))
            some = np.flatnonzero(np.diff(edges))
            part = pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), key[0].as_py())), pa.array(some), pa.array(np.full(len(some), k, dtype=np.int32)), pa.array([pack_sorted(found[edges[i] : edges[i + 1]]) for i in some], pa.binary()), pa.array([pack(counts[edges[i] : edges[i + 1]]) for i in some], pa.binary())],
                ["block", "shard", "k", "h", "c"],
            )
            out.append(part)
        return pa.Table.from_batches(out)

    def answer(group: pa.Table) -> pa.Table:
        hashes = [unpack_sorted(x.as_buffer()) for x in group["h"]]
        counts = np.concatenate([unpack(x.as_buffer(), np.uint32) for x in group["c"]])
        found, which = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.zeros(len(found), dtype=np.uint64)
        np.add.at(total, which, counts.astype(np.uint64))
        total = total[which]
        cuts = np.concatenate(([0], np.cumsum([len(x) for x in hashes])))
        return pa.table([group["block"], group["shard"], group["k"], pa.array([pack(total[cuts[i] : cuts[i + 1]]) for i in range(len(hashes))], pa.binary())], names=["block", "shard", "k", "c"])

    def walk(group: pa.Table, answers: pa.Table) -> pa.Table:
        symbols, bounds, place = sequences(group["t"].combine_chunks())
        answers = answers.sort_by([("k", "ascending"), ("shard", "ascending")])
        grams, counts = [], []
        for k in range(1, order + 1):
            ends, _, first, inverse = numbered(symbols, place, k)
            grams.append((ends, first, inverse))
            mine = answers.filter(pa.compute.equal(answers["k"], k))
            counts.append(np.concatenate([np.zeros(0, dtype=np.uint64), *(unpack(x.as_buffer(), np.uint64) for x in mine["c"])]).astype(np.int64))
        machine = Automaton(symbols, bounds, grams, counts, n_train + n_types + 1, strengths)
        weights = machine.walk(bounds, order)
        ends, _, which = grams[0]
        known, base = np.zeros(len(symbols)), np.zeros(len(symbols))
        known[ends] = counts[0][which] > 0
        base[ends] = np.log10((counts[0][which] + 1) / (n_train + n_types + 1))
        total = lambda x: np.add.reduceat(x, bounds[:-1])
        n = np.diff(bounds) - 1
        return pa.table([group["id"], group["held_out"], pa.array(n), pa.array(total(known).astype(np.int64)), pa.array(np.full(len(n), n_train)), pa.array(total(base)), pa.array(total(weights))], names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    asked = dealt.groupBy("block").applyInArrow(ask, "block long, shard long, k int, h binary, c binary")
    answers = asked.groupBy("shard", "k").applyInArrow(answer, "block long, shard long, k int, c binary")
    out = f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(walk, out)
