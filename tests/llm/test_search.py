import math
import random
import re

import numpy as np
import pytest

from menurank.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=20):
    own = [(d, t) for d, text in docs if (t := terms(text))]
    n_docs, n_terms = len(own), sum(len(t) for _, t in own)
    df = {}
    for _, t in own:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, words in sorted({(i, tuple(sorted(terms(t)))) for i, t in items}, key=str):
        found = []
        for d, t in own:
            m = 75 + 25 * len(t) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * t.count(w) // (1000 * t.count(w) + 12 * m)) for w in words if w in df)
            if score:
                found.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(found)[:k])]
    return out


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["the", "Of", "naïve", "x1", "Ünder", *(f"w{i}" for i in range(150))]
    weigh = [1 / (i + 1) for i in range(len(words))]
    sep = [" ", ", ", "\n", "-", "\x00"]
    text = lambda m: "".join(w + rng.choice(sep) for w in rng.choices(words, weigh, k=m))
    docs = [(i, text(rng.choice([1, 5, 30, 200]))) for i in range(n)]
    docs += [(n + 1, None), (n + 2, ""), (n + 3, " .;"), (5, docs[5][1]), (5, "other w7 w9"), (None, "w7 w9 w11"), (n + 4, "w3 " * 3000), *((2 * n + i, "tie w149 tie") for i in range(60))]
    items = [(i, text(rng.choice([1, 2, 8, 40]))) for i in range(25)]
    items += [(3, items[3][1]), (3, "w1 w2"), (None, "w7 w9"), (77, None), (78, "?"), (79, "nowhere"), (80, "tie"), (81, "tie tie W149 tie the"), (82, "the the the")]
    return docs, items


@pytest.mark.parametrize(("block_terms", "block_items", "k"), [(1 << 20, 4096, 20), (900, 10, 20), (2500, 4096, 3)])
def test_search_against_plain(spark, block_terms, block_items, k):
    docs, items = corpus(400)
    df = spark.createDataFrame([(*d, "z", 1) for d in docs], "doc_id long, text string, item_id string, rank int").repartition(3)
    queries = spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, score int")
    found = search.search(search.build_index(df, block_terms=block_terms), queries, k=k, block_items=block_items)
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert got == sorted(plain(docs, items, k), key=str)


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search.search(search.build_index(docs), items).count() == 0
    full = spark.createDataFrame([(1, "a"), (2, "b a")], "doc_id long, text string")
    index = search.build_index(full)
    assert search.search(index, items.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in search.search(index, items).orderBy("rank").collect()] == [(1, 1, 2), (1, 2, 1)]


def opened(docs, items, n_docs, n_terms):
    """One block, its items and what its impact row holds."""
    hashed = {w: i + 1 for i, w in enumerate(sorted({w for _, t in docs for w in t} | {w for t in items for w in t}))}
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    ids = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs])], ["id"])
    with pa.ipc.new_stream(sink, ids.schema) as out:
        out.write_batch(ids)
    row = dict(zip([c.split()[0] for c in search.INDEX.split(", ")], search.inverted(sink.getvalue().to_pybytes(), np.array([len(t) for _, t in docs]), np.array([hashed[w] for _, t in docs for w in t], dtype=np.uint64)), strict=True))
    own = [np.array([hashed[w] for w in t], dtype=np.uint64) for t in items]
    words = np.unique(np.concatenate(own))
    df = [sum(any(hashed[x] == w for x in t) for _, t in docs) for w in words.tolist()]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df])
    plan = search.plan_items(list(range(len(items))), own, words, weights)
    made = search.block_impacts(row, plan, n_docs, n_terms)
    return search.Block(dict(zip([c.split()[0] for c in search.IMPACTS.split(", ")], made, strict=True)), plan), plan


def test_pair_bounds_hold_and_tighten():
    docs = [(i, terms(t)) for i, t in corpus(300, seed=5)[0] if terms(t)]
    items = [terms(t) for _, t in corpus(300, seed=5)[1] if terms(t)]
    block, plan = opened(docs, items, len(docs), sum(len(t) for _, t in docs))
    bounds = search.unit_bounds(block, plan)
    every = np.arange(block.size)
    tighter = 0
    for i in range(len(items)):
        total = np.zeros(block.size, dtype=np.int64)
        for u in range(plan.first[i], plan.first[i + 1]):
            worth = block.worth(plan.a[u], every) * plan.times_a[u] + (block.worth(plan.b[u], every) * plan.times_b[u] if plan.b[u] >= 0 else 0)
            assert (worth <= bounds[3][u]).all()
            tighter += bounds[3][u] < bounds[0][u] + bounds[1][u]
            total += worth
        for least in (1, int(np.sort(total)[-20]), int(total.max())):
            found, score = search.hits(block, plan, i, bounds, least, 20)
            floor = max(least, int(np.sort(total)[-20]))
            assert set(np.flatnonzero((total >= floor) & (total > 0))) <= set(found) and (score == total[found]).all()
    assert tighter > 20


def test_saturation_in_whole_numbers_of_any_size():
    n, big = np.array([7, 10**6]), 10**13
    m = [75 + 25 * int(x) * big // (3 * big) for x in n]
    assert search.saturation(np.array([2, 3]), n, big, 3 * big).tolist() == [10**9 * t // (1000 * t + 12 * x) for t, x in zip((2, 3), m, strict=True)]
