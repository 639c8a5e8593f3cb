import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from menurank.llm import embed, lines, minhash, text
from menurank.llm.components import components


def closure(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}


def plain_sets(texts, n):
    import re

    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    out = [None, "", " \n\t", "One", "one", "ONE two", "one  two"]
    for _ in range(25):
        base = [word() for _ in range(rng.randint(3, 160))]
        for _ in range(rng.randint(1, 6)):
            edited = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 18))):
                edited[rng.randrange(len(edited))] = word()
            out.append(" ".join(edited))
    out += [out[10]] * 4
    rng.shuffle(out)
    return out


def test_words_and_shingles_against_plain():
    texts = corpus()
    data, offsets = text.raw(pa.array(texts, pa.string()))
    grams, bounds = text.shingles(text.split(data, offsets), 3)
    sets = plain_sets(texts, 3)
    seen = {}
    for i, s in enumerate(sets):
        own = set(grams[bounds[i] : bounds[i + 1]].tolist())
        assert len(own) == len(s)
        seen.setdefault(frozenset(s), own)
        assert seen[frozenset(s)] == own
    assert len({frozenset(v) for v in seen.values()}) == len(seen)


@pytest.mark.parametrize(("shingle", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_against_all_pairs(spark, shingle, percent):
    texts = corpus(shingle)
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(texts)], "doc_id long, text string, n long, node string")
    rows = minhash.near_duplicates(df, shingle=shingle, percent=percent).collect()
    sets = plain_sets(texts, shingle)
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    want = closure(range(len(texts)), links)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows} == {i: (len(sets[i]), want[i], want[i] == i) for i in range(len(texts))}


def test_near_duplicates_in_a_large_family(spark, monkeypatch):
    """Two thousand variants of one text in chains: neighbours link, most others don't, and nothing between chains."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 64)
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    template, rows = [word() for _ in range(60)], []
    for chain in range(20):
        words = template[:30] + [word() for _ in range(30)]
        for step in range(100):
            words[30 + rng.randrange(30)] = word()
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=80).collect()}
    sets = plain_sets([t for _, t in sorted(rows)], 3)
    links = [(c * 100 + i, c * 100 + j) for c in range(20) for i, j in itertools.combinations(range(100), 2) for a, b in [(sets[c * 100 + i], sets[c * 100 + j])] if 100 * len(a & b) >= 80 * len(a | b)]
    assert got == closure(range(2000), links)


def test_near_duplicates_odd_rows(spark):
    kind = "doc_id long, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    rows = minhash.near_duplicates(spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, None), (3, "a b c " * 40_000)], kind)).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in rows) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 2, True), (3, 3, True)]


def test_signature_agreement_is_the_similarity():
    rng = np.random.default_rng(1)
    grams = rng.integers(0, 1 << 63, 1150, dtype=np.uint64)
    both = np.concatenate((grams[:1000], grams[150:]))  # 850 of 1150 in common
    s = minhash.min_max_signatures(both, np.array([0, 1000, 2000]), 1500)
    assert abs((s[0] == s[1]).mean() - 850 / 1150) < 0.03


def test_components_against_plain(spark):
    rng = random.Random(5)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 260)] + [(7, 7)]
    links += [(1000, 2000 + i) for i in range(400)] + [(2000, 1)]  # a hub that isn't its component's smallest
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    ids = {x for a, b in links if a != b for x in (a, b)}
    assert {r["node"]: r["component"] for r in rows} == closure(ids, [x for x in links if x[0] != x[1]]) and len(rows) == len(ids)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("members", [512, 5])
def test_embeddings_against_all_pairs(spark, monkeypatch, members):
    monkeypatch.setattr(embed, "MEMBERS", members)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((12, 32))
    v = [b + rng.standard_normal(32) * s for b in base for s in (0, 0, 0.1, 0.25, 0.4)] + [np.zeros(32), np.full(32, np.nan)]
    rows = [(i, [float(x) for x in np.float32(e)]) for i, e in enumerate(v)] + [(100, None), (101, []), (102, [1.0, None]), (103, [1.0, 2.0]), (104, [2.0, 4.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    good = {i: np.array(e, dtype=float) for i, e in rows if e and None not in e and np.isfinite(e).all() and np.any(e)}
    links = [(i, j) for i, j in itertools.combinations(good, 2) if len(good[i]) == len(good[j]) and good[i] @ good[j] / np.linalg.norm(good[i]) / np.linalg.norm(good[j]) >= 0.9]
    want = closure([i for i, _ in rows], links)
    assert got == {i: (sum(i in x for x in links), want[i], want[i] == i) for i, _ in rows}
    assert embed.near_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_code_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(4)
    d, x = 64, rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    errors, inside = [], 0
    for seed in range(12):
        turned = x @ embed.rotation(d, seed).T
        codes = np.where(turned > 0, 1.0, -1.0)
        step = np.abs(turned[:50]).max(axis=1) / 127
        inner, width = embed.estimate(codes, (codes * turned).sum(axis=1) / 8, np.rint(turned[:50] / step[:, None]) * step[:, None], step * 4, 4.5)
        errors.append((inner - x @ x[:50].T).mean())
        inside += (np.abs(inner - x @ x[:50].T) <= width).mean() / 12
    assert abs(np.mean(errors)) < 0.005 and inside > 0.999


def test_lines(spark):
    common, local = "this line is on many sites", "this line is on one site"
    rows = [(i, f"Own text {i} is here today\n  {common} \n{local if i < 4 else 'x'}\n{common}", f"s{i}" if i >= 4 else "s0", 1) for i in range(8)] + [(20, None, "s", 1), (21, "", None, 1), (None, common, "s9", 1), (23, f"{common}", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, first int")
    got = {r["doc_id"]: (r["text"], r["lines_removed"]) for r in lines.drop_boilerplate_lines(df).collect()}
    assert got[0] == (f"Own text 0 is here today\n  {common} \n{local}", 1)
    assert got[3] == (f"Own text 3 is here today\n{local}", 2) and got[5] == ("Own text 5 is here today\nx", 2)
    assert got[20] == (None, 0) and got[21] == ("", 0) and got[None] == (common, 0) and got[23] == ("", 1)
    assert lines.drop_boilerplate_lines(df.limit(0)).count() == 0


def test_lines_that_are_joined_and_counted_exactly(spark, monkeypatch):
    monkeypatch.setattr(lines, "MOST_SENT", 0)
    long = "\n".join(f"the line number {i} of all" for i in range(3000))
    rows = [(i, f"{long}\nthree sites have this line\ntwo sites have this line\n", f"s{i % 3}", "a", 1, 2) for i in range(5)]
    rows += [(5, "two sites have this line", "s0", "a", 1, 2), (6, "only s1 and s2 say this", "s1", "a", 1, 2), (7, "only s1 and s2 say this", "s2", "a", 1, 2), (7, "only s1 and s2 say this", "s2", "a", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, gone string, lines_removed int, h int")
    out = lines.drop_boilerplate_lines(df)
    got = {r["doc_id"]: (r["text"], r["lines_removed"]) for r in out.collect()}
    assert got[0] == (rows[0][1], 0) and got[1] == ("", 3002) and got[5] == ("", 1) and got[6] == (rows[6][1], 0) and got[7] == (rows[7][1], 0)
    assert sorted(out.columns) == sorted(df.columns) and out.count() == len(rows)


def test_short_lines_by_sites(spark):
    long = "版权所有。保留所有权利。"
    rows = [(i, f"All rights reserved.\n{long if i < 4 else 'own'}\n\n{'few sites' if i < 5 else f'line {i}'}", f"s{i}") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["text"], r["lines_removed"]) for r in lines.drop_boilerplate_lines(df).collect()}
    assert got[0] == (rows[0][1], 0) and got[1] == ("\nfew sites", 2) and got[6] == ("own\n\nline 6", 1)
    assert all(r["lines_removed"] == 0 for r in lines.drop_boilerplate_lines(df, short_sites=None).collect())


def test_repeated_vectors_do_not_link_to_themselves(spark):
    from menurank.llm.embed import near_embeddings

    rows = [(1, [1.0, 0.0, 2.0]), (1, [1.0, 0.0, 2.0]), (2, [2.0, 0.0, 4.1]), (3, [0.0, 1.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [1.0, 0.0, 2.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, component_id string, copies int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_embeddings(df).collect())
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (3, 0, 3, True), (4, 2, 1, False)]
