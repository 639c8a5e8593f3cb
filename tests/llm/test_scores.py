import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from menurank.llm import decontaminate, html_main, lm, mixing, quality, tokens, toxicity
from menurank.llm.queries import vocabulary_path


def lm_plain(rows, strengths):
    seq = {}
    for i, held, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        seq.setdefault(i, []).append((held, ["$", *w, "$"]))
    train = [s for found in seq.values() for h, s in found if not h]
    c = Counter(tuple(s[i - k + 1 : i + 1]) for s in train for i in range(1, len(s)) for k in range(1, min(i + 1, len(strengths) + 1) + 1))
    n, v = sum(x for g, x in c.items() if len(g) == 1), sum(len(g) == 1 for g in c)

    def p(gram):
        if len(gram) == 1:
            return (c[gram] + 1) / (n + v + 1)
        s = strengths[len(gram) - 2]
        return (c[gram] + s * p(gram[1:])) / (c[gram[:-1]] + s)

    out = {}
    for i, found in seq.items():
        s = found[0][1]
        base = sum(math.log10(p((w,))) for w in s[1:])
        score = sum(math.log10(p(tuple(s[max(0, j - len(strengths)) : j + 1]))) for j in range(1, len(s)))
        out[i] = (len(s) - 1, sum(c[w,] > 0 for w in s[1:]), n, base, score)
    return out


@pytest.mark.parametrize("strengths", [(7.0,), (7.0, 3.0), (7.0, 3.0, 0.5)])
def test_language_model_against_plain(spark, monkeypatch, strengths):
    monkeypatch.setattr(lm, "PIECE", 100)
    rng = random.Random(1)
    rows = [(i, i % 5 == 2, " ".join(rng.choice(["a", "b", "the", "Of", "é", f"w{i}"]) for _ in range(rng.randint(0, 30)))) for i in range(60)] + [(90, False, None), (91, True, "new words only"), (92, False, "a b a " * 1000), (94, False, " ".join(rng.choice("abcd") for _ in range(701)))]
    rows += [(93, False, "twice the same row"), (93, False, "twice the same row")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, h boolean, text string, id string, t int")
    got = lm.score(df, held_out=F.col("h"), order=len(strengths) + 1, strengths=strengths, block_bytes=900).collect()
    want = lm_plain(rows, strengths)
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[r["doc_id"]][:3]
        assert r["base_score"] == pytest.approx(want[r["doc_id"]][3]) and r["score"] == pytest.approx(want[r["doc_id"]][4])
    named = df.withColumn("doc_id", F.concat(F.lit("n"), "doc_id"))
    assert {r["doc_id"] for r in lm.score(named, held_out=F.col("h")).collect()} == {f"n{i}" for i, _, _ in rows}
    assert lm.score(df.limit(0), held_out=F.col("h")).count() == 0
    # longer n-grams that share their hashes change the score alone
    exact, mixed = ({r["doc_id"]: r for r in lm.score(df, held_out=F.col("h"), spare_bits=b).collect()} for b in (20, -8))
    for i, r in exact.items():
        assert all(r[c] == mixed[i][c] for c in ("n_tokens", "n_known", "train_tokens")) and r["base_score"] == pytest.approx(mixed[i]["base_score"], abs=1e-9)
    assert any(r["score"] != mixed[i]["score"] for i, r in exact.items())


def test_language_model_probabilities_add_up():
    import numpy as np
    import pyarrow as pa

    symbols, bounds, place = lm.sequences(pa.array(["a b a c b a b", "b b a", "", "never seen here"]))
    training = np.repeat([True, True, True, False], np.diff(bounds))
    grams, counts = [], []
    for k in (1, 2, 3):
        ends, g = lm.gram_ends(symbols, place, k)
        _, first, inverse = np.unique(g, return_index=True, return_inverse=True)
        grams.append((ends, first, inverse))
        counts.append(np.bincount(inverse, weights=training[ends]).astype(np.int64))
    machine = lm.Automaton(symbols, bounds, grams, counts, int(counts[0].sum() + (counts[0] > 0).sum() + 1), (7.0, 3.0))
    known = np.flatnonzero(counts[0])
    unknown = np.flatnonzero(counts[0] == 0)
    assert len(machine.fail) == 1 + len(known) + (counts[1] > 0).sum() and len(unknown) == 3
    # a pair that ends with END is where a text is over: nothing follows
    ends, first, _ = grams[1]
    last = machine.symbol[ends[first]][counts[1] > 0]
    over = 1 + len(known) + np.flatnonzero(last == machine.symbol[0])
    for state in sorted(set(range(len(machine.fail))) - set(over.tolist())):
        weight = machine.step(np.full(len(known) + 1, state), np.append(known, unknown[0]))[1]
        assert (10**weight).sum() == pytest.approx(1)


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.choice([1, 3, 40, 400]), rng.choice(["a", "b", "c", None])) for i in range(400)] + [(900, None, "a"), (901, "", "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(df.repartition(3)).collect())) and len(got) == len(rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, full, left = {}, set(), 1.5 * sum(size.values())
    while True:
        rest = left - sum(2 * size[s] for s in full)
        level = rest / sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and weight[s] * level > 2 * size[s]}
        if not more:
            break
        full |= more
    target = {s: 2 * size[s] if s in full else weight[s] * level for s in order}
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]] and r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 40 for s in order)
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_decontamination(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [" ".join(word() for _ in range(rng.randint(14, 50))) for _ in range(30)]
    filler = lambda n: " ".join(word() for _ in range(n))
    docs, want = [], set()
    for i in range(60):
        t = filler(rng.randint(0, 300))
        if i % 3 == 0:
            w = items[i % 30].split()
            for _ in range(len(w) // 9 * (i % 2)):
                w[rng.randrange(len(w))] = word()
            t += " " + " ".join(w).upper() + " " + filler(50)
            want.add((i, i % 30))
        docs.append((i, t))
    docs += [(100, None), (101, ""), (None, items[0])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, ""), (52, "zz")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench).collect()}
    assert got == want | {(None, 0)}
    assert got == {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench, block_bytes=1000).collect()}
    kept = {r["doc_id"] for r in decontaminate.decontaminate(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want} - {None}  # a row without an id is judged by its text, too
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0 == decontaminate.contaminated(df.limit(0), bench).count()


def test_decontamination_of_edited_beside_exact_copies(spark):
    words = [f"w{i}" for i in range(30)]
    edited = [f"x{i}" if i % 5 == 4 else w for i, w in enumerate(words)]
    docs = [(0, " ".join(words)), (1, "a b " + " ".join(words)), (2, "c " + " ".join(edited) + " d")]
    docs += [(3, " ".join(words[:17])), (4, " ".join(words[:3] * 20))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in decontaminate.contaminated(df, spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")).collect()}
    assert got == {0: 1.0, 1: 1.0, 2: pytest.approx(43 / 60)}


def test_alignment_against_the_full_table():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = rng.integers(0, 5, rng.integers(1, 15)), rng.integers(0, 5, rng.integers(1, 25))
        h = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontaminate.align(a, b)[0] == h.max()


def test_token_counts_against_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    vocabulary = tokens.read_vocabulary(vocabulary_path())
    pieces = [("<unk>", 0.0), *vocabulary, *[(f"<0x{i:02X}>", 0.0) for i in range(256)]]
    # the bytes' score only matters to pieces that are spelled like them
    model = tokenizers.Tokenizer(tokenizers.models.Unigram(pieces, unk_id=0, byte_fallback=True))
    texts = ["Hello world", " two  spaces and a tail  ", "naïve café 東京 🙂 ok", "x" * 300, "Line\nbreak\ttab", "the of and " * 50]
    counter = tokens.Counter(vocabulary)
    for t in texts:
        want = len(model.encode("▁" + t.replace(" ", "▁")).ids)
        assert counter.text(t)[1] == want, t
    rows = tokens.token_counts(spark.createDataFrame([*enumerate(texts), (9, None), (10, "")], "doc_id long, text string"), vocabulary).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {**{i: counter.text(t)[1] for i, t in enumerate(texts)}, 9: 0, 10: 0}


def test_token_counts_of_ordinary_text():
    """Merges scored by Zipf's law come within a few pieces of the counts of the file's own tokenizer."""
    sentencepiece = pytest.importorskip("sentencepiece")
    own, counter = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path()), tokens.Counter(tokens.read_vocabulary(vocabulary_path()))
    for t in ["internationalization of tokenizers", "The quick brown fox jumps over the lazy dog.", "Evidence-based medicine requires randomized controlled trials and careful interpretation.", "Die Wissenschaft schreitet unaufhaltsam voran."]:
        assert abs(counter.text(t)[1] - len(own.encode(t))) <= 2, t


def best_segmentation(text, vocabulary, unknown):
    """All segmentations of a short text: the best score, and the piece counts of those that have it."""
    table = dict(vocabulary)
    ways = {0: [(0.0, 0)]}
    for end in range(1, len(text) + 1):
        ways[end] = [(s + table[text[b:end]], n + 1) for b in range(end) if text[b:end] in table for s, n in ways[b]]
        if text[end - 1] not in table:
            ways[end] += [(s + unknown, n + len(text[end - 1].encode())) for s, n in ways[end - 1]]
    best = max(s for s, _ in ways[len(text)])
    return best, {n for s, n in ways[len(text)] if abs(s - best) < 1e-9}


def test_token_counts_against_all_segmentations(spark):
    rng = random.Random(7)
    vocabulary = [(p, -float(i % 7) - 1) for i, p in enumerate(["a", "b", "▁", "ab", "ba", "aba", "▁a", "▁ab", "bb", "é"])]
    counter = tokens.Counter(vocabulary)
    texts = ["".join(rng.choice("ab é😀") for _ in range(rng.randint(1, 9))) for _ in range(150)]
    for t in texts:
        best, counts = best_segmentation("▁" + t.replace(" ", "▁"), vocabulary, counter.unknown)
        got = counter.text(t)
        assert got[0] == pytest.approx(best) and got[1] in counts, t
    rows = [("x", texts[0], 1), ("x", texts[0], 1), ("long", "ab " * 40_000, 2)]
    found = tokens.token_counts(spark.createDataFrame(rows, "doc_id string, text string, t int"), vocabulary).collect()
    assert sorted(r["n_tokens"] for r in found if r["doc_id"] == "x") == [counter.text(texts[0])[1]] * 2
    assert [r["n_tokens"] for r in found if r["doc_id"] == "long"] == [counter.text("ab " * 40_000)[1]]


def test_token_ties():
    c = tokens.Counter([("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁", -1.0)])
    assert c.text("ab") == (-3.0, 2)  # the longer of equals, which starts first


PAGES = {
    "<html><head><title>T</title></head><body><nav><a>Home</a></nav><article><h1>Head</h1><p>One <b>two</b>&amp; three.<br>Four</p></article><div class=comments><p>Nice, really.</p></div><footer>End</footer></body></html>": "Head One two& three. Four",
    "<body><div id=menu><ul><li><a>A</a><li><a>B</a></ul></div><div id=c><h2>Title</h2><p>Long text, with words. And more of it, so that it counts.</p><p>Again, a text of some length, yes.</p></div><form>Name<input></form><aside>Ad</aside></body>": "Title Long text, with words. And more of it, so that it counts. Again, a text of some length, yes.",
    "": "", "plain &lt;text&gt;": "plain <text>", "<p>cut in the <b": "cut in the", "<script>var x = '<p>no</p>';</script><p>Yes, this.</p>": "Yes, this.",
}


def test_main_text(spark):
    rows = [(i, "u", h) for i, h in enumerate(PAGES)] + [(50, None, None)]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_main.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: (t, len(t)) for i, t in enumerate(PAGES.values())}, 50: ("", 0)}


LONG = "<h2>Title</h2><p>Long text, with words. And more of it, so that it counts.</p><p>Again, a text of some length, yes.</p>"
PLAIN = "Title Long text, with words. And more of it, so that it counts. Again, a text of some length, yes."


def test_main_text_beside_teasers_in_articles():
    long = LONG + "<p>A third text, longer than the cards, with words. It also counts, as the first does.</p>" * 3
    teasers = "<article class=card><h3>Teaser</h3><p>Short.</p></article>" * 3
    got = html_main.main_text(f"<body><div id=c>{long}</div><div id=more>{teasers}</div></body>")
    assert got.startswith(PLAIN) and "Teaser" not in got
    assert html_main.main_text(f"<body><article>{LONG}</article><p>x</p></body>") == PLAIN


@pytest.mark.parametrize("names", ["post type-post tag-politics hentry", "post comments-open", "layout has-sidebar", "content no-sidebar", "post alert"])
@pytest.mark.parametrize("page", ["<body><article class='{}'>{}</article>{}</body>", "<body><div class='{}'><article>{}</article></div>{}</body>", "<body><div class='{}'>{}</div>{}</body>"])
def test_main_text_in_elements_named_like_furniture(names, page):
    assert html_main.main_text(page.format(names, LONG, "<div class=sidebar><p>Aside, yes.</p></div>")) == PLAIN


def test_path_scores_against_plain():
    rng = random.Random(11)
    for _ in range(20):
        paths = [tuple(rng.choice(["div", "p", "li"]) for _ in range(rng.randint(1, 2))) for _ in range(rng.randint(1, 12))]
        texts = ["".join(rng.choice("ab ., ") for _ in range(rng.randint(1, 40))) for _ in paths]
        mean = {}
        for path in set(paths):
            own = [t for p, t in zip(paths, texts, strict=True) if p == path]
            mean[path] = (sum(map(len, own)) / len(own), sum(t.count(".") + t.count(",") for t in own) / len(own))
        kernel = [math.exp(-0.5 * d * d) for d in range(-2, 3)]
        got = html_main.path_scores(paths, texts)
        for i in range(len(paths)):
            near = [mean[paths[min(max(i + d, 0), len(paths) - 1)]] for d in range(-2, 3)]
            length, marks = (sum(k * n[j] for k, n in zip(kernel, near, strict=True)) / sum(kernel) for j in (0, 1))
            assert got[i] == pytest.approx(math.log1p(length) * math.log1p(1 + marks))


def test_every_page_is_scored_by_its_paths(monkeypatch):
    calls, own = [], html_main.path_scores
    monkeypatch.setattr(html_main, "path_scores", lambda *x: calls.append(1) or own(*x))
    body = "".join(f"<p>Sentence {i}, with some words, is here. And one more of them.</p>" for i in range(6))
    want = " ".join(f"Sentence {i}, with some words, is here. And one more of them." for i in range(6))
    nav = "<nav><a>Home</a></nav>"
    pages = [f"<body>{nav}<article>{body}</article></body>", f"<body>{nav}<main>{body}</main></body>", f"<body>{nav}<div>{body}</div></body>", f"<body>{nav}<main><article>{body}</article></main></body>"]
    assert [html_main.main_text(x) for x in pages] == [want] * 4 and len(calls) == 4
    nested = f"<body>{nav}<article><h1>T</h1><article>{body}</article></article></body>"
    assert html_main.main_text(nested) == "T " + want
    long = "<p>Again and again, these words.</p>" * 20_000
    assert len(html_main.main_text(f"<body><article>{long}</article></body>")) == 20_000 * len("Again and again, these words. ") - 1


def test_pages_that_repeat_and_extra_columns(spark):
    page = "<body><article><p>Some text, and more.</p></article></body>"
    df = spark.createDataFrame([("a", "u", page, 1, "x"), ("a", "u", page, 1, "x")], "page_id string, url string, html string, n_chars int, text string")
    assert [tuple(r) for r in html_main.extract_main_text(df).collect()] == [("a", "u", "Some text, and more.", 20)] * 2


def test_mix_of_equal_sizes_repeats_and_a_long_text(spark):
    rows = [(i % 50, "w " * 10, "a", 1, 2) for i in range(200)] + [(900, "w " * 50_000, "b", 1, 2), (901, "w " * 50_000, "b", 1, 2), (902, "w", "c", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, taken int")
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in got)
    for s in "ab":
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    groups = spark.createDataFrame([("x", 3, 1), ("x", 1, 1)], "skey string, size long, n long")
    goals = spark.createDataFrame([("x", 4, 5.0, 8.0)], "skey string, source_size long, target double, cap double")
    with pytest.raises(RuntimeError):
        mixing.balance(groups, goals, 0.5, 2.0, steps=1)


def test_decontamination_of_repeats_and_long_texts(spark):
    item = " ".join(f"word{i}" for i in range(20))
    rows = [("a", item, 1), ("a", item, 1), ("long", "x " * 100_000 + item, 1), ("clean", "x " * 100, 1)]
    df = spark.createDataFrame(rows, "doc_id string, text string, item_id int")
    bench = spark.createDataFrame([(7, item, "b"), (7, item, "b")], "item_id long, text string, score string")
    got = decontaminate.contaminated(df, bench).collect()
    assert sorted((r["doc_id"], r["score"]) for r in got) == [("a", 1.0), ("long", 1.0)]
    assert [r["doc_id"] for r in decontaminate.decontaminate(df, bench).collect()] == ["clean"]


def labelled(seed=4, n=500):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghik") for _ in range(rng.randint(2, 7)))
    docs, labels = [], []
    for i in range(n):
        kind = i % 4
        w = [word() for _ in range(rng.randint(5, 60))]
        if kind == 0:
            w[rng.randrange(len(w))] = "zorkloser" + rng.choice(["s", "", "ish"])
        if kind == 1:
            w = [x + "$$%" for x in w]
        docs.append((i, " ".join(w)))
        labels.append((i, int(kind != 1), int(kind == 0)))
    return docs, labels


def slopes(loss, scores, y, free, step=1e-6):
    """Slopes of a loss by differences."""
    import numpy as np

    at = lambda s, f: loss(s, y, f)[0]
    by_score = [(at(scores + step * e, free) - at(scores - step * e, free)) / (2 * step) for e in np.eye(len(scores))]
    by_free = [(at(scores, free + step * e) - at(scores, free - step * e)) / (2 * step) for e in np.eye(len(free))]
    return np.array(by_score), np.array(by_free)


def test_slopes_against_differences():
    import numpy as np

    rng = np.random.default_rng(5)
    scores = rng.standard_normal(12) * 2
    for loss, y, free in [(toxicity.logistic(3.0), rng.integers(0, 2, 12).astype(float), np.array([0.4])), (quality.cumulative_link, rng.integers(0, 4, 12).astype(float), np.array([-1.0, 0.2, -0.3]))]:
        _, slope, more = loss(scores, y, free)
        want, want_more = slopes(loss, scores, y, free)
        assert np.allclose(slope, want, atol=1e-5) and np.allclose(more, want_more, atol=1e-4)


def test_fit_against_dense_steps(spark):
    import numpy as np

    from menurank.llm.linear import fit

    rng = np.random.default_rng(6)
    x = rng.standard_normal((80, 5)) * (rng.random((80, 5)) < 0.6)
    y = (x @ [2.0, -1.0, 0.0, 1.0, 0.5] + rng.standard_normal(80) * 0.3 > 0).astype(float) + (x[:, 0] > 1)
    rows = [(float(t), np.flatnonzero(r).tolist(), r[r != 0].astype(float).tolist()) for r, t in zip(x, y, strict=True)]
    sample = spark.createDataFrame(rows, "y double, index array<int>, value array<double>").repartition(2).persist()
    start = np.array([-0.5, 0.0])
    weights, free = fit(sample, 5, start, quality.cumulative_link, steps=90, rate=0.1, l2=1e-2)
    w = np.concatenate((np.zeros(5), start))
    for _ in range(8000):
        _, slope, more = quality.cumulative_link(x @ w[:5], y, w[5:])
        w = w - 0.2 * (np.concatenate((x.T @ slope, more)) / len(y) + 1e-2 * np.concatenate((w[:5], [0, 0])))
    assert np.allclose(weights, w[:5], atol=0.05) and np.allclose(free, w[5:], atol=0.05)


def test_log_count_ratios_against_a_dictionary(spark):
    import numpy as np
    import pyarrow as pa

    from menurank.llm import text

    rows = [(float(i % 3 == 0), "You BAD thing\tthere" if i % 3 == 0 else f"a good thing {i % 5}") for i in range(60)] + [(1.0, ""), (0.0, "abc")]
    got = toxicity.log_count_ratios(spark.createDataFrame(rows, "y double, t string"), informative=2.0)
    seen = {0.0: Counter(), 1.0: Counter()}
    for y, t in rows:
        t = f" {t.lower()} ".replace("\t", " ")
        seen[y].update({t[i : i + g] for g in toxicity.GRAMS for i in range(len(t) - g + 1)})
    total = Counter(y for y, _ in rows)
    used = set()
    for gram in set(seen[0.0]) | set(seen[1.0]):
        p, q = seen[1.0][gram] + 1, seen[0.0][gram] + 1
        ratio = math.log(p / (total[1.0] + 2)) - math.log(q / (total[0.0] + 2))
        # a text that is the n-gram alone, without the blanks around it, has its place among others
        index, _ = toxicity.char_grams(*text.raw(pa.array([gram])), grams=(len(gram),))
        alone = [i for i in index if abs(got[i] - ratio) < 1e-5]
        if abs(ratio) >= 2 * math.sqrt(1 / p + 1 / q):
            assert alone, gram
            used.update(alone)
    assert used == set(np.flatnonzero(got))


def test_classifiers_on_odd_rows(spark):
    docs, labels = labelled(8, 160)
    docs = [(f"d{i}", t, 1, 2, 3, 4) for i, t in docs] + [("d1", docs[1][1], 1, 2, 3, 4), ("long", "word " * 30_000, 1, 2, 3, 4), (None, "null id", 1, 2, 3, 4)]
    d = spark.createDataFrame(docs, "doc_id string, text string, score int, held_out int, y int, text_again int")
    gold = spark.createDataFrame([(f"d{i}", q, x) for i, q, x in [*labels, labels[1]]], "doc_id string, quality int, toxic int")
    tox = toxicity.toxicity(d, gold).collect()
    assert Counter(r["doc_id"] for r in tox) == Counter(x[0] for x in docs) and len({r["score"] for r in tox if r["doc_id"] == "d1"}) == 1
    again = toxicity.score(d, toxicity.train(d, gold))
    assert sorted(again.columns) == sorted(d.columns) and again.count() == len(docs)
    grades = quality.grade(d, gold.select("doc_id", quality.grade_column(F.col("quality"), F.col("toxic")).alias("grade"))).collect()
    assert Counter(r["doc_id"] for r in grades) == Counter(x[0] for x in docs) and len({r["expected_grade"] for r in grades if r["doc_id"] == "d1"}) == 1


def test_toxicity_on_held_out(spark):
    docs, labels = labelled()
    d = spark.createDataFrame([*docs, (1000, None), (1001, "")], "doc_id long, text string")
    gold = spark.createDataFrame([*labels, (None, 1, 1), (2000, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(d, gold, held_out=F.col("doc_id") % 5 == 0).collect()
    assert len(rows) == len(docs) + 2 and all(0 <= r["score"] <= 1 for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]][2]) for r in rows if r["held_out"] and r["doc_id"] < 1000]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    alike = {r["score"] for r in toxicity.toxicity(d, gold.limit(0)).collect()}
    assert len(alike) == 1 and toxicity.toxicity(d.limit(0), gold).count() == 0


def test_quality_on_held_out(spark):
    docs, labels = labelled(5)
    d = spark.createDataFrame([*docs, (1000, None), (1001, "")], "doc_id long, text string")
    gold = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").select("doc_id", quality.grade_column(F.col("quality"), F.col("toxic")).alias("grade"))
    rows = quality.grade(d, gold, 3, held_out=F.col("doc_id") % 5 == 0).collect()
    held = [(r["keep"], labels[r["doc_id"]][1] == 1) for r in rows if r["held_out"] and r["doc_id"] < 1000]
    assert len(rows) == len(docs) + 2 and sum(a == b for a, b in held) / len(held) > 0.95
    assert all(0 <= r["expected_grade"] <= 2 and 0 <= r["tail_probability"] <= 1 for r in rows)
    assert quality.grade(d.limit(0), gold, 3).count() == 0 and len({r["expected_grade"] for r in quality.grade(d, gold.limit(0), 3).collect()}) == 1


def test_decontamination_of_null_and_equal_ids(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"x y {item} z"), (None, item), (2, "nothing of it")], "id long, text string")
    items = spark.createDataFrame([(None, item), (7, "other words that are nowhere"), (8, item)], "id long, text string")
    got = decontaminate.contaminated(docs, items, "id", "text", "id", "text")
    assert got.columns == ["id", "id_", "score", "at"]
    assert sorted(((r["id"], r["id_"]) for r in got.collect()), key=str) == [(1, 8), (1, None), (None, 8), (None, None)]
    named = items.withColumn("id", F.concat(F.lit("q"), F.col("id")))
    assert {r["item_id"] for r in decontaminate.contaminated(docs, named.withColumnRenamed("id", "item_id"), "id").collect()} == {"q8", None}
