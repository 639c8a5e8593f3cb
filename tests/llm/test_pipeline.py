import random

import pytest

import corpus_pipeline
from menurank.llm import queries
from tests.llm.test_scores import labelled

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Clean, toxic, copied and contaminated documents, a line that sites share, and empty ones."""
    folder = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("lmnopqrstuv") for _ in range(rng.randint(2, 7)))
    docs, labels = labelled(6, 240)
    shared = " ".join(word() for _ in range(60))
    items = [" ".join(word() for _ in range(30)) for _ in range(5)]
    rows = [[i, t, f"s{i % 7}"] for i, t in docs]
    for i in (302, 303, 304, 306, 307):
        rows.append([i, " ".join(word() for _ in range(80)) + "\n" + shared, f"s{i % 7}"])
    base = [word() for _ in range(120)]
    for i in range(320, 326):
        edited = list(base)
        edited[i - 318] = word()
        rows.append([i, " ".join(edited), "s1"])
    for i in range(330, 335):
        rows.append([i, " ".join(word() for _ in range(40)) + " " + items[i - 330].upper() + " tail", "s2"])
    rows += [[340, None, "s3"], [341, "", None], [342, "only this", None]]
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]
    clean = stages["toxicity"](spark, docs, tables)
    assert clean.columns == docs.columns
    left = {r["doc_id"] for r in clean.collect()}
    toxic = {i for i in range(240) if i % 4 == 0}
    assert len(left & toxic) <= 3 and len(set(range(240)) - toxic - left) <= 3 and left >= {320, 340, 341, 342}
    lines = stages["line_dedup"](spark, docs, tables)
    rows = {r["doc_id"]: r for r in lines.collect()}
    assert lines.columns == docs.columns and len(rows) == docs.count()
    assert "\n" in rows[302]["text"] and all("\n" not in rows[i]["text"] and rows[i]["n_chars"] == len(rows[i]["text"]) for i in (303, 304, 306, 307))
    assert rows[340]["text"] is None and rows[0]["text"] == docs.where("doc_id = 0").first()["text"]
    near = {r["doc_id"] for r in stages["near_dedup"](spark, docs, tables).collect()}
    assert near & set(range(320, 326)) == {320} and near >= set(range(240)) | {340, 341, 342}
    free = {r["doc_id"] for r in stages["decontamination"](spark, docs, tables).collect()}
    assert free == {r["doc_id"] for r in docs.collect()} - set(range(330, 335))
    empty = docs.limit(0)
    assert all(f(spark, empty, tables).count() == 0 for _, f in corpus_pipeline.STAGES)


def test_run(spark, tables):
    rows = corpus_pipeline.run(spark, tables).collect()
    ids = [r["doc_id"] for r in rows]
    assert len(ids) == len(set(ids)) and 320 in ids and 321 not in ids and 330 not in ids and {340, 341} <= set(ids)
    assert all(r["taken"] <= 2 * r["size"] for r in rows)


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14)) and set(queries.SQL) <= set(queries.QUERIES)


def plain_near(rows):
    """Rows that stay: links of all pairs of different (id, text), the smallest id of each component."""
    own = sorted({(i is None, i or 0, t) for i, t in rows if t and t.split()})
    sets = [{tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for _, _, t in own]
    root = list(range(len(own)))
    for _ in own:
        for x in range(len(own)):
            for y in range(x):
                if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                    root[x] = root[y] = min(root[x], root[y])
    return sorted([(None if n else i, t) for k, (n, i, t) in enumerate(own) if root[k] == k] + [(i, t) for i, t in rows if not (t and t.split())], key=str)


def test_near_dedup_by_row(spark, tables):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    t, other, third = (" ".join(word() for _ in range(60)) for _ in range(3))
    near = t + " " + word()
    rows = [(1, t), (2, t), (2, other), (3, near), (4, other), (4, other), (None, other), (None, third), (None, third), (5, None), (5, None), (None, ""), (6, "  "), (7, "word " * 20_000), (8, "word " * 20_001)]
    docs = spark.createDataFrame([(i, x, "en", f"s{k % 3}", 1, "v", k % 2) for k, (i, x) in enumerate(rows)], COLUMNS + ", component_id string, n int")
    near_dedup = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, tables)
    assert near_dedup.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in near_dedup.collect()), key=str) == plain_near(rows)


def test_stages_by_row(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    leak = docs.where("doc_id = 330").first()["text"]
    clean = docs.where("doc_id = 1").first()["text"]
    rows = [(900, leak), (900, clean), (None, leak), (None, clean), (901, None), (901, clean), (901, clean)]
    some = spark.createDataFrame([(i, x, "en", "s1", 1, "v") for i, x in rows], COLUMNS + ", at string")
    stages = dict(corpus_pipeline.STAGES)
    got = sorted(((r["doc_id"], r["text"]) for r in stages["decontamination"](spark, some, tables).collect()), key=str)
    assert got == sorted([(900, clean), (None, clean), (901, None), (901, clean), (901, clean)], key=str)
    assert stages["toxicity"](spark, some, tables).count() == len(rows)
    assert stages["mixing"](spark, some, tables).count() == len(rows)
