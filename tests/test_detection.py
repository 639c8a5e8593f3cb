import random

from pyspark.sql import functions as F

from menurank import dims
from menurank.operators.costing import detect_ingredients, estimate_macros, match_text


def greedy(text):
    """Longest first, then the earlier name; what overlaps a kept run goes; an ingredient once."""
    words = text.split(" ")
    runs = sorted((o, i, n) for a, o, *_ in dims.alias_rows() if "-" not in a for n in (1, 2, 3) for i in range(len(words) - n + 1) if " ".join(words[i : i + n]) == a)
    name = {o: (a, ingredient) for a, o, ingredient, *_ in dims.alias_rows()}
    kept, taken, known = [], set(), set()
    for o, i, n in runs:
        if not taken & set(range(i, i + n)):
            taken |= set(range(i, i + n))
            if name[o][1] not in known:
                known.add(name[o][1])
                kept.append((i, *name[o]))
    return sorted(kept)


def test_detection_against_plain_and_by_join(spark):
    rng = random.Random(5)
    aliases = [a for a, *_ in dims.alias_rows()]
    parts = [w for a in aliases for w in a.split()]
    rows = [(0, "Truffle butter lettuce", None), (1, "", ""), (2, None, None), (3, "T-bone Steak", "grass-fed beef")]
    rows += [(i, " ".join(rng.choice([rng.choice(aliases), rng.choice(parts), "and"]) for _ in range(rng.randint(0, 4))), ", ".join(rng.choice([rng.choice(aliases), rng.choice(parts)]) for _ in range(rng.randint(0, 9)))) for i in range(4, 500)]
    rows += [(7, "Rice Bowl", "beans"), (None, "Rice Bowl", "beans")]
    df = spark.createDataFrame(rows, "k int, dish_name string, description string")
    text = match_text(F.concat(F.coalesce("dish_name", F.lit("")), F.lit(" "), F.coalesce("description", F.lit(""))))
    shown = lambda d: sorted(((r["k"], r["t"], [(m["at"], m["raw_text"], m["normalized_name"]) for m in r["matches"]], r["phrases"], r["phrases_known"]) for r in d.withColumn("t", text).collect()), key=str)
    got = shown(detect_ingredients(df, ["k"]))
    assert len(got) == len(rows) and all(m == greedy(t) for _, t, m, *_ in got)
    one = df.where("k <> 7 OR k IS NULL")
    assert shown(detect_ingredients(one, ["k"], dims.aliases(spark), dims.nutrition(spark))) == shown(detect_ingredients(one, ["k"]))
    few = dims.aliases(spark).where("alias = 'rice'")
    assert {m[1] for _, _, ms, *_ in shown(detect_ingredients(one, ["k"], few)) for m in ms} == {"rice"}


def test_chained_overlaps_and_no_shuffle(spark):
    df = spark.createDataFrame([(1, "Truffle Butter Lettuce", "")], "k int, dish_name string, description string")
    (r,) = detect_ingredients(df, ["k"]).collect()
    assert [m["normalized_name"] for m in r["matches"]] == ["butter", "lettuce"]
    plan = detect_ingredients(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Generate", "Join"))
    assert not any(r["matches"] for r in detect_ingredients(df, ["k"], active=F.lit(False)).collect())
    assert estimate_macros(df.withColumn("section", F.lit("Salads")).withColumn("price", F.lit(1.0)), ["k"]).count() == 1
