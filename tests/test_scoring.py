import itertools
import random

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from menurank.operators.scoring import each_goal, for_goal, rank_meals, score_meals, top_meals

SAMPLE = [
    ("Grilled Chicken Bowl", 480, 44, 42, 14), ("Salmon Plate", 560, 40, 34, 26), ("Turkey Avocado Wrap", 520, 32, 46, 22), ("Steak Rice Bowl", 690, 46, 58, 28), ("Veggie Grain Bowl", 540, 18, 72, 20),
    ("Chicken Caesar Wrap", 610, 36, 40, 32), ("Tofu Power Bowl", 500, 26, 54, 18), ("Classic Cheeseburger", 780, 34, 44, 48), ("Pasta Alfredo", 850, 22, 88, 44), ("Shrimp Taco Plate", 590, 34, 56, 22),
    ("Mediterranean Chicken Plate", 620, 48, 50, 22), ("BBQ Pulled Pork Bowl", 720, 38, 66, 30),
]
SCORES = {
    "Grilled Chicken Bowl": (83, 82, 75), "Salmon Plate": (72, 76, 70), "Turkey Avocado Wrap": (70, 72, 65), "Steak Rice Bowl": (65, 76, 76), "Veggie Grain Bowl": (49, 47, 43), "Chicken Caesar Wrap": (64, 71, 68),
    "Tofu Power Bowl": (67, 65, 59), "Classic Cheeseburger": (46, 58, 66), "Pasta Alfredo": (24, 33, 38), "Shrimp Taco Plate": (65, 73, 67), "Mediterranean Chicken Plate": (73, 81, 77), "BBQ Pulled Pork Bowl": (57, 69, 71),
}


def meals(spark, rows, category="entree"):
    return spark.createDataFrame([(1, i, r[0], r[5] if len(r) > 5 else category, *map(float, r[1:5])) for i, r in enumerate(rows)], "page_id int, item_pos int, name string, category string, calories double, protein_g double, carbs_g double, fat_g double")


def score(spark, goal, *macros):
    return score_meals(for_goal(meals(spark, [("x", *macros)]), goal)).first()


def test_scores_of_the_sample(spark):
    rows = score_meals(each_goal(meals(spark, SAMPLE))).select("name", "goal", "score").collect()
    found = {(r["name"], r["goal"]): r["score"] for r in rows}
    assert found == {(n, g): s for n, scores in SCORES.items() for g, s in zip(("cut", "maintain", "bulk"), scores, strict=True)}


@pytest.mark.parametrize(
    ("goal", "better", "worse"),
    [
        ("cut", (490, 35, 14, 32), (525, 35, 38, 23)), ("maintain", (550, 45, 40, 18), (550, 30, 55, 20)), ("bulk", (900, 60, 20, 55), (900, 45, 110, 20)), ("cut", (395, 47, 40, 5), (445, 45, 31, 15)),
        ("cut", (500, 40, 45, 15), (900, 40, 90, 40)), ("bulk", (750, 45, 70, 25), (1000, 18, 120, 45)),
    ],
)
def test_orderings(spark, goal, better, worse):
    assert score(spark, goal, *better)["score"] > score(spark, goal, *worse)["score"]


def test_caps_and_penalties(spark):
    assert score(spark, "cut", 150, 14, 10, 3)["score"] == 45
    assert score(spark, "cut", 180, 28, 5, 4)["score"] == 75
    assert score(spark, "cut", 290, 36, 10, 6)["score"] > 75
    assert score(spark, "bulk", 810, 35, 92, 31)["score"] < 0.85 * score(spark, "bulk", 790, 35, 90, 30)["score"]
    r = score(spark, "maintain", 520, 20, 60, 20)
    assert r["penalties"] == ["poorProteinRatio"]
    assert score(spark, "cut", 0, 0, 0, 0)["score"] == 19
    assert score(spark, "keto", 500, 30, 55, 20)["score"] == score(spark, "maintain", 500, 30, 55, 20)["score"]


def test_bounds_order_and_badges(spark):
    grid = [(f"m{i}", *m) for i, m in enumerate(itertools.product((0, 290, 520, 805, 2000), (0, 14, 22, 45), (0, 60), (0, 30, 80)))]
    rows = score_meals(each_goal(meals(spark, grid))).collect()
    assert all(0 <= r["score"] <= 100 and len(r["badges"]) <= 3 and r["explanation"] for r in rows)
    assert all(r["score"] <= 45 for r in rows if "veryLowProtein" in r["caps"])
    ranked = rank_meals(score_meals(each_goal(meals(spark, SAMPLE + [("Lobster Tail", 170, 25, 1, 7, "side"), ("Soda", 150, 0, 39, 0, "drink")]))), ["page_id"], ["item_pos"])
    rows = {(r["name"], r["goal"]): r for r in ranked.collect()}
    assert ("Soda", "cut") not in rows
    assert rows["Lobster Tail", "cut"]["rank"] == 13 and rows["Lobster Tail", "cut"]["badges"][0] == "Side dish"
    assert rows["Grilled Chicken Bowl", "cut"]["rank"] == 1 and rows["Grilled Chicken Bowl", "cut"]["badges"][0] == "Best Match"
    top = top_meals(score_meals(each_goal(meals(spark, SAMPLE))), ["page_id"], ["item_pos"])
    assert top.count() == 15
    other = top_meals(score_meals(each_goal(meals(spark, SAMPLE).orderBy(F.desc("name")))), ["page_id"], ["item_pos"])
    assert sorted(map(str, top.collect())) == sorted(map(str, other.collect()))


def test_ranks_by_range(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.choice(["entree", "side", "drink"]), "balanced", rng.choice([10, 50, 51, None]), rng.choice([0.0, 20.2, 20.9, 21.0, float("nan"), None]), rng.choice([300.0, 500.0]), ["x"]) for g in (None, 1, 2) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, i int, category string, goal string, score int, protein_g double, calories double, badges array<string>")
    plain, ranged = (rank_meals(df, ["page_id"], ["i"], by_range=by) for by in (False, True))
    assert ranged.schema["rank"].dataType == plain.schema["rank"].dataType
    columns = plain.columns
    assert sorted(map(repr, ranged.select(columns).collect())) == sorted(map(repr, plain.collect()))


def test_ranges_without_checkpoints(spark, monkeypatch):
    monkeypatch.setattr(DataFrame, "checkpoint", None)
    rng = random.Random(2)
    rows = [(g, i, rng.choice(["entree", "side"]), "balanced", rng.choice([10, 50, None]), rng.choice([0.0, 20.2, 20.9, 21.0, None]), 300.0, ["x"]) for g, n in ((None, 90), (1, 30), (2, 70)) for i in range(n)]
    df = spark.createDataFrame(rows, "page_id long, i int, category string, goal string, score int, protein_g double, calories double, badges array<string>")
    plain = sorted(map(repr, rank_meals(df, ["page_id"], ["i"]).collect()))
    for most in (1, 70, 1000):
        ranged = rank_meals(df, ["page_id"], ["i"], by_range=True, most_in_range=most)
        assert sorted(map(repr, ranged.collect())) == plain


def test_ranges_shuffle_little_more_than_the_meals(spark, monkeypatch):
    def written(rows):
        status = spark.sparkContext._jsc.sc().statusStore()
        stages = lambda: status.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        before = {stages().apply(i).stageId() for i in range(stages().size())}
        found = rows.collect()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        now = [stages().apply(i) for i in range(stages().size())]
        return found, sum(x.shuffleWriteRecords() for x in now if x.stageId() not in before)

    rng = random.Random(3)
    rows = [(g, i, rng.choice(["entree", "side"]), goal, rng.randrange(101), float(rng.randrange(60)), 300.0 + rng.randrange(9), ["x"]) for g in (None, 1, 2) for goal in ("cut", "bulk", "maintain") for i in range(800)]
    df = spark.createDataFrame(rows, "page_id long, i int, category string, goal string, score int, protein_g double, calories double, badges array<string>")
    plain = sorted(map(repr, rank_meals(df, ["page_id"], ["i"]).collect()))
    ranged = rank_meals(df, ["page_id"], ["i"], by_range=True)
    found, records = written(ranged)
    assert sorted(map(repr, found)) == plain and records < 1.1 * len(rows)
    # a meal's goals are together, if they are not large
    assert ranged.select("page_id", F.spark_partition_id().alias("task")).distinct().count() == 3
    # large groups are dealt out by range; many meals to more tasks than the session's
    monkeypatch.setattr("menurank.operators.scoring.MEALS_OF_A_TASK", 1000)
    ranged = rank_meals(df, ["page_id"], ["i"], by_range=True, most_in_range=500)
    assert sorted(map(repr, ranged.collect())) == plain
    assert ranged.select("page_id", F.spark_partition_id().alias("task")).distinct().count() > 12
