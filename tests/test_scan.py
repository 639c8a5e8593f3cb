import random

from pyspark.sql import functions as F

from menurank.operators.lines import menu_items, menu_lines
from menurank.operators.scan import dealt, running


def test_blocks_equal_windows(spark):
    rng = random.Random(3)
    rows = [(g, p, rng.choice([None, 1, 2, 5]), rng.choice([None, "a", "b"])) for g in (None, 1, 2) for p in sorted(rng.sample(range(100), 40))] + [(3, 7, None, None)]
    df = spark.createDataFrame(rows, "g long, pos int, n int, s string")
    wanted = {"sums": {"so_far": F.col("n")}, "lasts": {"last_s": F.col("s")}, "befores": {"before": F.col("s")}, "nexts": {"after": F.col("n")}, "totals": {"all_n": F.col("n")}}
    plain = running(df, ["g"], ["pos"], **wanted)
    for size in (1, 7):
        split = running(df, ["g"], ["pos"], [F.floor(F.col("pos") / size)], **wanted)
        assert split.columns == plain.columns and sorted(map(repr, split.collect())) == sorted(map(repr, plain.collect()))
    # and by hand
    for g in (None, 1, 2, 3):
        own, total, last = sorted([r for r in rows if r[0] == g], key=lambda r: r[1]), 0, None
        found = sorted([r for r in plain.collect() if r["g"] == g], key=lambda r: r["pos"])
        for i, (r, f) in enumerate(zip(own, found, strict=True)):
            total, last = total + (r[2] or 0), r[3] or last
            assert (f["so_far"], f["last_s"], f["all_n"]) == (total, last, sum(x[2] or 0 for x in own))
            assert f["before"] == (own[i - 1][3] if i else None) and f["after"] == (own[i + 1][2] if i + 1 < len(own) else None)


LINES = [
    "BOWLS", "Sandwiches", "", "", "Baja Chicken Bowl ... $14.50", "Salmon Plate", "$18", "12.50", "grilled chicken, brown rice and beans", "served warm with a side of the day", "two, three", "add shrimp +3", "* 4.00", "Page 1 of 3",
    "House Salad 9 / 12", "www.example.com", "A line that ends here.", "KIDS MENU", "CHICKEN PLATE", "...",
]


def test_long_pages_in_blocks(spark):
    rng = random.Random(5)
    pages = [(i, "\n".join(rng.choice(LINES) for _ in range(rng.choice([0, 1, 5, 60])))) for i in range(30)] + [(30, None), (31, "\n".join(["Salmon Plate", *["fish, rice and greens", "5.00"] * 40]))]
    df = spark.createDataFrame(pages, "page_id long, text string")
    lines = menu_lines(df)
    items = menu_items(lines)
    assert items.count() > 100
    for size in (1, 7):
        split = menu_lines(df, block_lines=size)
        assert sorted(map(repr, split.collect())) == sorted(map(repr, lines.collect()))
        assert sorted(map(repr, menu_items(split, block_lines=size).collect())) == sorted(map(repr, items.collect()))
    assert menu_items(menu_lines(df.limit(0), block_lines=4), block_lines=4).count() == 0


def test_work_is_dealt_out(spark):
    df = spark.createDataFrame([(i, "Salmon Plate 5.00") for i in range(50)], "page_id long, text string").coalesce(1)
    rows = dealt(df, ["page_id"])
    assert df.rdd.getNumPartitions() == 1 and rows.rdd.getNumPartitions() == 2 and rows.count() == 50
    plan = menu_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
