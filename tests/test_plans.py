"""What the driver has to plan for judging dishes, and cards as dishes against their SQL."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from menurank.functions.classify import DISH_RULES
from menurank.plans import rendered
from menurank.plans.pipeline import block_dishes, with_macros

SF = Path("/root/testdata/sf0.001")


def test_cascades_are_planned_once_and_no_text_is_folded(spark):
    blocks = spark.createDataFrame([(1, 0, "Chicken Bowl", "with rice and beans", "Bowls", "Chicken Bowl $9"), (1, 1, "House Lemonade", None, "Drinks", "")], "page_id long, pos long, name string, description string, section string, text string")
    judged = with_macros(block_dishes(blocks), F.col("read"))
    fields = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    plan = judged._jdf.queryExecution().analyzed().toString()
    spark.conf.set("spark.sql.debug.maxToStringFields", fields)
    rule = next(p for k, p in DISH_RULES if k == "burger").split("|")[-1].replace(r"\b", "")
    assert plan.count(rule) == 2  # over the name and over the description
    assert "str_to_map(" not in plan and "split(grilled" not in plan  # folding a function of texts, the driver loads all collations
    kept = {r.dish_name: r.exclusion_reason for r in judged.collect()}
    assert kept["Chicken Bowl"] is None and kept["House Lemonade"]


@pytest.mark.skipif(not SF.exists(), reason="no tables")
def test_card_extraction_reads_cards_once_and_equals_its_sql(spark):
    got = rendered.card_extraction(spark, str(SF))
    plan = got._jdf.queryExecution().optimizedPlan()
    assert "InMemoryRelation" not in plan.toString() and plan.toString().count("LogicalRDD [page_id") == 1
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{SF}/part.parquet')")
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({rendered.SQL['card_extraction']})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and want
