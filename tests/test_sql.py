"""Queries over rules, menu forms and preparations against their SQL, and menus in blocks against menus as a whole."""

from pathlib import Path

import duckdb
import pytest

from menurank.operators.lines import menu_items, menu_lines
from menurank.plans import menu_forms, preparations, rule_cases

SF = Path("/root/testdata/sf0.001")
QUERIES = rule_cases.QUERIES | menu_forms.QUERIES | preparations.QUERIES
SQL = rule_cases.SQL | menu_forms.SQL | preparations.SQL


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.skipif(not SF.exists(), reason="no tables")
@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{SF}/part.parquet')")
    got = QUERIES[name](spark, str(SF))
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({SQL[name]})").fetchall()
    assert ordered(got.collect()) == ordered(want) and want


@pytest.mark.skipif(not SF.exists(), reason="no tables")
def test_menus_in_capitals_in_blocks(spark):
    m = menu_forms.form_menus(spark, str(SF)).orderBy("p_brand").limit(4)
    assert 0 < m.where("text = upper(text)").count() < 4
    assert ordered(menu_items(menu_lines(m)).collect()) == ordered(menu_items(menu_lines(m, block_lines=8), block_lines=8).collect())
