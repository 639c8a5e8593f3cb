import pytest
from pyspark.sql import functions as F

from menurank.plans.pipeline import extract, give_out, linked_pdfs
from menurank.sources.pages import RESULTS, read_binary, read_results, read_text, write_results

MENU = "BOWLS\n\nBaja Chicken Bowl ... $14.50\ngrilled chicken, brown rice and beans\n\nSalmon Plate ... $18\nsalmon, rice and broccoli\n"


class Lost(Exception):
    pass


def test_batches_are_whole_or_absent_and_once(spark, tmp_path):
    folder = str(tmp_path / "out")
    found = extract(spark.createDataFrame([(1, MENU), (2, "nothing here")], "page_id long, text string"))
    tables = (found.items, found.excluded, found.report)
    write_results(*tables, folder, "2024-01")

    class Breaks:  # an executor is lost for good while the second table is written
        write = property(lambda self: (_ for _ in ()).throw(Lost()))

    with pytest.raises(Lost):
        write_results(found.items.withColumn("page_id", F.lit(9).cast("long")), Breaks(), found.report, folder, "2024-02")
    assert {r["page_id"] for r in read_results(spark, folder, "items").collect()} == {1}
    later = extract(spark.createDataFrame([(3, MENU)], "page_id long, text string"))
    for _ in range(2):  # and again after it was done
        write_results(later.items, later.excluded, later.report, folder, "2024-02")
    assert sorted(r["page_id"] for r in read_results(spark, folder, "items").collect()) == [1, 1, 3, 3]
    assert sorted(r["page_id"] for r in read_results(spark, folder, "page_report").collect()) == [1, 2, 3]
    write_results(later.items.limit(0), later.excluded, later.report.limit(0), folder, "2024-02")  # corrected to nothing
    assert sorted(r["page_id"] for r in read_results(spark, folder, "items").collect()) == [1, 1]
    assert all("batch" not in read_results(spark, folder, name).columns for name in RESULTS)
    with pytest.raises(ValueError):
        write_results(*tables, folder, "a/b")
    assert found.judged.is_cached
    found.release()
    later.release()
    assert not found.judged.is_cached


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text(MENU)
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.7 x")
    (text,) = read_text(spark, str(tmp_path / "a.txt")).collect()
    assert text["text"] == MENU
    (page,) = read_binary(spark, str(tmp_path / "b.pdf")).collect()
    assert bytes(page["content"]) == b"%PDF-1.7 x"


def test_work_lists(spark, tmp_path):
    folder = str(tmp_path / "out")
    links = spark.createDataFrame([(1, 0, "a", True), (1, 1, "b", True), (1, 2, "c", False), (2, 0, "a", True), (3, 0, "x", True)], "page_id long, pos int, href string, confident boolean")
    items = spark.createDataFrame([(3,)], "page_id long")
    pairs = lambda df: sorted((r["page_id"], r["href"]) for r in df.collect())
    assert pairs(give_out(links, items, folder, "1")) == [(1, "a"), (2, "a")]
    assert pairs(give_out(links, items, folder, "1")) == [(1, "a"), (2, "a")]  # run again
    # the second batch's list was written, but the job was lost before its manifest
    linked_pdfs(links, items, spark.createDataFrame([(1, "a"), (2, "a")], "page_id long, href string")).write.parquet(f"{folder}/work/batch=2")
    assert pairs(read_results(spark, folder, "work", manifest="work_manifest")) == [(1, "a"), (2, "a")]
    assert pairs(give_out(links, items, folder, "2")) == [(1, "b")]
    assert pairs(give_out(links, items, folder, "3")) == []
    assert pairs(read_results(spark, folder, "work", manifest="work_manifest")) == [(1, "a"), (1, "b"), (2, "a")]
