"""Tables that change by pointer: whole versions, failures in between, merges that read few files."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import seriesengine as se
from seriesengine.sources import tables

SCHEMA = "series string, time timestamp, value double"
DAY = datetime(2024, 1, 1)


def rows(spark, days, value=1.0, series="a"):
    return spark.createDataFrame([(series, DAY + timedelta(days=d), value) for d in days], SCHEMA)


def stored(spark, path, version=None):
    return se.read_table(spark, path, rows(spark, [0]).schema, version)


def test_replace_reads_its_own_input_and_old_versions_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    assert stored(spark, path).count() == 0 and se.table_version(spark, path) == 0
    assert se.replace_table(rows(spark, range(10)), path) == 1
    before = stored(spark, path)
    assert se.replace_table(stored(spark, path).where("time < '2024-01-04'"), path) == 2
    assert stored(spark, path).count() == 3 and stored(spark, path, 1).count() == 10 and before.count() == 10
    assert se.append_table(rows(spark, [50]), path) == 3 and stored(spark, path).count() == 4
    assert se.replace_table(rows(spark, []), path) == 4 and stored(spark, path).count() == 0
    assert se.drop_unused(spark, path) > 0 and stored(spark, path).count() == 0


def test_a_failure_before_the_commit_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    se.replace_table(rows(spark, range(5)), path)

    def broken(self, source, target):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(tables._Files, "rename", broken)
        with pytest.raises(OSError):
            se.replace_table(rows(spark, range(99)), path)
    assert stored(spark, path).count() == 5 and se.table_version(spark, path) == 1
    assert se.drop_unused(spark, path) == 2  # the data and the entry that were put aside
    assert stored(spark, path).count() == 5


def test_two_writers_cannot_both_write_a_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    se.replace_table(rows(spark, range(5)), path)
    monkeypatch.setattr(tables, "table_version", lambda *a: 0)
    with pytest.raises(se.ConcurrentWrite):
        se.append_table(rows(spark, [7]), path)
    monkeypatch.undo()
    assert stored(spark, path).count() == 5


def test_a_named_write_happens_once(spark, tmp_path):
    path = str(tmp_path / "t")
    for _ in range(2):
        se.append_table(rows(spark, range(4)), path, txn="q:0")
    se.append_table(rows(spark, [9]), path, txn="q:1")
    assert stored(spark, path).count() == 5
    assert tables.version_before(spark, path, "q:1") == 1 and tables.version_before(spark, path, "q:2") == 2


def test_merge_keeps_stored_rows_and_opens_only_files_of_the_batch(spark, tmp_path):
    path, cell = str(tmp_path / "t"), se.day_cell("time")
    for start in range(0, 400, 40):  # ten writes of forty days
        se.merge_table(rows(spark, range(start, start + 40)), path, ["series", "time"], cell=cell)
    batch = rows(spark, [395, 396, 400, 401], 9.0).unionByName(rows(spark, [401], 5.0))
    everything = se.table_files(spark, path).where("file is not null").select("file").distinct().count()
    opened = se.files_for(batch, path, cell).select("file").distinct().count()
    assert 1 <= opened <= everything / 10
    se.merge_table(batch, path, ["series", "time"], ["value"], cell=cell)
    got = stored(spark, path)
    assert got.count() == 402 and got.where("value = 9").count() == 1 and got.where("value = 5").count() == 1
    late = rows(spark, [3, 1000], 7.0)
    se.merge_table(late, path, ["series", "time"], cell=cell)
    assert stored(spark, path).where("value = 7").count() == 1


def test_keys_without_a_cell_are_found(spark, tmp_path):
    path, cell = str(tmp_path / "t"), se.day_cell("time")
    lost = spark.createDataFrame([("a", None, 1.0)], SCHEMA)
    se.merge_table(rows(spark, range(5)).unionByName(lost), path, ["series", "time"], cell=cell)
    se.merge_table(lost.withColumn("value", F.lit(2.0)), path, ["series", "time"], cell=cell)
    assert stored(spark, path).count() == 6 and stored(spark, path).where("value = 2").isEmpty()


def test_articles_by_hash_cells(spark, tmp_path):
    path, cell = str(tmp_path / "t"), se.hash_cell("title", "url")
    articles = spark.createDataFrame([(f"t{i % 50}", f"u{i % 3}", i) for i in range(300)], "title string, url string, id int")
    se.merge_table(articles.where("id < 100"), path, ["title", "url"], ["id"], cell=cell)
    se.merge_table(articles, path, ["title", "url"], ["id"], cell=cell)
    got = se.read_table(spark, path, articles.schema)
    want = se.keep_first(articles, ["title", "url"], ["id"])
    assert got.exceptAll(want).isEmpty() and got.count() == want.count() == 150
