"""A global order over many tasks, and the files that keep it."""

import random

import pytest

import seriesengine as se


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(rng.choice([None, rng.randrange(40)]), rng.randrange(1000), i) for i in range(2000)]
    return spark.createDataFrame(data, "a int, b int, id int").repartition(7)


def wanted(rows):
    return sorted((r["a"] is None, r["a"] or 0, r["b"], r["id"]) for r in rows.collect())


@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_positions(rows, partitions):
    got = se.global_positions(rows, ["a", "b", "id"], partitions=partitions).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(2000))
    assert [r["id"] for r in got] == [r[3] for r in wanted(rows)]
    assert got[0].asDict().keys() == {"a", "b", "id", "position"}


def test_positions_of_nothing(rows):
    assert se.global_positions(rows.limit(0), ["a"]).count() == 0


def test_sorted_files(spark, rows, tmp_path):
    path, order = str(tmp_path / "sorted"), ["a", "b", "id"]
    se.write_sorted(rows, path, order, partitions=6)
    back = spark.read.schema(rows.schema).parquet(path)
    assert back.inputFiles().__len__() > 1 and se.order_violations(back, path, order).isEmpty()
    lines = [r["id"] for f in sorted(back.inputFiles()) for r in spark.read.schema(rows.schema).parquet(f).coalesce(1).collect()]
    assert lines == [r[3] for r in wanted(rows)]
    other = str(tmp_path / "not_sorted")
    rows.write.parquet(other)
    assert not se.order_violations(spark.read.schema(rows.schema).parquet(other), other, order).isEmpty()
