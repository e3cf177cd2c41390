"""Slots of rows with very many copies, and of null groups and keys."""

from collections import defaultdict

import pytest

from seriesengine.llm import queries, sharding


@pytest.mark.parametrize("at_once", [10_000, 7])
def test_slots_are_gapless(spark, monkeypatch, at_once):
    monkeypatch.setattr(sharding, "COPIES_AT_ONCE", at_once)
    rows = [("a", 1)] * 500 + [("a", i) for i in range(50)] + [("b", None)] * 30 + [(None, 4)] * 20 + [(None, None)]
    df = spark.createDataFrame(rows, "g string, x long").repartition(5)
    got = sharding.number_slots(df, "g", ["x"], buckets=4).collect()
    by = defaultdict(list)
    for r in got:
        by[r.g].append(r.slot)
    assert {g: sorted(v) for g, v in by.items()} == {"a": list(range(550)), "b": list(range(30)), None: list(range(21))}


def test_query_with_a_null_key(spark, tmp_path):
    docs = [(None, "x"), (None, "x"), (0, None), (7, "é")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op1_jump_shards(spark, str(tmp_path)).collect()
    assert sorted(r["size"] for r in got) == [1, 2, 2, 3] and {r.law for r in got} == {"key"}
    assert len({r.shard for r in got if r.doc_id in (None, 0)}) == 1
    assert all(r.text_crc32 == 0 for r in got if r.doc_id == 0)
