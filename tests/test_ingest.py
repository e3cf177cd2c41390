"""A whole ingest: gate, merge, record, and what a failure in between leaves."""

from datetime import datetime

import pytest

import seriesengine as se
from seriesengine.sources import pipeline

DAY = 1_704_067_200_000  # 2024-01-01 in milliseconds


def landed(spark, *hours, close=1.0):
    bars = ", ".join(f"[{DAY + h * 3_600_000}, 1, 2, 0, {close}]" for h in hours)
    return spark.createDataFrame([("a", f"[{bars}]")], "series string, value string")


@pytest.fixture
def run(spark, tmp_path):
    def call(hour, df):
        return se.ingest(
            "prices", df, se.parse_ohlc_json, str(tmp_path / "bars"), str(tmp_path / "state"), datetime(2024, 1, 2, hour),
            on=["series", "time"], cell=se.day_cell("time"),
        )

    call.rows = lambda: se.read_table(spark, str(tmp_path / "bars"), se.schemas.OHLC)
    return call


def test_gate_merge_and_record(spark, run):
    assert run(0, landed(spark, 1, 2, 3))
    assert not run(5, landed(spark, 4)) and run.rows().count() == 3
    assert run(6, landed(spark, 3, 4, close=9.0))
    assert sorted(r["close"] for r in run.rows().collect()) == [1.0, 1.0, 1.0, 9.0]
    assert not run(11, landed(spark, 5)) and run(12, landed(spark, 5)) and run.rows().count() == 5


def test_a_failure_before_the_record_leaves_the_source_due(spark, run, monkeypatch):
    def broken(*a, **k):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(pipeline, "replace_table", broken)
        with pytest.raises(OSError):
            run(0, landed(spark, 1, 2))
    assert run.rows().count() == 2
    assert run(0, landed(spark, 1, 2)) and run.rows().count() == 2


def test_an_empty_payload_stores_nothing(spark, run):
    with pytest.raises(Exception, match="no bars"):
        run(0, spark.createDataFrame([("a", "[]")], "series string, value string"))
    assert run.rows().count() == 0 and run(0, landed(spark, 1))


def test_a_page_without_articles_gives_no_rows(spark):
    page = '{"articles": [{"title": "t", "description": null, "url": "u", "publishedAt": "2024-01-01T00:00:00Z"}]}'
    rows = spark.createDataFrame([(page,), ('{"articles": []}',), ("{}",)], "value string")
    assert se.parse_news_json(rows).count() == 1
