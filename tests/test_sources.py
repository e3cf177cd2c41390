"""Files, payloads, checks, merges and the freshness gate."""

from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

import seriesengine as se
from seriesengine import schemas as S
from seriesengine.sources.files import missing_as_null
from conftest import collected

BARS = S.without_series(S.OHLC)


def write(path, text):
    path.write_text(text)
    return str(path)


def test_csv(spark, tmp_path):
    path = write(
        tmp_path / "a.csv",
        "time,open,high,low,close\n2023-01-01,1,2,0.5,1.5\n2023-01-02 04:00:00,NaN,2,,1\n",
    )
    got = collected(se.read_series(spark, path, BARS, "csv"), "time")
    assert str(got["time"][1]) == "2023-01-02 04:00:00"
    assert got["open"].isna().tolist() == [False, True] and got["low"].isna().tolist() == [False, True]


def test_nan_is_null_after_loading(spark):
    df = missing_as_null(spark.createDataFrame([(float("nan"),), (1.0,)], "v double"))
    assert df.where("v is null").count() == 1


def test_alternate_time_header(spark, tmp_path):
    path = write(tmp_path / "a.csv", "timestamp,open,high,low,close\n2024-01-22,1,2,0.5,1.5\n")
    assert se.read_series(spark, path, BARS, "csv", time_col="timestamp").columns[0] == "time"
    with pytest.raises(Exception):
        se.read_series(spark, path, BARS, "csv").collect()


def test_malformed_time_is_strict_or_lenient(spark, tmp_path):
    path = write(tmp_path / "a.csv", "time,open,high,low,close\nsoon,1,2,0.5,1.5\n")
    with pytest.raises(Exception):
        se.read_series(spark, path, BARS, "csv").collect()
    assert se.read_series(spark, path, BARS, "csv", strict=False).first()["time"] is None


def test_missing_path(spark, tmp_path):
    assert se.read_series(spark, str(tmp_path / "no"), BARS, missing_ok=True).count() == 0
    with pytest.raises(Exception):
        se.read_series(spark, str(tmp_path / "no"), BARS)


def test_quoted_news_csv(spark, tmp_path):
    path = write(
        tmp_path / "n.csv",
        'title,description,url,published_at\n"A, ""b""","two\nlines",u,2025-01-16 11:00:00+00:00\n',
    )
    row = se.read_series(spark, path, S.NEWS, "csv", multi_line=True).first()
    assert row["title"] == 'A, "b"' and row["description"] == "two\nlines"
    assert row["published_at"] == datetime(2025, 1, 16, 11)


@pytest.mark.parametrize("fmt", ["parquet", "orc", "csv", "json"])
def test_write_and_read_back(spark, tmp_path, slopes, fmt):
    path = str(tmp_path / fmt)
    se.write_series(slopes, path, fmt=fmt)
    back = se.read_series(spark, path, S.OHLC, fmt)
    assert slopes.exceptAll(back).isEmpty() and back.count() == 105


def test_partitioned_write_and_self_overwrite(spark, tmp_path, slopes):
    path = str(tmp_path / "t")
    se.write_series(slopes, path, partition_by=["series"])
    again = spark.read.parquet(path)
    assert again.where("series = 'down'").count() == 41
    with pytest.raises(ValueError):
        se.write_series(again, path)


def test_checks(spark, slopes):
    with pytest.raises(ValueError, match="volume"):
        se.require_columns(slopes, ["close", "volume"])
    with pytest.raises(ValueError):
        se.require_columns(slopes, ["close"], min_rows=106)
    with pytest.raises(ValueError):
        se.ohlc_features(slopes.limit(0))
    with pytest.raises(ValueError):
        se.ohlc_features(slopes.unionByName(slopes.limit(1)))
    lost = slopes.limit(2).withColumn("time", F.lit(None).cast("timestamp"))
    assert se.duplicate_times(lost).first()["copies"] == 2
    assert se.quality_report(lost, ["time", "close"]).first()[1:] == (2, 2, 0)


def one(spark, text):
    return spark.createDataFrame([(text,)], "value string")


def test_payloads(spark):
    bars = se.parse_ohlc_json(one(spark, "[[1700000000000, 1, 2, 0.5, 1.5], [1700014400000, 2, 3, 1, 2]]"))
    assert bars.count() == 2 and str(bars.first()["time"]) == "2023-11-14 22:13:20"
    market = se.parse_market_json(
        one(spark, '{"prices": [[0, 1.5]], "market_caps": [[9, 2.5]], "total_volumes": [[9, 3.5]]}')
    )
    assert market.first()[1:] == (1.5, 2.5, 3.5) and market.first()["time"].year == 1970
    news = se.parse_news_json(
        one(
            spark,
            '{"articles": [{"title": "t", "description": null, "url": "u", "publishedAt": '
            '"2025-01-16T11:00:00Z"}, {"title": "x", "publishedAt": null}]}',
        )
    )
    assert news.count() == 1 and news.first()["description"] is None


@pytest.mark.parametrize(
    "parse, text",
    [
        (se.parse_ohlc_json, "[]"),
        (se.parse_market_json, '{"market_caps": []}'),
        (se.parse_market_json, '{"prices": [[0, 1]], "market_caps": [], "total_volumes": [[0, 1]]}'),
        (se.parse_news_json, '{"articles": []}'),
    ],
)
def test_unusable_payloads_are_errors(spark, parse, text):
    with pytest.raises(Exception):
        parse(one(spark, text)).collect()


def test_merge_keeps_the_stored_row_and_is_idempotent(spark):
    stored = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0), (None, 1, 5.0)], "k string, t int, v double")
    batch = spark.createDataFrame([("a", 2, 99.0), ("a", 3, 30.0), (None, 1, 6.0), ("a", 3, 31.0)], stored.schema)
    merged = se.merge_keep_first(stored, batch, ["k", "t"], ["v"])
    want = {("a", 1, 10.0), ("a", 2, 20.0), ("a", 3, 30.0), (None, 1, 5.0)}
    assert {tuple(r) for r in merged.collect()} == want
    assert {tuple(r) for r in se.merge_keep_first(merged, batch, ["k", "t"], ["v"]).collect()} == want
    assert [tuple(r) for r in se.new_rows(stored, batch, ["k", "t"], ["v"]).collect()] == [("a", 3, 30.0)]


def test_freshness_is_strict(spark):
    now = datetime(2025, 2, 8, 12)
    rows = [("fresh", datetime(2025, 2, 8, 6, 0, 1)), ("due", datetime(2025, 2, 8, 6)), ("never", None)]
    state = spark.createDataFrame(rows, S.INGEST_STATE)
    assert {r[0] for r in se.due_for_ingest(state, now).collect()} == {"due", "never"}
    after = se.record_ingest(state, "due", now)
    assert {r[0] for r in se.due_for_ingest(after, now).collect()} == {"never"} and after.count() == 3


def test_column_helpers(spark):
    df = spark.createDataFrame([(1.0, None, 0.0), (None, None, 2.0)], "a double, b double, c double")
    got = df.select(
        se.row_mean("a", "b").alias("m"), se.ratio("a", "c").alias("r"),
        se.sentiment_class("a").alias("s"),
    ).collect()
    assert [tuple(r) for r in got] == [(1.0, None, "Positive"), (None, None, "Neutral")]


def test_overlay_and_latest(spark, slopes):
    daily = se.daily_average(slopes)
    forecast = daily.withColumnRenamed("average_price", "predicted_price")
    assert se.chart_overlay(daily, forecast).groupBy("kind").count().count() == 2
    news = slopes.where("series = 'up'").select(F.col("time").alias("published_at"), F.lit("u").alias("url"), F.lit("t").alias("title"))
    assert se.latest_articles(news, 7).agg(F.min("published_at")).first()[0] == datetime(2021, 4, 29)
