"""Row windows against pandas, and cut series against whole ones."""

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import seriesengine as se
from seriesengine.operators import sequences
from seriesengine.operators.chunks import assign_chunks, plan_chunks
from conftest import collected


@pytest.fixture(scope="module")
def plan(walks):
    made = plan_chunks(walks, rows_per_chunk=64)
    assert made is not None
    assert made.cells.select("_chunk").distinct().count() > 5
    return made


def by_series(walks, f):
    pdf = collected(walks, "series", "time")
    return pd.concat([f(g) for _, g in pdf.groupby("series", sort=True)]).to_numpy(float)


CASES = {
    "mean": (
        lambda d, c: se.rolling_mean(d, "close", 7, "x", chunks=c),
        lambda g: g["close"].rolling(7).mean(),
    ),
    "partial mean": (
        lambda d, c: se.rolling_mean(d, "close", 5, "x", min_periods=1, chunks=c),
        lambda g: g["close"].rolling(5, min_periods=1).mean(),
    ),
    "std": (
        lambda d, c: se.rolling_std(d, "close", 7, "x", chunks=c),
        lambda g: g["close"].rolling(7).std(),
    ),
    "change": (
        lambda d, c: se.pct_change(d, "close", "x", chunks=c),
        lambda g: g["close"].ffill() / g["close"].ffill().shift() - 1,
    ),
    "unfilled change": (
        lambda d, c: se.pct_change(d, "close", "x", fill=False, chunks=c),
        lambda g: g["close"] / g["close"].shift() - 1,
    ),
    "diff": (lambda d, c: se.diff(d, "close", "x", chunks=c), lambda g: g["close"].diff()),
    "lag": (lambda d, c: se.lag(d, "close", 3, "x", chunks=c), lambda g: g["close"].shift(3)),
    "fill": (
        lambda d, c: se.forward_fill(d, {"close": "x"}, chunks=c),
        lambda g: g["close"].ffill(),
    ),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("cut", [False, True])
def test_matches_pandas(walks, plan, name, cut):
    ours, theirs = CASES[name]
    got = collected(ours(walks, plan if cut else None), "series", "time")
    assert len(got) == walks.count()
    np.testing.assert_allclose(got["x"].to_numpy(float), by_series(walks, theirs), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize(
    "operator",
    [
        se.moving_averages,
        se.lag_features,
        lambda d, chunks: se.ohlc_features(d, chunks=chunks),
        lambda d, chunks: se.seasonal_decompose(d.fillna(0.0), "close", 20, 40, chunks=chunks),
        lambda d, chunks: se.seasonal_decompose(d.fillna(0.0), "close", 7, 40, chunks=chunks),
        lambda d, chunks: se.chrono_split(d, chunks=chunks),
        lambda d, chunks: se.sequences(d.fillna(0.0), ["close", "open"], "close", 30, chunks=chunks),
        lambda d, chunks: se.sequence_frame(
            d.fillna(0.0), ["close"], "close", 30, (0.7, 0.85), ("a", "b", "c"), chunks=chunks
        ),
    ],
)
def test_cut_series_give_the_same_rows(walks, plan, operator):
    whole, cut = operator(walks, chunks=None), operator(walks, chunks=plan)
    assert whole.columns == cut.columns and whole.count() == cut.count()

    def settled(df):
        doubles = [c for c, t in df.dtypes if t == "double"]
        return df.withColumns({c: F.round(c, 6) for c in doubles})

    assert settled(whole).exceptAll(settled(cut)).isEmpty()


def test_market_features_cut(walks):
    metrics = walks.select(
        "series", "time", F.col("open").alias("price"), F.col("high").alias("market_cap"),
        (F.col("close") + 1000).alias("total_volume"),
    )
    plan = plan_chunks(metrics, rows_per_chunk=70)
    whole = se.market_features(metrics, chunks=None)
    cut = se.market_features(metrics, chunks=plan)
    a, b = (collected(d, "series", "time") for d in (whole, cut))
    assert len(a) == len(b) > 400
    np.testing.assert_allclose(a.iloc[:, 2:], b.iloc[:, 2:], rtol=1e-9, atol=1e-9)


def test_a_burst_in_time_and_missing_times(spark):
    """Most rows within seconds, some years away, some without a time (sorted last)."""
    pdf = pd.DataFrame({"i": range(1000)})
    df = spark.createDataFrame(pdf).select(
        F.lit("a").alias("series"),
        F.when(F.col("i") < 900, F.timestamp_seconds(F.col("i")))
        .when(F.col("i") < 999, F.timestamp_seconds(F.col("i") * 10_000_000))
        .alias("time"),
        F.col("i").cast("double").alias("v"),
    )
    plan = plan_chunks(df, rows_per_chunk=50)
    whole = se.rolling_mean(df, "v", 9, "x", chunks=None)
    cut = se.rolling_mean(df, "v", 9, "x", chunks=plan)
    assert whole.exceptAll(cut).isEmpty() and cut.count() == 1000
    # The burst is cut too: 900 rows in one cell of the first level.
    assert len(plan.levels) > 1
    sizes = assign_chunks(df, plan).groupBy("_chunk").count()
    assert sizes.agg(F.max("count")).first()[0] <= 100


def test_rows_of_one_time_stay_together(spark):
    df = spark.range(200).select(
        F.lit("a").alias("series"), F.timestamp_seconds(F.lit(0)).alias("time"), "id",
        F.col("id").cast("double").alias("v"),
    ).unionByName(
        spark.range(50).select(
            F.lit("a").alias("series"), F.timestamp_seconds(F.col("id") + 1).alias("time"),
            (F.col("id") + 1000).alias("id"), F.col("id").cast("double").alias("v"),
        )
    )
    plan = plan_chunks(df, rows_per_chunk=30)

    def summed(chunks):
        def build(d, w):
            return d.withColumn("x", F.sum("v").over(w.rowsBetween(-4, 0)))

        return se.over_rows(df, build, ties=["id"], before=4, chunks=chunks)

    assert summed(None).exceptAll(summed(plan)).isEmpty()


@pytest.mark.parametrize("rows_per_range", [10_000, 7, 1])
def test_hash_split_is_exact_and_independent_of_ranges(walks, monkeypatch, rows_per_range):
    whole = se.hash_split(walks)
    monkeypatch.setattr(sequences, "ROWS_PER_RANGE", rows_per_range)
    sizes = {(r[0], r[1]): r[2] for r in whole.groupBy("series", "split").count().collect()}
    assert sizes[("long", "test")] == 180 and sizes[("short", "test")] == 8
    assert sizes[("tiny", "test")] == 1
    again = se.hash_split(walks.repartition(5))
    assert whole.exceptAll(again).isEmpty() and again.count() == whole.count()


def test_reach_must_fit_the_chunk(walks):
    plan = plan_chunks(walks, rows_per_chunk=10)
    with pytest.raises(ValueError):
        se.rolling_mean(walks, "close", 30, "x", chunks=plan)


def test_keys_are_needed(walks):
    with pytest.raises(ValueError):
        se.plan_chunks(walks, keys=())


@pytest.mark.parametrize("cut", [False, True])
def test_ties_are_ordered_by_the_columns_named(spark, cut):
    rows = [("a", datetime(2024, 1, 1 + i // 3), i, float((7 * i) % 11) if i % 4 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "series string, time timestamp, id int, close double")
    pdf = pd.DataFrame(rows, columns=["series", "time", "id", "close"])
    want = pd.DataFrame({"id": pdf["id"], "mean": pdf["close"].rolling(4, min_periods=1).mean(), "lagged": pdf["close"].shift(1),
                         "change": pdf["close"].ffill().pct_change(fill_method=None).replace([np.inf, -np.inf], np.nan)})
    for seed in (1, 2):
        shuffled = df.orderBy(F.rand(seed)).repartition(5)
        chunks = se.plan_chunks(shuffled, rows_per_chunk=20) if cut else None
        out = se.rolling_mean(shuffled, "close", 4, "mean", 1, ties=["id"], chunks=chunks)
        out = se.lag(out, "close", 1, "lagged", ties=["id"], chunks=chunks)
        out = se.pct_change(out, "close", "change", ties=["id"], chunks=chunks)
        got = out.orderBy("id").toPandas()
        for c in ("mean", "lagged", "change"):
            np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-9)
        tail = se.series_tail(shuffled, 5, ties=["id"])
        assert sorted(r["id"] for r in tail.collect()) == [55, 56, 57, 58, 59]
        split = se.chrono_split(shuffled, ties=["id"], chunks=chunks).where("split = 'train'")
        assert sorted(r["id"] for r in split.collect()) == list(range(42))
