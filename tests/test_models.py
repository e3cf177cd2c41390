"""Decomposition, scaling, regression and recursion against numpy."""

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import seriesengine as se
from seriesengine.operators.scaling import apply_minmax, fit_minmax, invert_minmax
from conftest import collected, to_spark, walk_frame


def numpy_decomposition(x, period):
    half = period // 2
    kernel = np.ones(period) if period % 2 else np.r_[0.5, np.ones(period - 1), 0.5]
    trend = np.full(len(x), np.nan)
    trend[half: len(x) - half] = np.convolve(x, kernel / period, "valid")
    raw = np.array([np.nanmean((x - trend)[p::period]) for p in range(period)])
    seasonal = np.resize(raw - raw.mean(), len(x))
    return trend, seasonal, x - trend - seasonal


@pytest.mark.parametrize("period", [7, 12, 365])
def test_decomposition(spark, period):
    pdf = walk_frame(900, "a", 5)
    got = collected(se.seasonal_decompose(to_spark(spark, pdf), period=period), "time")
    for name, want in zip(("trend", "seasonal", "residual"), numpy_decomposition(pdf["close"].to_numpy(), period)):
        np.testing.assert_allclose(got[name].to_numpy(float), want, rtol=1e-9, atol=1e-8)


@pytest.mark.parametrize("n, zero", [(729, True), (730, False), (731, False)])
def test_decomposition_threshold(spark, n, zero):
    got = se.seasonal_decompose(to_spark(spark, walk_frame(n, "a", 6)))
    assert got.where("trend = 0 and seasonal = 0 and residual = 0").count() == (n if zero else 0)


def test_decomposition_with_a_missing_value_is_zero(spark):
    pdf = walk_frame(800, "a", 7)
    pdf.loc[400, "close"] = np.nan
    assert se.seasonal_decompose(to_spark(spark, pdf)).where("trend <> 0 or trend is null").isEmpty()


def test_minmax_round_trip_and_constant(spark):
    df = to_spark(spark, pd.concat([walk_frame(30, "a", 1), walk_frame(20, "b", 2)])).withColumn(
        "flat", F.lit(5.0)
    )
    cols = ["open", "close", "flat"]
    params = fit_minmax(df, cols)
    scaled = apply_minmax(df, params, cols)
    assert scaled.where("flat <> 0 or close < 0 or close > 1").isEmpty()
    back = invert_minmax(scaled, params, cols)
    a, b = (collected(d, "series", "time")[cols] for d in (df, back))
    np.testing.assert_allclose(a, b, rtol=1e-12)


def test_ols_matches_lstsq_with_collinear_and_constant_columns(spark):
    rng = np.random.default_rng(0)
    frames = []
    for name, n in (("a", 200), ("b", 50)):
        x = rng.random((n, 3))
        frames.append(
            pd.DataFrame(
                {"series": name, "x0": x[:, 0], "x1": x[:, 1], "dup": 2 * x[:, 0], "flat": 0.0,
                 "y": 3 + x @ [1.0, -2.0, 0.5] + rng.normal(0, 0.1, n)}
            )
        )
    pdf = pd.concat(frames)
    features = ["x0", "x1", "dup", "flat"]
    fitted = {r["series"]: r for r in se.fit_ols(spark.createDataFrame(pdf), features, "y").collect()}
    for name, g in pdf.groupby("series"):
        x, y = g[features].to_numpy(), g["y"].to_numpy()
        want = np.linalg.lstsq(x - x.mean(0), y - y.mean(), rcond=1e-8)[0]
        np.testing.assert_allclose(fitted[name]["coef"], want, atol=1e-8)
        assert np.isclose(fitted[name]["intercept"], y.mean() - want @ x.mean(0))


def test_recursion_matches_numpy(spark):
    rng = np.random.default_rng(3)
    n_steps, width, days = 6, 3, 40
    window, coef = rng.random((n_steps, width)), rng.normal(0, 0.2, n_steps * width)
    tails = spark.createDataFrame(
        [("a", datetime(2024, 1, 1), window.tolist())],
        "series string, time timestamp, x array<array<double>>",
    )
    got = collected(se.recursive_forecast(tails, coef, 0.1, days), "date")
    want = []
    for _ in range(days):
        y = window.ravel() @ coef + 0.1
        row = window[-1].copy()
        row[0] = y
        window = np.vstack([window[1:], row])
        want.append(y)
    np.testing.assert_allclose(got["predicted"], want, rtol=1e-9)
    assert str(got["date"].iloc[-1].date()) == "2024-02-10"


def test_a_series_forecasts_alone_as_among_others(spark):
    pdf = pd.concat([walk_frame(120, n, s) for n, s in (("a", 1), ("b", 2), ("c", 3))])
    together = se.ols_forecast(to_spark(spark, pdf), 10)
    alone = se.ols_forecast(to_spark(spark, pdf[pdf.series == "b"]), 10)
    a = collected(together.where("series = 'b'"), "date")["predicted_price"]
    np.testing.assert_allclose(a, collected(alone, "date")["predicted_price"], rtol=1e-9)


def test_anchors(spark):
    df = to_spark(spark, walk_frame(800, "a", 9))
    complete = collected(se.ols_forecast(df, 3), "date")
    last = collected(se.ols_forecast(df, 3, anchor="last"), "date")
    assert (last["date"][0] - complete["date"][0]).days == 182
    assert last["predicted_price"].notna().all()


def test_market_model(spark):
    pdf = walk_frame(366, "a", 4)
    df = to_spark(spark, pdf).selectExpr(
        "series", "time", "close as price", "close * 1000 as market_cap", "abs(open) + 50 as total_volume"
    )
    row = se.market_model_metrics(df).first()
    assert 0 < row["mae"] <= row["rmse"] < 10


def test_trailing_range_keeps_both_ends(spark):
    df = to_spark(spark, walk_frame(60, "a", 1))
    assert se.trailing_range(df, 30).count() == 31


def test_deltas(spark):
    rows = [("a", datetime(2024, 1, i), p) for i, p in ((1, 10.0), (2, 12.0), (3, 9.0))]
    df = spark.createDataFrame(rows, "series string, date timestamp, predicted_price double")
    got = collected(se.forecast_deltas(df), "date")
    assert got["daily_change"].tolist()[1:] == [2.0, -3.0]
    np.testing.assert_allclose(got["daily_pct_change"].tolist()[1:], [20.0, -25.0])


def test_ols_ignores_incomplete_rows(spark):
    rows = [("a", float(i), 2.0 * i + 1) for i in range(10)] + [("a", None, 500.0), ("a", 3.0, None), ("b", None, 1.0)]
    fitted = se.fit_ols(spark.createDataFrame(rows, "series string, x double, y double"), ["x"], "y").collect()
    assert [r["series"] for r in fitted] == ["a"]
    assert list(fitted[0]["coef"]) == pytest.approx([2.0]) and fitted[0]["intercept"] == pytest.approx(1.0)
