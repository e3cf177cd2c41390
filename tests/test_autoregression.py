"""The ridge autoregression against numpy, whole and cut, alone and among others."""

import numpy as np
import pandas as pd
import pytest

import seriesengine as se
from seriesengine.operators import autoregression as ar
from conftest import collected, to_spark, walk_frame

FEATURES, STEPS, CUTS, REGS = ["close", "open"], 6, (0.7, 0.85), (0.001, 0.1, 10.0)


def frame(*sizes):
    return pd.concat([walk_frame(n, f"s{i}", 10 + i) for i, n in enumerate(sizes)])


def plain(pdf):
    z = pdf.sort_values("time")[FEATURES].to_numpy()
    total = len(z) - STEPS
    x = np.array([z[t - STEPS : t].ravel() for t in range(STEPS, len(z))])
    y = z[STEPS:, 0]
    a, b = int(np.floor(CUTS[0] * total)), int(np.floor(CUTS[1] * total))
    mean, sd, top = x[:a].mean(0), x[:a].std(0), y[:a].mean()
    best = None
    for reg in REGS:
        u = (x[:a] - mean) / sd
        beta = np.linalg.solve(u.T @ u / a + reg * np.eye(u.shape[1]), u.T @ (y[:a] - top) / a) / sd
        model = (top - mean @ beta, beta)
        e = y[a:b] - model[0] - x[a:b] @ beta
        if best is None or (b > a and e @ e < best[0]):
            best = (e @ e, reg, *model)
    e = y[b:] - best[2] - x[b:] @ best[3]
    return a, b - a, best[1], best[2], best[3], len(e), e @ e, np.abs(e).sum()


def check(got, pdf):
    a, v, reg, intercept, coef, n, sse, sae = plain(pdf)
    assert (got["n_train"], got["n_validation"], got["n_test"], got["reg_param"]) == (a, v, n, reg)
    np.testing.assert_allclose(got["coef"], coef, rtol=1e-5, atol=1e-7)
    np.testing.assert_allclose([got["intercept"], got["sse"], got["sae"]], [intercept, sse, sae], rtol=1e-5, atol=1e-6)


@pytest.mark.parametrize("rows_per_chunk", [None, 60, 333])
def test_against_numpy(spark, rows_per_chunk):
    pdf = frame(700, 90, 41)
    df = to_spark(spark, pdf).repartition(7)
    chunks = None if rows_per_chunk is None else se.plan_chunks(df, rows_per_chunk=rows_per_chunk)
    got = ar.fit_autoregression(df, FEATURES, STEPS, CUTS, REGS, chunks=chunks).collect()
    assert len(got) == 3
    for r in got:
        check(r, pdf[pdf.series == r["series"]])


def test_batches_of_few_rows(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        pdf = frame(80, 35)
        for r in ar.fit_autoregression(to_spark(spark, pdf), FEATURES, STEPS, CUTS, REGS, chunks=None).collect():
            check(r, pdf[pdf.series == r["series"]])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_short_and_constant_series(spark):
    pdf = frame(STEPS + 1, STEPS, 1)
    flat = walk_frame(60, "flat", 3).assign(open=5.0, close=7.0)
    got = ar.fit_autoregression(to_spark(spark, pd.concat([pdf, flat])), FEATURES, STEPS, CUTS, REGS, chunks=None).collect()
    assert [r["series"] for r in got] == ["flat"]  # the others have no training sequence
    assert got[0]["intercept"] == pytest.approx(7.0) and not any(got[0]["coef"]) and got[0]["sse"] == pytest.approx(0)
    none = to_spark(spark, pdf).limit(0)
    assert ar.fit_autoregression(none, FEATURES, STEPS, CUTS, REGS, chunks=None).count() == 0


def test_each_series_forecasts_as_it_does_alone(spark):
    pdf = pd.concat([walk_frame(n, s, k) for k, (n, s) in enumerate([(150, "a"), (120, "b"), (90, "c")])])
    together = se.fit_sequence_forecast(to_spark(spark, pdf), 12)
    for name in ("a", "c"):
        alone = se.fit_sequence_forecast(to_spark(spark, pdf[pdf.series == name]), 12)
        mine = collected(together.predictions.where(f"series = '{name}'"), "date")
        theirs = collected(alone.predictions, "date")
        assert list(mine["date"]) == list(theirs["date"])
        np.testing.assert_allclose(mine["predicted_price"], theirs["predicted_price"], rtol=1e-7)
        a, b = (m.metrics.where(f"series = '{name}'").first() for m in (together, alone))
        np.testing.assert_allclose(a[1:], b[1:], rtol=1e-7)


def test_cut_series_forecast_the_same(spark):
    df = to_spark(spark, frame(400, 60))
    whole = collected(se.sequence_forecast(df, 5), "series", "date")
    cut = collected(se.sequence_forecast(df, 5, chunks=se.plan_chunks(df, rows_per_chunk=100)), "series", "date")
    np.testing.assert_allclose(whole["predicted_price"], cut["predicted_price"], rtol=1e-6)


def test_windows_are_never_rows(spark):
    """Between the sort and the models there is one pass of Python, and no collected windows."""
    df = to_spark(spark, frame(60))
    plan = ar.fit_autoregression(df, FEATURES, STEPS, CUTS, REGS, chunks=None)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("MapInArrow") == 1
