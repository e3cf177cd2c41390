"""Analytic results on two straight series."""

import numpy as np
import pytest

import seriesengine as se
from conftest import collected, mid_price

I, J = np.arange(64), np.arange(41)


def of(df, name, *order):
    return collected(df.where(f"series = '{name}'"), *order)


def test_moving_averages(slopes):
    got = se.moving_averages(slopes)
    up, down = of(got, "up", "time"), of(got, "down", "time")
    # The mean of a bar's prices lies 0.1 above its middle; a mean of n rows lies (n - 1) / 2 rows back.
    assert np.allclose(up["average_price"], mid_price(I, True) + 0.1)
    assert np.allclose(up["ma_7"][6:], mid_price(I[6:] - 3, True) + 0.1) and up["ma_7"].isna().sum() == 6
    assert np.allclose(down["ma_30"][29:], mid_price(J[29:] - 14.5, False) + 0.1)
    assert down["ma_30"].isna().sum() == 29  # rows count, not days: the gap makes no difference


def test_ohlc_features(slopes):
    up, down = (of(se.ohlc_features(slopes), s, "time") for s in ("up", "down"))
    back = np.minimum(I, 9) / 2
    assert np.allclose(up["moving_avg_10"], mid_price(I - back, True) + 0.6)
    assert np.isnan(down["daily_return"][0])
    assert np.allclose(down["daily_return"][1:], -0.5 / (mid_price(J[:-1], False) + 0.6))
    # 2021-03-03 is a Wednesday, 2021-05-01 a Saturday.
    assert list(up["day_of_week"][:3]) == [2, 3, 4] and list(down["day_of_week"][:3]) == [5, 0, 2]
    assert up["month"].iloc[-1] == 5 and set(down["year"]) == {2021}


def test_daily_average_and_weekdays(slopes):
    daily = of(se.daily_average(slopes), "down", "date")
    assert len(daily) == 41 and np.allclose(daily["average_price"], mid_price(J, False) + 0.1)
    assert (daily["date"].iloc[21] - daily["date"].iloc[20]).days == 12
    week = se.weekday_change(slopes)
    for name in ("up", "down"):
        days = of(week, name, "day_no")
        assert list(days["day_of_week"])[::6] == ["Monday", "Sunday"] and np.allclose(days["avg_daily_change"], 1.0)


def test_weekdays_without_bars_stay_null(slopes):
    week = of(se.weekday_change(slopes.where("weekday(time) < 5")), "up", "day_no")
    assert len(week) == 7 and week["avg_daily_change"].isna().sum() == 2


def test_forecasts(slopes):
    fitted = se.fit_ols_forecast(slopes, 4)
    got = of(fitted.predictions, "up", "date")
    assert [str(d.date()) for d in got["date"]] == [f"2021-05-{d:02d}" for d in range(6, 10)]
    n = {r["series"]: r["n"] for r in fitted.coefficients.collect()}
    assert n == {"up": 63 - 13, "down": 40 - 8}  # the first row has no return; a fifth, rounded up, is for testing
    assert all(r["mse"] < 0.05 for r in fitted.metrics.collect())
    ahead = se.fit_sequence_forecast(slopes, 4)
    # 33 and 10 sequences of 30 rows.
    kinds = {r["series"]: (r["n_train"], r["n_validation"], r["n_test"]) for r in ahead.models.collect()}
    assert kinds == {"up": (23, 5, 5), "down": (7, 1, 2)}
    assert ahead.predictions.count() == 8
    assert ahead.predictions.where("series = 'up' and predicted_price between 50 and 60").count() == 4


def test_sequence_counts(slopes):
    lagged = se.lag_features(slopes)
    frame = se.sequence_frame(
        lagged, ["close", "lag_close"], "close", 30, (0.7, 0.85), ("train", "validation", "test")
    )
    counts = frame.where("series = 'up'").groupBy("split").count()
    assert {r["split"]: r["count"] for r in counts.collect()} == {"train": 23, "validation": 5, "test": 5}


def test_too_few_rows(slopes):
    with pytest.raises(ValueError):
        se.sequence_forecast(slopes.where("series = 'up'").limit(29), 5)
    with pytest.raises(ValueError):
        se.ols_forecast(slopes, 0)
