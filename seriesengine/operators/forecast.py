"""Forecasts M4–M9: least squares on features, and a ridge autoregression.

The autoregression stands where a recurrent network could: same inputs, same
windows, same chronological splits, and the validation slice chooses the
regularisation as it would choose the stopping epoch.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesengine.functions.columns import day_of_week, join_on
from seriesengine.operators.aggregates import last_known, regression_metrics
from seriesengine.operators.autoregression import fit_autoregression
from seriesengine.operators.chunks import KEYS, ROWS_PER_CHUNK, over_rows, resolve_chunks
from seriesengine.operators.decompose import seasonal_decompose
from seriesengine.operators.features import (
    MARKET_SCALED, lag_features, longest_unique_series, market_features, ohlc_features,
)
from seriesengine.operators.quality import require_columns
from seriesengine.operators.regression import fit_ols, predict_linear
from seriesengine.operators.rolling import change
from seriesengine.operators.scaling import apply_minmax, fit_minmax, unscaled
from seriesengine.operators.sequences import hash_split, series_tail
from seriesengine.schemas import METRICS, PRICES
from seriesengine.session import materialize

# The model columns by name.
OLS_FEATURES = (
    "moving_avg_5", "moving_avg_10", "daily_return", "trend", "seasonal",
    "day_of_week", "month", "year",
)
FROZEN = ("moving_avg_5", "moving_avg_10", "daily_return", "trend", "seasonal")
LAG_FEATURES = ("close", "day_of_week", "month", "lag_close")


def _require_days(days: int) -> None:
    if days < 1:
        raise ValueError("days must be 1 or more")


def future_frame(
    features: DataFrame, days: int, frozen: Sequence[str] = FROZEN,
    *, keys: Sequence[str] = KEYS, time_col: str = "time",
) -> DataFrame:
    """M4: one row per series and future day; ``frozen`` columns keep their last known values."""
    _require_days(days)
    last = last_known(features, frozen, keys=keys, time_col=time_col)
    ahead = last.withColumn("_day", F.explode(F.sequence(F.lit(1), F.lit(days))))
    date = F.col(time_col) + F.make_dt_interval(F.col("_day"))
    return ahead.withColumn("date", date).select(
        *keys, "date", *frozen,
        day_of_week("date").alias("day_of_week"),
        F.month("date").alias("month"),
        F.year("date").alias("year"),
    )


def ols_frame(
    df: DataFrame, *, keys: Sequence[str] = KEYS, time_col: str = "time", chunks="auto"
) -> DataFrame:
    """F1 → D1: the features a forecast is fitted on, incomplete rows included."""
    require_columns(df, [*keys, time_col, *PRICES])
    longest = longest_unique_series(df, keys, time_col)
    whole = chunks == "auto" and longest <= ROWS_PER_CHUNK
    plan = None if whole else resolve_chunks(df, keys, time_col, chunks)
    featured = ohlc_features(df, check=False, keys=keys, time_col=time_col, chunks=plan)
    return seasonal_decompose(featured, keys=keys, time_col=time_col, chunks=plan)


@dataclass(frozen=True)
class OlsForecast:
    predictions: DataFrame  # keys, date, predicted_price
    metrics: DataFrame  # keys, mse, mae, rmse on the test rows
    coefficients: DataFrame  # keys, n, intercept, coef (scaled features)


def fit_ols_forecast(
    df: DataFrame, days: int = 30, anchor: str = "last_complete",
    *, keys: Sequence[str] = KEYS, time_col: str = "time", chunks="auto",
) -> OlsForecast:
    """M5: features, scaling, 80/20 split, least squares per series, evaluation, forecast.

    ``anchor="last_complete"`` starts after the last row without gaps, which for a
    decomposed series lies half a period before its end; ``anchor="last"`` starts
    after the last row and takes the last known value of every feature.
    """
    if anchor not in ("last_complete", "last"):
        raise ValueError("anchor must be last_complete or last")
    # Scaling, fitting, evaluation and forecast all read this frame: write it once.
    every_row = materialize(ols_frame(df, keys=keys, time_col=time_col, chunks=chunks))
    frame = every_row.dropna(
        subset=[time_col, "open", "high", "low", "close", *OLS_FEATURES, "residual"]
    )
    bounds = fit_minmax(frame, OLS_FEATURES, keys=keys)
    # Training, evaluation and the ranges of the split all read it.
    split = materialize(
        hash_split(apply_minmax(frame, bounds, OLS_FEATURES, keys=keys), keys=keys, time_col=time_col)
    )
    coefficients = fit_ols(split.where("split = 'train'"), OLS_FEATURES, "close", keys=keys)
    tested = predict_linear(split.where("split = 'test'"), coefficients, OLS_FEATURES, keys=keys)
    ahead = future_frame(
        frame if anchor == "last_complete" else every_row, days, keys=keys, time_col=time_col
    )
    scaled_ahead = apply_minmax(ahead, bounds, OLS_FEATURES, keys=keys)
    predicted = predict_linear(scaled_ahead, coefficients, OLS_FEATURES, "predicted_price", keys=keys)
    return OlsForecast(
        predicted.select(*keys, "date", "predicted_price"),
        regression_metrics(tested, "close", "predicted", keys=keys),
        coefficients,
    )


def ols_forecast(
    df: DataFrame, days: int = 30, anchor: str = "last_complete",
    *, keys: Sequence[str] = KEYS, time_col: str = "time", chunks="auto",
) -> DataFrame:
    """M5: predicted prices only."""
    return fit_ols_forecast(
        df, days, anchor, keys=keys, time_col=time_col, chunks=chunks
    ).predictions


def forecast_deltas(
    predictions: DataFrame, *, keys: Sequence[str] = KEYS, date_col: str = "date", chunks="auto"
) -> DataFrame:
    """M8: change and percent change from one forecast day to the next."""

    def build(d, w):
        price = F.col("predicted_price")
        return d.withColumns(
            {
                "daily_change": price - F.lag(price).over(w),
                "daily_pct_change": change(price, w, scale=100.0),
            }
        )

    return over_rows(
        predictions, build, keys=keys, order_by=date_col, before=1, chunks=chunks
    )


# -- sequence model ---------------------------------------------------------------------------


def sequence_metrics(
    models: DataFrame, bounds: DataFrame, target: str, *, keys: Sequence[str] = KEYS
) -> DataFrame:
    """A6 of the test sequences per series, in the target's own unit."""
    span = F.col(f"{target}_max") - F.col(f"{target}_min")
    mse = F.try_divide("sse", "n_test") * span * span
    return join_on(models, bounds.select(*keys, f"{target}_min", f"{target}_max"), list(keys)).select(
        *keys, mse.alias("mse"), (F.try_divide("sae", "n_test") * span).alias("mae"), F.sqrt(mse).alias("rmse")
    )


def tail_windows(
    df: DataFrame, features: Sequence[str], n_steps: int,
    *, keys: Sequence[str] = KEYS, time_col: str = "time",
) -> DataFrame:
    """One row per series: its last n_steps rows as ``x`` (oldest first) and last time."""
    rows = series_tail(df.select(*keys, time_col, *features), n_steps, keys=keys, time_col=time_col)
    values = F.array(*[F.col(c).cast("double") for c in features])
    # At most n_steps rows per series are collected.
    packed = F.array_sort(F.collect_list(F.struct(F.col(time_col).alias("t"), values.alias("v"))))
    return (
        rows.groupBy(*keys)
        .agg(packed.alias("_rows"))
        .select(
            *keys,
            F.element_at("_rows", -1)["t"].alias(time_col),
            F.transform("_rows", lambda r: r["v"]).alias("x"),
        )
        .where(F.size("x") == n_steps)
    )


def recursive_forecast(
    tails: DataFrame, coef: Sequence[float] | Column, intercept: float | Column, days: int,
    *, keys: Sequence[str] = KEYS, time_col: str = "time",
) -> DataFrame:
    """M7: predict, push a copy of the last row holding the prediction, repeat.

    ``x`` is the window and the target its first feature; the other features of the
    pushed row stay as they were. Series run in parallel; one series is a fold over
    its days inside the JVM. The weights are the same for all series, or columns of
    ``tails``. Returns (keys, date, predicted), still scaled.
    """
    _require_days(days)
    weights = coef if isinstance(coef, Column) else F.array(*[F.lit(float(c)) for c in coef])
    base = intercept if isinstance(intercept, Column) else F.lit(float(intercept))

    def dot(window):
        products = F.zip_with(window, weights, lambda a, b: a * b)
        return F.aggregate(products, F.lit(0.0), lambda s, v: s + v) + base

    def step(state, _day):
        width = F.size(state["win"][0])

        def push(y):
            last = F.element_at(state["win"], -1)
            row = F.concat(F.array(y), F.slice(last, F.lit(2), width - 1))
            kept = F.slice(state["win"], F.lit(2), F.size(state["win"]) - 1)
            return F.struct(
                F.concat(kept, F.array(row)).alias("win"),
                F.concat(state["preds"], F.array(y)).alias("preds"),
            )

        # transform over a one-element array names the prediction, so it is computed once.
        return F.transform(F.array(dot(F.flatten(state["win"]))), push)[0]

    start = F.struct(F.col("x").alias("win"), F.array().cast("array<double>").alias("preds"))
    folded = F.aggregate(F.sequence(F.lit(1), F.lit(days)), start, step, lambda s: s["preds"])
    return (
        tails.select(*keys, time_col, folded.alias("_preds"))
        .select(*keys, time_col, F.posexplode("_preds").alias("_day", "predicted"))
        .select(
            *keys,
            (F.col(time_col) + F.make_dt_interval(F.col("_day") + 1)).alias("date"),
            "predicted",
        )
    )


@dataclass(frozen=True)
class SequenceForecast:
    predictions: DataFrame  # keys, date, predicted_price
    metrics: DataFrame  # keys, mse, mae, rmse on the test sequences
    models: DataFrame  # keys, n_train, n_validation, reg_param, intercept, coef, n_test, sse, sae


def fit_sequence_forecast(
    df: DataFrame, days: int = 30, n_steps: int = 30, reg_params: Sequence[float] = (0.0001, 0.01),
    *, keys: Sequence[str] = KEYS, time_col: str = "time", chunks="auto",
) -> SequenceForecast:
    """M6: F3 → F5 → 70/15/15 of the sequences → ridge → A6 → M7 → F6, each series by itself.

    Raises if no series has n_steps rows. A series too short to have a training sequence gets
    no forecast. The rows are read once for model and errors; see ``fit_autoregression``.
    """
    _require_days(days)
    require_columns(df, [*keys, time_col, "close"])
    longest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if longest < n_steps:
        raise ValueError(f"at least {n_steps} rows are needed")
    whole = chunks == "auto" and longest <= ROWS_PER_CHUNK
    chunks = None if whole else chunks
    lagged = materialize(lag_features(df, keys=keys, time_col=time_col, chunks=chunks))
    bounds = materialize(fit_minmax(lagged, LAG_FEATURES, keys=keys))
    base = apply_minmax(lagged, bounds, LAG_FEATURES, keys=keys)
    models = materialize(
        fit_autoregression(
            base, LAG_FEATURES, n_steps, (0.7, 0.85), reg_params,
            keys=keys, time_col=time_col, chunks=chunks,
        )
    )
    # Scaling keeps a window's shape, so only the last rows are scaled for the forecast.
    last = series_tail(lagged, n_steps, keys=keys, time_col=time_col)
    tails = tail_windows(
        apply_minmax(last, bounds, LAG_FEATURES, keys=keys), LAG_FEATURES, n_steps, keys=keys, time_col=time_col
    )
    known = join_on(tails, models.select(*keys, "intercept", "coef"), list(keys), "inner")
    ahead = recursive_forecast(
        known, F.col("coef"), F.col("intercept"), days, keys=keys, time_col=time_col
    )
    priced = join_on(ahead, bounds.select(*keys, "close_min", "close_max"), list(keys))
    return SequenceForecast(
        priced.select(*keys, "date", unscaled("predicted", "close").alias("predicted_price")),
        sequence_metrics(models, bounds, "close", keys=keys),
        models,
    )


def sequence_forecast(
    df: DataFrame, days: int = 30, n_steps: int = 30,
    *, keys: Sequence[str] = KEYS, time_col: str = "time", chunks="auto",
) -> DataFrame:
    """M6: predicted prices only."""
    return fit_sequence_forecast(
        df, days, n_steps, keys=keys, time_col=time_col, chunks=chunks
    ).predictions


def market_model_metrics(
    df: DataFrame, n_steps: int = 30, reg_param: float = 0.01,
    *, keys: Sequence[str] = KEYS, time_col: str = "time", chunks="auto",
) -> DataFrame:
    """M9: F2 → 80/20 of the sequences → ridge → MSE, MAE and RMSE per series in price units."""
    require_columns(df, [*keys, time_col, *METRICS])
    features = market_features(df, scaled=False, keys=keys, time_col=time_col, chunks=chunks)
    raw = materialize(features)
    bounds = materialize(fit_minmax(raw, MARKET_SCALED, keys=keys))
    base = apply_minmax(raw, bounds, MARKET_SCALED, keys=keys)
    models = fit_autoregression(
        base, MARKET_SCALED, n_steps, (0.8,), (reg_param,), keys=keys, time_col=time_col, chunks=chunks
    )
    return sequence_metrics(models, bounds, "price", keys=keys)
