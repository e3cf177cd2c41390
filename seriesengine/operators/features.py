"""Feature frames F1–F3 and the chart projections P8, P11, P12."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesengine.functions.columns import day_of_week, join_on, ratio
from seriesengine.operators.chunks import KEYS, ROWS_PER_CHUNK, over_rows, resolve_chunks
from seriesengine.operators.quality import require_columns
from seriesengine.operators.rolling import change, forward_fill, rolling
from seriesengine.operators.scaling import apply_minmax, fit_minmax
from seriesengine.schemas import METRICS, PRICES

MARKET_SCALED = (
    "price", "total_volume", "market_cap",
    "price_return", "volume_change", "market_cap_change", "volatility_7",
)


def ohlc_features(
    df: DataFrame, check: bool = True,
    *, keys: Sequence[str] = KEYS, time_col: str = "time", chunks="auto",
) -> DataFrame:
    """partial moving averages, the return of the close and calendar features.

    ``check`` first raises on an empty table and on duplicate times. Its one aggregate
    over (keys, time) also tells whether a series must be cut.
    """
    require_columns(df, [*keys, time_col, *PRICES])
    if check:
        longest = longest_unique_series(df, keys, time_col)
        if chunks == "auto" and longest <= ROWS_PER_CHUNK:
            chunks = None
    plan = resolve_chunks(df, keys, time_col, chunks)
    filled = forward_fill(df, {"close": "_filled"}, keys=keys, time_col=time_col, chunks=plan)

    def build(d, w):
        return d.withColumns(
            {
                "moving_avg_5": rolling(F.avg, "close", 5, w, 1),
                "moving_avg_10": rolling(F.avg, "close", 10, w, 1),
                "daily_return": change("_filled", w),
            }
        )

    framed = over_rows(filled, build, keys=keys, order_by=time_col, before=9, chunks=plan)
    return framed.drop("_filled").withColumns(
        {
            "day_of_week": day_of_week(time_col),
            "month": F.month(time_col),
            "year": F.year(time_col),
        }
    )


def longest_unique_series(df: DataFrame, keys: Sequence[str], time_col: str) -> int:
    """Rows of the longest series; raises on an empty table and on a time held twice."""
    per_time = df.groupBy(*keys, time_col).agg(F.count(F.lit(1)).alias("_copies"))
    per_series = per_time.groupBy(*keys).agg(
        F.sum("_copies").alias("_rows"), F.max("_copies").alias("_copies")
    )
    seen = per_series.agg(F.max("_rows").alias("longest"), F.max("_copies").alias("copies")).first()
    if not seen["longest"]:
        raise ValueError("the table is empty")
    if seen["copies"] > 1:
        raise ValueError("duplicate timestamps in a series")
    return seen["longest"]


def market_features(
    df: DataFrame, scaled: bool = True,
    *, keys: Sequence[str] = KEYS, time_col: str = "time", chunks="auto",
) -> DataFrame:
    """returns, moving averages, volatility, cap-to-volume; incomplete rows dropped.

    With ``scaled`` seven of the columns are min-max scaled per series; the moving
    averages and the ratio keep their units. A zero denominator makes the row
    incomplete instead of infinite.
    """
    require_columns(df, [*keys, time_col, *METRICS])
    plan = resolve_chunks(df, keys, time_col, chunks)
    fills = {c: f"_filled_{c}" for c in METRICS}
    filled = forward_fill(df, fills, keys=keys, time_col=time_col, chunks=plan)

    def build(d, w):
        d = d.withColumns(
            {
                "price_return": change(fills["price"], w),
                "volume_change": change(fills["total_volume"], w),
                "market_cap_change": change(fills["market_cap"], w),
                "ma_7": rolling(F.avg, "price", 7, w),
                "ma_30": rolling(F.avg, "price", 30, w),
            }
        )
        return d.withColumn("volatility_7", rolling(F.stddev_samp, "price_return", 7, w))

    added = ["price_return", "volume_change", "market_cap_change", "ma_7", "ma_30", "volatility_7"]
    out = (
        over_rows(filled, build, keys=keys, order_by=time_col, before=29, chunks=plan)
        .withColumn("market_cap_to_volume", ratio("market_cap", "total_volume"))
        .dropna(subset=[time_col, *METRICS, *added, "market_cap_to_volume"])
        .select(*keys, time_col, *METRICS, *added, "market_cap_to_volume")
    )
    if not scaled:
        return out
    return apply_minmax(out, fit_minmax(out, MARKET_SCALED, keys=keys), MARKET_SCALED, keys=keys)


def lag_features(
    df: DataFrame, *, keys: Sequence[str] = KEYS, time_col: str = "time", chunks="auto"
) -> DataFrame:
    """close, weekday, month and the previous close; incomplete rows dropped."""
    require_columns(df, [*keys, time_col, "close"])
    framed = over_rows(
        df.select(*keys, time_col, "close"),
        lambda d, w: d.withColumn("lag_close", F.lag("close").over(w)),
        keys=keys, order_by=time_col, before=1, chunks=chunks,
    )
    return framed.select(
        *keys, time_col, "close",
        day_of_week(time_col).cast("double").alias("day_of_week"),
        F.month(time_col).cast("double").alias("month"),
        "lag_close",
    ).dropna(subset=[time_col, "close", "lag_close"])


def trailing_range(
    df: DataFrame, days: int = 30, *, keys: Sequence[str] = KEYS, time_col: str = "time"
) -> DataFrame:
    """The rows of the last ``days`` days of every series, both ends included (A5).

    The earliest of these ranges is found from keys and times alone, in a scalar subquery, whose
    value reaches the scan as a filter: older rows of a long history are not read.
    """
    reach = F.make_dt_interval(F.lit(days))
    last = df.groupBy(*keys).agg(F.max(time_col).alias("_last"))
    earliest = last.agg(F.min(F.col("_last") - reach)).scalar()
    recent = df.where(F.col(time_col) >= earliest)
    return (
        join_on(recent, last, list(keys))
        .where(F.col(time_col).between(F.col("_last") - reach, F.col("_last")))
        .drop("_last")
    )


def chart_overlay(
    history: DataFrame, forecast: DataFrame,
    history_value: str = "average_price", forecast_value: str = "predicted_price",
    *, keys: Sequence[str] = KEYS, date_col: str = "date",
) -> DataFrame:
    """History and forecast on one axis, long format."""

    def side(d, kind, value):
        return d.select(
            *keys, F.col(date_col).cast("date").alias("date"),
            F.lit(kind).alias("kind"), F.col(value).alias("value"),
        )

    return side(history, "history", history_value).unionByName(
        side(forecast, "forecast", forecast_value)
    )


def sentiment_over_time(df: DataFrame) -> DataFrame:
    """The chart rows of scored articles; raises without a valid publication time."""
    require_columns(df, ["published_at", "title", "sentiment_compound"])
    dated = df.where(F.col("published_at").isNotNull())
    if dated.isEmpty():
        raise ValueError("no valid published_at values")
    return dated.select("published_at", "title", "sentiment_compound")
