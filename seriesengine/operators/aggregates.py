"""Aggregations A1–A7. All combine map-side, so no series is too long for them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesengine.functions.columns import as_column, day_of_week, row_mean, sentiment_class
from seriesengine.operators.chunks import KEYS
from seriesengine.operators.quality import require_columns
from seriesengine.schemas import PRICES

WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def daily_average(
    df: DataFrame, *, keys: Sequence[str] = KEYS, time_col: str = "time"
) -> DataFrame:
    """A1: mean over the bars of a date of each bar's mean price; missing dates dropped."""
    require_columns(df, [*keys, time_col, *PRICES])
    return (
        df.where(F.col(time_col).isNotNull())
        .groupBy(*keys, F.to_date(time_col).alias("date"))
        .agg(F.avg(row_mean(*PRICES)).alias("average_price"))
    )


def weekday_change(
    df: DataFrame, *, keys: Sequence[str] = KEYS, time_col: str = "time"
) -> DataFrame:
    """A2 + J1: mean close - open per weekday, always seven rows per series.

    Seven conditional means in one aggregate leave one row per series to shuffle,
    and the fixed weekdays come from exploding it: no dimension join.
    """
    require_columns(df, [*keys, time_col, "open", "close"])
    moved = F.col("close") - F.col("open")
    per_day = [
        F.avg(F.when(day_of_week(time_col) == i, moved)).alias(f"_d{i}") for i in range(7)
    ]
    week = F.array(
        *[
            F.struct(
                F.lit(i).alias("day_no"),
                F.lit(day).alias("day_of_week"),
                F.col(f"_d{i}").alias("avg_daily_change"),
            )
            for i, day in enumerate(WEEKDAYS)
        ]
    )
    return df.groupBy(*keys).agg(*per_day).select(*keys, F.inline(week))


def sentiment_distribution(
    df: DataFrame, col: str = "sentiment_compound", *, keys: Sequence[str] = ()
) -> DataFrame:
    """A3 + P9: articles per class, most frequent first; ties as Positive, Neutral, Negative."""
    order = F.expr("array_position(array('Positive', 'Neutral', 'Negative'), sentiment)")
    return (
        df.groupBy(*keys, sentiment_class(col).alias("sentiment"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(*keys, F.desc("count"), order)
    )


def regression_metrics(
    df: DataFrame, y: str, yhat: str, *, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Mean squared, mean absolute and root mean squared error per series."""
    error = as_column(y) - as_column(yhat)
    return (
        df.groupBy(*keys)
        .agg(F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"))
        .withColumn("rmse", F.sqrt("mse"))
    )


def last_known(
    df: DataFrame, cols: Sequence[str], *, keys: Sequence[str] = KEYS, time_col: str = "time"
) -> DataFrame:
    """The latest time of every series and the last non-missing value of each column."""
    seen = [
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(time_col))).alias(c) for c in cols
    ]
    return df.groupBy(*keys).agg(F.max(time_col).alias(time_col), *seen)
