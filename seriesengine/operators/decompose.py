"""Additive seasonal decomposition, trend + seasonal + residual."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesengine.functions.columns import join_on
from seriesengine.operators.chunks import KEYS, over_rows
from seriesengine.operators.quality import require_columns
from seriesengine.session import materialize


def _with_centred_mean(df: DataFrame, col: str, period: int, w, out: str) -> DataFrame:
    """Mean over one period around the row, NULL near both ends or beside a missing value.

    A difference of two running sums, so a row costs the same whatever the period; they are sums
    of distances from the first value, which keeps them small and their differences precise.
    For an even period the frame has period + 1 rows and its two ends count half: the mean of
    the two one-period windows that share all inner rows.
    """
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    summed = df.withColumn("_level", F.first(col, ignorenulls=True).over(so_far)).withColumns(
        {"_sum": F.sum(F.col(col) - F.col("_level")).over(so_far), "_known": F.count(col).over(so_far)}
    )

    def full(back: int, ahead: int):
        def across(c):
            return F.lead(c, ahead).over(w) - F.coalesce(F.lag(c, back + 1).over(w), F.lit(0))

        return F.when(across("_known") == back + ahead + 1, across("_sum") / (back + ahead + 1))

    half = period // 2
    mean = full(half, half) if period % 2 else (full(half, half - 1) + full(half - 1, half)) / 2
    return summed.withColumn(out, F.col("_level") + mean).drop("_level", "_sum", "_known")


def seasonal_decompose(
    df: DataFrame, col: str = "close", period: int = 365, min_rows: int = 730,
    *, keys: Sequence[str] = KEYS, time_col: str = "time", chunks="auto",
) -> DataFrame:
    """Add ``trend``, ``seasonal`` and ``residual``.

    Periods count rows. A series with fewer than ``min_rows`` rows, or with any
    missing value, gets 0 in all three. Trend and residual are NULL within half a
    period of both ends. The rows are read and sorted once; their trend is written, as the
    means of the phases are needed for every row.
    """
    require_columns(df, [*keys, time_col, col])
    framed = materialize(
        over_rows(
            df,
            lambda d, w: _with_centred_mean(d, col, period, w, "_trend").withColumn(
                "_phase", F.col("_pos") % period
            ),
            keys=keys, order_by=time_col, before=period // 2, after=period // 2,
            positions=True, chunks=chunks,
        )
    )
    # One row per series and phase, with the series totals alongside.
    whole = Window.partitionBy(*keys)
    by_phase = (
        framed.groupBy(*keys, "_phase")
        .agg(
            F.avg(F.col(col) - F.col("_trend")).alias("_raw"),
            F.count(F.lit(1)).alias("_rows"),
            F.count(col).alias("_known"),
        )
        .select(
            *keys, "_phase",
            (F.col("_raw") - F.avg("_raw").over(whole)).alias("_seasonal"),
            F.sum("_rows").over(whole).alias("_n"),
            F.sum("_known").over(whole).alias("_n_known"),
        )
    )
    usable = (F.col("_n") >= min_rows) & (F.col("_n_known") == F.col("_n"))

    def or_zero(value):
        return F.when(usable, value).otherwise(F.lit(0.0))

    seasonal, trend = F.col("_seasonal"), F.col("_trend")
    return (
        join_on(framed, by_phase, [*keys, "_phase"])
        .withColumns(
            {
                "trend": or_zero(trend),
                "seasonal": or_zero(seasonal),
                "residual": or_zero(F.col(col) - trend - seasonal),
            }
        )
        .drop("_trend", "_phase", "_seasonal", "_n", "_n_known")
    )
