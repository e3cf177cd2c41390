"""Checks on a series table: S3, P3, A8."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesengine.operators.chunks import KEYS


def require_columns(df: DataFrame, cols: Iterable[str], min_rows: int = 0) -> DataFrame:
    """S3: raise if a column is missing or there are fewer than ``min_rows`` rows.

    Columns are checked on the schema; the row check reads at most ``min_rows`` rows.
    """
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if min_rows and df.limit(min_rows).count() < min_rows:
        raise ValueError(f"at least {min_rows} rows are needed")
    return df


def duplicate_times(
    df: DataFrame, *, keys: Sequence[str] = KEYS, time_col: str = "time"
) -> DataFrame:
    """Every (keys, time) held by more than one row; missing times equal each other."""
    return (
        df.groupBy(*keys, time_col).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    )


def require_unique_times(
    df: DataFrame, *, keys: Sequence[str] = KEYS, time_col: str = "time"
) -> DataFrame:
    """P3 as a check: raise if any series holds a time twice."""
    if not duplicate_times(df, keys=keys, time_col=time_col).isEmpty():
        raise ValueError("duplicate timestamps in a series")
    return df


def quality_report(
    df: DataFrame, cols: Sequence[str], *, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Rows and missing values per series."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in cols],
    )
