"""Min-max scaling: A4, F5, F6.

The fitted state is one row per series: ``<col>_min`` and ``<col>_max``. It joins
back as an ordinary equi-join, so the planner broadcasts it while it is small and
splits skewed series when it is not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesengine.functions.columns import join_on
from seriesengine.operators.chunks import KEYS


def fit_minmax(df: DataFrame, cols: Sequence[str], *, keys: Sequence[str] = KEYS) -> DataFrame:
    """A4: minimum and maximum of every column, per series."""
    bounds = [f(c).alias(f"{c}_{n}") for c in cols for n, f in (("min", F.min), ("max", F.max))]
    return df.groupBy(*keys).agg(*bounds)


def scaled(c: str) -> Column:
    """(x - min) / (max - min); a constant column becomes 0."""
    low, high = F.col(f"{c}_min"), F.col(f"{c}_max")
    span = F.when(high == low, F.lit(1.0)).otherwise(high - low)
    return (F.col(c) - low) / span


def unscaled(c: str, bounds: str | None = None) -> Column:
    """x * (max - min) + min, with the bounds of column ``bounds``."""
    b = bounds or c
    return F.col(c) * (F.col(f"{b}_max") - F.col(f"{b}_min")) + F.col(f"{b}_min")


def _bound_columns(cols: Sequence[str]) -> list[str]:
    return [f"{c}_{n}" for c in cols for n in ("min", "max")]


def apply_minmax(
    df: DataFrame, params: DataFrame, cols: Sequence[str], *, keys: Sequence[str] = KEYS
) -> DataFrame:
    """scale the columns in place."""
    bounds = _bound_columns(cols)
    joined = join_on(df, params.select(*keys, *bounds), list(keys))
    return joined.withColumns({c: scaled(c) for c in cols}).drop(*bounds)


def invert_minmax(
    df: DataFrame, params: DataFrame, cols: dict[str, str] | Sequence[str],
    *, keys: Sequence[str] = KEYS,
) -> DataFrame:
    """undo the scaling; ``cols`` may map a column to the one whose bounds it uses."""
    pairs = cols if isinstance(cols, dict) else {c: c for c in cols}
    bounds = _bound_columns(sorted(set(pairs.values())))
    joined = join_on(df, params.select(*keys, *bounds), list(keys))
    return joined.withColumns({c: unscaled(c, b) for c, b in pairs.items()}).drop(*bounds)
