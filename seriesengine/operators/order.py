"""O1: a global order over many tasks, and files that keep it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesengine.session import materialize

_ROW_BITS = 33  # fixed value: monotonically_increasing_id keeps the row in the lower 33 bits


def _ascending(order: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in order]


def sorted_ranges(df: DataFrame, order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Rows in range partitions, sorted within each: together, in global order, missing last."""
    by = _ascending(order)
    spread = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    return spread.sortWithinPartitions(*by)


def global_positions(df: DataFrame, order: Sequence[str], out: str = "position", partitions: int | None = None) -> DataFrame:
    """Add the 0-based place of every row in the order of all rows.

    Each task numbers its own range, and the ranges' sizes, one row each, say where each
    begins: no task sees more than its range. Rows that tie in ``order`` are numbered in any way.
    """
    numbered = materialize(
        sorted_ranges(df, order, partitions).withColumn("_id", F.monotonically_increasing_id())
    )
    part, row = F.shiftright("_id", _ROW_BITS), F.col("_id").bitwiseAND((1 << _ROW_BITS) - 1)
    placed = numbered.withColumns({"_part": part, out: row}).drop("_id")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # As many rows as there are partitions.
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    joined = placed.join(F.broadcast(starts), "_part")
    return joined.withColumn(out, F.col(out) + F.col("_start")).drop("_part", "_start")


def write_sorted(df: DataFrame, path: str, order: Sequence[str], partitions: int | None = None) -> None:
    """Parquet files that hold one range of the order each, in the order of their names."""
    sorted_ranges(df, order, partitions).write.parquet(path)


def order_violations(df: DataFrame, path: str, order: Sequence[str]) -> DataFrame:
    """Files under ``path`` (read as ``df``) that begin before the one ahead of them ends."""
    key = F.struct(*[v for c in order for v in (F.col(c).isNull().alias(f"{c}_missing"), F.col(c))])
    files = df.groupBy(F.input_file_name().alias("file")).agg(F.min(key).alias("first"), F.max(key).alias("last"))
    # One row for each file.
    ahead = F.max("last").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("ahead", ahead).where("first < ahead").select("file")
