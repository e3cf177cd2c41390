"""Merging new batches into stored tables and deciding when to fetch: S8–S10, U1, U2."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesengine.functions.columns import join_on
from seriesengine.schemas import INGEST_STATE


def keep_first(df: DataFrame, on: Sequence[str], order_by: Sequence[str | Column]) -> DataFrame:
    """One row per key, the first by ``order_by``; NULL keys equal each other.

    ``row_number() = 1`` keeps at most one row per key in every map task before the
    shuffle, so a key with very many copies costs no more than any other.
    """
    first = Window.partitionBy(*on).orderBy(*order_by)
    return df.withColumn("_n", F.row_number().over(first)).where(F.col("_n") == 1).drop("_n")


def merge_keep_first(
    stored: DataFrame, batch: DataFrame, on: Sequence[str],
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Stored and new rows, one per key; a stored row wins, then ``order_by`` decides."""
    both = stored.withColumn("_prio", F.lit(0)).unionByName(batch.withColumn("_prio", F.lit(1)))
    return keep_first(both, on, ["_prio", *order_by]).drop("_prio")


def new_rows(
    stored: DataFrame, batch: DataFrame, on: Sequence[str], order_by: Sequence[str] = ()
) -> DataFrame:
    """The rows a merge would add, for appending instead of rewriting the table.

    The stored side is read for its keys only and first reduced to those the batch
    has, so its size does not matter to the final join.
    """
    fresh = keep_first(batch, on, list(order_by) or list(on))
    known = join_on(stored.select(*on), fresh.select(*on), list(on), "left_semi")
    return join_on(fresh, known.distinct(), list(on), "left_anti")


def due_for_ingest(state: DataFrame, now: datetime | Column, max_age: str = "6 hours") -> DataFrame:
    """Sources whose last ingest is at least ``max_age`` ago, or that never had one."""
    now = now if isinstance(now, Column) else F.lit(now)
    recent = (now - F.col("last_ts")) < F.expr(f"INTERVAL {max_age}")
    return state.where(~F.coalesce(recent, F.lit(False)))


def record_ingest(state: DataFrame, source: str, at: datetime) -> DataFrame:
    """The state after a successful ingest, still one row per source."""
    done = state.sparkSession.createDataFrame([(source, at)], INGEST_STATE)
    return state.where(~F.col("source").eqNullSafe(F.lit(source))).unionByName(done)
