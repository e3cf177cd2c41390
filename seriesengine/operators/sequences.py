"""Sequences, tails and splits: W7–W9, F4, M1."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesengine.functions.columns import join_on
from seriesengine.operators.chunks import KEYS, over_rows


def _window_rows(features: Sequence[str], n_steps: int, w) -> Column:
    values = F.array(*[F.col(c).cast("double") for c in features])
    return F.collect_list(values).over(w.rowsBetween(-n_steps, -1))


def sequences(
    df: DataFrame, features: Sequence[str], target: str, n_steps: int,
    *, keys: Sequence[str] = KEYS, time_col: str = "time", ties: Sequence[str] = (), chunks="auto",
) -> DataFrame:
    """``x`` holds the features of the n_steps rows before, ``y`` the row's target.

    A series of r rows yields r - n_steps sequences. Drop incomplete rows first.
    """

    def build(d, w):
        return d.withColumn("x", _window_rows(features, n_steps, w))

    framed = over_rows(
        df, build, keys=keys, order_by=time_col, ties=ties, before=n_steps, chunks=chunks
    )
    return framed.where(F.size("x") == n_steps).select(
        *keys, time_col, "x", F.col(target).cast("double").alias("y")
    )


def sequence_frame(
    df: DataFrame, features: Sequence[str], target: str, n_steps: int,
    cuts: Sequence[float], names: Sequence[str],
    *, keys: Sequence[str] = KEYS, time_col: str = "time", ties: Sequence[str] = (), chunks="auto",
) -> DataFrame:
    """sequences with their chronological split, in one pass over the rows."""

    def build(d, w):
        split = _split_by_position(
            F.col("_pos") - n_steps, F.col("_total") - n_steps, cuts, names
        )
        return d.withColumn("x", _window_rows(features, n_steps, w)).withColumn("split", split)

    framed = over_rows(
        df, build, keys=keys, order_by=time_col, ties=ties, before=n_steps, positions=True, chunks=chunks
    )
    return framed.where(F.size("x") == n_steps).select(
        *keys, time_col, "x", F.col(target).cast("double").alias("y"), "split"
    )


def series_tail(
    df: DataFrame, n: int, *, keys: Sequence[str] = KEYS, time_col: str = "time", ties: Sequence[str] = ()
) -> DataFrame:
    """The last n rows of every series; every map task passes on at most n per series."""
    latest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_first() for c in (time_col, *ties)])
    return (
        df.withColumn("_rank", F.row_number().over(latest)).where(F.col("_rank") <= n).drop("_rank")
    )


def _split_by_position(pos: Column, n: Column, cuts, names) -> Column:
    split = F.lit(names[-1])
    for cut, name in reversed(list(zip(cuts, names))):
        split = F.when(pos < F.floor(F.lit(cut) * n), name).otherwise(split)
    return split


def chrono_split(
    df: DataFrame, cuts: Sequence[float] = (0.7, 0.85),
    names: Sequence[str] = ("train", "validation", "test"),
    *, keys: Sequence[str] = KEYS, time_col: str = "time", ties: Sequence[str] = (), chunks="auto",
) -> DataFrame:
    """Split by position in time; ``cuts`` are cumulative shares, rounded down."""

    def build(d, w):
        return d.withColumn(
            "split", _split_by_position(F.col("_pos"), F.col("_total"), cuts, names)
        )

    return over_rows(
        df, build, keys=keys, order_by=time_col, ties=ties, positions=True, chunks=chunks
    )


#: Rows of a series that share a range of the hash and are ranked together, on average.
ROWS_PER_RANGE = 10_000


def split_hash(keys: Sequence[str], time_col: str, seed: int, as_time: bool = True) -> Column:
    """60 bits of the MD5 of keys, time (in microseconds) and seed, which SQL can make too."""
    at = F.unix_micros(F.col(time_col).cast("timestamp")) if as_time else F.col(time_col)
    named = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], at.cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long")


def hash_split(
    df: DataFrame, test_size: float = 0.2, seed: int = 42,
    *, keys: Sequence[str] = KEYS, time_col: str = "time",
) -> DataFrame:
    """M1: exactly ceil(test_size * n) test rows per series, those with the smallest hashes.

    Repeatable and independent of row order and partitioning; rows of equal key and time are
    told apart by no rule. The hash is even, so counts per range of it show in which range the
    last test row lies. Only the rows of that one range are ranked: no series meets in a task.
    """
    as_time = isinstance(df.schema[time_col].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
    hashed = df.withColumn("_hash", split_hash(keys, time_col, seed, as_time))
    size = hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    sized = join_on(hashed, size.withColumn("_ranges", F.ceil(F.col("_rows") / ROWS_PER_RANGE)), list(keys))
    placed = sized.withColumn("_range", F.floor(F.col("_hash") / F.lit(float(1 << 60)) * F.col("_ranges")))
    along = Window.partitionBy(*keys).orderBy("_range")
    counts = (
        placed.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"), F.max("_rows").alias("_rows"))
        .withColumn("_to", F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_need", F.ceil(F.lit(test_size) * F.col("_rows")))
        .where((F.col("_to") >= F.col("_need")) & (F.col("_to") - F.col("_n") < F.col("_need")))
        .select(*keys, F.col("_range").alias("_last"), (F.col("_need") - F.col("_to") + F.col("_n")).alias("_take"))
    )
    judged = join_on(placed, counts, list(keys))
    ranked = Window.partitionBy(*keys, "_range").orderBy("_hash", time_col)
    sure = judged.where("_range <> _last or _last is null").withColumn(
        "split", F.when(F.col("_range") < F.col("_last"), "test").otherwise("train")
    )
    close = judged.where("_range = _last").withColumn("_at", F.row_number().over(ranked)).withColumn(
        "split", F.when(F.col("_at") <= F.col("_take"), "test").otherwise("train")
    )
    return sure.select(*df.columns, "split").unionByName(close.select(*df.columns, "split"))
