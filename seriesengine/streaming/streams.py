"""Streaming forms of the operators: R1–R7.

Functions named ``stream_*`` take and return streaming frames. The ``start_*``
functions run a query whose every micro-batch can be repeated without changing the
result, so a lost executor or a restart from the checkpoint loses and doubles nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from seriesengine.functions.columns import join_on, row_mean
from seriesengine.operators.chunks import KEYS
from seriesengine.operators.rolling import moving_averages
from seriesengine.operators.sequences import series_tail
from seriesengine.schemas import PRICES
from seriesengine.sources.files import missing_as_null
from seriesengine.session import materialize
from seriesengine.sources.ingest import keep_first
from seriesengine.sources.tables import append_table, merge_table, read_table, replace_table, version_before


def read_landed(
    spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "json",
    files_per_batch: int | None = None, **options: str,
) -> DataFrame:
    """Files landing in a folder as a stream (text, JSON, CSV or Parquet)."""
    reader = spark.readStream.schema(schema).format(fmt).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return missing_as_null(reader.load(path))


def event_time(df: DataFrame, time_col: str, delay: str) -> DataFrame:
    """Watermark on ``time_col``, which must be TIMESTAMP: a zoneless one is cast."""
    if not isinstance(df.schema[time_col].dataType, T.TimestampType):
        df = df.withColumn(time_col, F.col(time_col).cast("timestamp"))
    return df.withWatermark(time_col, delay)


def stream_dedup(
    df: DataFrame, on: Sequence[str], delay: str = "1 day", time_col: str = "time"
) -> DataFrame:
    """R2: the first arrival of every key; state is kept for ``delay`` only."""
    return event_time(df, time_col, delay).dropDuplicatesWithinWatermark(list(on))


def stream_bars(
    ticks: DataFrame, value: str = "value", width: str = "4 hours", delay: str = "10 minutes",
    ties: Sequence[str] = (), *, keys: Sequence[str] = KEYS, time_col: str = "time",
) -> DataFrame:
    """Open, high, low and close per time window; a bar appears once its window is closed.

    The windows open at the end never appear, and later rows are dropped (R7); ``bar_parts``
    has neither limit.
    """
    at = F.struct(time_col, *ties)
    return (
        event_time(ticks, time_col, delay)
        .groupBy(F.window(time_col, width).alias("_w"), *keys)
        .agg(
            F.min_by(value, at).alias("open"), F.max(value).alias("high"),
            F.min(value).alias("low"), F.max_by(value, at).alias("close"),
        )
        .select(*keys, F.col("_w.start").alias("time"), *PRICES)
    )


def stream_daily_average(
    bars: DataFrame, delay: str = "1 hour", *, keys: Sequence[str] = KEYS, time_col: str = "time"
) -> DataFrame:
    """A1 over a stream; a date appears once the watermark has passed its end.

    R7: rows later than that are dropped by the watermark; ``daily_average_parts`` keeps them.
    """
    return (
        event_time(bars, time_col, delay)
        .groupBy(F.window(time_col, "1 day").alias("_w"), *keys)
        .agg(F.avg(row_mean(*PRICES)).alias("average_price"))
        .select(*keys, F.to_date("_w.start").alias("date"), "average_price")
    )


# R4 needs no form of its own: weekday_change and sentiment_distribution accept a
# streaming frame and hold 7 and 3 groups per series, for complete output mode.


def _each_batch(stream: DataFrame, checkpoint: str, write: Callable, mode: str = "append") -> StreamingQuery:
    """Call ``write(batch, batch_id)`` for everything available."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.outputMode(mode).foreachBatch(write).start()


def start_table(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Run a stream over everything available into a table.

    ``append`` uses the Parquet file sink, exactly once. ``complete`` replaces the table with the
    newest result after every batch; read it with ``read_table``, which shows the table before
    a batch or after it, never in between.
    """
    if mode == "append":
        writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        return writer.outputMode("append").format("parquet").option("path", path).start()

    def replace(batch: DataFrame, batch_id: int) -> None:
        replace_table(batch, path, txn=f"{checkpoint}:{batch_id}")

    return _each_batch(stream, checkpoint, replace, "complete")


def start_merge(
    stream: DataFrame, path: str, checkpoint: str, on: Sequence[str],
    order_by: Sequence[str] = (), *, cell: Column,
) -> StreamingQuery:
    """Add to the stored table at ``path`` the keys it does not hold yet (see ``merge_table``).

    Only the key columns of files with a ``cell`` of the batch are read, so a batch costs what it
    holds, not what the table holds. A repeated batch finds itself committed and adds nothing.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        merge_table(batch, path, on, order_by, cell=cell, txn=f"{checkpoint}:{batch_id}")

    return _each_batch(stream, checkpoint, merge)


# -- R3, R6, R7: aggregates that no row is too late for ---------------------------------------


def start_parts(
    stream: DataFrame, partial: Callable[[DataFrame], DataFrame], path: str, checkpoint: str
) -> StreamingQuery:
    """Append each micro-batch's partial aggregates to the table at ``path``.

    A part can be merged with others of its group at any time, so windows that are open at the
    end are there, a row may come as late as it likes, and no state is kept between batches.
    A repeated batch finds itself committed.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        append_table(partial(batch), path, txn=f"{checkpoint}:{batch_id}")

    return _each_batch(stream, checkpoint, add)


def bar_parts(
    ticks: DataFrame, value: str = "value", width: str = "4 hours", ties: Sequence[str] = (),
    *, keys: Sequence[str] = KEYS, time_col: str = "time",
) -> DataFrame:
    """Per time window its first and last (time, ties, value) and its extremes."""
    at = F.struct(time_col, *ties, F.col(value).alias("_value"))
    return ticks.groupBy(*keys, F.window(time_col, width).alias("_w")).agg(
        F.min(at).alias("first"), F.max(value).alias("high"), F.min(value).alias("low"), F.max(at).alias("last")
    ).select(*keys, F.col("_w.start").alias("time"), "first", "high", "low", "last")


def merged_bars(parts: DataFrame, *, keys: Sequence[str] = KEYS) -> DataFrame:
    """The bars that parts add up to, complete up to the newest batch."""
    return parts.groupBy(*keys, "time").agg(
        F.min("first")["_value"].alias("open"), F.max("high").alias("high"),
        F.min("low").alias("low"), F.max("last")["_value"].alias("close"),
    )


def daily_average_parts(bars: DataFrame, *, keys: Sequence[str] = KEYS, time_col: str = "time") -> DataFrame:
    """Per date the sum and the number of the bars' mean prices; rows without a time are left out."""
    priced = bars.select(*keys, F.to_date(time_col).alias("date"), row_mean(*PRICES).alias("_mean"))
    return priced.where("date is not null").groupBy(*keys, "date").agg(
        F.sum("_mean").alias("total"), F.count("_mean").alias("n")
    )


def merged_daily_average(parts: DataFrame, *, keys: Sequence[str] = KEYS) -> DataFrame:
    """A1 as the parts add up to it."""
    return parts.groupBy(*keys, "date").agg(
        F.try_divide(F.sum("total"), F.sum("n")).alias("average_price")
    )


def start_rolling(
    stream: DataFrame, path: str, checkpoint: str,
    build: Callable[[DataFrame], DataFrame] = moving_averages, reach: int = 29,
    *, keys: Sequence[str] = KEYS, time_col: str = "time",
) -> StreamingQuery:
    """Row-window features over a stream, for rows that come in any order.

    Row frames need the rows before a batch, so the last ``2 * reach`` rows of every series are
    kept beside the output, one version per batch, and all accepted rows in a table. A row that
    comes late but among the last ``reach`` rows of its series is put in its place and the rows
    after it are computed again. For one later than that (R7), the rows from ``reach`` before
    the first to ``reach`` after the last such row of its series are fetched from that table and
    computed again; without such rows it is never read. A time that is there already is ignored.
    Batch b reads version b - 1 and replaces version b, and its output partition, as a whole.
    Read the result with ``read_rolling``.
    """
    on = [*keys, time_col]

    def update(batch: DataFrame, batch_id: int) -> None:
        spark, schema = batch.sparkSession, batch.schema
        kept = spark.createDataFrame([], schema)
        if batch_id:  # a version that is lost must not pass for an empty one
            kept = spark.read.schema(schema).parquet(f"{path}/tail/{batch_id - 1}")
        txn = f"{checkpoint}:{batch_id}"
        oldest = _nth_latest(kept, reach, keys, time_col)
        fits = F.col("_limit").isNull() | F.coalesce(F.col(time_col) >= F.col("_limit"), F.lit(False))
        placed = materialize(
            join_on(keep_first(batch.where(F.col(time_col).isNotNull()), on, on), oldest, list(keys))
            .withColumn("_late", ~fits).drop("_limit")
        )
        near, late = (placed.where(c).drop("_late") for c in ("not _late", "_late"))
        new = join_on(near, kept.select(*on), on, "left_anti")
        again = None
        if not late.isEmpty():
            before = version_before(spark, f"{path}/stored", txn)
            stored = read_table(spark, f"{path}/stored", schema, before)
            late = materialize(join_on(late, stored.select(*on), on, "left_anti"))
            again = _around(stored, late, new, build, reach, keys, time_col)
            kept = kept.unionByName(late)
        rows = kept.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
        changed = rows.where("_new = 1").groupBy(*keys).agg(F.min(time_col).alias("_from"))
        result = join_on(build(rows.drop("_new")), changed, list(keys), "inner")
        result = result.where(F.col(time_col) >= F.col("_from")).drop("_from")
        if again is not None:
            result = result.unionByName(again).dropDuplicates(on)
        result.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        tail = series_tail(rows.drop("_new"), 2 * reach, keys=keys, time_col=time_col)
        tail.write.mode("overwrite").parquet(f"{path}/tail/{batch_id}")
        append_table(new.unionByName(late), f"{path}/stored", txn=txn)

    return _each_batch(stream, checkpoint, update)


def _around(
    stored: DataFrame, late: DataFrame, new: DataFrame, build: Callable[[DataFrame], DataFrame], reach: int,
    keys: Sequence[str], time_col: str,
) -> DataFrame:
    """The features of all rows that late rows change: from the first to ``reach`` after the last of a series."""
    span = late.groupBy(*keys).agg(F.min(time_col).alias("_first"), F.max(time_col).alias("_last"))
    rows = join_on(stored.unionByName(late).unionByName(new), span, list(keys), "inner")
    t = F.col(time_col)
    ahead = series_tail(rows.where(t < F.col("_first")), reach, keys=keys, time_col=time_col)
    following = Window.partitionBy(*keys).orderBy(t)
    after = rows.where(t > F.col("_last")).withColumn("_n", F.row_number().over(following))
    after = after.where(F.col("_n") <= reach).drop("_n")
    within = rows.where(t.between(F.col("_first"), F.col("_last")))
    part = ahead.unionByName(within).unionByName(after).drop("_first", "_last")
    features = join_on(build(part), span, list(keys), "inner")
    return features.where(t >= F.col("_first")).drop("_first", "_last")


def _nth_latest(df: DataFrame, n: int, keys: Sequence[str], time_col: str) -> DataFrame:
    tail = series_tail(df.select(*keys, time_col), n, keys=keys, time_col=time_col)
    per_series = tail.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), F.min(time_col).alias("_limit")
    )
    return per_series.where(F.col("_rows") >= n).drop("_rows")


def read_rolling(
    spark: SparkSession, path: str, *, keys: Sequence[str] = KEYS, time_col: str = "time"
) -> DataFrame:
    """The newest version of every row written by ``start_rolling``."""
    written = spark.read.parquet(f"{path}/rows")
    return keep_first(written, [*keys, time_col], [F.desc("batch")]).drop("batch")
