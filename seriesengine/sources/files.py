"""Files in and out: S1, S2, S7, S11."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesengine.functions.columns import nan_to_null
from seriesengine.schemas import with_time_named

# Quoted fields may hold commas and doubled quotes; ``enforceSchema`` off makes a
# file with other headers an error instead of shifted columns.
CSV_OPTIONS = {"header": "true", "escape": '"', "enforceSchema": "false"}


def missing_as_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating point column, once, at the border."""
    floats = [
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    ]
    return df.withColumns({c: nan_to_null(c) for c in floats}) if floats else df


def read_series(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fmt: str = "parquet",
    missing_ok: bool = False,
    time_col: str = "time",
    strict: bool = True,
    multi_line: bool = False,
) -> DataFrame:
    """Read Parquet, ORC, JSON or CSV with a fixed schema.

    With ``missing_ok`` an absent path is an empty table. ``time_col`` names the
    file's time column, returned as ``time``. A malformed value fails the read when
    ``strict`` and becomes NULL otherwise. ``multi_line`` is for CSV whose quoted
    fields hold line breaks; it keeps a file from being split over tasks.
    """
    wanted = with_time_named(schema, time_col)
    reader = spark.read.schema(wanted)
    if fmt in ("csv", "json"):
        reader = reader.option("mode", "FAILFAST" if strict else "PERMISSIVE")
    if fmt == "csv":
        reader = reader.options(**CSV_OPTIONS).option("multiLine", str(multi_line).lower())
    try:
        df = reader.format(fmt).load(path)
    except AnalysisException as e:
        if missing_ok and e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise
    return missing_as_null(df.withColumnRenamed(time_col, "time"))


def spread(df: DataFrame) -> DataFrame:
    """Use every core on a freshly read table with fewer splits than the cluster has cores.

    A small file is often a single row group, hence a single task, which per-row
    text work feels. A large table has splits enough and is returned as it is.
    ``df`` must be a scan: counting the partitions of a shuffled plan would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def write_series(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet",
    mode: str = "overwrite",
) -> None:
    """Full refresh of a table.

    Refuses to overwrite files that ``df`` still reads. With ``partition_by`` the
    rows are rebalanced on those columns first: few files per partition, and a
    partition too large for one task is split.
    """
    target = path.rstrip("/") + "/"
    if mode == "overwrite" and any(target in f for f in df.inputFiles()):
        raise ValueError(f"{path} is an input of this table; write elsewhere and switch")
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def latest_articles(df: DataFrame, limit: int = 100) -> DataFrame:
    """At most ``limit`` articles, newest first; a top-k, not a full sort."""
    return df.orderBy(
        F.col("published_at").desc_nulls_last(), F.col("url"), F.col("title")
    ).limit(limit)
