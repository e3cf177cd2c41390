"""Stored tables that change by pointer: S7, R4, and the merge of S8/J5/R2 that reads few files.

A table is a folder with ``data/<name>``, one folder of Parquet files for each write, and ``log/v=<n>``,
one small Parquet folder for each version. A write goes aside first; then its log entry, complete
and in a folder of its own, is renamed to the next version number. The rename is the commit: it
fails if that version is there, readers see the table before it or after it, and a failure in
between leaves only files that nothing points to (``drop_unused`` removes them).

An entry lists the written files, each with the cells of the key that it holds (days, or parts of
a hash), so a merge opens only files that can hold one of its batch's keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesengine.functions.columns import join_on
from seriesengine.sources.ingest import keep_first

LOG = "v long, replaces boolean, txn string, folder string, file string, cell string, n_rows long"
#: Parts of a hash that serve as cells of keys that are not times.
CELLS = 4096


class ConcurrentWrite(RuntimeError):
    """Another writer has committed the version that this one was about to."""


@dataclass(frozen=True)
class _Files:
    """The folder operations that Spark's writers lack: list, rename without overwriting, delete."""

    spark: SparkSession

    def _hadoop(self, path: str):
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        return jvm, at, at.getFileSystem(conf)

    def names(self, path: str) -> list[str]:
        _, at, fs = self._hadoop(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def rename(self, source: str, target: str) -> bool:
        """False if ``target`` exists."""
        jvm, at, fs = self._hadoop(target)
        fs.mkdirs(at.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf())
        options = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(jvm.org.apache.hadoop.fs.Path(source), at, options)
        except Py4JJavaError:
            if fs.exists(at):
                return False
            raise
        return True

    def delete(self, path: str) -> None:
        _, at, fs = self._hadoop(path)
        fs.delete(at, True)


def day_cell(time_col: str) -> Column:
    """A row's cell by its day."""
    return F.date_format(time_col, "yyyy-MM-dd")


def hash_cell(*on: str) -> Column:
    """A row's cell by its key's hash."""
    return F.pmod(F.xxhash64(*on), F.lit(CELLS)).cast("string")


def table_version(spark: SparkSession, path: str) -> int:
    """The newest version; 0 before the first write."""
    return max((int(n[2:]) for n in _Files(spark).names(f"{path}/log") if n.startswith("v=")), default=0)


def table_files(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The log entries (see LOG) that make up a version, the newest by default."""
    newest = table_version(spark, path) if version is None else version
    if not newest:
        return spark.createDataFrame([], LOG)
    log = spark.read.schema(LOG).parquet(f"{path}/log").where(F.col("v") <= newest)
    since = log.where("replaces").agg(F.coalesce(F.max("v"), F.lit(0)).alias("since"))
    return log.join(F.broadcast(since), F.col("v") >= F.col("since")).drop("since")  # one number


def _read(spark: SparkSession, entries: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of the files in ``entries``: only their names reach the driver."""
    files = [r["file"] for r in entries.where("file is not null").select("file").distinct().collect()]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def read_table(spark: SparkSession, path: str, schema: T.StructType, version: int | None = None) -> DataFrame:
    """A stored table as it stands after ``version`` (the newest), whole; empty before the first write."""
    entries = table_files(spark, path, version)
    folders = [f"{path}/{r['folder']}" for r in entries.where("folder is not null").select("folder").distinct().collect()]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def version_before(spark: SparkSession, path: str, txn: str) -> int:
    """The version that the write named ``txn`` found, or would find now."""
    made = table_files(spark, path).where(F.col("txn") == txn).agg(F.min("v")).first()[0]
    return table_version(spark, path) if made is None else made - 1


def _commit(df: DataFrame, path: str, replaces: bool, cell: Column | None, txn: str | None, base: int) -> int:
    spark = df.sparkSession
    if txn is not None and not table_files(spark, path, base).where(F.col("txn") == txn).isEmpty():
        return base  # a repeated write that has been committed before
    folder = f"data/{uuid.uuid4().hex}"
    # Rows of one cell lie together, so that a file holds few cells.
    placed = df if cell is None else df.repartitionByRange(cell).sortWithinPartitions(cell)
    placed.write.parquet(f"{path}/{folder}")
    kept = spark.read.schema(df.schema).parquet(f"{path}/{folder}")
    at = F.lit(None).cast("string") if cell is None else cell
    entry = kept.groupBy(F.input_file_name().alias("file"), at.alias("cell")).agg(F.count(F.lit(1)).alias("n_rows"))
    named = [F.lit(replaces).alias("replaces"), F.lit(txn).cast("string").alias("txn"), F.lit(folder).alias("folder")]
    # A row without a file tells of the write itself, also of one without rows.
    head = spark.createDataFrame([(replaces, txn, folder, None, None, None)], LOG.removeprefix("v long, "))
    aside = f"{path}/aside/{uuid.uuid4().hex}"
    entry.select(*named, "file", "cell", "n_rows").unionByName(head).write.parquet(aside)
    if not _Files(spark).rename(aside, f"{path}/log/v={base + 1}"):
        raise ConcurrentWrite(f"version {base + 1} of {path} is already written")
    return base + 1


def replace_table(df: DataFrame, path: str, cell: Column | None = None, txn: str | None = None) -> int:
    """A full refresh. ``df`` may read the table itself: its files stay until ``drop_unused``.

    ``txn`` names the write: one that has been committed is not repeated. Returns the version.
    """
    return _commit(df, path, True, cell, txn, table_version(df.sparkSession, path))


def append_table(df: DataFrame, path: str, cell: Column | None = None, txn: str | None = None) -> int:
    """Add the rows of ``df``; see ``replace_table``."""
    return _commit(df, path, False, cell, txn, table_version(df.sparkSession, path))


def files_for(batch: DataFrame, path: str, cell: Column, version: int | None = None) -> DataFrame:
    """The log entries of files that can hold a key of ``batch``: those with one of its cells.

    Files that were written without cells, or hold rows without one, can hold any.
    """
    entries = table_files(batch.sparkSession, path, version).where("file is not null")
    wanted = batch.select(cell.alias("cell")).where("cell is not null").distinct()
    held = entries.where("cell is not null").join(wanted, "cell", "left_semi")
    return held.unionByName(entries.where("cell is null"))


def merge_table(
    batch: DataFrame, path: str, on: Sequence[str], order_by: Sequence[str] = (), *, cell: Column, txn: str | None = None
) -> int:
    """Add the rows of ``batch`` whose key is not stored yet, one per key.

    A stored row wins, then ``order_by`` decides. ``cell`` must be a function of the key. Of the table only
    the key columns of the files with a cell of the batch are read.
    """
    spark = batch.sparkSession
    base = table_version(spark, path)
    stored = _read(spark, files_for(batch, path, cell, base), batch.schema)
    fresh = keep_first(batch, on, list(order_by) or list(on))
    new = join_on(fresh, stored.select(*on).distinct(), list(on), "left_anti")
    return _commit(new, path, False, cell, txn, base)


def drop_unused(spark: SparkSession, path: str) -> int:
    """Delete what no entry of the newest version points to; returns how many folders went.

    Only while nothing writes to the table or reads an older version of it.
    """
    files, newest = _Files(spark), table_files(spark, path)
    live = {r["folder"] for r in newest.where("folder is not null").select("folder").distinct().collect()}
    since = newest.agg(F.min("v")).first()[0] or 0
    unused = [f"{path}/data/{n}" for n in files.names(f"{path}/data") if f"data/{n}" not in live]
    unused += [f"{path}/aside/{n}" for n in files.names(f"{path}/aside")]
    unused += [f"{path}/log/{n}" for n in files.names(f"{path}/log") if int(n[2:]) < since]
    for name in unused:
        files.delete(name)
    return len(unused)
