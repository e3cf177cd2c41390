"""Session settings and the two ways this library cuts a long plan."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

# UTC keeps TIMESTAMP and TIMESTAMP_NTZ in the same order and on the same dates.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, and the master is local, a folder in the warehouse serves until the
    process ends: on a cluster other executors could not read a folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    made = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/seriesengine-{uuid.uuid4().hex}"
    spark.conf.set("spark.checkpoint.dir", made)
    atexit.register(shutil.rmtree, made.removeprefix("file:"), ignore_errors=True)
    return made


def materialize(df: DataFrame, *folders: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Used where several passes follow (fit, evaluate, predict): later passes
    prune columns, know the real size, and a lost executor costs a re-read
    instead of the whole lineage. With ``folders``, columns of few values, a pass over some
    of their values reads no others. ``discard`` deletes it again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.partitionBy(*folders).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once nothing will read them any more."""
    for df in written:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of queries that have ended and that nothing refers to any more.

    It does so when the driver's memory is collected, which may be long after the disk is full. The last query
    is referred to until another one has run.
    """
    gc.collect()
    spark.range(1).count()
    spark._jvm.System.gc()
