"""The library's tables, derived from whole given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesengine.schemas import METRICS, PRICES
from seriesengine.sources.files import spread

__all__ = [
    "METRICS", "PRICES", "articles", "bars", "daily_bars", "dated_articles", "lexicon", "metrics",
    "modifiers", "table", "ticks",
]

# Terms frequent in the documents, with valences for tests only.
LEXICON = (
    ("the", 0.4), ("and", -0.6), ("tion", 1.9), ("ing", -1.3), ("an", 0.8), ("er", -0.4),
    ("de", 0.3), ("la", -0.7), ("que", 1.2), ("ou", -2.1), ("en", 0.9), ("der", -0.2),
    ("die", 1.1), ("und", -0.5), ("le", 0.6), ("et", -1.7), ("ha", 2.3), ("re", -0.9),
)
BOOSTERS = (("that", 0.293), ("in", 0.293), ("los", 0.293), ("of", -0.293), ("von", -0.293))
NEGATIONS = ("is", "with", "es", "ist", "un")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: 4-hour bars of the event stream, one series per event type."""
    at = F.struct("ts", "event_id")
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("series"), F.window("ts", "4 hours").alias("_w"))
        .agg(
            F.min_by("value", at).alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", at).alias("close"),
        )
        .select("series", F.col("_w.start").alias("time"), "open", "high", "low", "close")
    )


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: daily metrics of the orders, one series per priority."""
    price = F.col("o_totalprice")
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("series"), F.col("o_orderdate").alias("time"))
        .agg(
            F.avg(price).alias("price"),
            F.sum(price).alias("market_cap"),
            F.count(F.lit(1)).cast("double").alias("total_volume"),
        )
    )


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: daily bars of the line items, one series per return flag."""
    price = F.col("l_extendedprice")
    # One number orders the lines: a struct would force a sort-based aggregate.
    at = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_returnflag").alias("series"), F.col("l_shipdate").alias("time"))
        .agg(
            F.min_by(price, at).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, at).alias("close"),
        )
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: documents as news articles, the whole text as title; ``doc_id`` orders them."""
    return spread(
        table(spark, sf_dir, "documents").select(
            "doc_id",
            F.col("text").alias("title"),
            F.col("text").alias("description"),
            F.col("source").alias("url"),
            "lang",
        )
    )


def dated_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4 with a publication time: one article a minute, in ``doc_id`` order."""
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    return articles(spark, sf_dir).select(
        "*", (start + F.make_dt_interval(mins=F.col("doc_id").cast("int"))).alias("published_at")
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw events as one long series per event type."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("series"), F.col("ts").alias("time"),
        F.col("value").alias("close"),
    )


def lexicon(spark: SparkSession) -> DataFrame:
    """V6: the valence table."""
    return spark.createDataFrame(list(LEXICON), "term string, valence double")


def modifiers(spark: SparkSession) -> DataFrame:
    """V6: boosters and negations."""
    rows = [(t, b, False) for t, b in BOOSTERS] + [(t, 0.0, True) for t in NEGATIONS]
    return spark.createDataFrame(rows, "term string, boost double, negates boolean")
