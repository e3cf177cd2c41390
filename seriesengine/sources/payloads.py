"""Landed JSON payloads to rows: S4, S5, S6. One payload per row of the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesengine.functions.columns import lenient_time, millis_time
from seriesengine.schemas import MARKET_PAYLOAD, NEWS_PAYLOAD, OHLC_PAYLOAD


def _required(values: Column, message: str) -> Column:
    """``values`` unless it is empty or missing, which fails the query."""
    return F.when(F.coalesce(F.size(values), F.lit(0)) > 0, values).otherwise(
        F.raise_error(F.lit(message))
    )


def _others(df: DataFrame, col: str) -> list[str]:
    return [c for c in df.columns if c != col]


def parse_ohlc_json(df: DataFrame, col: str = "value") -> DataFrame:
    """``[[ms, open, high, low, close], …]`` to one bar per row."""
    bars = _required(F.from_json(col, OHLC_PAYLOAD), "no bars in the payload")
    rows = F.transform(
        bars,
        lambda r: F.struct(
            millis_time(r[0]).alias("time"),
            r[1].alias("open"), r[2].alias("high"), r[3].alias("low"), r[4].alias("close"),
        ),
    )
    return df.select(*_others(df, col), F.inline(rows))


def parse_market_json(df: DataFrame, col: str = "value") -> DataFrame:
    """Three parallel ``[ms, value]`` arrays, matched by position.

    Times come from ``prices``. Empty prices and arrays of unequal length are errors.
    """
    parsed = df.withColumn("_p", F.from_json(col, MARKET_PAYLOAD))
    empty = F.array().cast("array<array<double>>")
    prices, caps, volumes = [
        F.coalesce(F.col(f"_p.{n}"), empty) for n in ("prices", "market_caps", "total_volumes")
    ]
    equal = (F.size(prices) == F.size(caps)) & (F.size(prices) == F.size(volumes))
    zipped = F.when(
        equal,
        F.arrays_zip(
            _required(prices, "no prices in the payload").alias("p"), caps.alias("c"),
            volumes.alias("v"),
        ),
    ).otherwise(F.raise_error(F.lit("arrays of unequal length in the payload")))
    rows = F.transform(
        zipped,
        lambda z: F.struct(
            millis_time(z["p"][0]).alias("time"),
            z["p"][1].alias("price"),
            z["c"][1].alias("market_cap"),
            z["v"][1].alias("total_volume"),
        ),
    )
    return parsed.select(*_others(df, col), F.inline(rows))


def parse_news_json(df: DataFrame, col: str = "value") -> DataFrame:
    """``{articles: […]}`` to one article per row; articles without a valid time dropped.

    A page without articles, as the last of a search is, gives no rows.
    """
    rows = df.select(*_others(df, col), F.inline(F.from_json(col, NEWS_PAYLOAD)["articles"]))
    return rows.withColumn("published_at", lenient_time("publishedAt")).drop("publishedAt").dropna(
        subset=["published_at"]
    )
