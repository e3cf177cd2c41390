"""Table schemas. ``series`` is the key that lets one table hold many assets."""

from pyspark.sql import types as T


def _doubles(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.DoubleType()) for n in names]


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


_SERIES = T.StructField("series", T.StringType())
_TIME = T.StructField("time", T.TimestampType())

PRICES = ("open", "high", "low", "close")
METRICS = ("price", "market_cap", "total_volume")

OHLC = T.StructType([_SERIES, _TIME, *_doubles(*PRICES)])
MARKET_METRICS = T.StructType([_SERIES, _TIME, *_doubles(*METRICS)])
NEWS = T.StructType(
    [*_strings("title", "description", "url"), T.StructField("published_at", T.TimestampType())]
)
NEWS_SENTIMENT = T.StructType(
    [
        *NEWS.fields,
        *_doubles("sentiment_neg", "sentiment_neu", "sentiment_pos", "sentiment_compound"),
    ]
)
INGEST_STATE = T.StructType(
    [T.StructField("source", T.StringType()), T.StructField("last_ts", T.TimestampType())]
)

# Landed JSON payloads (DDL for from_json).
OHLC_PAYLOAD = "array<array<double>>"
MARKET_PAYLOAD = (
    "prices array<array<double>>, market_caps array<array<double>>, "
    "total_volumes array<array<double>>"
)
NEWS_PAYLOAD = (
    "articles array<struct<title: string, description: string, url: string, publishedAt: string>>"
)


def without_series(schema: T.StructType) -> T.StructType:
    """The single-asset file layout: the same columns without the key."""
    return T.StructType([f for f in schema.fields if f.name != "series"])


def with_time_named(schema: T.StructType, time_col: str) -> T.StructType:
    """The schema of a file whose time column carries another header."""
    return T.StructType(
        [T.StructField(time_col, f.dataType) if f.name == "time" else f for f in schema.fields]
    )
