"""The registered queries: every operator over whole given tables.

Doubles are rounded only here, so that two engines' sums compare equal.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import seriesengine as se
from seriesengine.plans import views as V
from seriesengine.session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(se.configure(spark), sf_dir)

    QUERIES[f.__name__] = run
    return f


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every double, by way of a decimal of three places more: a mean that lies exactly between
    two rounded values has one place more, so no last bit decides which way it goes."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(F.col(c).cast(f"decimal(38,{digits + 3})"), digits).cast("double") for c in doubles})


# -- rolling windows, features ----------------------------------------------------------------


@query
def moving_averages(spark, d):
    return rounded(se.moving_averages(V.bars(spark, d)))


@query
def moving_averages_cut_series(spark, d):
    """The same windows with every series cut into chunks, as a very long one would be."""
    bars = V.daily_bars(spark, d)
    return rounded(se.moving_averages(bars, chunks=se.plan_chunks(bars, rows_per_chunk=300)))


@query
def rolling_partial_mean(spark, d):
    return rounded(se.rolling_mean(V.ticks(spark, d), "close", 5, "mean_5", min_periods=1))


@query
def rolling_std(spark, d):
    return rounded(se.rolling_std(V.ticks(spark, d), "close", 7, "std_7"))


@query
def pct_change(spark, d):
    return rounded(se.pct_change(V.ticks(spark, d), "close", "change"), 6)


@query
def pct_change_filled(spark, d):
    """Gaps (values under 5) are filled forward before the change is taken."""
    gaps = V.ticks(spark, d).withColumn("close", F.when(F.col("close") >= 5, F.col("close")))
    return rounded(se.pct_change(gaps, "close", "change"), 6)


@query
def diff(spark, d):
    return rounded(se.diff(V.ticks(spark, d), "close", "change"))


@query
def lag_close(spark, d):
    return se.lag(V.ticks(spark, d), "close", 1, "lag_close")


@query
def ohlc_features(spark, d):
    return rounded(se.ohlc_features(V.daily_bars(spark, d)))


@query
def lag_features(spark, d):
    return se.lag_features(V.bars(spark, d))


@query
def market_features(spark, d):
    return rounded(se.market_features(V.metrics(spark, d), scaled=False))


@query
def market_features_scaled(spark, d):
    return rounded(se.market_features(V.metrics(spark, d)))


@query
def cap_to_volume(spark, d):
    m = V.metrics(spark, d)
    return rounded(m.select("series", "time", se.ratio("market_cap", "total_volume").alias("ratio")))


@query
def trailing_range(spark, d):
    return rounded(se.trailing_range(V.metrics(spark, d), 30))


@query
def chart_overlay(spark, d):
    bars = V.bars(spark, d)
    ahead = se.future_frame(se.ohlc_features(bars), 5, frozen=["moving_avg_5"])
    forecast = ahead.withColumnRenamed("moving_avg_5", "predicted_price")
    return rounded(se.chart_overlay(se.daily_average(bars), forecast))


@query
def seasonal_decompose(spark, d):
    out = se.seasonal_decompose(V.daily_bars(spark, d))
    return rounded(out.select("series", "time", "close", "trend", "seasonal", "residual"), 3)


@query
def seasonal_decompose_even(spark, d):
    """An even period (30 rows) on the daily metrics."""
    out = se.seasonal_decompose(V.metrics(spark, d), "price", period=30, min_rows=60)
    return rounded(out.select("series", "time", "price", "trend", "seasonal", "residual"), 3)


# -- aggregates and checks --------------------------------------------------------------------


@query
def daily_average(spark, d):
    return rounded(se.daily_average(V.bars(spark, d)))


@query
def weekday_change(spark, d):
    return rounded(se.weekday_change(V.daily_bars(spark, d)))


@query
def duplicate_times(spark, d):
    orders = V.table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("series"), F.col("o_orderdate").alias("time")
    )
    return se.duplicate_times(orders)


@query
def quality_report(spark, d):
    labelled = V.table(spark, d, "documents").join(V.table(spark, d, "labels"), "doc_id", "left")
    return se.quality_report(labelled, ["quality", "toxic"], keys=["lang"])


@query
def regression_metrics(spark, d):
    features = se.ohlc_features(V.daily_bars(spark, d))
    return rounded(se.regression_metrics(features, "close", "moving_avg_5"), 2)


# -- sources and merges -----------------------------------------------------------------------


def _orders_as_stored(spark, d):
    return V.table(spark, d, "orders").select(
        F.col("o_orderdate").alias("time"), (F.col("o_orderkey") * 10).alias("seq"),
        F.col("o_totalprice").alias("value"),
    )


def _lines_as_batch(spark, d):
    return V.table(spark, d, "lineitem").select(
        F.col("l_shipdate").alias("time"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.col("l_extendedprice").alias("value"),
    )


@query
def merge_bars(spark, d):
    """Orders are stored, line items arrive; one value per date stays."""
    return se.merge_keep_first(
        _orders_as_stored(spark, d), _lines_as_batch(spark, d), ["time"], ["seq"]
    )


@query
def new_bars(spark, d):
    return se.new_rows(_orders_as_stored(spark, d), _lines_as_batch(spark, d), ["time"], ["seq"])


@query
def merge_articles(spark, d):
    """Labelled articles are stored, all articles arrive; (title, url) is the key."""
    articles = V.articles(spark, d)
    labelled = articles.join(V.table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    merged = se.merge_keep_first(labelled, articles, ["title", "url"], ["doc_id"])
    return merged.select("doc_id", "title", "url")


@query
def latest_articles(spark, d):
    return se.latest_articles(V.dated_articles(spark, d)).select(
        "title", "url", F.col("published_at").cast("timestamp_ntz").alias("published_at")
    )


@query
def freshness_gate(spark, d):
    state = V.table(spark, d, "events").groupBy(F.col("user_id").alias("source")).agg(
        F.max("ts").alias("last_ts")
    )
    now = F.to_timestamp_ntz(F.lit("2024-01-31 00:00:00"))
    return se.due_for_ingest(state, now)


def _as_ms(c):
    return F.unix_millis(F.col(c).cast("timestamp")).cast("double")


@query
def parse_ohlc_json(spark, d):
    """Payloads of one day each, written from the bars and parsed back."""
    row = F.array(_as_ms("time"), "open", "high", "low", "close")
    landed = V.bars(spark, d).groupBy("series", F.to_date("time").alias("_day")).agg(
        F.to_json(F.collect_list(row)).alias("value")
    )
    parsed = se.parse_ohlc_json(landed.drop("_day"))
    return parsed.withColumn("time", F.col("time").cast("timestamp_ntz"))


@query
def parse_market_json(spark, d):
    """Payloads of one month each, three parallel arrays ordered by time."""
    rows = F.array_sort(F.collect_list(F.struct(_as_ms("time").alias("ms"), *V.METRICS)))

    def series(c):
        return F.transform("_rows", lambda r: F.array(r["ms"], r[c]))

    payload = F.to_json(
        F.struct(
            series("price").alias("prices"), series("market_cap").alias("market_caps"),
            series("total_volume").alias("total_volumes"),
        )
    )
    landed = (
        V.metrics(spark, d).groupBy("series", F.trunc("time", "month")).agg(rows.alias("_rows"))
        .select("series", payload.alias("value"))
    )
    parsed = se.parse_market_json(landed)
    return rounded(parsed.withColumn("time", F.col("time").cast("timestamp_ntz")))


@query
def parse_news_json(spark, d):
    """One payload per article; Spanish ones carry an unreadable time and are dropped."""
    article = F.struct(
        "title", "description", "url",
        F.when(F.col("lang") == "es", "unknown").otherwise(
            F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
        ).alias("publishedAt"),
    )
    landed = V.dated_articles(spark, d).select(
        "doc_id", F.to_json(F.struct(F.array(article).alias("articles"))).alias("value")
    )
    parsed = se.parse_news_json(landed)
    return parsed.select(
        "doc_id", "title", "description", "url",
        F.col("published_at").cast("timestamp_ntz").alias("published_at"),
    )


@query
def ingest_bars(spark, d):
    """Payloads of two sources ingested at three times: the second time is within six hours of the
    first for one of them, and what it brings is left for the third."""
    path, ms = _folder(spark), _as_ms("time")
    row = F.array(ms, "open", "high", "low", "close")
    late = F.pmod(F.hash("time"), F.lit(3)) == 0

    def run(source: str, rows: DataFrame, hour: int) -> bool:
        landed = rows.groupBy("series", F.to_date("time").alias("_d")).agg(F.to_json(F.collect_list(row)).alias("value"))
        return se.ingest(
            source, landed.drop("_d"), se.parse_ohlc_json, f"{path}/bars", f"{path}/state", datetime(2024, 2, 1, hour),
            on=["series", "time"], cell=se.day_cell("time"),
        )

    bars = V.bars(spark, d)
    clicks, others = bars.where("series = 'click'"), bars.where("series <> 'click'")
    done = [run("click", clicks.where(~late), 0), run("click", clicks, 5), run("others", others, 5), run("click", clicks, 6)]
    done.append(run("others", others.withColumn("open", F.lit(0.0)), 11))  # stored rows win
    if done != [True, False, True, True, True]:
        raise ValueError(f"ingested: {done}")
    stored = se.read_table(spark, f"{path}/bars", se.schemas.OHLC)
    return stored.withColumn("time", F.col("time").cast("timestamp_ntz"))


@query
def csv_bars(spark, d):
    """Bars written as CSV by series, read back with a fixed schema and checked."""
    path, order = _folder(spark), ["series", "time", *V.PRICES]
    utc = V.bars(spark, d).withColumn("time", F.col("time").cast("timestamp"))
    se.write_series(utc.select(*order), path, fmt="csv")
    back = se.require_columns(se.read_series(spark, path, se.schemas.OHLC, "csv"), order, min_rows=30)
    return back.withColumn("time", F.col("time").cast("timestamp_ntz"))


@query
def load_or_empty(spark, d):
    """A table that is not there yet is empty: the merge with it is the batch."""
    absent = se.read_series(spark, _folder(spark), se.schemas.OHLC, missing_ok=True)
    batch = V.bars(spark, d).withColumn("time", F.col("time").cast("timestamp"))
    merged = se.merge_keep_first(absent, batch, ["series", "time"])
    return merged.withColumn("time", F.col("time").cast("timestamp_ntz"))


@query
def time_order(spark, d):
    """The place of every event in the order of time, over all series."""
    events = V.table(spark, d, "events").select("event_id", "ts")
    return se.global_positions(events, ["ts", "event_id"], partitions=16)


@query
def sorted_files(spark, d):
    """Events in sorted files: how many rows, and how many files break the order."""
    path = _folder(spark)
    events = V.table(spark, d, "events").select("event_id", "ts")
    se.write_sorted(events, path, ["ts", "event_id"], partitions=16)
    back = spark.read.schema(events.schema).parquet(path)
    rows = back.agg(F.count(F.lit(1)).alias("n_rows"))
    broken = se.order_violations(back, path, ["ts", "event_id"]).agg(F.count(F.lit(1)).alias("n_broken"))
    return rows.withColumn("n_broken", broken.scalar())


@query
def lenient_time(spark, d):
    """Order dates as text, replaced by something unreadable on finished orders."""
    text = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    )
    return V.table(spark, d, "orders").select(
        "o_orderkey", se.lenient_time(text).cast("timestamp_ntz").alias("time")
    )


# -- scaling, sequences, splits ---------------------------------------------------------------


@query
def minmax_scale(spark, d):
    bars = V.daily_bars(spark, d)
    cols = list(V.PRICES)
    return rounded(se.apply_minmax(bars, se.fit_minmax(bars, cols), cols), 6)


@query
def inverse_scale(spark, d):
    bars = V.daily_bars(spark, d)
    params = se.fit_minmax(bars, list(V.PRICES))
    scaled = se.apply_minmax(bars, params, list(V.PRICES))
    return rounded(se.invert_minmax(scaled, params, list(V.PRICES)))


@query
def sequences(spark, d):
    """One row per step of every five-step sequence."""
    made = se.sequences(V.bars(spark, d), ["close", "high"], "close", 5)
    steps = made.select("series", "time", "y", F.posexplode("x").alias("step", "v"))
    return steps.select(
        "series", "time", "y", "step", F.col("v")[0].alias("close"), F.col("v")[1].alias("high")
    )


@query
def sequence_frame(spark, d):
    """The same sequences with their 70/15/15 split, counted by split."""
    frame = se.sequence_frame(
        V.bars(spark, d), ["close", "high"], "close", 30, (0.7, 0.85),
        ("train", "validation", "test"),
    )
    return rounded(
        frame.groupBy("series", "split").agg(
            F.count("x").alias("n"), F.min("time").alias("first"), F.max("time").alias("last"),
            F.avg("y").alias("mean_y"),
        )
    )


@query
def series_tail(spark, d):
    return se.series_tail(V.ticks(spark, d), 30)


@query
def chrono_split(spark, d):
    return se.chrono_split(V.ticks(spark, d))


@query
def hash_split_members(spark, d):
    """Which row is in which part, of series that are ranked range by range."""
    return se.hash_split(V.ticks(spark, d))


@query
def hash_split_sizes(spark, d):
    return se.hash_split(V.ticks(spark, d)).groupBy("series", "split").agg(
        F.count(F.lit(1)).alias("n")
    )


# -- models -----------------------------------------------------------------------------------


@query
def gram_matrix(spark, d):
    """One row per matrix cell, on scaled features."""
    features = ["moving_avg_5", "moving_avg_10", "close"]
    frame = se.ohlc_features(V.daily_bars(spark, d)).select("series", *features)
    scaled = se.apply_minmax(frame, se.fit_minmax(frame, features), features)
    sums = se.gram_matrix(scaled, features[:2], "close")
    return rounded(
        sums.select(
            "series", "n", "sum_y",
            *[F.col("sum_x")[i].alias(f"sum_x{i}") for i in range(2)],
            *[F.col("sum_xx")[k].alias(n) for k, n in enumerate(["x0x0", "x0x1", "x1x1"])],
            *[F.col("sum_xy")[i].alias(f"sum_x{i}y") for i in range(2)],
        )
    )


@query
def fit_ols(spark, d):
    """One feature, where SQL has the same regression built in."""
    fitted = se.fit_ols(V.daily_bars(spark, d), ["open"], "close")
    return rounded(
        fitted.select("series", "n", "intercept", F.element_at("coef", 1).alias("slope"))
    )


@query
def future_frame(spark, d):
    features = se.ohlc_features(V.bars(spark, d))
    return rounded(se.future_frame(features, 30, frozen=["moving_avg_5", "daily_return"]))


@query
def ols_forecast(spark, d):
    return rounded(se.ols_forecast(V.daily_bars(spark, d), 30), 2)


@query
def ols_test_error(spark, d):
    return rounded(se.fit_ols_forecast(V.bars(spark, d), 30).metrics)


@query
def sequence_forecast(spark, d):
    return rounded(se.sequence_forecast(V.bars(spark, d), 30))


@query
def market_model_error(spark, d):
    """Errors in price units; the mean square, of eleven digits, is left to its root."""
    return rounded(se.market_model_metrics(V.metrics(spark, d)).drop("mse"), 2)


@query
def recursive_forecast(spark, d):
    """Twelve steps with given weights: the mean of the last five closes, plus one."""
    tails = se.tail_windows(V.bars(spark, d), ["close", "high"], 5)
    weights = [0.2, 0.0] * 5
    return rounded(se.recursive_forecast(tails, weights, 1.0, 12))


@query
def forecast_deltas(spark, d):
    predictions = se.daily_average(V.bars(spark, d)).withColumnRenamed(
        "average_price", "predicted_price"
    )
    return rounded(se.forecast_deltas(predictions))


# -- text -------------------------------------------------------------------------------------


@query
def tokens(spark, d):
    return se.tokens(V.articles(spark, d), "description", "doc_id")


@query
def lexicon_sentiment(spark, d):
    return se.lexicon_sentiment(
        V.articles(spark, d), "description", "doc_id", V.lexicon(spark), V.modifiers(spark)
    )


def _scored(spark, d):
    return se.score_articles(
        V.dated_articles(spark, d), "doc_id", V.lexicon(spark), V.modifiers(spark)
    )


@query
def sentiment_distribution(spark, d):
    return se.sentiment_distribution(_scored(spark, d))


@query
def sentiment_over_time(spark, d):
    chart = se.sentiment_over_time(_scored(spark, d))
    return chart.withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


@query
def term_counts(spark, d):
    return se.term_counts(V.articles(spark, d), "description")


@query
def term_frequency(spark, d):
    return rounded(se.term_frequency(V.articles(spark, d), "description"), 6)


@query
def bigram_llr(spark, d):
    return rounded(se.bigram_llr(V.articles(spark, d), "description"), 3)


@query
def word_cloud(spark, d):
    return rounded(se.word_cloud(V.articles(spark, d), "description"), 6)


# -- streams ----------------------------------------------------------------------------------


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def _landed(spark, df: DataFrame) -> DataFrame:
    """``df`` written as files and read back as a stream."""
    path = _folder(spark)
    df.write.parquet(path)
    return se.read_landed(spark, path, df.schema, "parquet")


def _landed_late(spark, df: DataFrame, run: Callable[[DataFrame], None]) -> None:
    """Land nine tenths of the rows and ``run`` over them, then the other rows, all of them late."""
    path, late = _folder(spark), F.pmod(F.hash("series", "time"), F.lit(10)) == 0
    df.where(~late).write.parquet(path)
    run(se.read_landed(spark, path, df.schema, "parquet"))
    df.where(late).write.mode("append").parquet(path)
    run(se.read_landed(spark, path, df.schema, "parquet"))


def _finished(spark, stream: DataFrame, mode: str = "append") -> DataFrame:
    path = _folder(spark)
    se.start_table(stream, f"{path}/table", f"{path}/checkpoint", mode).awaitTermination()
    if mode == "complete":
        return se.read_table(spark, f"{path}/table", stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


def _tick_stream(spark, d):
    events = se.read_landed(
        spark, d, V.table(spark, d, "events").schema, "parquet", pathGlobFilter="events.parquet"
    )
    return events.select(
        F.col("event_type").alias("series"), F.col("ts").alias("time"), "event_id", "value"
    )


@query
def stream_bars(spark, d):
    """Every bar of the event stream, also the ones that are open at its end."""
    path = _folder(spark)
    ticks = _tick_stream(spark, d)
    parts = se.bar_parts(ticks, ties=["event_id"])
    se.start_parts(
        ticks, lambda batch: se.bar_parts(batch, ties=["event_id"]), f"{path}/parts", f"{path}/checkpoint"
    ).awaitTermination()
    bars = se.merged_bars(se.read_table(spark, f"{path}/parts", parts.schema))
    return bars.withColumn("time", F.col("time").cast("timestamp_ntz"))


@query
def stream_daily_average(spark, d):
    """Every day's average, though a tenth of the bars come after all others."""
    path, bars = _folder(spark), V.bars(spark, d)

    def run(stream):
        se.start_parts(stream, se.daily_average_parts, f"{path}/parts", f"{path}/checkpoint").awaitTermination()

    _landed_late(spark, bars, run)
    parts = se.read_table(spark, f"{path}/parts", se.daily_average_parts(bars).schema)
    return rounded(se.merged_daily_average(parts))


@query
def stream_closed_bars(spark, d):
    """The bars whose window the watermark has closed, each written once."""
    bars = _finished(spark, se.stream_bars(_tick_stream(spark, d), ties=["event_id"]))
    return bars.withColumn("time", F.col("time").cast("timestamp_ntz"))


@query
def stream_dedup(spark, d):
    """The first of each (title, url) to arrive; which one is up to arrival order."""
    stream = se.stream_dedup(
        _landed(spark, V.dated_articles(spark, d).select("title", "url", "published_at")),
        ["title", "url"], "365 days", "published_at",
    )
    return _finished(spark, stream).select("title", "url")


@query
def stream_merge(spark, d):
    """Line items merged into the stored orders batch by batch; one value per date stays."""
    path = _folder(spark)
    orders = se.keep_first(_orders_as_stored(spark, d), ["time"], ["seq"])
    se.replace_table(orders, f"{path}/table", cell=se.day_cell("time"))
    stream = _landed(spark, _lines_as_batch(spark, d))
    se.start_merge(
        stream, f"{path}/table", f"{path}/checkpoint", ["time"], ["seq"], cell=se.day_cell("time")
    ).awaitTermination()
    return se.read_table(spark, f"{path}/table", stream.schema)


@query
def merge_stored_articles(spark, d):
    """Labelled articles are stored by hash cells, all articles arrive; (title, url) is the key."""
    path, articles = _folder(spark), V.articles(spark, d).select("doc_id", "title", "url")
    labelled = articles.join(V.table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    cell = se.hash_cell("title", "url")
    se.merge_table(labelled, path, ["title", "url"], ["doc_id"], cell=cell)
    se.merge_table(articles, path, ["title", "url"], ["doc_id"], cell=cell)
    return se.read_table(spark, path, articles.schema)


@query
def replaced_table(spark, d):
    """A table replaced by a result of its own: bars, then the bars above their series' mean close."""
    path, bars = _folder(spark), V.bars(spark, d)
    se.replace_table(bars, path)
    stored = se.read_table(spark, path, bars.schema)
    means = stored.groupBy("series").agg(F.avg("close").alias("mean"))
    se.replace_table(stored.join(means, "series").where("close > mean").select(*bars.columns), path)
    se.drop_unused(spark, path)
    return se.read_table(spark, path, bars.schema)


@query
def stream_weekday_change(spark, d):
    return rounded(
        _finished(spark, se.weekday_change(_landed(spark, V.daily_bars(spark, d))), "complete")
    )


@query
def stream_sentiment_counts(spark, d):
    scores = _landed(spark, _scored(spark, d).select("sentiment_compound"))
    return _finished(spark, se.sentiment_distribution(scores), "complete")


@query
def stream_rolling(spark, d):
    path = _folder(spark)
    stream = _landed(spark, V.bars(spark, d))
    se.start_rolling(stream, path, f"{path}/checkpoint").awaitTermination()
    return rounded(se.read_rolling(spark, path))


@query
def stream_rolling_late(spark, d):
    """The same, with a tenth of the bars coming after all others, most of them very late."""
    path = _folder(spark)

    def run(stream):
        se.start_rolling(stream, path, f"{path}/checkpoint").awaitTermination()

    _landed_late(spark, V.bars(spark, d), run)
    return rounded(se.read_rolling(spark, path))
