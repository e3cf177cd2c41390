"""The physical plans that keep the operators fit for large tables."""

import re

import pytest
from pyspark.sql import functions as F

import seriesengine as se
from seriesengine.plans import views as V
from seriesengine.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan_of(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return re.sub(r"#\d+L?", "", text)


PARTITIONED = [
    "moving_averages", "rolling_std", "pct_change", "ohlc_features", "market_features_scaled",
    "seasonal_decompose", "daily_average", "weekday_change", "merge_bars",
    "new_bars", "minmax_scale", "sequences", "chrono_split", "hash_split_sizes", "gram_matrix",
    "series_tail", "duplicate_times", "lexicon_sentiment", "future_frame", "recursive_forecast",
]


@pytest.mark.parametrize("name", PARTITIONED)
def test_no_single_partition_and_no_cross_join(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert "SinglePartition" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_one_shuffle_for_all_windows_of_the_features(spark):
    df = V.ticks(spark, SF).select(
        "series", "time", *[F.col("close").alias(c) for c in V.PRICES]
    )
    plan = plan_of(se.ohlc_features(df, check=False, chunks=None))
    assert plan.count("Exchange hashpartitioning") == 1


def test_scans_read_only_what_they_need(spark):
    plan = plan_of(QUERIES["rolling_std"](spark, SF))
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in plan
    daily = plan_of(QUERIES["duplicate_times"](spark, SF))
    assert "ReadSchema: struct<o_orderdate:timestamp_ntz,o_orderpriority:string>" in daily


def test_filters_reach_the_scan(spark):
    recent = se.daily_average(
        V.ticks(spark, SF).select("series", "time", *[F.col("close").alias(c) for c in V.PRICES])
        .where("time >= timestamp_ntz '2024-01-20 00:00:00'")
    )
    assert "GreaterThanOrEqual(ts" in plan_of(recent)


def test_the_trailing_range_reaches_the_scan(spark):
    plan = plan_of(se.trailing_range(V.ticks(spark, SF), 7))
    scans = re.findall(r"FileScan parquet.*", plan)
    assert any(re.search(r"DataFilters: \[.*ts >= .*subquery", s) for s in scans)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_decomposition_sorts_its_rows_once(spark):
    made = []

    def watch(df):
        made.append(plan_of(df))
        return materialize(df)

    from seriesengine.operators import decompose

    materialize = decompose.materialize
    decompose.materialize = watch
    try:
        out = se.seasonal_decompose(V.daily_bars(spark, SF), chunks=None)
    finally:
        decompose.materialize = materialize
    assert len(made) == 1 and made[0].count("Sort [") == 1
    assert "FileScan parquet" in plan_of(out) and "l_shipdate" not in plan_of(out)


@pytest.mark.parametrize("name", ["merge_bars", "merge_articles", "series_tail"])
def test_keep_first_limits_before_the_shuffle(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert re.search(r"WindowGroupLimit .*Partial", plan)


def test_cut_series_are_partitioned_by_chunk(spark):
    ticks = V.ticks(spark, SF)
    plan = plan_of(
        se.rolling_mean(ticks, "close", 7, "x", chunks=se.plan_chunks(ticks, rows_per_chunk=50))
    )
    assert "hashpartitioning(series, _chunk" in plan and "hashpartitioning(series," in plan
    assert re.search(r"WindowGroupLimit .*Partial", plan)


def test_aggregates_combine_before_the_shuffle(spark):
    for name in ("daily_average", "weekday_change", "gram_matrix", "lexicon_sentiment"):
        assert "partial_" in plan_of(QUERIES[name](spark, SF))


def test_tokens_are_joined_to_broadcast_words(spark):
    plan = plan_of(QUERIES["lexicon_sentiment"](spark, SF))
    assert "SortMergeJoin" not in plan
