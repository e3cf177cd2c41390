"""Streams against the batch operators, with several micro-batches, restarts and late rows."""

import shutil
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import seriesengine as se
from seriesengine.streaming.streams import read_landed, start_table

START = datetime(2024, 1, 1)
BARS = "series string, time timestamp, open double, high double, low double, close double"


def bars(spark, hours, value=lambda h: float(h % 17)):
    rows = [("a", START + timedelta(hours=h), value(h), value(h) + 2, value(h) - 2, value(h) + 1) for h in hours]
    return spark.createDataFrame(rows, BARS)


class Landing:
    """A folder that micro-batches land in, and a stream over it."""

    def __init__(self, spark, path):
        self.spark, self.path = spark, str(path)

    def land(self, df):
        df.coalesce(1).write.mode("append").parquet(f"{self.path}/in")

    def stream(self):
        return read_landed(self.spark, f"{self.path}/in", BARS, "parquet")


@pytest.fixture
def landing(spark, tmp_path):
    return Landing(spark, tmp_path)


def finished(landing, stream, mode="append"):
    start_table(stream, f"{landing.path}/out", f"{landing.path}/ck", mode).awaitTermination()
    if mode == "complete":
        return se.read_table(landing.spark, f"{landing.path}/out", stream.schema)
    return landing.spark.read.parquet(f"{landing.path}/out")


def test_daily_average_holds_open_days_back_and_drops_late_rows(spark, landing):
    landing.land(bars(spark, range(0, 50, 2)))
    first = finished(landing, se.stream_daily_average(landing.stream()))
    assert {str(r["date"]) for r in first.collect()} == {"2024-01-01"}
    # The first day is closed: its late row must not change it.
    landing.land(bars(spark, [1], lambda h: 1e6).unionByName(bars(spark, range(50, 80, 2))))
    both = finished(landing, se.stream_daily_average(landing.stream()))
    want = se.daily_average(bars(spark, range(0, 72, 2)))
    got = {r["date"]: r["average_price"] for r in both.collect()}
    assert got == {r["date"]: pytest.approx(r["average_price"]) for r in want.collect()}


def test_weekday_change_and_classes_in_complete_mode(spark, landing):
    landing.land(bars(spark, range(0, 100)))
    finished(landing, se.weekday_change(landing.stream()), "complete")
    landing.land(bars(spark, range(100, 200)))
    got = finished(landing, se.weekday_change(landing.stream()), "complete")
    want = se.weekday_change(bars(spark, range(200)))
    assert got.exceptAll(want).isEmpty() and got.count() == 7


def test_sentiment_classes_in_complete_mode(spark, landing):
    landing.land(bars(spark, range(30)))
    scored = landing.stream().select((F.col("open") - 3).alias("sentiment_compound"))
    got = finished(landing, se.sentiment_distribution(scored), "complete")
    batch = bars(spark, range(30)).select((F.col("open") - 3).alias("sentiment_compound"))
    assert got.exceptAll(se.sentiment_distribution(batch)).isEmpty()


def test_dedup(spark, landing):
    landing.land(bars(spark, range(10)))
    finished(landing, se.stream_dedup(landing.stream(), ["series", "time"]))
    landing.land(bars(spark, range(5, 15), lambda h: 99.0))
    got = finished(landing, se.stream_dedup(landing.stream(), ["series", "time"]))
    assert got.count() == 15 and got.where("open = 99").count() == 5


def test_bars_from_ticks(spark, landing):
    landing.land(bars(spark, range(0, 24)))
    ticks = landing.stream().select("series", "time", F.col("open").alias("value"))
    got = finished(landing, se.stream_bars(ticks)).orderBy("time").collect()
    assert len(got) == 5 and got[1]["open"] == 4.0 and got[1]["close"] == 7.0


def test_merge_adds_new_keys_once(spark, landing):
    path, on = f"{landing.path}/table", ["series", "time"]

    def run(ck):
        se.start_merge(
            landing.stream(), path, f"{landing.path}/{ck}", on, cell=se.day_cell("time")
        ).awaitTermination()
        return se.read_table(spark, path, landing.stream().schema)

    landing.land(bars(spark, range(10)))
    assert run("ck").count() == 10
    landing.land(bars(spark, range(8, 12), lambda h: 99.0))
    merged = run("ck")
    assert merged.count() == 12 and merged.where("open = 99").count() == 2
    # A lost checkpoint replays everything; nothing is added.
    assert run("other").count() == 12


def test_parts_hold_open_windows_and_late_rows(spark, landing):
    def run(partial, name):
        se.start_parts(landing.stream(), partial, f"{landing.path}/{name}", f"{landing.path}/ck_{name}").awaitTermination()
        return se.read_table(spark, f"{landing.path}/{name}", partial(bars(spark, [0])).schema)

    def ticks(df):
        return se.bar_parts(df.select("series", "time", F.col("open").alias("value")))

    landing.land(bars(spark, [h for h in range(0, 50) if h != 2]))
    run(ticks, "bars"), run(se.daily_average_parts, "days")
    landing.land(bars(spark, range(50, 75)).unionByName(bars(spark, [2], lambda h: 1e6)))
    got = se.merged_bars(run(ticks, "bars")).orderBy("time").collect()
    assert len(got) == 19 and (got[0]["open"], got[0]["high"], got[0]["close"]) == (0.0, 1e6, 3.0)
    assert got[-1]["time"] == START + timedelta(hours=72) and got[-1]["close"] == float(74 % 17)
    all_bars = bars(spark, [h for h in range(75) if h != 2]).unionByName(bars(spark, [2], lambda h: 1e6))
    want = {r["date"]: r["average_price"] for r in se.daily_average(all_bars).collect()}
    days = se.merged_daily_average(run(se.daily_average_parts, "days")).collect()
    assert {r["date"]: pytest.approx(r["average_price"]) for r in days} == want


def test_rolling_over_batches_with_a_late_row(spark, landing):
    path = f"{landing.path}/rolling"

    def run():
        se.start_rolling(landing.stream(), path, f"{landing.path}/ck").awaitTermination()
        return se.read_rolling(spark, path)

    landing.land(bars(spark, range(0, 40)))
    run()
    landing.land(bars(spark, [h for h in range(40, 75) if h != 60]))
    run()
    landing.land(bars(spark, [60]))  # late, within the last 29 rows
    landing.land(bars(spark, range(75, 80)))
    got = run()
    want = se.moving_averages(bars(spark, range(80)))

    def settled(df):
        return df.select("series", "time", *[F.round(c, 9).alias(c) for c in ("average_price", "ma_7", "ma_30")])

    assert got.count() == 80
    assert settled(want).exceptAll(settled(got)).isEmpty()


def settled(df):
    return df.select("series", "time", *[F.round(c, 9).alias(c) for c in ("average_price", "ma_7", "ma_30")])


@pytest.mark.parametrize("late", [[0], [3, 4, 100], list(range(20, 190, 10)) + [210]])
def test_rows_later_than_the_tail_are_put_in_their_place(spark, landing, late):
    path = f"{landing.path}/rolling"

    def run():
        se.start_rolling(landing.stream(), path, f"{landing.path}/ck").awaitTermination()
        return se.read_rolling(spark, path)

    landing.land(bars(spark, [h for h in range(200) if h not in late]))
    run()
    landing.land(bars(spark, [*late, 5, 200, 201], lambda h: float(h) if h == 5 else float(h % 17)))  # 5 is stored already
    run()
    landing.land(bars(spark, range(202, 220)))
    got = run()
    want = se.moving_averages(bars(spark, [h for h in range(220) if h != 210 or 210 in late] + ([] if 210 in late else [210])))
    assert got.count() == 220 and settled(want).exceptAll(settled(got)).isEmpty()


def test_a_lost_tail_is_an_error(spark, landing):
    path = f"{landing.path}/rolling"
    landing.land(bars(spark, range(40)))
    se.start_rolling(landing.stream(), path, f"{landing.path}/ck").awaitTermination()
    shutil.rmtree(f"{path}/tail/0")
    landing.land(bars(spark, range(40, 50)))
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        se.start_rolling(landing.stream(), path, f"{landing.path}/ck").awaitTermination()


def test_a_repeated_batch_changes_nothing(spark, landing):
    """The batch is run again after everything but the checkpoint was written."""
    path = f"{landing.path}/rolling"
    landing.land(bars(spark, [h for h in range(80) if h != 10]))
    se.start_rolling(landing.stream(), path, f"{landing.path}/ck").awaitTermination()
    landing.land(bars(spark, [10, 80]))
    se.start_rolling(landing.stream(), path, f"{landing.path}/ck").awaitTermination()
    for name in ("1", ".1.crc"):
        Path(f"{landing.path}/ck/commits/{name}").unlink()
    se.start_rolling(landing.stream(), path, f"{landing.path}/ck").awaitTermination()
    got = se.read_rolling(spark, path)
    assert got.count() == 81 and settled(se.moving_averages(bars(spark, range(81)))).exceptAll(settled(got)).isEmpty()
    stored = se.read_table(spark, f"{path}/stored", landing.stream().schema)
    assert stored.count() == 81
