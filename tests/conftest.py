import os
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from seriesengine.session import configure  # noqa: E402

OHLC = "series string, time timestamp, open double, high double, low double, close double"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = configure(
        SparkSession.builder.master(os.environ.get("TEST_MASTER", "local[*]"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def mid_price(i, up):
    """The middle of the i-th bar: rising by 1/4 from 40, or falling by 1/2 from 90."""
    return 40 + 0.25 * i if up else 90 - 0.5 * i


@pytest.fixture(scope="session")
def slopes(spark):
    """Two straight series: "up", 64 daily bars, and "down", 41 bars every other day with a gap of
    twelve days after the 21st. Around the middle lie open -0.4, high +1.1, low -0.9, close +0.6."""
    frames = []
    for name, up, start, step, n in (("up", True, "2021-03-03", 1, 64), ("down", False, "2021-05-01", 2, 41)):
        days = np.arange(n) * step + (0 if up else 10 * (np.arange(n) > 20))
        mid = mid_price(np.arange(n), up)
        frames.append(
            pd.DataFrame(
                {"series": name, "time": pd.Timestamp(start) + pd.to_timedelta(days, unit="D"),
                 "open": mid - 0.4, "high": mid + 1.1, "low": mid - 0.9, "close": mid + 0.6}
            )
        )
    return spark.createDataFrame(pd.concat(frames), OHLC).cache()


def walk_frame(n, name, seed, missing=0.0):
    rng = np.random.default_rng(seed)
    close = 100 + rng.normal(0, 1, n).cumsum()
    pdf = pd.DataFrame(
        {
            "series": name,
            "time": pd.date_range("2020-01-01", periods=n, freq="D"),
            "open": close + rng.normal(0, 1, n),
            "high": close + 2,
            "low": close - 2,
            "close": close,
        }
    )
    if missing:
        pdf.loc[rng.random(n) < missing, "close"] = np.nan
    return pdf


def to_spark(spark, pdf):
    """NaN becomes NULL, as the loader does."""
    df = spark.createDataFrame(pdf, OHLC)
    prices = ("open", "high", "low", "close")
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in prices})


@pytest.fixture(scope="session")
def walks(spark):
    """One long series with gaps (and one long gap) and two short ones."""
    long = walk_frame(900, "long", 1, missing=0.2)
    long.loc[300:460, "close"] = np.nan
    pdf = pd.concat([long, walk_frame(40, "short", 2, 0.2), walk_frame(5, "tiny", 3)])
    return to_spark(spark, pdf).cache()


def collected(df, *order):
    return df.orderBy(*order).toPandas()
