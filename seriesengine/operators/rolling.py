"""Row windows W1–W6: rolling statistics, changes and lags.

Frames count rows, not days, as the bars may come at any interval. Every function
takes ``keys``, ``time_col`` and ``chunks`` (see ``chunks.py``), and ``ties``: the columns that order
rows of one time. Without them such rows come in any order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from seriesengine.functions.columns import as_column, join_on, row_mean
from seriesengine.operators.chunks import KEYS, assign_chunks, over_rows, resolve_chunks
from seriesengine.schemas import PRICES


def rolling(aggregate, c: Column | str, n: int, w: WindowSpec, min_periods: int | None = None):
    """``aggregate`` over the last n rows; NULL until ``min_periods`` (n) values are there."""
    c = as_column(c)
    frame = w.rowsBetween(-(n - 1), 0)
    need = n if min_periods is None else min_periods
    value = aggregate(c).over(frame)
    return value if need <= 1 else F.when(F.count(c).over(frame) >= need, value)


def change(c: Column | str, w: WindowSpec, scale: float = 1.0) -> Column:
    """Relative change from the previous row; NULL where the previous value is 0."""
    c = as_column(c)
    grown = F.try_divide(c, F.lag(c).over(w)) - 1
    return grown if scale == 1.0 else grown * scale


def rolling_mean(
    df: DataFrame, col: str, n: int, out: str, min_periods: int | None = None,
    *, keys: Sequence[str] = KEYS, time_col: str = "time", ties: Sequence[str] = (), chunks="auto",
) -> DataFrame:
    """W1 (full windows) and W2 (``min_periods=1``)."""
    return over_rows(
        df, lambda d, w: d.withColumn(out, rolling(F.avg, col, n, w, min_periods)),
        keys=keys, order_by=time_col, ties=ties, before=n - 1, chunks=chunks,
    )


def rolling_std(
    df: DataFrame, col: str, n: int, out: str, min_periods: int | None = None,
    *, keys: Sequence[str] = KEYS, time_col: str = "time", ties: Sequence[str] = (), chunks="auto",
) -> DataFrame:
    """Sample standard deviation; one value alone has none (NULL)."""
    need = n if min_periods is None else max(min_periods, 2)
    return over_rows(
        df, lambda d, w: d.withColumn(out, rolling(F.stddev_samp, col, n, w, need)),
        keys=keys, order_by=time_col, ties=ties, before=n - 1, chunks=chunks,
    )


def lag(
    df: DataFrame, col: str, n: int, out: str,
    *, keys: Sequence[str] = KEYS, time_col: str = "time", ties: Sequence[str] = (), chunks="auto",
) -> DataFrame:
    """The value n rows earlier."""
    return over_rows(
        df, lambda d, w: d.withColumn(out, F.lag(col, n).over(w)),
        keys=keys, order_by=time_col, ties=ties, before=n, chunks=chunks,
    )


def diff(
    df: DataFrame, col: str, out: str,
    *, keys: Sequence[str] = KEYS, time_col: str = "time", ties: Sequence[str] = (), chunks="auto",
) -> DataFrame:
    """Difference from the previous row; gaps are not filled."""
    return over_rows(
        df, lambda d, w: d.withColumn(out, F.col(col) - F.lag(col).over(w)),
        keys=keys, order_by=time_col, ties=ties, before=1, chunks=chunks,
    )


def forward_fill(
    df: DataFrame, cols: dict[str, str],
    *, keys: Sequence[str] = KEYS, time_col: str = "time", ties: Sequence[str] = (), chunks="auto",
) -> DataFrame:
    """Add each ``out`` in ``cols`` (source → out): the last non-missing value so far.

    The frame is unbounded, so a cut series needs one value carried into every
    chunk: the last one of the chunks before it, found by an aggregate that is
    combined before its shuffle.
    """
    plan = resolve_chunks(df, keys, time_col, chunks)
    order = [F.col(c).asc_nulls_last() for c in (time_col, *ties)]
    if plan is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({o: _last(F.col(c), w) for c, o in cols.items()})

    keyed = [*plan.keys, "_chunk"]
    placed = assign_chunks(df, plan)
    when = F.struct(*[v for c in (time_col, *ties) for v in (F.col(c).isNull(), F.col(c))])
    ends = placed.where(F.col("_total").isNotNull()).groupBy(*keyed).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), when)).alias(f"_end_{o}")
          for c, o in cols.items()]
    )
    along = Window.partitionBy(*plan.keys).orderBy("_chunk")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *keyed,
        *[F.last(f"_end_{o}", ignorenulls=True).over(earlier).alias(f"_in_{o}")
          for o in cols.values()],
    )
    # One row per chunk of a long series: at most 2 * MAX_CHUNKS rows.
    joined = join_on(placed, F.broadcast(carried), keyed)
    w = Window.partitionBy(*keyed).orderBy(*order)
    filled = joined.withColumns(
        {o: F.coalesce(_last(F.col(c), w), F.col(f"_in_{o}")) for c, o in cols.items()}
    )
    return filled.drop("_chunk", "_start", "_total", *[f"_in_{o}" for o in cols.values()])


def _last(c: Column, w: WindowSpec) -> Column:
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    return F.last(c, ignorenulls=True).over(so_far)


def pct_change(
    df: DataFrame, col: str, out: str, fill: bool = True, scale: float = 1.0,
    *, keys: Sequence[str] = KEYS, time_col: str = "time", ties: Sequence[str] = (), chunks="auto",
) -> DataFrame:
    """Relative change from the previous row, over forward-filled values by default."""
    plan = resolve_chunks(df, keys, time_col, chunks)
    source = "_filled" if fill else col
    if fill:
        df = forward_fill(df, {col: source}, keys=keys, time_col=time_col, ties=ties, chunks=plan)
    out_df = over_rows(
        df, lambda d, w: d.withColumn(out, change(source, w, scale)),
        keys=keys, order_by=time_col, ties=ties, before=1, chunks=plan,
    )
    return out_df.drop("_filled") if fill else out_df


def moving_averages(
    df: DataFrame, windows: Sequence[int] = (7, 30),
    *, keys: Sequence[str] = KEYS, time_col: str = "time", ties: Sequence[str] = (), chunks="auto",
) -> DataFrame:
    """P4 → W1 → P7: per bar the mean of its four prices and its moving averages."""
    priced = df.select(*keys, time_col, *ties, row_mean(*PRICES).alias("average_price"))
    return over_rows(
        priced,
        lambda d, w: d.withColumns(
            {f"ma_{n}": rolling(F.avg, "average_price", n, w) for n in windows}
        ),
        keys=keys, order_by=time_col, ties=ties, before=max(windows) - 1, chunks=chunks,
    )
