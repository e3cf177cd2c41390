"""Row windows that survive a series too long for one task.

A window partitioned by the series key puts a whole series into one task. That
is right for most series and wrong for the one that holds a third of the table.
Here a long series is cut along its order column into chunks of about equal row
counts, every chunk gets copies of the few neighbouring rows its frames reach
into, and the window is partitioned by (keys, chunk). Short series stay whole in
chunk 0, so the same plan serves both.

Cutting is exact: chunk borders come from exact row counts per cell of the order
axis, so the number of rows before each chunk is known and row positions are as
cheap as ``row_number``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesengine.functions.columns import join_on
from seriesengine.session import materialize

KEYS = ("series",)
ROWS_PER_CHUNK = 4_000_000
# Bounds the broadcast tables whatever the data: at most MAX_CHUNKS series or cells can
# hold more than rows / MAX_CHUNKS rows each, so a level has at most
# 2 * MAX_CHUNKS * CELLS_PER_CHUNK cells (800,000 narrow rows; 3.2 million in all).
MAX_CHUNKS = 50_000
CELLS_PER_CHUNK = 8
MAX_LEVELS = 4


@dataclass(frozen=True)
class ChunkPlan:
    """How the long series of one table are cut; holds for exactly that table's rows.

    Level 0 divides every long series into cells of equal width; each further level
    divides the cells that still hold more than a chunk, as a burst in time does.
    """

    keys: tuple[str, ...]
    order_by: str
    rows_per_chunk: int
    levels: tuple[DataFrame, ...]  # keys, cells so far, _lo, _hi, _width; level 0 also _total
    cells: DataFrame  # keys, all cells, _chunk, _start (rows of the series before the chunk)


def _order_number(df: DataFrame, order_by: str) -> Column:
    kind = df.schema[order_by].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(order_by).cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(order_by)).cast("long")
    if isinstance(kind, T.IntegralType):
        return F.col(order_by).cast("long")
    raise ValueError(f"cannot cut along {order_by}: {kind.simpleString()} is not a time or integer")


def plan_chunks(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    order_by: str = "time",
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> ChunkPlan | None:
    """Count rows per series; None if no series is longer than a chunk.

    One pass over the key and order columns, combined before the shuffle. A
    second pass, over long series only, runs when there are any.
    """
    if not keys:
        raise ValueError("at least one key column is needed; add a constant one")
    numbered = df.select(*keys, _order_number(df, order_by).alias("_ord"))
    totals = numbered.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_total"), F.min("_ord").alias("_lo"), F.max("_ord").alias("_hi")
    )
    seen = totals.agg(F.sum("_total").alias("rows"), F.max("_total").alias("longest")).first()
    if not seen["rows"] or seen["longest"] <= rows_per_chunk:
        return None
    size = max(rows_per_chunk, ceil(seen["rows"] / MAX_CHUNKS))
    spans = totals.withColumnRenamed("_total", "_rows")
    levels: list[DataFrame] = []
    while True:
        wide = spans.where((F.col("_rows") > size) & (F.col("_lo") < F.col("_hi")))
        levels.append(materialize(_with_width(wide, size)))
        located, path = _locate(numbered, levels, keys, "inner")
        spans = materialize(
            located.groupBy(*path).agg(
                F.count(F.lit(1)).alias("_rows"), F.min("_ord").alias("_lo"),
                F.max("_ord").alias("_hi"),
            )
        )
        crowded = spans.where((F.col("_rows") > size) & (F.col("_lo") < F.col("_hi")))
        if len(levels) == MAX_LEVELS or crowded.isEmpty():
            break
    levels[0] = levels[0].withColumnRenamed("_rows", "_total")
    levels[1:] = [level.drop("_rows") for level in levels[1:]]

    whole = Window.partitionBy(*keys)
    along = whole.orderBy(*path[len(keys):])
    before = F.sum("_rows").over(along.rowsBetween(Window.unboundedPreceding, -1))
    cells = (
        spans.withColumn("_before", F.coalesce(before, F.lit(0)))
        .withColumn("_slice", F.floor(F.col("_before") / size))
        .withColumn("_chunk", F.dense_rank().over(whole.orderBy("_slice")) - 1)
        .withColumn("_start", F.min("_before").over(Window.partitionBy(*keys, "_chunk")))
        .select(*path, "_chunk", "_start")
    )
    return ChunkPlan(tuple(keys), order_by, size, tuple(levels), materialize(cells))


def _with_width(spans: DataFrame, size: int) -> DataFrame:
    n_cells = F.ceil(F.col("_rows") / size) * CELLS_PER_CHUNK
    return spans.withColumn("_width", F.floor((F.col("_hi") - F.col("_lo")) / n_cells) + 1)


def _locate(
    numbered: DataFrame, levels: Sequence[DataFrame], keys: Sequence[str], how: str
) -> tuple[DataFrame, list[str]]:
    """Add the cell of every row at each level (0 where a level does not divide further)."""
    path = list(keys)
    for i, level in enumerate(levels):
        joined = join_on(numbered, F.broadcast(level), path, "left" if i else how)
        # Rows without an order value sort last, so they go with the last cell.
        at = F.coalesce("_ord", "_hi") - F.col("_lo")
        numbered = joined.withColumn(
            f"_cell{i}", F.coalesce(F.floor(at / F.col("_width")), F.lit(0))
        ).drop("_lo", "_hi", "_width", "_rows")
        path.append(f"_cell{i}")
    return numbered, path


def resolve_chunks(
    df: DataFrame, keys: Sequence[str], order_by: str, chunks: ChunkPlan | str | None
) -> ChunkPlan | None:
    """``chunks`` is "auto" (count now), a plan made before, or None (never cut)."""
    return plan_chunks(df, keys, order_by) if chunks == "auto" else chunks


def assign_chunks(df: DataFrame, plan: ChunkPlan) -> DataFrame:
    """Add ``_chunk``, ``_start`` and ``_total`` (the last two NULL for short series)."""
    numbered = df.withColumn("_ord", _order_number(df, plan.order_by))
    located, path = _locate(numbered, plan.levels, plan.keys, "left")
    return (
        join_on(located, F.broadcast(plan.cells), path)
        .withColumn("_chunk", F.coalesce("_chunk", F.lit(0)))
        .drop("_ord", *path[len(plan.keys):])
    )


def _with_neighbours(
    df: DataFrame, plan: ChunkPlan, order: list[str], before: int, after: int
) -> DataFrame:
    """Union each chunk with the rows its frames reach into, marked ``_own = false``.

    A chunk shorter than the reach is never next to another such one (unless it
    is the last), because chunks hold at least rows_per_chunk - reach rows
    otherwise: two chunks back (or ahead) always cover the reach.
    """
    if plan.rows_per_chunk < 2 * max(before, after):
        raise ValueError("rows_per_chunk must be at least twice the window's reach")
    own = assign_chunks(df, plan)
    cut = own.where(F.col("_total").isNotNull())
    part = Window.partitionBy(*plan.keys, "_chunk")
    parts = [own.withColumn("_own", F.lit(True))]
    # row_number() <= n is limited in every map task before the shuffle.
    for reach, step, by in (
        (before, 1, [F.col(c).desc_nulls_first() for c in order]),
        (after, -1, [F.col(c).asc_nulls_last() for c in order]),
    ):
        if reach:
            edge = (
                cut.withColumn("_rank", F.row_number().over(part.orderBy(*by)))
                .where(F.col("_rank") <= reach)
                .drop("_rank")
            )
            targets = F.array(F.col("_chunk") + step, F.col("_chunk") + 2 * step)
            parts.append(
                edge.withColumn("_chunk", F.explode(targets)).withColumn("_own", F.lit(False))
            )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def frame_rows(
    df: DataFrame, *, keys: Sequence[str] = KEYS, order_by: str = "time", ties: Sequence[str] = (),
    before: int = 0, chunks: ChunkPlan | str | None = "auto",
) -> tuple[DataFrame, ChunkPlan | None]:
    """The rows by (keys, ``_chunk``) in order, for a pass that streams over them, and the plan.

    Each chunk of a cut series begins with copies of the ``before`` rows ahead of it, marked
    ``_own = false``; ``_pos`` and ``_total`` are those of the series, ``_cut`` tells cut ones.
    """
    plan = resolve_chunks(df, keys, order_by, chunks)
    order = [order_by, *ties]
    if plan is None:
        framed = df.withColumns(
            {"_own": F.lit(True), "_cut": F.lit(False), "_chunk": F.lit(0).cast("long"),
             "_start": F.lit(0).cast("long"), "_total": F.lit(None).cast("long")}
        )
    else:
        framed = _with_neighbours(df, plan, order, before, 0)
        framed = framed.withColumn("_cut", F.col("_total").isNotNull())
    part = [*keys, "_chunk"]
    framed = _with_positions(framed, part, order).drop("_start")
    return framed.sortWithinPartitions(*part, *[F.col(c).asc_nulls_last() for c in order]), plan


def _with_positions(framed: DataFrame, part: Sequence[str], order: Sequence[str]) -> DataFrame:
    whole = Window.partitionBy(*part)
    so_far = whole.orderBy(*[F.col(c).asc_nulls_last() for c in order]).rowsBetween(
        Window.unboundedPreceding, 0
    )
    own = F.col("_own").cast("int")
    return framed.withColumn(
        "_pos", F.coalesce("_start", F.lit(0)) + F.sum(own).over(so_far) - 1
    ).withColumn("_total", F.coalesce("_total", F.sum(own).over(whole)))


def over_rows(
    df: DataFrame,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    *,
    keys: Sequence[str] = KEYS,
    order_by: str = "time",
    ties: Sequence[str] = (),
    before: int = 0,
    after: int = 0,
    positions: bool = False,
    chunks: ChunkPlan | str | None = "auto",
) -> DataFrame:
    """Apply ``build(df, window)`` with frames of at most ``before``/``after`` rows.

    ``window`` is partitioned by the keys (and the chunk) and ordered by time,
    missing times last. With ``positions`` the frame also holds ``_pos`` (0-based
    row number in the series) and ``_total`` (rows of the series).
    """
    plan = resolve_chunks(df, keys, order_by, chunks)
    order = [order_by, *ties]
    ascending = [F.col(c).asc_nulls_last() for c in order]
    if plan is None:
        whole = Window.partitionBy(*keys)
        window = whole.orderBy(*ascending)
        if positions:
            df = df.withColumn("_pos", F.row_number().over(window) - 1).withColumn(
                "_total", F.count(F.lit(1)).over(whole)
            )
        out = build(df, window)
        return out.drop("_pos", "_total") if positions else out

    framed = _with_neighbours(df, plan, order, before, after)
    whole = Window.partitionBy(*keys, "_chunk")
    window = whole.orderBy(*ascending)
    if positions:
        framed = _with_positions(framed, [*plan.keys, "_chunk"], order)
    out = build(framed, window).where("_own")
    return out.drop("_own", "_chunk", "_start", "_total", "_pos")
