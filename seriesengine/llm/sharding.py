"""Shards by jump consistent hashing, and gapless slots within them. Spark SQL only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesengine.llm.common import let

#: Fixed value: multiplier of the published jump hash (Lamping and Veach, 2014).
MULTIPLIER = 2862933555777941757
#: A key moves to a later shard about ln(n) times; more moves than these take the slow way.
USUAL_MOVES = 40


def stable_key(key: Column, integral: bool) -> Column:
    """The 64-bit seed of a key: an integer itself, anything else its hash; null counts as 0."""
    seed = key.cast("long") if integral else F.when(key.isNotNull(), F.xxhash64(key))
    return F.coalesce(seed, F.lit(0).cast("long"))


def jump_shards(seed: Column, *counts: int) -> Column:
    """For a 64-bit seed, a struct of its shard for each number of shards: ``s<count>``.

    One chain of moves serves all counts: the shard of n is the last move below n, so a
    larger count moves a key only into the added shards.
    """
    if not counts or min(counts) < 1:
        raise ValueError("counts of shards start at 1")
    wide, most = "decimal(20,0)", max(counts)
    modulus = F.lit(str(2**64)).cast("decimal(21,0)")

    def step(s: Column, _: Column) -> Column:
        product = s["state"] * F.lit(str(MULTIPLIER)).cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)")

        def moved(state: Column) -> Column:
            # The upper 31 bits, exactly.
            low = state % F.lit(str(2**33)).cast("decimal(10,0)")
            top = ((state - low) / F.lit(str(2**33)).cast("decimal(10,0)")).cast("double")
            move = F.floor((s["move"] + 1).cast("double") * (F.lit(float(2**31)) / (top + 1)))
            shards = [F.when(s["move"] < n, s["move"]).otherwise(s[f"s{n}"]).alias(f"s{n}") for n in counts]
            return F.struct(state.alias("state"), move.alias("move"), *shards)

        return F.when(s["move"] < most, let((product % modulus).cast(wide), moved)).otherwise(s)

    zero = F.lit(0).cast("long")
    unsigned = F.when(seed < 0, seed.cast(wide) + modulus).otherwise(seed.cast(wide)).cast(wide)
    first = F.struct(unsigned.alias("state"), zero.alias("move"), *(zero.alias(f"s{n}") for n in counts))
    usual = F.aggregate(F.sequence(F.lit(1), F.lit(min(most, USUAL_MOVES))), first, step)
    if most <= USUAL_MOVES:
        return usual
    rest = F.sequence(F.lit(1), F.lit(most))
    return let(usual, lambda s: F.when(s["move"] < most, F.aggregate(rest, s, step)).otherwise(s))


def assign_shards(
    df: DataFrame, key: str, shards: int, *, shard_col: str = "shard", grown_col: str | None = None
) -> DataFrame:
    """Every row with its shard 0 to ``shards - 1`` and, if named, its shard with one more.

    The key and the count alone decide: equal keys meet, null keys go with the integer key 0,
    and one more shard takes rows only into itself. No shuffle. Columns of the same names as
    the new ones are replaced; an empty table stays empty.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    integral = dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    both = jump_shards(stable_key(F.col(key), integral), shards, shards + 1)
    new = {shard_col: both[f"s{shards}"].cast("int")}
    if grown_col:
        new[grown_col] = both[f"s{shards + 1}"].cast("int")
    return df.withColumns(new)


#: Copies of one row that are numbered together.
COPIES_AT_ONCE = 10_000


def number_slots(df: DataFrame, group: str, order: Sequence[str], buckets: int = 1024) -> DataFrame:
    """Rows of ``group`` and ``order`` with ``slot``, gapless from 0 within each group.

    A window over a whole group would put it in one task. Here equal rows are counted first,
    each group is cut into ``buckets`` hash buckets, rows are numbered inside their bucket, and
    the bucket's start comes from a table of groups x buckets counts. Slots depend only on the
    set of rows, not on how they are stored. Nulls are values like others, in ``group`` too; equal
    rows get slots next to each other; an empty table gives no rows.
    """
    cols = [group, *order]
    copies = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    copies = copies.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = copies.groupBy(group, "_bucket").agg(F.sum("_n").alias("_rows"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        group, "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")
    )
    inside = (
        Window.partitionBy(group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    counted = copies.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    begins = starts.withColumnsRenamed({group: "_of", "_bucket": "_in"})
    same = F.col(group).eqNullSafe(F.col("_of")) & (F.col("_bucket") == F.col("_in"))
    placed = counted.join(begins, same).drop("_of", "_in")
    # By blocks, so that no array holds all copies of a row.
    zero, last = F.lit(0).cast("long"), F.col("_n") - 1
    block = placed.withColumn("_block", F.explode(F.sequence(zero, F.floor(last / COPIES_AT_ONCE))))
    begin = F.col("_block") * COPIES_AT_ONCE
    each = block.withColumn("_i", F.explode(F.sequence(begin, F.least(last, begin + COPIES_AT_ONCE - 1))))
    return each.select(*cols, (F.col("_start") + F.col("_before") + F.col("_i")).alias("slot"))
