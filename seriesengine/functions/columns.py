"""Column expressions: everything here stays inside whole-stage codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    """One notion of "missing": NaN becomes NULL."""
    c = as_column(c)
    return F.when(~F.isnan(c), c)


def row_mean(*cols: Column | str) -> Column:
    """Mean across columns of one row, skipping missing; NULL if all are."""
    values = [as_column(c) for c in cols]
    total = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in values])
    present = reduce(lambda a, b: a + b, [v.isNotNull().cast("int") for v in values])
    return F.try_divide(total, present)


def ratio(a: Column | str, b: Column | str) -> Column:
    """A / b, NULL on a zero denominator (so that a later dropna removes it)."""
    return F.try_divide(as_column(a), as_column(b))


def strict_time(c: Column | str) -> Column:
    """Parse or fail (ANSI mode raises on a malformed value)."""
    return F.to_timestamp(as_column(c))


def lenient_time(c: Column | str) -> Column:
    """Parse, NULL where the value is malformed."""
    return F.try_to_timestamp(as_column(c))


def millis_time(c: Column | str) -> Column:
    """Epoch milliseconds."""
    return F.timestamp_millis(as_column(c).cast("bigint"))


def day_of_week(c: Column | str) -> Column:
    """Monday = 0 … Sunday = 6."""
    return F.weekday(as_column(c))


def day_name(c: Column | str) -> Column:
    return F.date_format(as_column(c), "EEEE")


def sentiment_class(c: Column | str) -> Column:
    """Sign of the compound score; a missing score counts as Neutral."""
    c = as_column(c)
    return (
        F.when(F.isnan(c), "Neutral")
        .when(c > 0, "Positive")
        .when(c < 0, "Negative")
        .otherwise("Neutral")
    )


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join that matches NULL keys (as group-by does) and keeps the left keys."""
    named = {k: f"__{k}" for k in keys}
    right = right.select(
        *[F.col(k).alias(n) for k, n in named.items()],
        *[c for c in right.columns if c not in named],
    )
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in named.items()])
    joined = left.join(right, match, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*named.values())
