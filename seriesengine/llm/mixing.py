"""Mixing of sources, languages and topics to target weights by raking."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesengine.llm.common import words
from seriesengine.session import materialize

#: Combinations of categories up to which one task rakes them.
SMALL_CELLS = 1_000_000
#: Raking ends unconverged if its error fell by less than a hundredth over so many rounds: then the
#: targets cannot be met together.
PATIENCE = 20
#: Topics by the statistics at hand, where a table has no topic column: the shape of a text.
TOPICS = ("fragment", "note", "article", "book")


def topic_of(n_tokens: Column) -> Column:
    return F.when(n_tokens < 50, TOPICS[0]).when(n_tokens < 300, TOPICS[1]).when(n_tokens < 2000, TOPICS[2]).otherwise(TOPICS[3])


def tempered(cells: DataFrame, by: str, power: float) -> DataFrame:
    """Target shares (``by``, ``target``) in proportion to tokens to the ``power``: below 1,
    large categories give way to small ones."""
    weight = cells.groupBy(by).agg(F.sum("tokens").alias("t")).filter("t > 0").select(
        by, F.pow(F.col("t").cast("double"), F.lit(power)).alias("w")
    )
    total = weight.agg(F.sum("w")).first()[0] or 1.0
    return weight.select(by, (F.col("w") / F.lit(total)).alias("target"))


def _stuck(errors: list[float]) -> bool:
    return len(errors) > PATIENCE and errors[-1] > 0.99 * errors[-1 - PATIENCE]


def _joined(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """Left join in which a null category is a category like others."""
    named = right.withColumnRenamed(by, "_by")
    return left.join(named, left[by].eqNullSafe(named["_by"]), "left").drop("_by")


def _rake_here(cells: DataFrame, targets: Mapping[str, DataFrame], tolerance: float) -> DataFrame:
    """``rake`` in one task."""
    dims = list(targets)
    wide = cells
    for i, (by, target) in enumerate(targets.items()):
        wide = _joined(wide, target.select(by, F.col("target").alias(f"_t{i}")), by)
    names = wide.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := [x for x in batches if x.num_rows]) else None
        if table is None:
            return
        weight = np.array(table.column("weight").to_numpy(), np.float64)
        most = table.column("most").to_numpy().astype(np.float64)
        groups = []
        for i, by in enumerate(dims):
            code = table.column(by).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            goal = np.full(int(code.max()) + 1, np.nan)
            goal[code] = table.column(f"_t{i}").to_pandas().to_numpy(np.float64)
            groups.append((code, goal))
        errors = []
        while not errors or (errors[-1] > tolerance and not _stuck(errors)):
            worst = 0.0
            for code, goal in groups:
                sums = np.bincount(code, weight, len(goal))
                factor = np.where(np.isnan(goal) | (sums == 0), 1.0, goal / np.where(sums == 0, 1.0, sums))
                weight = np.minimum(weight * factor[code], most)
                worst = max(worst, float(np.abs(factor - 1).max()))
            errors.append(worst)
        yield from table.set_column(names.index("weight"), "weight", pa.array(weight)).select(kept).to_batches()

    kept = cells.columns
    return materialize(wide.coalesce(1).mapInArrow(run, cells.schema))


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], tolerance: float = 1e-6, budget: float = 0.0) -> DataFrame:
    """``cells`` (one row for each combination of categories, with ``tokens``) plus ``weight``, the
    share of tokens that the combination should have, and ``most``, the largest it can have.

    With a ``budget``, the share of all tokens that will be taken, no combination gets more than all
    its tokens: such a one stays at that, and the others of its categories make up for it.

    Iterative proportional fitting: for each dimension in turn, weights are scaled so that
    their sums over its categories meet ``targets`` (category, target; shares that sum to 1).
    Up to SMALL_CELLS cells are raked in one task; more stay in Spark, where each round is a
    handful of small aggregations, written so that the plan stays short. Categories without a
    target keep their share. Ends when no sum is off by more than ``tolerance``, relative to its
    target, or, where targets contradict one another, when the error no longer falls
    (see ``raking_errors``).
    """
    total, n = cells.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    targets = {by: materialize(t) for by, t in targets.items()}
    share = F.col("tokens") / F.lit(float(total or 1))
    now = cells.withColumns({"weight": share, "most": share / budget if budget else F.lit(float("inf"))})
    if n <= SMALL_CELLS:
        return _rake_here(now, targets, tolerance)
    now, errors = materialize(now), []
    while not errors or (errors[-1] > tolerance and not _stuck(errors)):
        now = now.withColumn("_off", F.lit(0.0))  # the largest change of a factor in this round
        for by, target in targets.items():
            sums = now.groupBy(by).agg(F.sum("weight").alias("_sum"))
            factor = F.coalesce(F.try_divide("target", "_sum"), F.lit(1.0))
            factors = _joined(sums, target, by).select(by, factor.alias("_f"))
            now = _joined(now, factors, by).withColumns(
                {"weight": F.least(F.col("weight") * F.col("_f"), "most"), "_off": F.greatest("_off", F.abs(F.col("_f") - 1))}
            ).drop("_f")
        now = materialize(now)
        errors.append(now.agg(F.max("_off")).first()[0] or 0.0)
        now = now.drop("_off")
    return now


def raking_errors(raked: DataFrame, targets: Mapping[str, DataFrame]) -> dict[str, float]:
    """For each dimension, how far the sum of a category's weights is off its target at most,
    relative to the target."""
    out = {}
    for by, target in targets.items():
        sums = raked.groupBy(by).agg(F.sum("weight").alias("_sum"))
        off = F.abs(F.coalesce("_sum", F.lit(0.0)) / F.col("target") - 1)
        out[by] = _joined(target.filter("target > 0"), sums, by).agg(F.max(off)).first()[0] or 0.0
    return out


def uniform(key: Column) -> Column:
    """A number in [0, 1) that the key alone decides."""
    return F.pmod(F.xxhash64(key, F.lit("mix")), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


def _categories(df: DataFrame, text: str, n: Column) -> DataFrame:
    """``_source``, ``_lang`` and ``_topic`` (null as an empty string) and ``_tokens``."""
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")
    counted = df.withColumns({"_tokens": n, "_source": own("source"), "_lang": own("lang")})
    return counted.withColumn("_topic", own("topic") if "topic" in df.columns else topic_of(F.col("_tokens")))


DIMENSIONS = ("_source", "_lang", "_topic")


def within_reach(cells: DataFrame, by: str, target: DataFrame, budget: float) -> DataFrame:
    """``target`` with no category above the tokens it has, if ``budget`` of all tokens are taken.

    A category that asks for more is taken whole, and what it lacks goes to the others in
    proportion. There are as many rounds as categories fall short at most; a round is one number.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    have = cells.groupBy(by).agg((F.sum("tokens") / F.lit(float(total * budget))).alias("_have"))
    rows = materialize(_joined(target, have, by).withColumn("_have", F.coalesce("_have", F.lit(0.0))))
    scale = 1.0
    while True:
        short = F.col("target") * scale >= F.col("_have")
        kept, asked = rows.agg(F.sum(F.when(short, F.col("_have"))), F.sum(F.when(~short, F.col("target")))).first()
        new = (1 - (kept or 0.0)) / asked if asked else scale
        if new <= scale * (1 + 1e-12):
            return rows.select(by, F.least(F.col("target") * scale, "_have").alias("target"))
        scale = new


def _probabilities(light: DataFrame, power: float, budget: float, targets: Mapping[str, DataFrame] | None) -> DataFrame:
    """For each combination of categories: ``tokens``, ``weight``, the probability ``p``, and the
    remaining error of each dimension.

    p is such that in expectation ``budget`` of the tokens are taken, in the raked shares; no
    document is taken twice.
    """
    if not 0 < budget <= 1:
        raise ValueError("budget must be above 0, and 1 at most")
    cells = materialize(light.groupBy(*DIMENSIONS).agg(F.sum("_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents")))
    goals = targets or {d: tempered(cells, d, power) for d in DIMENSIONS}
    raked = rake(cells, {d: within_reach(cells, d, t, budget) for d, t in goals.items()}, budget=budget)
    errors = raking_errors(raked, goals)
    total = raked.agg(F.sum("tokens")).first()[0] or 0
    p = F.when(F.col("tokens") > 0, F.col("weight") * F.lit(float(budget * total)) / F.col("tokens")).otherwise(1.0)
    left = {f"{d}_error": F.lit(float(errors.get(d, 0.0))) for d in DIMENSIONS}
    return materialize(raked.drop("most").withColumns({"p": F.least(F.lit(1.0), p), **left}))


def mix_documents(
    df: DataFrame, *, key: str = "doc_id", text: str = "text", power: float = 0.85, budget: float = 0.5,
    targets: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """One row per row of ``df``: ``key``, ``source``, ``lang``, ``topic``, ``n_tokens``,
    ``probability`` and ``sampled``, and ``source_error``, ``lang_error`` and ``topic_error``: how far
    the share of a category is off its target at most, relative to it (the same on every row; 0
    but for rounding unless the targets contradict one another).

    Token weights are raked to marginal targets over source, language and topic (by default
    tokens to the power 0.85 on each), and a document is sampled if a number that its key alone
    decides is below its combination's probability. In expectation ``budget`` of all tokens are
    sampled; categories and combinations that have too few tokens for their share are taken whole, so a
    rare one never sets the rate of the others (its error is told). Tokens are words; null and empty texts
    have none and are sampled with probability 1, as they change no share. Null categories are
    one category, null keys are decided alike, repeated rows too. A missing ``topic`` column is
    made from the text's length. Other columns are not read; an empty table gives no rows.
    """
    slim = df.select(*dict.fromkeys([key, text, *(c for c in ("source", "lang", "topic") if c in df.columns)]))
    light = materialize(_categories(slim, text, F.size(words(F.col(text))).cast("long")).select(F.col(key).alias("_key"), "_tokens", *DIMENSIONS))
    cells = _probabilities(light, power, budget, targets)
    out = light.join(cells.drop("tokens", "documents", "weight"), list(DIMENSIONS), "left")
    return out.select(
        F.col("_key").alias(key), F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"),
        F.col("_tokens").alias("n_tokens"), F.col("p").alias("probability"), (uniform(F.col("_key")) < F.col("p")).alias("sampled"),
        *(F.col(f"{d}_error").alias(f"{d[1:]}_error") for d in DIMENSIONS),
    )


def sample_documents(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", power: float = 0.85, budget: float = 0.5,
    targets: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """The sampled rows of ``docs``, with all their columns; see ``mix_documents``. Equal rows are
    sampled together, null keys alike; an empty table stays empty."""
    n = F.size(words(F.col(text))).cast("long")
    slim = docs.select(*dict.fromkeys([key, text, *(c for c in ("source", "lang", "topic") if c in docs.columns)]))
    cells = _probabilities(_categories(slim, text, n).select("_tokens", *DIMENSIONS), power, budget, targets)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), *slim.columns)
    placed = _categories(rows, text, n).join(cells.select(*DIMENSIONS, "p"), list(DIMENSIONS), "left")
    return placed.filter(uniform(F.col(key)) < F.coalesce("p", F.lit(1.0))).select("_row.*")
