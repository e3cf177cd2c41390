"""Quality scores: random Fourier features of document statistics, ridge, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesengine.llm.common import let, words
from seriesengine.session import materialize

#: Statistics of a text that scores may use: nothing else of a row is an input.
FEATURES = (
    "log_words", "word_length", "symbols", "upper", "marks", "bars", "digits", "distinct_words",
    "distinct_pairs", "line_words", "distinct_lines", "stops",
)
BINS = 200


def statistics(text: Column) -> Column:
    """An array of FEATURES; an empty or null text has zeros."""
    text = F.coalesce(text, F.lit(""))
    lines = F.split(text, "\n")
    found = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")

    def of(w: Column) -> Column:
        n, chars = F.size(w).cast("double"), F.greatest(F.length(text), F.lit(1)).cast("double")
        per = F.greatest(n, F.lit(1.0))
        pairs = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1)))
        return F.array(
            F.log1p(n),
            F.least(F.length(F.array_join(w, "")) / per, F.lit(40.0)),
            F.least(found("[#*$%&<>]") / per, F.lit(3.0)),
            found("[A-Z]") / chars,
            F.least(found("[!?]") / per, F.lit(3.0)),
            F.least(found("[|]") / per, F.lit(3.0)),
            found("[0-9]") / chars,
            F.size(F.array_distinct(w)) / per,
            F.size(F.array_distinct(pairs)) / per,
            F.log1p(n / F.size(lines)),
            F.size(F.array_distinct(lines)) / F.size(lines),
            F.least(found("[.,;:]") / per, F.lit(3.0)),
        )

    return let(words(text), of)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  # raw scores, ascending
    values: np.ndarray  # calibrated scores at the knots

    def features(self, x: np.ndarray) -> np.ndarray:
        return _fourier((x - self.mean) / self.scale, self.frequencies, self.phases)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.features(x) @ self.weights, self.knots, self.values)


def _fourier(z: np.ndarray, frequencies: np.ndarray, phases: np.ndarray) -> np.ndarray:
    """cos(w z + b) approximates a Gaussian kernel; a last column of ones is the intercept."""
    out = np.sqrt(2.0 / len(phases)) * np.cos(np.clip(z, -8, 8) @ frequencies + phases)
    return np.hstack([out, np.ones((len(z), 1))])


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, len(FEATURES)))


def _normal_equations(rows: DataFrame, frequencies: np.ndarray, phases: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Sum over all rows of z'z and z'y, for (stats, y): one matrix for each partition, whose
    rows are added up by Spark; the sum has the size of the model, whatever the data."""
    d = len(phases) + 1

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d, d + 1))
        for b in batches:
            z = _fourier((_matrix(b["stats"]) - mean) / scale, frequencies, phases)
            total[:, :d] += z.T @ z
            total[:, d] += z.T @ b["y"].to_numpy(float)
        yield pd.DataFrame({"i": range(d), "v": list(total)})

    parts = rows.mapInPandas(sums, "i int, v array<double>")
    added = parts.groupBy("i").agg(*(F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(d + 1)))
    out = np.zeros((d, d + 1))
    for r in added.collect():  # d rows
        out[r["i"]] = r[1:]
    return out


def isotonic(weight: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Non-decreasing means closest to ``mean`` by weighted squares: pool adjacent violators."""
    blocks: list[list[float]] = []
    for w, m in zip(weight, mean, strict=True):
        blocks.append([w, m, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, m2, n2 = blocks.pop()
            w1, m1, n1 = blocks.pop()
            blocks.append([w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), n1 + n2])
    return np.concatenate([np.full(n, m) for _, m, n in blocks]) if blocks else np.zeros(0)


def fit(rows: DataFrame, calibration: DataFrame, *, features: int = 200, bandwidth: float = 3.0, ridge: float = 1e-2, seed: int = 7) -> Model:
    """A model from (stats, y) rows; scores are calibrated on other rows of the same kind.

    With no rows to learn from, every score is 0.5.
    """
    k = len(FEATURES)
    rng = np.random.default_rng(seed)
    frequencies = rng.normal(0, 1 / bandwidth, (k, features))
    phases = rng.uniform(0, 2 * np.pi, features)
    moments = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *(F.avg(F.col("stats")[j]).alias(f"m{j}") for j in range(k)),
        *(F.stddev_pop(F.col("stats")[j]).alias(f"s{j}") for j in range(k)),
    ).first()
    if not moments["n"]:
        zero = np.zeros(k)
        return Model(zero, np.ones(k), frequencies, phases, np.zeros(features + 1), np.array([0.0]), np.array([0.5]))
    mean = np.array([moments[f"m{j}"] for j in range(k)])
    scale = np.array([moments[f"s{j}"] or 1.0 for j in range(k)])
    both = _normal_equations(rows, frequencies, phases, mean, scale)
    penalty = ridge * np.eye(features + 1) * max(1.0, np.sqrt(moments["n"]))
    penalty[-1, -1] = 1e-9
    weights = np.linalg.solve(both[:, :-1] + penalty, both[:, -1])
    raw = Model(mean, scale, frequencies, phases, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = raw.features(_matrix(b["stats"])) @ weights if len(b) else np.zeros(0)
            at = np.clip((s + 0.5) * (BINS / 2), 0, BINS - 1).astype(int)
            yield pd.DataFrame({"bin": at, "s": s, "y": b["y"].astype(float)})

    bins = calibration.mapInPandas(binned, "bin int, s double, y double").groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("s").alias("s"), F.avg("y").alias("y")
    )
    got = sorted((r["s"], r["n"], r["y"]) for r in bins.collect())  # BINS rows at most
    if not got:
        return raw
    s, n, y = (np.array(c, float) for c in zip(*got, strict=True))
    # A fifth of an observation at the overall mean keeps small bins from exactly 0 and 1.
    overall = (n * y).sum() / n.sum()
    return Model(mean, scale, frequencies, phases, weights, s, isotonic(n, (n * y + 0.2 * overall) / (n + 0.2)))


def held_out(key: Column) -> Column:
    """Whether crc32 of the key as text, modulo 5, is 0; a null key is held out."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(True))


def score_documents(
    df: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality",
    threshold: float = 0.3, **options,
) -> DataFrame:
    """One row per row of ``df``: ``key``, ``held_out``, ``score`` (0 to 1) and ``predicted``.

    Learns P(``label`` = 1) from the statistics of texts whose key is not held out: ridge on
    those with remainder 2 to 4, calibration on those with 1. Labels that are null are ignored,
    repeated labels count each. Null and empty texts have the statistics of an empty text and
    are scored. Other columns are not read; an empty table gives no rows; with no labels all
    scores are 0.5. All labelled rows are used: the sums have the size of the model.
    """
    stats = materialize(df.select(key, held_out(F.col(key)).alias("held_out"), statistics(F.col(text)).alias("stats")))
    known = labels.filter(F.col(label).isNotNull()).select(key, F.col(label).alias("y"))
    rest = F.crc32(F.col(key).cast("string")) % 5
    learn = materialize(stats.filter(~F.col("held_out")).join(known, key).select("stats", "y", rest.alias("rest")))
    model = df.sparkSession.sparkContext.broadcast(
        fit(learn.filter("rest > 1").select("stats", "y"), learn.filter("rest = 1").select("stats", "y"), **options)
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            score = model.value.score(_matrix(b["stats"])) if len(b) else np.zeros(0)
            yield b[[key, "held_out"]].assign(score=np.clip(score, 0, 1))

    kind = stats.schema[key].dataType.simpleString()
    scored = stats.mapInPandas(run, f"`{key}` {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
