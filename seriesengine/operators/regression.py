"""Ordinary least squares per series: M2, M3.

Everything that grows with the data is a sum: the Gram matrix of the features and
its product with the target, one aggregate row per series. Only that row (8
features: 64 + 8 numbers) reaches Python, in Arrow batches of many series.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesengine.functions.columns import join_on
from seriesengine.operators.chunks import KEYS

# Eigenvalues below this share of the largest count as zero: constant and collinear
# columns are normal here, and get the minimum-norm solution.
RELATIVE_CUTOFF = 1e-10


def gram_matrix(
    df: DataFrame, features: Sequence[str], target: str, *, keys: Sequence[str] = KEYS
) -> DataFrame:
    """n, sums and cross products per series (upper triangle, row by row).

    All sums and ``n`` are over the same rows: those with the target and every feature present.
    A series without such a row has no result.
    """
    x = [F.col(c).cast("double") for c in features]
    y = F.col(target).cast("double")
    m = range(len(x))
    pairs = [(i, j) for i in m for j in m if i <= j]
    sums = (
        [F.sum(x[i]).alias(f"_s{i}") for i in m]
        + [F.sum(x[i] * x[j]).alias(f"_g{i}_{j}") for i, j in pairs]
        + [F.sum(x[i] * y).alias(f"_m{i}") for i in m]
    )
    return (
        df.dropna(subset=[*features, target])
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("sum_y"), *sums)
        .select(
            *keys, "n", "sum_y",
            F.array(*[f"_s{i}" for i in m]).alias("sum_x"),
            F.array(*[f"_g{i}_{j}" for i, j in pairs]).alias("sum_xx"),
            F.array(*[f"_m{i}" for i in m]).alias("sum_xy"),
        )
    )


FIT = T.StructType(
    [T.StructField("intercept", T.DoubleType()), T.StructField("coef", T.ArrayType(T.DoubleType()))]
)


@F.pandas_udf(FIT)
def _solve(
    n: pd.Series, sum_y: pd.Series, sum_x: pd.Series, sum_xx: pd.Series, sum_xy: pd.Series
) -> pd.DataFrame:
    """Minimum-norm solution of the centred normal equations, a batch of series at once."""
    count = n.to_numpy(float)[:, None]
    mean_x = np.stack(sum_x.to_numpy()) / count
    mean_y = sum_y.to_numpy(float)[:, None] / count
    m = mean_x.shape[1]
    upper = np.triu_indices(m)
    gram = np.zeros((len(n), m, m))
    gram[:, upper[0], upper[1]] = np.stack(sum_xx.to_numpy())
    gram[:, upper[1], upper[0]] = gram[:, upper[0], upper[1]]
    centred = gram - count[:, :, None] * mean_x[:, :, None] * mean_x[:, None, :]
    moment = np.stack(sum_xy.to_numpy()) - count * mean_x * mean_y
    inverse = np.linalg.pinv(centred, rcond=RELATIVE_CUTOFF, hermitian=True)
    coef = np.einsum("kij,kj->ki", inverse, moment)
    intercept = mean_y[:, 0] - (coef * mean_x).sum(axis=1)
    return pd.DataFrame({"intercept": intercept, "coef": list(coef)})


def fit_ols(
    df: DataFrame, features: Sequence[str], target: str, *, keys: Sequence[str] = KEYS
) -> DataFrame:
    """M2: (keys, n, intercept, coef), coefficients in the order of ``features``."""
    sums = gram_matrix(df, features, target, keys=keys)
    solved = sums.withColumn("_fit", _solve("n", "sum_y", "sum_x", "sum_xx", "sum_xy"))
    return solved.select(*keys, "n", "_fit.intercept", "_fit.coef")


def predict_linear(
    df: DataFrame, coef: DataFrame, features: Sequence[str], out: str = "predicted",
    *, keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Linear prediction with each series' own coefficients."""
    joined = join_on(df, coef.select(*keys, "intercept", "coef"), list(keys))
    value = F.col("intercept")
    for i, c in enumerate(features):
        value = value + F.element_at("coef", i + 1) * F.col(c)
    return joined.withColumn(out, value).drop("intercept", "coef")
