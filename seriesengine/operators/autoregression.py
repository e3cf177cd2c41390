"""Ridge autoregression per series from Gram sums: the model of M6 and M9.

The target, the first feature, is regressed on all features of the ``n_steps`` rows before, flattened. Rows
stream through a task in the order of their series; a window exists only as a view on one Arrow
batch, and what is kept of it is the sum of its products. A whole series is fitted, validated and
tested in that one pass, as its splits follow each other in time. Of a series too long for one
task each chunk gives its sums, which Spark adds up before the solve; its errors then take a
second pass over the test rows alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesengine.functions.columns import join_on
from seriesengine.operators.chunks import KEYS, ChunkPlan, frame_rows
from seriesengine.session import materialize

_MODEL = "n_train long, n_validation long, reg_param double, intercept double, coef array<double>"
_ERRORS = "n_test long, sse double, sae double"


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of products of (1, x, y) with each other over the rows."""
    z = np.hstack([np.ones((len(x), 1)), x, y[:, None]])
    return z.T @ z


def solve_ridge(sums: np.ndarray, reg_params: Sequence[float]) -> np.ndarray:
    """(intercept, coefficients) for each of ``reg_params`` from the sums of (1, x, y).

    Minimises the mean squared error plus lambda times the squares of the coefficients of
    standardised features, relative to the target's variance. Constant features get 0.
    """
    n = sums[0, 0]
    mean = sums[0, 1:] / n
    cov = sums[1:, 1:] / n - np.outer(mean, mean)
    spread = np.sqrt(np.clip(np.diag(cov), 0, None))
    # Rounding leaves a constant feature with a spread of this order.
    live = spread > 1e-7 * np.maximum(1.0, np.abs(mean))
    scale = np.where(live, spread, 1.0)
    corr = cov / np.outer(scale, scale) * np.outer(live, live)
    values, vectors = np.linalg.eigh(corr[:-1, :-1])
    moment = vectors.T @ corr[:-1, -1]
    out = np.empty((len(reg_params), len(mean)))
    for i, reg in enumerate(reg_params):
        beta = vectors @ (moment / (np.clip(values, 0, None) + reg)) * spread[-1] / scale[:-1]
        out[i, 1:] = np.where(live[:-1], beta, 0.0)
        out[i, 0] = mean[-1] - out[i, 1:] @ mean[:-1]
    return out


def squared_error(sums: np.ndarray, model: np.ndarray) -> float:
    """Sum of squared errors of (intercept, coefficients) from the sums of (1, x, y)."""
    e = np.append(model, -1.0)
    return max(float(e @ sums @ e), 0.0)


def _choose(train: np.ndarray, validation: np.ndarray, reg_params: Sequence[float]) -> int:
    """The regularisation with the least validation error; the first where there is none to tell."""
    if not validation[0, 0]:
        return 0
    models = solve_ridge(train, reg_params)
    return int(np.argmin([squared_error(validation, m) for m in models]))


@dataclass
class _Fit:
    """One (series, chunk) while its rows pass by."""

    n_steps: int
    width: int
    reg_params: tuple[float, ...]
    cut: bool
    model: np.ndarray | None = None
    reg: float | None = None
    tail: np.ndarray = field(init=False)
    sums: list[np.ndarray] = field(init=False)
    errors: np.ndarray = field(init=False)

    def __post_init__(self):
        size = self.n_steps * self.width + 2
        self.tail = np.zeros((0, self.width))
        self.sums = [np.zeros((size, size)), np.zeros((size, size))]
        self.errors = np.zeros(3)

    def take(self, z: np.ndarray, split: np.ndarray) -> None:
        """``split`` per row: 0 train, 1 validation, 2 test, -1 no target."""
        rows = np.concatenate([self.tail, z])
        old, n = len(self.tail), self.n_steps
        self.tail = rows[max(0, len(rows) - n) :]
        if len(rows) <= n:
            return
        windows = np.lib.stride_tricks.sliding_window_view(rows[:-1], n, axis=0)
        split = np.concatenate([np.full(old, -1), split])[n:]
        for kind in (0, 1):
            at = np.flatnonzero(split == kind)
            if len(at):
                self.sums[kind] += _products(self._flat(windows, at), rows[at + n, 0])
        at = np.flatnonzero(split == 2)
        if len(at) and (not self.cut or self.model is not None) and self.fitted():
            e = rows[at + n, 0] - self._flat(windows, at) @ self.model[1:] - self.model[0]
            self.errors += [len(e), e @ e, np.abs(e).sum()]

    def _flat(self, windows: np.ndarray, at: np.ndarray) -> np.ndarray:
        return windows[at].transpose(0, 2, 1).reshape(len(at), -1)  # step by step

    def fitted(self) -> bool:
        """Solve once training and validation rows have passed."""
        if self.model is None and not self.cut and self.sums[0][0, 0]:
            i = _choose(*self.sums, self.reg_params)
            self.model, self.reg = solve_ridge(self.sums[0], self.reg_params)[i], self.reg_params[i]
        return self.model is not None


def _stream(
    batches: Iterator[pa.RecordBatch], names: pa.Schema, features: Sequence[str], new, result
) -> Iterator[pa.RecordBatch]:
    """Feed the rows of each group to a ``_Fit`` and give out what ``result`` makes of it."""
    now, fit, keys = None, None, None

    def done() -> Iterator[pa.RecordBatch]:
        row = result(fit) if fit is not None else None
        if row is not None:
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array([v], t.type) for v, t in zip(row, names, strict=True))], [*key_names, *names.names])

    for batch in batches:
        key_names = [c for c in batch.schema.names if c.startswith("_key")]
        group, split = (batch.column(c).to_numpy() for c in ("_group", "_split"))
        z = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in features], axis=1)
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1), len(group)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            if group[a] != now:
                yield from done()
                now, keys = group[a], [batch.column(c).slice(a, 1) for c in key_names]
                fit = new(batch, a)
            start = a + (split[a] == -2)  # a header row brings the model, no values
            fit.take(z[start:b], split[start:b])
    yield from done()


def _prepared(framed: DataFrame, features: Sequence[str], n_steps: int, cuts: Sequence[float], keys: Sequence[str]) -> DataFrame:
    sequences = F.col("_total") - n_steps
    split = F.lit(2)
    for kind, cut in ((1, cuts[-1] if len(cuts) > 1 else None), (0, cuts[0])):
        if cut is not None:
            split = F.when(F.col("_pos") - n_steps < F.floor(F.lit(cut) * sequences), kind).otherwise(split)
    split = F.when(F.col("_own") & (F.col("_pos") >= n_steps), split).otherwise(-1)
    return framed.select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)],
        F.xxhash64(*keys, "_chunk").alias("_group"), "_chunk", "_cut", split.cast("int").alias("_split"),
        *[F.col(c).cast("double").alias(f"f_{c}") for c in features],
    )


def fit_autoregression(
    df: DataFrame, features: Sequence[str], n_steps: int, cuts: Sequence[float], reg_params: Sequence[float],
    *, keys: Sequence[str] = KEYS, time_col: str = "time", chunks: ChunkPlan | str | None = "auto",
) -> DataFrame:
    """One model per series: keys, n_train, n_validation, reg_param, intercept, coef, n_test, sse, sae.

    ``cuts`` are the cumulative shares of the sequences at which validation and test begin (one
    share: no validation, and the first of ``reg_params`` is used). ``coef`` runs step by step, oldest first.
    The errors are sums over the test sequences, in the target's scale. A series without a
    training sequence has no row. Rows must be complete; rows of one time keep no fixed order.
    """
    framed, plan = frame_rows(
        df.select(*keys, time_col, *features), keys=keys, order_by=time_col, before=n_steps, chunks=chunks
    )
    slots = [f"f_{c}" for c in features]
    rows = _prepared(framed, features, n_steps, cuts, keys)
    kinds = [f"_key{i} {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keys)]
    regs, width = tuple(float(r) for r in reg_params), len(features)
    named = [F.col(f"_key{i}").alias(k) for i, k in enumerate(keys)]

    whole_names = pa.schema(
        [("n_train", pa.int64()), ("n_validation", pa.int64()), ("reg_param", pa.float64()), ("intercept", pa.float64()),
         ("coef", pa.list_(pa.float64())), ("n_test", pa.int64()), ("sse", pa.float64()), ("sae", pa.float64()),
         ("train", pa.list_(pa.float64())), ("validation", pa.list_(pa.float64()))]
    )

    def first_pass(batches):
        def new(batch, at):
            return _Fit(n_steps, width, regs, batch.column("_cut")[at].as_py())

        def result(fit):
            counts = [int(s[0, 0]) for s in fit.sums]
            if fit.cut:
                return (*counts, None, None, None, None, None, None, *(s.ravel() for s in fit.sums)) if any(counts) else None
            if not fit.fitted():
                return None
            n, sse, sae = fit.errors
            return (*counts, fit.reg, fit.model[0], fit.model[1:], int(n), sse, sae, None, None)

        yield from _stream(batches, whole_names, slots, new, result)

    kind = f"{', '.join(kinds)}, {_MODEL}, {_ERRORS}, train array<double>, validation array<double>"
    if plan is None:
        return rows.mapInArrow(first_pass, kind).select(*named, *whole_names.names[:-2])
    passed = materialize(rows.mapInArrow(first_pass, kind).select(*named, *whole_names.names))
    whole = passed.where("train is null").drop("train", "validation")
    solved = _solve_sums(passed.where("train is not null"), regs, keys)
    return whole.unionByName(_with_errors(rows, solved, plan, kinds, slots, n_steps, width, keys))


def _solve_sums(parts: DataFrame, regs: tuple[float, ...], keys: Sequence[str]) -> DataFrame:
    """Add up the chunks' sums, one place at a time, and solve: one row per cut series."""
    keyed = list(keys)
    counts = parts.groupBy(*keyed).agg(F.sum("n_train").alias("n_train"), F.sum("n_validation").alias("n_validation"))
    placed = parts.select(*keyed, F.posexplode(F.arrays_zip("train", "validation")).alias("i", "s"))
    added = placed.groupBy(*keyed, "i").agg(F.sum("s.train").alias("t"), F.sum("s.validation").alias("v"))
    # As many places as the model has products, whatever the data.
    packed = added.groupBy(*keyed).agg(F.array_sort(F.collect_list(F.struct("i", "t", "v"))).alias("p"))

    @F.pandas_udf("reg_param double, intercept double, coef array<double>")
    def solved(train: pd.Series, validation: pd.Series) -> pd.DataFrame:
        out = []
        for t, v in zip(train, validation, strict=True):
            size = int(round(len(t) ** 0.5))
            t, v = (np.asarray(x, float).reshape(size, size) for x in (t, v))
            i = _choose(t, v, regs) if t[0, 0] else 0
            model = solve_ridge(t, regs)[i] if t[0, 0] else np.zeros(size - 1)
            out.append((regs[i], model[0], model[1:]))
        return pd.DataFrame(out, columns=["reg_param", "intercept", "coef"])

    fitted = packed.withColumn("_fit", solved(F.col("p.t"), F.col("p.v"))).select(*keyed, "_fit.*")
    return materialize(join_on(fitted, counts.where("n_train > 0"), keyed, "inner"))


def _with_errors(rows, solved: DataFrame, plan: ChunkPlan, kinds, slots, n_steps: int, width: int, keys) -> DataFrame:
    """The second pass over cut series: a header row brings each chunk its series' model."""
    named = {f"_key{i}": F.col(k) for i, k in enumerate(keys)}
    chunks = plan.cells.select(*keys, "_chunk").distinct()
    headers = join_on(chunks, solved, list(keys), "inner").select(
        *[c.alias(n) for n, c in named.items()], F.xxhash64(*keys, "_chunk").alias("_group"),
        F.col("_chunk").cast("long").alias("_chunk"), F.lit(True).alias("_cut"), F.lit(-2).alias("_split"),
        *[F.lit(0.0).alias(c) for c in slots], F.concat(F.array("intercept"), "coef").alias("_model"),
        F.lit(0).cast("long").alias("_row"),
    )
    # The rows of a chunk keep the order they come in.
    data = rows.where("_cut").withColumn("_model", F.lit(None).cast("array<double>")).withColumn("_row", F.monotonically_increasing_id() + 1)
    both = headers.unionByName(data).repartition("_group").sortWithinPartitions("_group", "_row")
    names = pa.schema([("n_test", pa.int64()), ("sse", pa.float64()), ("sae", pa.float64())])

    def second_pass(batches):
        def new(batch, at):
            model = batch.column("_model")[at].as_py()
            return _Fit(n_steps, width, (0.0,), True, None if model is None else np.array(model))

        def result(fit):
            return (int(fit.errors[0]), fit.errors[1], fit.errors[2])

        yield from _stream(batches, names, slots, new, result)

    errors = both.mapInArrow(second_pass, f"{', '.join(kinds)}, {_ERRORS}")
    per_series = errors.groupBy(*[F.col(f"_key{i}").alias(k) for i, k in enumerate(keys)]).agg(
        *[F.sum(c).alias(c) for c in ("n_test", "sse", "sae")]
    )
    return join_on(solved, per_series, list(keys), "inner").select(
        *keys, "n_train", "n_validation", "reg_param", "intercept", "coef", "n_test", "sse", "sae"
    )
