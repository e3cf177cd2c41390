"""The models in SQL: least squares and ridge by Gauss-Jordan elimination in a recursive query."""

from __future__ import annotations

from collections.abc import Sequence

from seriesengine.operators.features import MARKET_SCALED
from seriesengine.operators.forecast import LAG_FEATURES, OLS_FEATURES
from seriesengine.plans.oracle import (
    BARS, DAILY_BARS, MARKET, METRICS, OHLC_FEATURES, W_SERIES, minmax, near,
)


def eliminated(source: str, out: str, size: str, keys: str, least: float) -> str:
    """``out``: (keys, b) from (keys, m), the rows of a symmetric matrix with the right side as last column.

    A pivot below ``least`` belongs to a constant column, whose coefficient is 0.
    """
    cell = "m[i][j] - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1]"
    return f"""{out}_e AS (
  SELECT {keys}, 0 AS k, m FROM {source}
  UNION ALL
  SELECT {keys}, k + 1, CASE WHEN m[k + 1][k + 1] < {least} THEN m ELSE
    list_transform(range(1, {size} + 1), lambda i: list_transform(range(1, {size} + 2), lambda j:
      CASE WHEN i = k + 1 THEN m[i][j] / m[i][i] ELSE {cell} END)) END
  FROM {out}_e WHERE k < {size}),
{out} AS (
  SELECT {keys}, list_transform(range(1, {size} + 1), lambda i:
    CASE WHEN abs(m[i][i] - 1) < 1e-6 THEN m[i][{size} + 1] ELSE 0 END) AS b
  FROM {out}_e WHERE k = {size})"""


def ols(bars: str, period: int = 365, min_rows: int = 730) -> str:
    """Features, decomposition, scaling, split and fit: rows ``x`` (list) and models (b0, b)."""
    h, n = period // 2, len(OLS_FEATURES)
    around = f"(PARTITION BY series ORDER BY time ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)"
    terms = [f"covar_pop(x[{i + 1}], x[{j + 1}])" for i in range(n) for j in range(n)]
    rows = ", ".join(
        "[" + ", ".join([*terms[i * n : (i + 1) * n], f"covar_pop(x[{i + 1}], close)"]) + "]" for i in range(n)
    )
    return f"""{bars}, {OHLC_FEATURES},
t AS (SELECT *, CASE WHEN count(close) OVER {around} = {period} THEN avg(close) OVER {around} END AS mid,
             count(*) OVER (PARTITION BY series) AS n,
             (row_number() OVER (PARTITION BY series ORDER BY time) - 1) % {period} AS phase FROM features),
raw AS (SELECT series, phase, avg(close - mid) AS m FROM t GROUP BY 1, 2),
seas AS (SELECT series, phase, m - avg(m) OVER (PARTITION BY series) AS s FROM raw),
frame AS (
  SELECT t.* EXCLUDE (phase), CASE WHEN n >= {min_rows} THEN mid ELSE 0 END AS trend,
         CASE WHEN n >= {min_rows} THEN s ELSE 0 END AS seasonal
  FROM t JOIN seas ON t.series = seas.series AND t.phase = seas.phase
  WHERE daily_return IS NOT NULL AND (n < {min_rows} OR mid IS NOT NULL)),
x AS (
  SELECT series, time, close, [{', '.join(minmax(c) for c in OLS_FEATURES)}] AS x,
         substr(md5(concat_ws('|', series, epoch_us(time), 42)), 1, 15) AS h,
         ceil(CAST(0.2 AS DOUBLE) * count(*) OVER (PARTITION BY series)) AS n_test FROM frame),
split AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY h, time) <= n_test AS test FROM x),
mat AS (SELECT series, [{rows}] AS m, avg(close) AS my,
               [{', '.join(f'avg(x[{i + 1}])' for i in range(n))}] AS mx
        FROM split WHERE NOT test GROUP BY 1),
{eliminated('mat', 'fit', str(n), 'series, my, mx', 1e-10)},
model AS (SELECT series, b, my - list_dot_product(b, mx) AS b0 FROM fit)"""


OLS_ERROR = f"""WITH RECURSIVE {ols(BARS)},
e AS (SELECT series, close - b0 - list_dot_product(x, b) AS e FROM split JOIN model USING (series) WHERE test)
SELECT series, {near('avg(e * e)')} AS mse, {near('avg(abs(e))')} AS mae, {near('sqrt(avg(e * e))')} AS rmse
FROM e GROUP BY 1"""
_AHEAD = {"day_of_week": "isodow(date) - 1", "month": "month(date)", "year": "year(date)"}


def _scaled_ahead(c: str) -> str:
    value = _AHEAD.get(c, f"last_{c}")
    return f"CASE WHEN hi_{c} = lo_{c} THEN {value} - lo_{c} ELSE ({value} - lo_{c}) / (hi_{c} - lo_{c}) END"


OLS_FORECAST = f"""WITH RECURSIVE {ols(DAILY_BARS)},
bounds AS (SELECT series, max(time) AS last, {', '.join(
    f'min({c}) AS lo_{c}, max({c}) AS hi_{c}, arg_max({c}, time) AS last_{c}' for c in OLS_FEATURES)}
  FROM frame GROUP BY 1),
ahead AS (SELECT *, last + to_days(CAST(i AS INTEGER)) AS date FROM bounds CROSS JOIN range(1, 31) r(i))
SELECT series, date, {near(f"b0 + list_dot_product([{', '.join(_scaled_ahead(c) for c in OLS_FEATURES)}], b)", 2)} AS predicted_price
FROM ahead JOIN model USING (series)"""


def ridge(source: str, features: Sequence[str], n: int, cuts: Sequence[float], regs: Sequence[float]) -> str:
    """Scaled rows ``z``, sequences with their split, and one chosen model (b0, b) per series."""
    p = n * len(features)
    cut = [f"floor(CAST({c} AS DOUBLE) * total)" for c in cuts]
    split = f"CASE WHEN i < {cut[0]} THEN 0 " + (f"WHEN i < {cut[1]} THEN 1 " if len(cut) > 1 else "") + "ELSE 2 END"
    return f"""z AS (
  SELECT series, time, [{', '.join(minmax(c) for c in features)}] AS v FROM {source}),
w AS (
  SELECT series, time, v[1] AS y, row_number() OVER o - 1 - {n} AS i,
         count(*) OVER (PARTITION BY series) - {n} AS total,
         flatten(list(v) OVER (PARTITION BY series ORDER BY time ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)) AS x
  FROM z WINDOW o AS (PARTITION BY series ORDER BY time)),
seqs AS (SELECT series, time, x, y, {split} AS split FROM w WHERE i >= 0),
train AS (SELECT series, list_append(x, y) AS x FROM seqs WHERE split = 0),
one AS (SELECT series, row_number() OVER () AS id, x FROM train),
cells AS (SELECT series, id, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM one),
moments AS (SELECT series, i, avg(v) AS m, stddev_pop(v) AS s FROM cells GROUP BY 1, 2),
sized AS (SELECT series, i, m, s, s > 1e-7 * greatest(1, abs(m)) AS live FROM moments),
products AS (SELECT a.series, a.i, b.i AS j, avg(a.v * b.v) AS q FROM cells a
  JOIN cells b ON a.series = b.series AND a.id = b.id AND a.i <= b.i GROUP BY 1, 2, 3),
upper AS (SELECT q.series, q.i, q.j,
    CASE WHEN a.live AND b.live THEN (q.q - a.m * b.m) / a.s / b.s ELSE 0 END AS c
  FROM products q JOIN sized a ON q.series = a.series AND q.i = a.i
  JOIN sized b ON q.series = b.series AND q.j = b.i),
corr AS (SELECT series, i, j, c FROM upper UNION ALL SELECT series, j, i, c FROM upper WHERE i < j),
mat AS (
  SELECT series, reg, list(r ORDER BY i) AS m FROM (
    SELECT series, reg, i, list(c + CASE WHEN i = j THEN reg ELSE 0 END ORDER BY j) AS r
    FROM corr CROSS JOIN (VALUES {', '.join(f'(CAST({r} AS DOUBLE))' for r in regs)}) l(reg)
    WHERE i <= {p} GROUP BY 1, 2, 3) GROUP BY 1, 2),
{eliminated('mat', 'fit', str(p), 'series, reg', 1e-12)},
scales AS (SELECT series, list(m ORDER BY i) AS ms, list(CASE WHEN live THEN s ELSE 1 END ORDER BY i) AS ss
           FROM sized GROUP BY 1),
fitted AS (SELECT series, reg, ms, list_transform(range(1, {p} + 1), lambda i: b[i] * ss[{p} + 1] / ss[i]) AS b
           FROM fit JOIN scales USING (series)),
models AS (SELECT series, reg, b, ms[{p} + 1] - list_dot_product(b, ms[1:{p}]) AS b0 FROM fitted),
tried AS (SELECT m.series, reg, b, b0, (SELECT coalesce(sum((y - b0 - list_dot_product(x, b)) ** 2), 0)
          FROM seqs s WHERE s.series = m.series AND split = 1) AS sse FROM models m),
model AS (SELECT series, b, b0 FROM tried QUALIFY row_number() OVER (PARTITION BY series ORDER BY sse, reg) = 1)"""


LAGGED = f"""{BARS}, l AS (SELECT *, lag(close) OVER w AS lag_close FROM bars {W_SERIES}),
lagged AS (SELECT series, time, close, CAST(isodow(time) - 1 AS DOUBLE) AS day_of_week,
                  CAST(month(time) AS DOUBLE) AS month, lag_close FROM l WHERE lag_close IS NOT NULL)"""
SEQUENCE_FORECAST = f"""WITH RECURSIVE {LAGGED},
{ridge('lagged', LAG_FEATURES, 30, (0.7, 0.85), (0.0001, 0.01))},
tail AS (SELECT series, max(time) AS t, list_reverse((list(v ORDER BY time DESC))[1:30]) AS win FROM z GROUP BY 1),
r AS (
  SELECT series, t, 0 AS k, win, b, b0, CAST(NULL AS DOUBLE) AS y FROM tail JOIN model USING (series)
  UNION ALL
  SELECT series, t, k + 1, list_append(win[2:30], list_prepend(b0 + list_dot_product(flatten(win), b), win[30][2:4])),
         b, b0, b0 + list_dot_product(flatten(win), b)
  FROM r WHERE k < 30)
SELECT series, t + to_days(k) AS date, {near('y * (hi - lo) + lo')} AS predicted_price
FROM r JOIN (SELECT series, min(close) AS lo, max(close) AS hi FROM lagged GROUP BY 1) USING (series) WHERE k > 0"""
MARKET_ERROR = f"""WITH RECURSIVE {METRICS}, {MARKET},
{ridge('features', MARKET_SCALED, 30, (0.8,), (0.01,))},
e AS (SELECT series, (y - b0 - list_dot_product(x, b)) * (hi - lo) AS e FROM seqs JOIN model USING (series)
      JOIN (SELECT series, min(price) AS lo, max(price) AS hi FROM features GROUP BY 1) USING (series) WHERE split = 2)
SELECT series, {near('avg(abs(e))', 2)} AS mae, {near('sqrt(avg(e * e))', 2)} AS rmse
FROM e GROUP BY 1"""

MODELS = {
    "ols_forecast": OLS_FORECAST,
    "ols_test_error": OLS_ERROR,
    "sequence_forecast": SEQUENCE_FORECAST,
    "market_model_error": MARKET_ERROR,
}
