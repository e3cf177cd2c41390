"""The same queries in SQL, for a check by another engine on the same tables."""

from __future__ import annotations

from seriesengine.plans import views as V
from seriesengine.text import words as W

# -- tables -----------------------------------------------------------------------------------

BARS = """bars AS (
  SELECT event_type AS series, time_bucket(INTERVAL '4 hours', ts) AS time,
         arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, (ts, event_id)) AS close
  FROM events GROUP BY 1, 2)"""
DAILY_BARS = """bars AS (
  SELECT l_returnflag AS series, l_shipdate AS time,
         arg_min(l_extendedprice, (l_orderkey, l_linenumber)) AS open,
         max(l_extendedprice) AS high, min(l_extendedprice) AS low,
         arg_max(l_extendedprice, (l_orderkey, l_linenumber)) AS close
  FROM lineitem GROUP BY 1, 2)"""
METRICS = """metrics AS (
  SELECT o_orderpriority AS series, o_orderdate AS time, avg(o_totalprice) AS price,
         sum(o_totalprice) AS market_cap, CAST(count(*) AS DOUBLE) AS total_volume
  FROM orders GROUP BY 1, 2)"""
TICKS = "ticks AS (SELECT event_type AS series, ts AS time, value AS close FROM events)"
ARTICLES = """articles AS (
  SELECT doc_id, text AS title, text AS description, source AS url, lang,
         TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS published_at
  FROM documents)"""
W_SERIES = "WINDOW w AS (PARTITION BY series ORDER BY time)"


def frame(n: int) -> str:
    return f"(PARTITION BY series ORDER BY time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(agg: str, c: str, n: int) -> str:
    return f"CASE WHEN count({c}) OVER {frame(n)} >= {n} THEN {agg}({c}) OVER {frame(n)} END"


def change(c: str, scale: str = "") -> str:
    return f"({c} / NULLIF(lag({c}) OVER w, 0) - 1){scale}"


def _listed(terms) -> str:
    return ", ".join("'" + t.replace("'", "''") + "'" for t in terms)


def near(expr: str, digits: int = 4) -> str:
    """Rounded by way of a decimal of three places more, as the Spark side does."""
    return f"CAST(round(CAST({expr} AS DECIMAL(38, {digits + 3})), {digits}) AS DOUBLE)"


MEAN4 = "(open + high + low + close) / 4"
MOVING = f"""priced AS (SELECT series, time, {MEAN4} AS average_price FROM bars)
SELECT series, time, {near('average_price')} AS average_price,
       {near(full('avg', 'average_price', 7))} AS ma_7,
       {near(full('avg', 'average_price', 30))} AS ma_30
FROM priced"""
OHLC_FEATURES = f"""features AS (
  SELECT *, avg(close) OVER {frame(5)} AS moving_avg_5, avg(close) OVER {frame(10)} AS moving_avg_10,
         {change('close')} AS daily_return, isodow(time) - 1 AS day_of_week, month(time) AS month,
         year(time) AS year
  FROM bars {W_SERIES})"""
DAILY_AVERAGE = f"""daily AS (
  SELECT series, CAST(time AS DATE) AS date, avg({MEAN4}) AS average_price
  FROM bars GROUP BY 1, 2)"""
WEEKDAYS = f"""SELECT s.series, CAST(d.day_no AS INTEGER) AS day_no, d.day_of_week,
       {near('a.v')} AS avg_daily_change
FROM (SELECT DISTINCT series FROM bars) s
CROSS JOIN (VALUES (0, 'Monday'), (1, 'Tuesday'), (2, 'Wednesday'), (3, 'Thursday'),
                   (4, 'Friday'), (5, 'Saturday'), (6, 'Sunday')) d(day_no, day_of_week)
LEFT JOIN (SELECT series, isodow(time) - 1 AS day_no, avg(close - open) AS v
           FROM bars GROUP BY 1, 2) a ON a.series = s.series AND a.day_no = d.day_no"""
MARKET = f"""r AS (
  SELECT *, {change('price')} AS price_return, {change('total_volume')} AS volume_change,
         {change('market_cap')} AS market_cap_change, {full('avg', 'price', 7)} AS ma_7,
         {full('avg', 'price', 30)} AS ma_30
  FROM metrics {W_SERIES}),
v AS (SELECT *, {full('stddev_samp', 'price_return', 7)} AS volatility_7,
             market_cap / NULLIF(total_volume, 0) AS market_cap_to_volume FROM r),
features AS (SELECT * FROM v WHERE price_return IS NOT NULL AND volume_change IS NOT NULL
  AND market_cap_change IS NOT NULL AND ma_7 IS NOT NULL AND ma_30 IS NOT NULL
  AND volatility_7 IS NOT NULL AND market_cap_to_volume IS NOT NULL)"""
SCALED = ("price", "total_volume", "market_cap", "price_return", "volume_change",
          "market_cap_change", "volatility_7")
OTHER = ("ma_7", "ma_30", "market_cap_to_volume")


def minmax(c: str) -> str:
    over = "OVER (PARTITION BY series)"
    return (f"CASE WHEN max({c}) {over} = min({c}) {over} THEN 0.0 "
            f"ELSE ({c} - min({c}) {over}) / (max({c}) {over} - min({c}) {over}) END")


def decomposed(source: str, col: str, period: int, min_rows: int) -> str:
    h = period // 2

    def mean(a: int, b: int) -> str:
        over = (f"(PARTITION BY series ORDER BY time ROWS BETWEEN {a} PRECEDING AND {b} FOLLOWING)")
        return f"CASE WHEN count({col}) OVER {over} = {a + b + 1} THEN avg({col}) OVER {over} END"

    trend = mean(h, h) if period % 2 else f"({mean(h, h - 1)} + {mean(h - 1, h)}) / 2"
    return f"""t AS (
  SELECT series, time, {col}, {trend} AS trend, count(*) OVER (PARTITION BY series) AS n,
         (row_number() OVER (PARTITION BY series ORDER BY time) - 1) % {period} AS phase
  FROM {source}),
raw AS (SELECT series, phase, avg({col} - trend) AS m FROM t GROUP BY 1, 2),
seas AS (SELECT series, phase, m - avg(m) OVER (PARTITION BY series) AS seasonal FROM raw)
SELECT t.series, time, {near(col, 3)} AS {col},
       {near(f'CASE WHEN n >= {min_rows} THEN trend ELSE 0 END', 3)} AS trend,
       {near(f'CASE WHEN n >= {min_rows} THEN seasonal ELSE 0 END', 3)} AS seasonal,
       {near(f'CASE WHEN n >= {min_rows} THEN {col} - trend - seasonal ELSE 0 END', 3)} AS residual
FROM t JOIN seas ON t.series = seas.series AND t.phase = seas.phase"""


LANDED = """stored AS (SELECT o_orderdate AS time, o_orderkey * 10 AS seq, o_totalprice AS value
  FROM orders),
batch AS (SELECT l_shipdate AS time, l_orderkey * 10 + l_linenumber AS seq,
  l_extendedprice AS value FROM lineitem)"""
MERGED = f"""WITH {LANDED},
b AS (SELECT *, 0 AS p FROM stored UNION ALL SELECT *, 1 AS p FROM batch)
SELECT time, seq, value FROM b
QUALIFY row_number() OVER (PARTITION BY time ORDER BY p, seq) = 1"""

# -- sentiment --------------------------------------------------------------------------------

_LEX = ", ".join(f"('{t}', {v})" for t, v in V.LEXICON)
_MOD = ", ".join(
    [f"('{t}', {b}, false)" for t, b in V.BOOSTERS] + [f"('{t}', 0.0, true)" for t in V.NEGATIONS]
)
_PUNCT = W.PUNCTUATION.replace("'", "''")


def _shouted(t: str) -> str:
    return f"({t} = upper({t}) AND {t} <> lower({t}))"


def _step(d: int, source: str) -> str:
    damp = W.DISTANCE_DAMPING[d - 1]
    return f"""s{d} AS (
  SELECT s.*, CASE WHEN coalesce(m.negates, false) OR coalesce(contains(lower(p{d}), 'n''t'), false)
    THEN {W.NEGATION_FACTOR} ELSE 1 END * (v{d - 1} + CASE WHEN coalesce(m.boost, 0) <> 0 THEN
      (CASE WHEN v{d - 1} < 0 THEN -m.boost ELSE m.boost END
       + CASE WHEN {_shouted(f'p{d}')} AND mixed
              THEN CASE WHEN v{d - 1} > 0 THEN {W.CAPS_INCREMENT} ELSE -{W.CAPS_INCREMENT} END
              ELSE 0 END) * {damp} ELSE 0 END) AS v{d}
  FROM {source} s LEFT JOIN active m ON m.term = lower(p{d}))"""


SCORES = f"""lex(term, valence) AS (VALUES {_LEX}),
modifiers(term, boost, negates) AS (VALUES {_MOD}),
valued AS (SELECT * FROM lex WHERE term NOT IN (SELECT term FROM modifiers WHERE boost <> 0)),
active AS (SELECT * FROM modifiers WHERE term NOT IN (SELECT term FROM lex)),
parts AS (
  SELECT doc_id, text,
         list_transform(regexp_extract_all(text, '\\S+'), lambda t:
           CASE WHEN length(t) > 2 AND length(trim(t, '{_PUNCT}')) > 2
                THEN trim(t, '{_PUNCT}') ELSE t END) AS toks
  FROM documents),
docs AS (
  SELECT doc_id, toks, len(toks) AS n_tok,
         length(text) - length(replace(text, '!', '')) AS excl,
         length(text) - length(replace(text, '?', '')) AS quest,
         len(list_filter(toks, lambda t: {_shouted('t')})) AS n_up,
         coalesce(list_position(list_transform(toks, lambda t: lower(t)), 'but'), 0) AS but_ix
  FROM parts),
placed AS (
  SELECT doc_id, excl, quest, but_ix, n_up > 0 AND n_up < n_tok AS mixed,
         unnest(toks) AS tok, generate_subscripts(toks, 1) AS ix FROM docs),
near AS (
  SELECT *, lag(tok, 1) OVER o AS p1, lag(tok, 2) OVER o AS p2, lag(tok, 3) OVER o AS p3
  FROM placed WINDOW o AS (PARTITION BY doc_id ORDER BY ix)),
s0 AS (
  SELECT near.*, valence + CASE WHEN {_shouted('tok')} AND mixed
    THEN CASE WHEN valence > 0 THEN {W.CAPS_INCREMENT} ELSE -{W.CAPS_INCREMENT} END ELSE 0 END AS v0
  FROM near LEFT JOIN valued ON valued.term = lower(tok)),
{_step(1, 's0')},
{_step(2, 's1')},
{_step(3, 's2')},
weighted AS (
  SELECT *, coalesce(v3 * CASE WHEN but_ix = 0 OR ix = but_ix THEN 1.0
    WHEN ix < but_ix THEN {W.BEFORE_BUT} ELSE {W.AFTER_BUT} END, 0) AS s FROM s3),
sums AS (
  SELECT doc_id, round(sum(s), 9) AS total,
         round(sum(CASE WHEN s > 0 THEN s + 1 ELSE 0 END), 9) AS pos,
         round(sum(CASE WHEN s < 0 THEN 1 - s ELSE 0 END), 9) AS neg,
         count(*) FILTER (s = 0) AS neu
  FROM weighted GROUP BY 1),
emph AS (
  SELECT d.doc_id, coalesce(total, 0) AS total, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg,
         coalesce(neu, 0) AS neu,
         least(excl, {W.MAX_EXCLAMATIONS}) * {W.EXCLAMATION} + CASE WHEN quest <= 1 THEN 0
           WHEN quest <= 3 THEN quest * {W.QUESTION} ELSE {W.MANY_QUESTIONS} END AS e
  FROM docs d LEFT JOIN sums USING (doc_id)),
fin AS (
  SELECT doc_id, neu, CASE WHEN total > 0 THEN total + e WHEN total < 0 THEN total - e ELSE 0 END AS x,
         pos + CASE WHEN pos > neg THEN e ELSE 0 END AS p,
         neg + CASE WHEN pos < neg THEN e ELSE 0 END AS n FROM emph),
scores AS (
  SELECT doc_id, round(round(coalesce(n / nullif(p + n + neu, 0), 0), 9), 3) AS sentiment_neg,
         round(round(coalesce(neu / nullif(p + n + neu, 0), 0), 9), 3) AS sentiment_neu,
         round(round(coalesce(p / nullif(p + n + neu, 0), 0), 9), 3) AS sentiment_pos,
         round(round(x / sqrt(x * x + {W.COMPOUND_ALPHA}), 9), 4) AS sentiment_compound FROM fin)"""
CLASSES = """SELECT CASE WHEN sentiment_compound > 0 THEN 'Positive'
  WHEN sentiment_compound < 0 THEN 'Negative' ELSE 'Neutral' END AS sentiment, count(*) AS count
FROM scores GROUP BY 1"""

# -- terms ------------------------------------------------------------------------------------

_STOP = _listed(W.STOPWORDS)
_WORD = W.WORD_PATTERN.replace("'", "''")
TERMS = f"""lists AS MATERIALIZED (
  SELECT doc_id, list_filter(
    list_transform(regexp_extract_all(text, '{_WORD}'), lambda t: regexp_replace(t, '''[sS]$', '')),
    lambda t: NOT regexp_full_match(t, '\\p{{Nd}}+')) AS ws FROM documents),
spoken AS MATERIALIZED (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS at FROM lists),
kept AS (SELECT word FROM spoken WHERE lower(word) NOT IN ({_STOP}))"""


def folded(source: str, c: str, out: str) -> str:
    """Counts per term with plurals folded; ``out`` is (term, word, n, base, has_singular)."""
    return f"""{out}_a AS MATERIALIZED (
  SELECT {c} AS sp, regexp_matches(lower({c}), '[^s]s$') AS pl, count(*) AS n
  FROM {source} GROUP BY 1, 2),
{out}_b AS MATERIALIZED (
  SELECT *, CASE WHEN pl THEN lower(sp)[:-2] ELSE lower(sp) END AS base,
         CASE WHEN pl THEN sp[:-2] ELSE sp END AS stem FROM {out}_a),
{out}_h AS MATERIALIZED (SELECT base, bool_or(NOT pl) AS has_singular, sum(n) AS n FROM {out}_b GROUP BY 1),
{out}_s AS (
  SELECT base, has_singular, CASE WHEN has_singular THEN stem ELSE sp END AS word,
         sum({out}_b.n) AS m FROM {out}_b JOIN {out}_h USING (base) GROUP BY 1, 2, 3),
{out}_w AS (
  SELECT base, word FROM {out}_s
  QUALIFY row_number() OVER (PARTITION BY base ORDER BY m DESC, word) = 1),
{out} AS (
  SELECT CASE WHEN has_singular THEN base ELSE base || 's' END AS term, word,
         CAST(n AS BIGINT) AS n, base, has_singular FROM {out}_h JOIN {out}_w USING (base))"""


def _ll(k: str, n: str, p: str) -> str:
    return f"(ln(greatest({p}, 1e-10)) * {k} + ln(greatest(1 - {p}, 1e-10)) * ({n} - {k}))"


TOP = f"""SELECT term, word, n, {near('n / max(n) OVER ()', 6)} AS rel
FROM (SELECT term, word, n FROM {{source}} ORDER BY n DESC, term LIMIT 200)"""
PAIRS = f"""pairs AS (
  SELECT a.word || ' ' || b.word AS pair FROM spoken a
  JOIN spoken b ON a.doc_id = b.doc_id AND b.at = a.at + 1
  WHERE lower(a.word) NOT IN ({_STOP}) AND lower(b.word) NOT IN ({_STOP})),
{folded('pairs', 'pair', 'two')},
surface AS (
  SELECT b.base AS base, lower(b.sp) AS form, any_value(h.n) AS n, bool_or(h.has_singular) AS hs
  FROM one_b b JOIN one_h h USING (base) GROUP BY 1, 2),
canon AS (SELECT form, n, CASE WHEN hs THEN base ELSE base || 's' END AS canonical FROM surface),
halved AS MATERIALIZED (
  SELECT *, split_part(term, ' ', 1) AS one_half, split_part(term, ' ', 2) AS other_half FROM two),
joined AS (
  SELECT t.term AS bigram, t.word, t.n, f.canonical AS first_term, s.canonical AS second_term,
         CAST(t.n AS DOUBLE) AS k, CAST(f.n AS DOUBLE) AS c1, CAST(s.n AS DOUBLE) AS c2, total
  FROM halved t JOIN canon f ON f.form = one_half JOIN canon s ON s.form = other_half,
       (SELECT CAST(count(*) AS DOUBLE) AS total FROM kept)),
llrs AS (
  SELECT *, CASE WHEN total > c1 AND total > c2 THEN -2 * (
    {_ll('k', 'c1', '(c2 / total)')} + {_ll('(c2 - k)', '(total - c1)', '(c2 / total)')}
    - {_ll('k', 'c1', '(k / c1)')} - {_ll('(c2 - k)', '(total - c1)', '((c2 - k) / (total - c1))')})
    ELSE 0 END AS llr FROM joined),
bigrams AS (SELECT bigram, word, n, first_term, second_term, llr FROM llrs WHERE llr > 30)"""
CLOUD = f"""cloud AS (
  SELECT term, max(word) AS word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT term, word, n FROM one
    UNION ALL SELECT first_term, NULL, -n FROM bigrams
    UNION ALL SELECT second_term, NULL, -n FROM bigrams)
  GROUP BY 1 HAVING sum(n) > 0
  UNION ALL SELECT bigram, word, n FROM bigrams)"""

ORACLE: dict[str, str] = {
    "moving_averages": f"WITH {BARS}, {MOVING}",
    "moving_averages_cut_series": f"WITH {DAILY_BARS}, {MOVING}",
    "rolling_partial_mean": f"""WITH {TICKS}
SELECT series, time, {near('close', 4)} AS close, {near('avg(close) OVER ' + frame(5))} AS mean_5
FROM ticks""",
    "rolling_std": f"""WITH {TICKS}
SELECT series, time, {near('close', 4)} AS close,
       {near(full('stddev_samp', 'close', 7))} AS std_7 FROM ticks""",
    "pct_change": f"""WITH {TICKS}
SELECT series, time, {near('close', 6)} AS close, {near(change('close'), 6)} AS change
FROM ticks {W_SERIES}""",
    "pct_change_filled": f"""WITH {TICKS},
gaps AS (SELECT series, time, CASE WHEN close >= 5 THEN close END AS close FROM ticks),
f AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY series ORDER BY time
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM gaps)
SELECT series, time, close, {near(change('filled'), 6)} AS change FROM f {W_SERIES}""",
    "diff": f"""WITH {TICKS}
SELECT series, time, close, {near('close - lag(close) OVER w', 4)} AS change FROM ticks {W_SERIES}""",
    "lag_close": f"""WITH {TICKS}
SELECT series, time, close, lag(close) OVER w AS lag_close FROM ticks {W_SERIES}""",
    "ohlc_features": f"""WITH {DAILY_BARS}, {OHLC_FEATURES}
SELECT series, time, open, high, low, close, {near('moving_avg_5', 4)} AS moving_avg_5,
       {near('moving_avg_10', 4)} AS moving_avg_10, {near('daily_return', 4)} AS daily_return,
       CAST(day_of_week AS INTEGER) AS day_of_week, CAST(month AS INTEGER) AS month,
       CAST(year AS INTEGER) AS year FROM features""",
    "lag_features": f"""WITH {BARS}, l AS (SELECT *, lag(close) OVER w AS lag_close FROM bars {W_SERIES})
SELECT series, time, close, CAST(isodow(time) - 1 AS DOUBLE) AS day_of_week,
       CAST(month(time) AS DOUBLE) AS month, lag_close FROM l WHERE lag_close IS NOT NULL""",
    "market_features": f"""WITH {METRICS}, {MARKET}
SELECT series, time, {', '.join(near(c) + f' AS {c}' for c in SCALED + OTHER)} FROM features""",
    "market_features_scaled": f"""WITH {METRICS}, {MARKET}
SELECT series, time, {', '.join(near(minmax(c)) + f' AS {c}' for c in SCALED)},
       {', '.join(near(c) + f' AS {c}' for c in OTHER)} FROM features""",
    "cap_to_volume": f"""WITH {METRICS}
SELECT series, time, {near('market_cap / NULLIF(total_volume, 0)', 4)} AS ratio FROM metrics""",
    "trailing_range": f"""WITH {METRICS},
m AS (SELECT *, max(time) OVER (PARTITION BY series) AS last FROM metrics)
SELECT series, time, {near('price', 4)} AS price, {near('market_cap', 4)} AS market_cap, total_volume
FROM m WHERE time BETWEEN last - INTERVAL 30 DAY AND last""",
    "chart_overlay": f"""WITH {BARS}, {DAILY_AVERAGE}, {OHLC_FEATURES}
SELECT series, date, 'history' AS kind, {near('average_price')} AS value FROM daily
UNION ALL
SELECT series, CAST(max(time) + to_days(CAST(any_value(i) AS INTEGER)) AS DATE), 'forecast',
       {near('arg_max(moving_avg_5, time)')}
FROM features CROSS JOIN range(1, 6) r(i) GROUP BY series, i""",
    "seasonal_decompose": f"WITH {DAILY_BARS}, {decomposed('bars', 'close', 365, 730)}",
    "seasonal_decompose_even": f"WITH {METRICS}, {decomposed('metrics', 'price', 30, 60)}",
    "daily_average": f"""WITH {BARS}, {DAILY_AVERAGE}
SELECT series, date, {near('average_price')} AS average_price FROM daily""",
    "weekday_change": f"WITH {DAILY_BARS} {WEEKDAYS}",
    "duplicate_times": """SELECT o_orderpriority AS series, o_orderdate AS time, count(*) AS copies
FROM orders GROUP BY 1, 2 HAVING count(*) > 1""",
    "quality_report": """SELECT lang, count(*) AS n_rows, count(*) FILTER (quality IS NULL) AS missing_quality,
       count(*) FILTER (toxic IS NULL) AS missing_toxic
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""",
    "regression_metrics": f"""WITH {DAILY_BARS}, {OHLC_FEATURES},
m AS (SELECT series, avg((close - moving_avg_5) * (close - moving_avg_5)) AS mse,
             avg(abs(close - moving_avg_5)) AS mae FROM features GROUP BY 1)
SELECT series, {near('mse', 2)} AS mse, {near('mae', 2)} AS mae, {near('sqrt(mse)', 2)} AS rmse FROM m""",
    "merge_bars": MERGED,
    "new_bars": f"""WITH {LANDED}
SELECT time, seq, value FROM batch WHERE time NOT IN (SELECT time FROM stored)
QUALIFY row_number() OVER (PARTITION BY time ORDER BY seq) = 1""",
    "merge_articles": f"""WITH {ARTICLES},
b AS (SELECT doc_id, title, url, 0 AS p FROM articles WHERE doc_id IN (SELECT doc_id FROM labels)
      UNION ALL SELECT doc_id, title, url, 1 AS p FROM articles)
SELECT doc_id, title, url FROM b
QUALIFY row_number() OVER (PARTITION BY title, url ORDER BY p, doc_id) = 1""",
    "latest_articles": f"""WITH {ARTICLES}
SELECT title, url, published_at FROM articles ORDER BY published_at DESC, url, title LIMIT 100""",
    "freshness_gate": """SELECT user_id AS source, max(ts) AS last_ts FROM events GROUP BY 1
HAVING TIMESTAMP '2024-01-31' - max(ts) >= INTERVAL 6 HOUR""",
    "parse_ohlc_json": f"WITH {BARS} SELECT series, time, open, high, low, close FROM bars",
    "parse_market_json": f"""WITH {METRICS}
SELECT series, time, {near('price', 4)} AS price, {near('market_cap', 4)} AS market_cap, total_volume
FROM metrics""",
    "parse_news_json": f"""WITH {ARTICLES}
SELECT doc_id, title, description, url, published_at
FROM articles WHERE lang <> 'es'""",
    "ingest_bars": f"WITH {BARS} SELECT series, time, open, high, low, close FROM bars",
    "csv_bars": f"WITH {BARS} SELECT series, time, open, high, low, close FROM bars",
    "load_or_empty": f"WITH {BARS} SELECT series, time, open, high, low, close FROM bars",
    "time_order": "SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) - 1 AS position FROM events",
    "sorted_files": "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_broken FROM events",
    "lenient_time": """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_orderdate END AS time
FROM orders""",
    "minmax_scale": f"""WITH {DAILY_BARS}
SELECT series, time, {', '.join(f'{near(minmax(c), 6)} AS {c}' for c in V.PRICES)} FROM bars""",
    "inverse_scale": f"WITH {DAILY_BARS} SELECT series, time, open, high, low, close FROM bars",
    "sequences": f"""WITH {BARS},
n AS (SELECT *, row_number() OVER w AS i FROM bars {W_SERIES})
SELECT a.series, a.time, a.close AS y, CAST(5 - (a.i - b.i) AS INTEGER) AS step, b.close, b.high
FROM n a JOIN n b ON a.series = b.series AND b.i BETWEEN a.i - 5 AND a.i - 1 WHERE a.i > 5""",
    "sequence_frame": f"""WITH {BARS},
n AS (SELECT *, row_number() OVER w - 31 AS i, count(*) OVER (PARTITION BY series) - 30 AS total
      FROM bars {W_SERIES}),
s AS (SELECT *, CASE WHEN i < floor(CAST(0.7 AS DOUBLE) * total) THEN 'train'
        WHEN i < floor(CAST(0.85 AS DOUBLE) * total) THEN 'validation' ELSE 'test' END AS split FROM n WHERE i >= 0)
SELECT series, split, count(*) AS n, min(time) AS first, max(time) AS last,
       {near('avg(close)', 4)} AS mean_y FROM s GROUP BY 1, 2""",
    "series_tail": f"""WITH {TICKS} SELECT series, time, close FROM ticks
QUALIFY row_number() OVER (PARTITION BY series ORDER BY time DESC) <= 30""",
    "chrono_split": f"""WITH {TICKS},
n AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY series) AS total
      FROM ticks {W_SERIES})
SELECT series, time, close, CASE WHEN i < floor(CAST(0.7 AS DOUBLE) * total) THEN 'train'
  WHEN i < floor(CAST(0.85 AS DOUBLE) * total) THEN 'validation' ELSE 'test' END AS split FROM n""",
    "hash_split_members": f"""WITH {TICKS}, h AS (
  SELECT *, substr(md5(concat_ws('|', series, epoch_us(time), 42)), 1, 15) AS h,
         ceil(CAST(0.2 AS DOUBLE) * count(*) OVER (PARTITION BY series)) AS n FROM ticks)
SELECT series, time, close, CASE WHEN row_number() OVER (PARTITION BY series ORDER BY h, time) <= n
  THEN 'test' ELSE 'train' END AS split FROM h""",
    "hash_split_sizes": f"""WITH {TICKS}, n AS (SELECT series, count(*) AS n FROM ticks GROUP BY 1)
SELECT series, 'test' AS split, CAST(ceil(CAST(0.2 AS DOUBLE) * n) AS BIGINT) AS n FROM n
UNION ALL SELECT series, 'train', n - CAST(ceil(CAST(0.2 AS DOUBLE) * n) AS BIGINT) FROM n""",
    "gram_matrix": f"""WITH {DAILY_BARS}, {OHLC_FEATURES},
x AS (SELECT series, {minmax('moving_avg_5')} AS a, {minmax('moving_avg_10')} AS b,
             {minmax('close')} AS y FROM features)
SELECT series, count(*) AS n, {near('sum(y)', 4)} AS sum_y, {near('sum(a)', 4)} AS sum_x0,
       {near('sum(b)', 4)} AS sum_x1, {near('sum(a * a)', 4)} AS x0x0, {near('sum(a * b)', 4)} AS x0x1,
       {near('sum(b * b)', 4)} AS x1x1, {near('sum(a * y)', 4)} AS sum_x0y,
       {near('sum(b * y)', 4)} AS sum_x1y FROM x GROUP BY 1""",
    "fit_ols": f"""WITH {DAILY_BARS}
SELECT series, count(*) AS n, {near('regr_intercept(close, open)', 4)} AS intercept,
       {near('regr_slope(close, open)', 4)} AS slope FROM bars GROUP BY 1""",
    "future_frame": f"""WITH {BARS}, {OHLC_FEATURES},
last AS (SELECT series, max(time) AS t, {near('arg_max(moving_avg_5, time)', 4)} AS moving_avg_5,
                {near('arg_max(daily_return, time)', 4)} AS daily_return FROM features GROUP BY 1),
f AS (SELECT series, t + to_days(CAST(i AS INTEGER)) AS date, moving_avg_5, daily_return
      FROM last CROSS JOIN range(1, 31) r(i))
SELECT series, date, moving_avg_5, daily_return, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week,
       CAST(month(date) AS INTEGER) AS month, CAST(year(date) AS INTEGER) AS year FROM f""",
    "recursive_forecast": f"""WITH RECURSIVE {BARS},
tail AS (SELECT series, max(time) AS t, (list(close ORDER BY time DESC))[1:5] AS l
         FROM bars GROUP BY 1),
r AS (
  SELECT series, t, 0 AS k, l, CAST(NULL AS DOUBLE) AS p FROM tail
  UNION ALL
  SELECT series, t, k + 1, list_prepend(list_sum(l) * 0.2 + 1, l[1:4]), list_sum(l) * 0.2 + 1
  FROM r WHERE k < 12)
SELECT series, t + to_days(k) AS date, {near('p', 4)} AS predicted FROM r WHERE k > 0""",
    "forecast_deltas": f"""WITH {BARS}, {DAILY_AVERAGE}
SELECT series, date, {near('average_price')} AS predicted_price,
       {near('average_price - lag(average_price) OVER w')} AS daily_change,
       {near(change('average_price', ' * 100'))} AS daily_pct_change
FROM daily WINDOW w AS (PARTITION BY series ORDER BY date)""",
    "tokens": f"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '{_WORD}') AS ws FROM documents)
SELECT doc_id, CAST(generate_subscripts(ws, 1) - 1 AS INTEGER) AS pos, unnest(ws) AS token FROM t""",
    "lexicon_sentiment": f"WITH {SCORES} SELECT * FROM scores",
    "sentiment_distribution": f"WITH {SCORES} {CLASSES}",
    "sentiment_over_time": f"""WITH {ARTICLES}, {SCORES}
SELECT published_at, title, sentiment_compound FROM articles JOIN scores USING (doc_id)""",
    "term_counts": f"WITH {TERMS}, {folded('kept', 'word', 'one')} SELECT term, word, n FROM one",
    "term_frequency": f"WITH {TERMS}, {folded('kept', 'word', 'one')} {TOP.format(source='one')}",
    "bigram_llr": f"""WITH {TERMS}, {folded('kept', 'word', 'one')}, {PAIRS}
SELECT bigram, word, n, first_term, second_term, {near('llr', 3)} AS llr FROM bigrams""",
    "word_cloud": f"""WITH {TERMS}, {folded('kept', 'word', 'one')}, {PAIRS}, {CLOUD}
{TOP.format(source='cloud')}""",
    "stream_bars": f"WITH {BARS} SELECT series, time, open, high, low, close FROM bars",
    "stream_daily_average": f"""WITH {BARS}, {DAILY_AVERAGE}
SELECT series, date, {near('average_price')} AS average_price FROM daily""",
    "stream_closed_bars": f"""WITH {BARS}, done AS (SELECT max(ts) - INTERVAL 10 MINUTE AS t FROM events)
SELECT series, time, open, high, low, close FROM bars, done WHERE time + INTERVAL 4 HOUR <= t""",
    "replaced_table": f"""WITH {BARS}
SELECT series, time, open, high, low, close FROM bars
QUALIFY close > avg(close) OVER (PARTITION BY series)""",
    "stream_dedup": f"WITH {ARTICLES} SELECT DISTINCT title, url FROM articles",
    "stream_merge": MERGED,
    "stream_weekday_change": f"WITH {DAILY_BARS} {WEEKDAYS}",
    "stream_sentiment_counts": f"WITH {SCORES} {CLASSES}",
    "stream_rolling": f"WITH {BARS}, {MOVING}",
    "stream_rolling_late": f"WITH {BARS}, {MOVING}",
}
ORACLE["merge_stored_articles"] = ORACLE["merge_articles"]
