"""Quality rules whose cutoffs are certified on labelled documents. Spark SQL only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesengine.llm.common import let, words
from seriesengine.session import materialize

SYMBOLS = "[#*$%&|<>]"
NOT_SPACE = "[^\\x20\\x09-\\x0D]"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


@dataclass(frozen=True)
class Rule:
    """Reject when ``value`` is above the cutoff; ``cutoffs`` run from lenient to strict."""

    name: str
    value: Column
    cutoffs: tuple[float, ...]


def _ratio(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def rules() -> tuple[Rule, ...]:
    shares = (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05)
    return (
        Rule("symbols per word", _ratio("n_symbols", "n_words"), (3.0, 2.0, 1.5, 1.0, *shares)),
        Rule("upper case share", _ratio("n_upper", "word_chars"), shares),
        Rule("repeated word share", _ratio("n_repeat_words", "n_words"), shares),
        Rule("repeated line share", _ratio("n_dup_lines", "n_lines"), shares),
        Rule("characters per word", _ratio("word_chars", "n_words"), (60.0, 40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0)),
    )


def _repeat_words(w: Column) -> Column:
    """Words inside three-word windows that are found twice or more in the array ``w``."""

    def counted(h: Column) -> Column:
        def placed(s: Column) -> Column:
            def twin(p: Column, i: Column) -> Column:
                same = lambda j: F.coalesce(F.get(s, j)["h"] == p["h"], F.lit(False))
                return F.when(same(i - 1) | same(i + 1), p["i"])

            at = F.sort_array(F.filter(F.transform(s, twin), lambda i: i.isNotNull()))
            start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
            step = lambda a, i: F.struct(
                i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"]).cast("long")).alias("n")
            )
            return F.aggregate(at, start, step, lambda a: a["n"])

        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(ordered, placed)).otherwise(
            F.lit(0).cast("long")
        )

    window = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    n = F.size(w)
    return F.when(n >= 4, let(F.slice(window, F.lit(1), F.greatest(n - 2, F.lit(1))), counted)).otherwise(
        F.lit(0).cast("long")
    )


def text_stats(text: Column) -> Column:
    """A struct of STATS for a text; null counts as empty.

    Words are runs without white space; symbols match SYMBOLS; a repeated line
    has a word and equals an earlier line of the text; upper case means A to Z. All of the text is read, whatever its length.
    """
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))

    def stats(w: Column) -> Column:
        return let(
            lines,
            lambda rows: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                (F.size(rows) - F.size(F.array_distinct(rows))).cast("long").alias("n_dup_lines"),
                _repeat_words(w).alias("n_repeat_words"),
                F.size(rows).cast("long").alias("n_lines"),
                F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_upper"),
            ),
        )

    return let(words(text), stats)


def base_failed() -> Column:
    """Too short, or more than half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1, by Stirling's series after a shift of 8."""
    y = x + 8
    shift = F.lit(0.0)
    for k in range(8):
        shift = shift + F.log(x + k)
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5)))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - shift


def binomial_tail(k: Column, n: Column, risk: float, terms: int = 2000) -> Column:
    """P(at most k of n) when each has probability ``risk``, exactly, or a shade above.

    The terms fall at least geometrically below k when k / n < risk; beyond ``terms`` of them the
    rest is bounded by the geometric series and added, so the value never comes out too small.
    With k / n >= risk the value is 1, which certifies nothing.
    """
    kd, nd = k.cast("double"), n.cast("double")
    top = (
        _log_gamma(nd + 1) - _log_gamma(kd + 1) - _log_gamma(nd - kd + 1)
        + kd * F.log(F.lit(risk)) + (nd - kd) * F.log(F.lit(1 - risk))
    )
    odds = (1 - risk) / risk
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))

    def step(a: Column, j: Column) -> Column:  # from the term of j to that of j - 1
        jd = j.cast("double")
        return F.struct(
            (a["term"] * jd / (nd - jd + 1) * odds).alias("term"), (a["sum"] + a["term"]).alias("sum")
        )

    down = F.sequence(k.cast("long"), F.greatest(k.cast("long") - terms, F.lit(0).cast("long")), F.lit(-1).cast("long"))
    rest = F.greatest(kd - terms, F.lit(0.0))
    ratio = rest / (nd - rest + 1) * odds
    total = F.aggregate(down, start, step, lambda a: a["sum"] + F.when(rest > 0, a["term"] / (1 - ratio)).otherwise(0.0))
    return F.when(kd >= nd * risk, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(top) * total))


def certified_cutoffs(good: DataFrame, stratum: str, risk: float, error: float) -> DataFrame:
    """One row (stratum, rule, cutoff, n_good, n_rejected) for each certified rule and stratum.

    ``good`` holds the statistics of documents labelled good. For each stratum and rule the
    cutoffs are tested from lenient to strict by the exact binomial test of "the rule rejects
    more than its share of ``risk`` of the good documents", the rules having equal shares; the last
    before the first failure is taken (fixed-sequence testing). The level is ``error`` divided by the
    number of strata and rules. So with probability 1 - ``error``, in every stratum all rules
    together reject at most ``risk`` of the good documents. A stratum with too few labels gets
    no cutoff, and its documents pass.
    """
    all_rules = rules()
    risk = risk / len(all_rules)

    def lenient(rule: Rule) -> Column:  # how many cutoffs let a document pass: it violates the others
        return F.size(F.filter(F.array(*map(F.lit, rule.cutoffs)), lambda c: rule.value <= c))

    levels = F.array(
        *(
            F.struct(
                F.lit(r.name).alias("rule"),
                F.array(*map(F.lit, r.cutoffs)).alias("cutoffs"),
                lenient(r).alias("from"),  # the first place it violates
            )
            for r in all_rules
        )
    )
    seen = (
        good.select(stratum, F.explode(levels).alias("x"))
        .groupBy(stratum, "x.rule", "x.cutoffs", "x.from").agg(F.count(F.lit(1)).alias("n"))
        .groupBy(stratum, "rule", "cutoffs")
        .agg(F.sum("n").alias("n_good"), F.collect_list(F.struct("from", "n")).alias("counts"))
    )
    tested = seen.select(
        stratum, "rule", "n_good", F.posexplode("cutoffs").alias("place", "cutoff"), "counts"
    ).withColumn(
        "n_rejected",
        F.aggregate(
            F.filter("counts", lambda c: c["from"] <= F.col("place")),
            F.lit(0).cast("long"), lambda a, c: a + c["n"],
        ),
    )
    chains = len(all_rules) * max(1, good.select(stratum).distinct().count())
    order = Window.partitionBy(stratum, "rule").orderBy("place")
    passed = binomial_tail(F.col("n_rejected"), F.col("n_good"), risk) <= error / chains
    certified = tested.withColumn("ok", F.min(passed).over(order)).filter("ok")
    return certified.groupBy(stratum, "rule").agg(
        F.min("cutoff").alias("cutoff"),
        F.max("n_good").alias("n_good"),
        F.max_by("n_rejected", "place").alias("n_rejected"),
    )


def _with_stats(df: DataFrame, text: str, stratum: str) -> DataFrame:
    """``stratum`` (null as an empty string) and STATS beside the columns of ``df``."""
    stratum_of = F.coalesce(F.col(stratum).cast("string"), F.lit("")) if stratum in df.columns else F.lit("")
    return df.withColumns({"_stratum": stratum_of, "_s": text_stats(F.col(text))}).select(
        *df.columns, "_stratum", "_s.*"
    )


def _with_verdict(stats: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``base_failed`` and ``kept`` beside ``_stratum`` and STATS.

    There is a row of cutoffs for each stratum, so Spark broadcasts the table as long as its
    measured size allows, and joins by shuffling otherwise.
    """
    by_stratum = cutoffs.groupBy("_stratum").agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cutoffs")
    )
    broken = F.lit(False)
    for r in rules():
        broken = broken | F.coalesce(r.value > F.col("_cutoffs")[r.name], F.lit(False))
    return (
        stats.join(by_stratum, "_stratum", "left")
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & ~broken)
        .drop("_cutoffs")
    )


def learned_cutoffs(
    stats: DataFrame, labels: DataFrame, *, key: str = "doc_id", risk: float = 0.02, error: float = 0.1
) -> DataFrame:
    """Certified cutoffs from the statistics of documents labelled ``quality = 1`` that pass the base."""
    good = labels.filter("quality = 1").select(key)
    held = stats.join(good, key, "left_semi").filter(~base_failed()).select("_stratum", *STATS)
    return materialize(certified_cutoffs(materialize(held), "_stratum", risk, error))


def judge_documents(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", stratum: str = "lang",
    risk: float = 0.02, error: float = 0.1,
) -> DataFrame:
    """``key``, STATS, ``base_failed`` and ``kept`` for every document.

    A document goes if it fails the base, or if a statistic exceeds the cutoff certified for
    its stratum (see ``certified_cutoffs``). Null and empty texts have no words and fail the
    base; repeated rows are judged one by one; a null stratum is a stratum; other columns of
    ``docs`` are not read. Without labels nothing but the base rejects. Statistics are made in
    one pass over the text and kept in the shared folder.
    """
    slim = docs.select(key, text, *([stratum] if stratum in docs.columns else []))
    stats = materialize(_with_stats(slim, text, stratum).select(key, "_stratum", *STATS))
    cutoffs = learned_cutoffs(stats, labels, key=key, risk=risk, error=error)
    return _with_verdict(stats, cutoffs).select(key, *STATS, "base_failed", "kept")


def keep_good_documents(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", stratum: str = "lang",
    risk: float = 0.02, error: float = 0.1,
) -> DataFrame:
    """The rows of ``docs`` that ``judge_documents`` keeps, with all their columns.

    The second pass makes the statistics anew beside each row instead of moving texts.
    """
    slim = docs.select(key, text, *([stratum] if stratum in docs.columns else []))
    stats = materialize(_with_stats(slim, text, stratum).select(key, "_stratum", *STATS))
    cutoffs = learned_cutoffs(stats, labels, key=key, risk=risk, error=error)
    whole = docs.select(F.struct(*docs.columns).alias("_row"), *slim.columns)
    kept = _with_verdict(_with_stats(whole, text, stratum), cutoffs).filter("kept")
    return kept.select("_row.*")
