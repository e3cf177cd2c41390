"""Lexicon sentiment: T1 and T2.

A document is split inside its row, so every token is born next to its three
predecessors and to the document's own flags (where "but" stands, whether the text
mixes capitals, how many tokens it has). Only tokens that the lexicon knows become rows;
they meet it in a join, and a partial aggregate folds them into one row per document
before the only shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesengine.text import words as W

MAX_BROADCAST_TERMS = 200_000
#: Terms up to which tokens are looked up inside the document's row, before they become rows.
MAX_ROW_TERMS = 50_000


def words_of(text: Column) -> Column:
    """T1, word mode: runs of letters, digits and underscores with inner apostrophes."""
    return F.regexp_extract_all(text, F.lit(W.WORD_PATTERN), F.lit(0))


def spoken_tokens(text: Column) -> Column:
    """T1, whitespace mode: outer punctuation is stripped if more than two characters stay."""
    parts = F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))

    def spoken(t: Column) -> Column:
        stripped = F.btrim(t, F.lit(W.PUNCTUATION))
        return F.when((F.length(t) > 2) & (F.length(stripped) > 2), stripped).otherwise(t)

    return F.transform(parts, spoken)


def tokens(df: DataFrame, col: str, id_col: str, mode: str = "words") -> DataFrame:
    """One row per token, (id, pos, token)."""
    if mode not in ("words", "whitespace"):
        raise ValueError("mode must be words or whitespace")
    split = words_of if mode == "words" else spoken_tokens
    return df.select(id_col, F.posexplode(split(F.col(col))).alias("pos", "token"))


def default_modifiers(spark: SparkSession) -> DataFrame:
    """The published boosters and negations as a table (term, boost, negates)."""

    def listed(terms: tuple[str, ...], boost: float, negates: bool) -> DataFrame:
        array = F.array(*[F.lit(t) for t in terms])
        return spark.range(1).select(
            F.explode(array).alias("term"), F.lit(boost).alias("boost"),
            F.lit(negates).alias("negates"),
        )

    return (
        listed(W.BOOSTERS_UP, W.BOOST, False)
        .unionByName(listed(W.BOOSTERS_DOWN, -W.BOOST, False))
        .unionByName(listed(W.NEGATIONS, 0.0, True))
    )


def fits_broadcast(df: DataFrame, limit: int = MAX_BROADCAST_TERMS) -> bool:
    """Whether a term table is small enough to send to every executor, by counting it."""
    return df.limit(limit + 1).count() <= limit


def _shouted(token: Column) -> Column:
    return (token == F.upper(token)) & (token != F.lower(token))


def _occurrences(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _signed(value: Column, sign_of: Column) -> Column:
    return F.when(sign_of > 0, value).otherwise(-value)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A lexicon file as (term, valence): lines of a term, a tab, its mean valence, and what else follows.

    Terms are lower-cased; lines without a number are skipped, and of a repeated term the first
    in alphabetical order of its line stays.
    """
    parts = F.split("value", "\t")
    lines = spark.read.text(path).select(
        F.lower(F.trim(parts[0])).alias("term"), F.get(parts, F.lit(1)).try_cast("double").alias("valence"), "value"
    )
    known = lines.where("term <> '' and valence is not null")
    return known.groupBy("term").agg(F.min_by("valence", "value").alias("valence"))


def _token_rows(df: DataFrame, col: str, id_col: str, terms: list[str] | None) -> DataFrame:
    """A row for each token among ``terms`` (None: each token), or one without a token."""
    text = F.coalesce(F.col(col), F.lit(""))  # P10: only the scoring input is defaulted
    said = df.select(
        F.col(id_col).alias("_id"),
        spoken_tokens(text).alias("_t"),
        _occurrences(text, "!").alias("_excl"),
        _occurrences(text, "?").alias("_quest"),
    )
    n_shouted = F.size(F.filter("_t", _shouted))
    described = said.withColumns(
        {
            "_mixed": (n_shouted > 0) & (n_shouted < F.size("_t")),
            # 1-based position of the first "but", 0 if there is none
            "_but": F.array_position(F.transform("_t", F.lower), F.lit("but")),
            "_n": F.size("_t"),
        }
    )
    placed = F.transform("_t", lambda t, i: F.struct(i.alias("_pos"), t.alias("_token")))
    if terms is not None:
        placed = F.filter(placed, lambda x: F.lower(x["_token"]).isin(terms))
    with_before = F.transform(
        placed,
        lambda x: F.struct(
            x["_pos"], x["_token"],
            *[F.get(F.col("_t"), x["_pos"] - d).alias(f"_prev{d}") for d in (1, 2, 3)],
        ),
    )
    return described.select(
        "_id", "_excl", "_quest", "_mixed", "_but", "_n", F.inline_outer(with_before)
    )


def _lookup(rows: DataFrame, modifiers: DataFrame, d: int, small: bool) -> DataFrame:
    """Join the modifier d tokens back; only tokens with a valence have a key to look up."""
    side = modifiers.select(
        F.col("term").alias(f"_m{d}"), F.col("boost").alias(f"_boost{d}"),
        F.col("negates").alias(f"_negates{d}"),
    )
    key = F.when(F.col("_valence").isNotNull(), F.lower(f"_prev{d}"))
    if not small:
        # A shuffled join would send every token without a key to one task: spread them.
        key = F.coalesce(key, F.concat(F.lit("\u0000"), F.col("_pos").cast("string")))
    return rows.join(F.broadcast(side) if small else side, key == F.col(f"_m{d}"), "left")


def _modified(valence: Column, d: int) -> Column:
    """Booster and negation at distance d, applied to the valence so far."""
    previous = F.col(f"_prev{d}")
    boost = F.coalesce(f"_boost{d}", F.lit(0.0))
    signed = F.when(valence < 0, -boost).otherwise(boost)
    louder = F.when(_shouted(previous) & F.col("_mixed"), _signed(F.lit(W.CAPS_INCREMENT), valence))
    scalar = F.when(boost != 0, signed + F.coalesce(louder, F.lit(0.0))).otherwise(F.lit(0.0))
    moved = valence + scalar * W.DISTANCE_DAMPING[d - 1]
    active = F.coalesce(f"_negates{d}", F.lit(False))
    negated = active | F.coalesce(F.lower(previous).contains("n't"), F.lit(False))
    out = F
    for word, followed, factor in (
        (W.NEVER, W.NEVER_FOLLOWED, W.NEVER_FACTOR), (W.WITHOUT, W.WITHOUT_FOLLOWED, 1.0)
    ):
        between = [F.coalesce(F.lower(f"_prev{k}").isin(*followed), F.lit(False)) for k in range(1, d)]
        if between:
            out = out.when(active & (F.lower(previous) == word) & reduce(Column.__or__, between), moved * factor)
    return out.when(negated, moved * W.NEGATION_FACTOR).otherwise(moved)


def _with_phrases(rows: DataFrame, phrases: DataFrame) -> DataFrame:
    """Boosters of two words, among the three tokens before: their step is added as it is."""
    for far, near in ((3, 2), (2, 1)):
        pair = F.concat_ws(" ", F.lower(f"_prev{far}"), F.lower(f"_prev{near}"))
        side = phrases.select(F.col("term").alias("_phrase"), F.col("boost").alias("_step"))
        key = F.when(F.col(f"_prev{far}").isNotNull() & F.col("_valence").isNotNull(), pair)
        rows = rows.join(F.broadcast(side), key == F.col("_phrase"), "left").withColumn(
            "_v", F.col("_v") + F.coalesce("_step", F.lit(0.0))
        ).drop("_phrase", "_step")
    return rows


def _with_least(valence: Column) -> Column:
    least = F.coalesce(F.lower("_prev1") == W.LEAST, F.lit(False))
    after = F.coalesce(F.lower("_prev2").isin(*W.LEAST_AFTER), F.lit(False))
    return F.when(least & ~after, valence * W.NEGATION_FACTOR).otherwise(valence)


def _steady_sum(value: Column) -> Column:
    """A sum whose sign and ties do not hang on the order of the additions."""
    return F.round(F.sum(value), 9)


def changing_phrases(modifiers: DataFrame, most: int = 1000) -> list:
    """The boosters of two words, which are few: (term, boost)."""
    found = modifiers.where("term like '% %' and boost <> 0").select("term", "boost").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} boosters of two words")
    return found


def lexicon_sentiment(
    df: DataFrame, col: str, id_col: str, lexicon: DataFrame, modifiers: DataFrame | None = None
) -> DataFrame:
    """(id, sentiment_neg, sentiment_neu, sentiment_pos, sentiment_compound) per document.

    ``lexicon`` is (term, valence), lower case; ``modifiers`` is (term, boost, negates)
    and defaults to the published boosters and negations. ``id_col`` must be unique.
    Rules: negation and boosters (also of two words) within three tokens before, unless that
    token is itself in the lexicon; "never so", "without doubt" and "least"; capitals in
    mixed-case text; "but" shifts weight to what follows; exclamation and question marks.
    Idioms and emoji are left out.
    """
    given = modifiers is not None
    modifiers = modifiers if given else default_modifiers(df.sparkSession)
    few = not given or fits_broadcast(modifiers)
    known = [r["term"] for r in lexicon.select("term").distinct().limit(MAX_ROW_TERMS + 1).collect()]
    small = len(known) <= MAX_ROW_TERMS or fits_broadcast(lexicon)
    terms = F.broadcast(lexicon) if small else lexicon
    changing = F.broadcast(modifiers) if few else modifiers
    valued = lexicon.join(changing.where("boost <> 0"), "term", "left_anti").select(
        F.col("term").alias("_term"), F.col("valence").cast("double").alias("_valence")
    )
    active = modifiers.join(terms, "term", "left_anti")

    rows = _token_rows(df, col, id_col, known if len(known) <= MAX_ROW_TERMS else None)
    rows = rows.join(
        F.broadcast(valued) if small else valued, F.lower("_token") == F.col("_term"), "left"
    )
    rows = reduce(lambda r, d: _lookup(r, active, d, few), (1, 2, 3), rows)

    valence = F.col("_valence")
    shout = F.when(_shouted(F.col("_token")) & F.col("_mixed"), _signed(F.lit(W.CAPS_INCREMENT), valence))
    rows = rows.withColumn("_v", valence + F.coalesce(shout, F.lit(0.0)))
    for d in (1, 2, 3):
        rows = rows.withColumn("_v", _modified(F.col("_v"), d))
    phrases = [(r["term"], r["boost"]) for r in changing_phrases(modifiers)]
    if phrases:
        rows = _with_phrases(rows, df.sparkSession.createDataFrame(phrases, "term string, boost double"))
    rows = rows.withColumn("_v", F.when(F.col("_v").isNotNull(), _with_least(F.col("_v"))))
    at = F.col("_pos") + 1
    weight = (
        F.when((F.col("_but") == 0) | (at == F.col("_but")), 1.0)
        .when(at < F.col("_but"), W.BEFORE_BUT)
        .otherwise(W.AFTER_BUT)
    )
    score = F.coalesce(F.col("_v") * weight, F.lit(0.0))
    scored = rows.select(
        "_id", "_excl", "_quest", "_n", score.alias("_s")
    )
    per_doc = scored.groupBy("_id").agg(
        F.max("_excl").alias("_excl"),
        F.max("_quest").alias("_quest"),
        _steady_sum(F.col("_s")).alias("_sum"),
        _steady_sum(F.when(F.col("_s") > 0, F.col("_s") + 1).otherwise(F.lit(0.0))).alias("_pos"),
        _steady_sum(F.when(F.col("_s") < 0, 1 - F.col("_s")).otherwise(F.lit(0.0))).alias("_neg"),
        (F.max("_n") - F.count_if(F.col("_s") != 0)).alias("_neu"),  # all other tokens
    )
    return _summary(per_doc).withColumnRenamed("_id", id_col)


def _summary(per_doc: DataFrame) -> DataFrame:
    quest = F.col("_quest")
    emphasis = (
        F.least(F.col("_excl"), F.lit(W.MAX_EXCLAMATIONS)) * W.EXCLAMATION
        + F.when(quest <= 1, 0.0).when(quest <= 3, quest * W.QUESTION).otherwise(W.MANY_QUESTIONS)
    )
    total = F.col("_sum")
    stressed = F.when(total > 0, total + F.col("_e")).when(total < 0, total - F.col("_e"))
    out = per_doc.withColumn("_e", emphasis).withColumns(
        {
            "_x": F.coalesce(stressed, F.lit(0.0)),
            "_p": F.when(F.col("_pos") > F.col("_neg"), F.col("_pos") + F.col("_e")).otherwise(F.col("_pos")),
            "_n": F.when(F.col("_pos") < F.col("_neg"), F.col("_neg") + F.col("_e")).otherwise(F.col("_neg")),
        }
    )
    whole = F.col("_p") + F.col("_n") + F.col("_neu")

    def settled(value: Column, digits: int) -> Column:
        # The order of the additions may not decide how an exact half is rounded.
        return F.round(F.round(value, 9), digits)

    def share(c: str) -> Column:
        return settled(F.coalesce(F.try_divide(F.col(c), whole), F.lit(0.0)), 3)

    return out.select(
        "_id",
        share("_n").alias("sentiment_neg"),
        share("_neu").alias("sentiment_neu"),
        share("_p").alias("sentiment_pos"),
        settled(F.col("_x") / F.sqrt(F.col("_x") * F.col("_x") + W.COMPOUND_ALPHA), 4).alias(
            "sentiment_compound"
        ),
    )


def score_articles(
    articles: DataFrame, id_col: str, lexicon: DataFrame, modifiers: DataFrame | None = None
) -> DataFrame:
    """Articles with the scores of their descriptions; the stored description stays NULL."""
    scores = lexicon_sentiment(articles, "description", id_col, lexicon, modifiers)
    return articles.join(scores, id_col)
