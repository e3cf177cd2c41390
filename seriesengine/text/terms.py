"""Term and bigram frequencies behind a word cloud: T4, T5, A9, O3.

Words and their neighbours are formed inside each document's row; what is shuffled
is counts that were already combined per task. A term's count and how it is spelled are
one row, and only spellings with capitals have rows besides: the rest is the term itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesengine.session import materialize
from seriesengine.text import words as W
from seriesengine.text.sentiment import words_of

#: Most frequent words whose counts are broadcast to the pairs; the others are joined by shuffle.
LOOKED_UP = 100_000
#: Kinds of counts; those of pairs are higher by 2.
_TERM, _SPELLING, _OF_PAIRS = 0, 1, 2


def _clean_words(text: Column) -> Column:
    """Words without a closing 's and without plain numbers."""
    def bare_word(t: Column) -> Column:
        return F.when(t.endswith("'s") | t.endswith("'S"), F.substring(t, F.lit(1), F.length(t) - 2)).otherwise(t)

    bare = F.transform(words_of(text), bare_word)
    return F.filter(bare, lambda t: ~t.rlike(r"^\p{Nd}+$"))


def _not_stopword(c: str, stopwords: Sequence[str]) -> Column:
    return ~F.lower(c).isin(*[s.lower() for s in stopwords])


def content_words(df: DataFrame, col: str, stopwords: Sequence[str] = W.STOPWORDS) -> DataFrame:
    """One row per counted word; missing text is skipped."""
    kept = df.where(F.col(col).isNotNull())
    found = kept.select(F.explode(_clean_words(F.col(col))).alias("word"))
    return found.where(_not_stopword("word", stopwords))


def words_and_bigrams(
    df: DataFrame, col: str, stopwords: Sequence[str] = W.STOPWORDS
) -> DataFrame:
    """(kind, spelling) of every counted word, and every pair of neighbours of a document without a
    stopword.

    One row each, from one pass over the text; a pair is its words with a space between.
    """
    listed = df.where(F.col(col).isNotNull()).select(_clean_words(F.col(col)).alias("_w"))
    following = F.slice("_w", F.lit(2), F.size("_w"))
    pairs = F.zip_with(
        "_w", following, lambda a, b: F.struct(a.alias("first"), b.alias("second"))
    )
    rows = listed.select(F.inline(pairs)).where(_not_stopword("first", stopwords))
    both = F.when(
        _not_stopword("second", stopwords), F.concat_ws(" ", "first", "second")
    )
    found = rows.select(F.posexplode(F.array("first", both)).alias("at", "spelling")).where("spelling is not null")
    return found.select((F.col("at") * _OF_PAIRS).alias("kind"), "spelling")


def _chop(c: Column) -> Column:
    return F.substring(c, F.lit(1), F.length(c) - 1)


def _is_plural(low: Column) -> Column:
    return low.endswith("s") & ~low.endswith("ss") & (low != "s")


def _base(spelling: Column) -> Column:
    """The term without its plural: one ending in a single s shares its base with the term without it,
    so the group of a base itself shows whether the singular exists: no self-join."""
    low = F.lower(spelling)
    return F.when(_is_plural(low), _chop(low)).otherwise(low)


def _counted(found: DataFrame) -> DataFrame:
    """(kind, key, n, has_singular, plain) from (kind, spelling), written once, a folder for each kind.

    Kind _TERM counts a base, plurals and all spellings together; ``plain`` says that all are in lower
    case. Kind _SPELLING counts each spelling that is not. So one shuffle settles the terms, and
    spellings that follow from the term are not carried.
    """
    low = F.col("low")
    told = found.withColumn("low", F.lower("spelling")).select(
        "kind", "spelling", F.when(_is_plural(low), _chop(low)).otherwise(low).alias("key"),
        (~_is_plural(low)).alias("single"), (F.col("spelling") == low).alias("plain"),
    )
    rows = told.select(F.inline(F.array(
        F.struct((F.col("kind") + _TERM).alias("kind"), "key", "single", "plain"),
        F.when(~F.col("plain"), F.struct(
            (F.col("kind") + _SPELLING).alias("kind"), F.col("spelling").alias("key"),
            F.lit(None).cast("boolean").alias("single"), F.lit(None).cast("boolean").alias("plain"),
        )),
    ))).where("key is not null")
    counts = rows.groupBy("kind", "key").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or("single").alias("has_singular"), F.bool_and("plain").alias("plain")
    )
    return materialize(counts, "kind")


def _terms(counted: DataFrame, kind: int = 0) -> DataFrame:
    """(base, n, has_singular, plain): counts with plurals folded into present singulars."""
    return counted.where(F.col("kind") == kind + _TERM).select(F.col("key").alias("base"), "n", "has_singular", "plain")


def _cased(counted: DataFrame, kind: int = 0) -> DataFrame:
    """(base, spelling, m) of the spellings that are not all lower case."""
    key = F.col("key")
    return counted.where(F.col("kind") == kind + _SPELLING).select(_base(key).alias("base"), key.alias("spelling"), F.col("n").alias("m"))


def _term() -> Column:
    base = F.col("base")
    return F.when(F.col("has_singular"), base).otherwise(F.concat(base, F.lit("s")))


def _with_word(chosen: DataFrame, cased: DataFrame, total: str = "n") -> DataFrame:
    """Add ``word``, the most frequent spelling, to the chosen bases only.

    What is left of a base's count (``total``) is spelled as the term.
    """
    mixed = chosen.where(~F.col("plain")).select("base", "has_singular", F.col(total).alias("total"))
    plural = _is_plural(F.lower("spelling"))
    form = F.when(F.col("has_singular") & plural, _chop(F.col("spelling"))).otherwise(F.col("spelling"))
    found = cased.join(mixed, "base").select(
        "base", F.inline(F.array(F.struct(form.alias("word"), F.col("m").alias("m")), F.struct(_term().alias("word"), (-F.col("m")).alias("m"))))
    )
    forms = found.union(mixed.select("base", _term(), "total")).groupBy("base", "word").agg(F.sum("m").alias("m"))
    first = Window.partitionBy("base").orderBy(F.desc("m"), "word")
    best = forms.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    return chosen.join(best.select("base", "word"), "base", "left").withColumn("word", F.coalesce("word", _term()))


def _by_surface(bases: DataFrame) -> DataFrame:
    """(form, base, has_singular, total) for every lower-case form that counts for a base."""
    base = F.col("base")
    plural = F.concat(base, F.lit("s"))
    forms = (
        F.when(~F.col("has_singular"), F.array(plural))
        .when(base.endswith("s"), F.array(base))
        .otherwise(F.array(base, plural))
    )
    return bases.select(
        F.explode(forms).alias("form"), "base", "has_singular", F.col("n").alias("total")
    )


def _as_found(words: DataFrame) -> DataFrame:
    return words.select(F.lit(0).alias("kind"), F.col("word").alias("spelling"))


def term_counts(df: DataFrame, col: str, stopwords: Sequence[str] = W.STOPWORDS) -> DataFrame:
    """(term, word, n): lower-case term, its most frequent spelling, its count."""
    counted = _counted(_as_found(content_words(df, col, stopwords)))
    return _with_word(_terms(counted), _cased(counted)).select(_term().alias("term"), "word", "n")


def _top(counts: DataFrame, k: int) -> DataFrame:
    """O3: the k most frequent, with counts relative to the first."""
    best = counts.orderBy(F.desc("n"), "term").limit(k)
    # At most k rows are left for this window.
    most = F.max("n").over(Window.partitionBy())
    return best.withColumn("rel", F.col("n") / most)


def term_frequency(
    df: DataFrame, col: str, stopwords: Sequence[str] = W.STOPWORDS, k: int = W.TOP_TERMS
) -> DataFrame:
    """T4: the k most frequent words of all texts, without their bigrams."""
    counted = _counted(_as_found(content_words(df, col, stopwords)))
    best = materialize(_top(_terms(counted).withColumn("term", _term()), k))
    return _with_word(best, _cased(counted)).select("term", "word", "n", "rel")


def _log_likelihood(k: Column, n: Column, p: Column) -> Column:
    low = F.lit(1e-10)
    return F.log(F.greatest(p, low)) * k + F.log(F.greatest(1 - p, low)) * (n - k)


def _ratio(c12: Column, c1: Column, c2: Column, total: Column) -> Column:
    """Dunning's log-likelihood ratio of a pair counted ``c12`` times, of words counted c1 and c2 times."""
    p, p1 = c2 / total, c12 / c1
    p2 = F.try_divide(c2 - c12, total - c1)
    score = (
        _log_likelihood(c12, c1, p) + _log_likelihood(c2 - c12, total - c1, p)
        - _log_likelihood(c12, c1, p1) - _log_likelihood(c2 - c12, total - c1, p2)
    )
    return F.when((total > c1) & (total > c2), -2 * score).otherwise(F.lit(0.0))


def _frequent(surface: DataFrame) -> DataFrame:
    """The most frequent forms, LOOKED_UP at most."""
    size = F.floor(F.log2("total") * 8)
    steps = surface.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("forms")).orderBy(F.desc("size"))
    held = 0
    for step in steps.collect():  # a few hundred
        held += step["forms"]
        if held > LOOKED_UP:
            return surface.where(size > step["size"])
    return surface


def _scored_pairs(pairs: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """(base, has_singular, plain, n, first_*, second_*, llr) of the pairs above the threshold.

    The counts of frequent words are broadcast, so that most pairs are decided where they are; only
    pairs with a rarer word are moved to it. Of those many cannot reach the threshold: with the pair's
    and the first word's counts fixed, the ratio falls with the second word's
    count c2 until the words are independent, and rises from there (its slope is that of
    logit((c2 - n) / (N - c1)) over logit(c2 / N)). So it is largest at one end: c2 = n, or the
    count of the most frequent word. Pairs that miss the threshold at both ends go before their
    second word is looked up.
    """
    surface = _by_surface(words)
    known = words.agg(F.sum("n").cast("double").alias("all"), F.max("n").cast("double").alias("most")).first()
    total = F.lit(known["all"] or 0.0)
    frequent = _frequent(surface)

    def side(forms: DataFrame, name: str) -> DataFrame:
        return forms.select(
            F.col("form").alias(f"_{name}"), F.col("base").alias(f"{name}_base"),
            F.col("has_singular").alias(f"{name}_has_singular"),
            F.col("total").cast("double").alias(f"_{name}_n"),
        )

    # The term of a pair ends in the surface form of its second word.
    halves = F.split(_term(), " ")
    c12, c1, c2 = F.col("n").cast("double"), F.col("_first_n"), F.col("_second_n")
    ratio = _ratio(c12, c1, c2, total)

    begun = pairs.withColumns({"_first": halves[0], "_second": halves[1]})
    for name in ("first", "second"):
        begun = begun.join(F.broadcast(side(frequent, name)), f"_{name}", "left")
    # One ratio only: a longer condition would not be compiled.
    looked = materialize(begun.where(c1.isNull() | c2.isNull() | (ratio > threshold)))
    both = c1.isNotNull() & c2.isNotNull()
    decided = looked.where(both).withColumn("llr", ratio)
    rest = looked.where(~both).select(*pairs.columns, "_first", "_second")
    # Forms are unique, so these sides hash evenly; hashing them spares sorting the pairs.
    rest = rest.join(side(surface, "first").hint("shuffle_hash"), "_first")
    if threshold >= 0:
        most = F.greatest(F.lit(known["most"] or 0.0), c12)
        highest = F.greatest(_ratio(c12, c1, c12, total), _ratio(c12, c1, most, total))
        rest = rest.where(highest > threshold - 1e-6)  # a margin for rounding
    rest = rest.join(side(surface, "second").hint("shuffle_hash"), "_second").withColumn("llr", ratio)
    return decided.unionByName(rest).where(F.col("llr") > threshold)


def _named(name: str) -> Column:
    base = F.col(f"{name}_base")
    return F.when(F.col(f"{name}_has_singular"), base).otherwise(F.concat(base, F.lit("s"))).alias(
        f"{name}_term"
    )


def bigram_llr(
    df: DataFrame, col: str, stopwords: Sequence[str] = W.STOPWORDS,
    threshold: float = W.LLR_THRESHOLD,
) -> DataFrame:
    """T5: word pairs whose Dunning log-likelihood ratio exceeds ``threshold``.

    Returns (bigram, word, n, first_term, second_term, llr): the lower-case pair, its
    most frequent spelling, its count and the counted terms it consists of. Pairs do
    not cross document borders. Spellings are looked up for the pairs that remain.
    """
    counted = _counted(words_and_bigrams(df, col, stopwords))
    kept = materialize(_scored_pairs(_terms(counted, _OF_PAIRS), _terms(counted), threshold))
    return _with_word(kept, _cased(counted, _OF_PAIRS)).select(
        _term().alias("bigram"), "word", "n", _named("first"), _named("second"), "llr"
    )


def word_cloud(
    df: DataFrame, col: str, stopwords: Sequence[str] = W.STOPWORDS, k: int = W.TOP_TERMS,
    threshold: float = W.LLR_THRESHOLD,
) -> DataFrame:
    """T4 + T5: words and collocations together, (term, word, n, rel), the k most frequent.

    The count of a collocation is taken off both of its words; what falls to zero goes.
    """
    counted = _counted(words_and_bigrams(df, col, stopwords))
    words = _terms(counted)
    # The pairs are read twice, once for what they take off and once for themselves.
    pairs = materialize(
        _scored_pairs(_terms(counted, _OF_PAIRS), words, threshold).select(
            "base", "n", "has_singular", "plain", "first_base", "second_base"
        )
    )
    taken = pairs.select(
        F.explode(F.array("first_base", "second_base")).alias("base"),
        (-F.col("n")).alias("n"), F.lit(None).cast("boolean").alias("has_singular"),
        F.lit(None).cast("boolean").alias("plain"), F.lit(0).cast("long").alias("total"),
    )
    left = (
        words.withColumn("total", F.col("n"))
        .unionByName(taken)
        .groupBy("base")
        .agg(
            F.sum("n").alias("n"), F.bool_or("has_singular").alias("has_singular"),
            F.bool_and("plain").alias("plain"), F.sum("total").alias("total"),
        )
        .where(F.col("n") > 0)
    )
    both = left.withColumn("pair", F.lit(False)).unionByName(
        pairs.select("base", "n", "has_singular", "plain", F.col("n").alias("total"), F.lit(True).alias("pair"))
    )
    best = materialize(_top(both.withColumn("term", _term()), k))
    return (
        _with_word(best.where(~F.col("pair")), _cased(counted), "total")
        .unionByName(_with_word(best.where("pair"), _cased(counted, _OF_PAIRS), "total"))
        .select("term", "word", "n", "rel")
    )
