"""Sentiment rules by hand, term counts by brute force."""

import re
from collections import Counter
from math import log, sqrt

import pytest

import seriesengine as se
from seriesengine.text import words as W

LEXICON = [("good", 1.9), ("great", 3.1), ("bad", -2.5), ("happy", 2.7)]


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(LEXICON, "term string, valence double")


def compound(x):
    return round(x / sqrt(x * x + 15), 4)


CASES = [
    ("the book was good", compound(1.9)),
    ("the book was not good", compound(1.9 * -0.74)),
    ("the book wasn't good", compound(1.9 * -0.74)),
    ("very good", compound(1.9 + 0.293)),
    ("very bad", compound(-2.5 - 0.293)),
    ("very the good", compound(1.9 + 0.293 * 0.95)),
    ("very the the good", compound(1.9 + 0.293 * 0.9)),
    ("very the the the good", compound(1.9)),
    ("barely good", compound(1.9 - 0.293)),
    ("it was GOOD", compound(1.9 + 0.733)),
    ("GOOD", compound(1.9)),
    ("good!!", compound(1.9 + 2 * 0.292)),
    ("good!!!!!!", compound(1.9 + 4 * 0.292)),
    ("good? good??", compound(3.8 + 3 * 0.18)),
    ("good but bad", compound(0.95 - 3.75)),
    ("VERY good", compound(1.9 + 0.293 + 0.733)),
    ("never so good", compound(((1.9 + 0.293) * 1.25))),
    ("never was this good", compound(1.9 * 1.25)),
    ("it was never good", compound(1.9 * -0.74)),
    ("without doubt good", compound(1.9)),
    ("without a doubt good", compound(1.9)),
    ("without good", compound(1.9 * -0.74)),
    ("least good", compound(1.9 * -0.74)),
    ("at least good", compound(1.9)),
    ("kind of good", compound(1.9 - 0.293)),
    ("sort of a good book", compound(1.9 - 0.293)),
    ("just enough bad", compound(-2.5 - 0.293)),
    ("nothing here", 0.0),
    ("", 0.0),
    (None, 0.0),
]


def test_rules(spark, lexicon):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "id int, text string")
    got = {r["id"]: r for r in se.lexicon_sentiment(df, "text", "id", lexicon).collect()}
    for i, (text, want) in enumerate(CASES):
        assert got[i]["sentiment_compound"] == pytest.approx(want, abs=1e-4), text
        shares = sum(got[i][f"sentiment_{s}"] for s in ("neg", "neu", "pos"))
        assert shares == pytest.approx(1.0 if text else 0.0, abs=0.002), text


def test_known_shares(spark, lexicon):
    df = spark.createDataFrame([(1, "The book was good.")], "id int, text string")
    assert se.lexicon_sentiment(df, "text", "id", lexicon).first()[1:] == (0.0, 0.508, 0.492, 0.4404)


def test_scored_articles_keep_a_missing_description(spark, lexicon):
    df = spark.createDataFrame([(1, "t", None)], "id int, title string, description string")
    row = se.score_articles(df, "id", lexicon).first()
    assert row["description"] is None and row["sentiment_compound"] == 0.0


def test_large_word_tables_give_the_same_scores(spark, lexicon, monkeypatch):
    from seriesengine.text import sentiment

    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "id int, text string")
    modifiers = se.default_modifiers(spark)
    small = se.lexicon_sentiment(df, "text", "id", lexicon, modifiers).collect()
    monkeypatch.setattr(sentiment, "MAX_ROW_TERMS", 1)
    every_token = se.lexicon_sentiment(df, "text", "id", lexicon, modifiers)
    assert sorted(map(tuple, every_token.collect())) == sorted(map(tuple, small))
    monkeypatch.setattr(sentiment, "fits_broadcast", lambda *_: False)
    shuffled = se.lexicon_sentiment(df, "text", "id", lexicon, modifiers)
    assert sorted(map(tuple, shuffled.collect())) == sorted(map(tuple, small))


def test_lexicon_files(spark, tmp_path):
    path = tmp_path / "lexicon.txt"
    path.write_text("good\t1.9\t0.9\t[2, 2]\nBad\t-2.5\nno number\tx\n\nshort\ngood\t9.9\n")
    got = sorted(map(tuple, se.read_lexicon(spark, str(path)).collect()))
    assert got == [("bad", -2.5), ("good", 1.9)]


def test_distribution_order(spark):
    df = spark.createDataFrame([(0.1,), (-0.1,), (None,), (float("nan"),)], "sentiment_compound double")
    got = [tuple(r) for r in se.sentiment_distribution(df).collect()]
    assert got == [("Neutral", 2), ("Positive", 1), ("Negative", 1)]


def test_over_time_needs_a_time(spark):
    df = spark.createDataFrame([(None, "t", 0.1)], "published_at timestamp, title string, sentiment_compound double")
    with pytest.raises(ValueError):
        se.sentiment_over_time(df)


TEXTS = [
    "Copper prices rise. Copper price rises again, says John's bank 2024",
    "COPPER price; the banks and the bank of été, été! glass glasses",
    None,
    "New York traders: new york Trader new york",
]


def brute_words(text):
    found = re.findall(r"[^\W][\w']*", text)
    found = [w[:-2] if w.lower().endswith("'s") else w for w in found]
    return [w for w in found if not w.isdigit()]


def brute_counts(items):
    spelled = {}
    for w in items:
        spelled.setdefault(w.lower(), Counter())[w] += 1
    for low in list(spelled):
        if low.endswith("s") and not low.endswith("ss") and low[:-1] in spelled:
            for w, n in spelled.pop(low).items():
                spelled[low[:-1]][w[:-1]] += n
    best = {t: min(c.items(), key=lambda i: (-i[1], i[0]))[0] for t, c in spelled.items()}
    return {t: (best[t], sum(c.values())) for t, c in spelled.items()}


def is_word(w):
    return w.lower() not in W.STOPWORDS


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(t,) for t in TEXTS], "text string")


def test_term_counts(texts):
    words = [w for t in TEXTS if t for w in brute_words(t) if is_word(w)]
    got = {r["term"]: (r["word"], r["n"]) for r in se.term_counts(texts, "text").collect()}
    assert got == brute_counts(words)
    assert got["price"][1] == 3 and got["glass"][1] == 1 and got["été"][1] == 2


def test_term_frequency_is_relative_to_the_first(texts):
    rows = se.term_frequency(texts, "text", k=3).orderBy("term").collect()
    assert len(rows) == 3 and max(r["rel"] for r in rows) == 1.0


def brute_llr(pairs, words):
    total = sum(n for _, n in words.values())
    out = {}
    for pair, (word, n) in pairs.items():
        c = []
        for half in pair.split(" "):
            base = half if half in words else half[:-1]
            c.append((base, words[base][1]))
        (a, c1), (b, c2) = c
        def ll(k, m, p):
            return log(max(p, 1e-10)) * k + log(max(1 - p, 1e-10)) * (m - k)
        p, p1, p2 = c2 / total, n / c1, (c2 - n) / (total - c1)
        score = ll(n, c1, p) + ll(c2 - n, total - c1, p) - ll(n, c1, p1) - ll(c2 - n, total - c1, p2)
        out[pair] = (word, n, a, b, round(-2 * score, 6))
    return out


@pytest.mark.parametrize("threshold", [0.0, 0.5, 5.0])
def test_bigrams(texts, threshold):
    listed = [brute_words(t) for t in TEXTS if t]
    words = brute_counts([w for ws in listed for w in ws if is_word(w)])
    pairs = brute_counts(
        [f"{a} {b}" for ws in listed for a, b in zip(ws, ws[1:]) if is_word(a) and is_word(b)]
    )
    got = {
        r["bigram"]: (r["word"], r["n"], r["first_term"], r["second_term"], round(r["llr"], 6))
        for r in se.bigram_llr(texts, "text", threshold=threshold).collect()
    }
    assert got == {k: v for k, v in brute_llr(pairs, words).items() if v[-1] > threshold} and got
    assert got["new york"][1] == 3

    cloud = {r["term"]: r["n"] for r in se.word_cloud(texts, "text", threshold=threshold).collect()}
    left = Counter({t: n for t, (_, n) in words.items()})
    for _, n, a, b, _ in got.values():
        left.subtract({a: n})
        left.subtract({b: n})
    want = {t: n for t, n in left.items() if n > 0} | {k: v[1] for k, v in got.items()}
    assert cloud == want


def test_the_bound_of_the_ratio_holds(spark):
    """At the ends of the second word's count the ratio is largest."""
    import random

    from seriesengine.text.terms import _ratio
    from pyspark.sql import functions as F

    rng = random.Random(4)
    rows = []
    for _ in range(3000):
        total = rng.choice([50, 1000, 10**6, 10**9])
        most = rng.randint(2, total // 2)
        k = rng.randint(1, min(most, rng.choice([1, 3, 50])))
        rows.append((float(k), float(rng.randint(k, most)), float(rng.randint(k, most)), float(most), float(total)))
    df = spark.createDataFrame(rows, "k double, c1 double, c2 double, most double, total double")
    k, c1, c2, most, total = (F.col(c) for c in df.columns)
    highest = F.greatest(_ratio(k, c1, k, total), _ratio(k, c1, most, total))
    assert df.where(_ratio(k, c1, c2, total) > highest * (1 + 1e-9) + 1e-6).isEmpty()


SPELLED = (
    "Cats chase Mice and CATS chase mice; cat's Cat catS naps", "Zurich Glass glass buses Bus BUS's",
    "ΣΊΣΥΦΟΣ rolls Stones rolls STONES", "New York's New york new YORKS", "s S ss Ss class CLASSES",
)


@pytest.mark.parametrize("frequent", [0, 3, 100_000])
def test_spellings_and_rare_words(spark, monkeypatch, frequent):
    """Words are named, and pairs scored, alike whether their words' counts are broadcast or not."""
    from seriesengine.text import terms

    monkeypatch.setattr(terms, "LOOKED_UP", frequent, raising=False)
    df = spark.createDataFrame([(t,) for t in SPELLED * 3], "text string")
    listed = [brute_words(t) for t in SPELLED * 3]
    words = brute_counts([w for ws in listed for w in ws if is_word(w)])
    pairs = brute_counts([f"{a} {b}" for ws in listed for a, b in zip(ws, ws[1:]) if is_word(a) and is_word(b)])
    assert {r["term"]: (r["word"], r["n"]) for r in se.term_counts(df, "text").collect()} == words
    got = {
        r["bigram"]: (r["word"], r["n"], r["first_term"], r["second_term"], round(r["llr"], 6))
        for r in se.bigram_llr(df, "text", threshold=0.5).collect()
    }
    assert got == {k: v for k, v in brute_llr(pairs, words).items() if v[-1] > 0.5} and got


def test_counts_are_shuffled_once(spark):
    """Terms are counted in one shuffle; spellings without capitals are not written besides."""
    from pyspark.sql import functions as F

    from seriesengine.text import terms

    df = spark.createDataFrame([("plain words stand here Paris",)], "text string")
    counted = terms._counted(terms.words_and_bigrams(df, "text"))
    assert counted.where(F.col("kind") % 2 == 1).count() == 1  # the word Paris; no pair has it, as "here" is no term
    plan = terms._terms(counted)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PartitionFilters: [isnotnull(kind" in plan
