"""Near-duplicate groups whose pairs lie around the threshold, against all pairs."""

import random

import brute
import pytest

from seriesengine.llm import minhash

rng = random.Random(77)
WORDS = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 7))) for _ in range(3000)]


def edited(words, edits):
    w = list(words)
    for _ in range(edits):
        i, kind = rng.randrange(len(w)), rng.random()
        if kind < 0.5:
            w[i] = rng.choice(WORDS)
        elif kind < 0.75 and len(w) > 10:
            del w[i]
        else:
            w.insert(i, rng.choice(WORDS))
    return w


def group(size, length, edits, chains=0.3):
    """Copies of a text, and copies of copies."""
    texts = [[rng.choice(WORDS) for _ in range(length)]]
    while len(texts) < size:
        base = rng.choice(texts) if rng.random() < chains else texts[0]
        texts.append(edited(base, rng.randint(0, edits)))
    return [" ".join(t) for t in texts]


def compare(spark, rows, n_words, percent):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = sorted(map(tuple, minhash.near_duplicates(df, n_words=n_words, percent=percent).collect()))
    assert got == brute.near(rows, n_words, percent)


@pytest.mark.parametrize(("n_words", "percent"), [(5, 80), (3, 85)])
def test_a_large_group_around_the_threshold(spark, n_words, percent):
    texts = group(450, 150, 6)
    compare(spark, list(enumerate(texts)), n_words, percent)


@pytest.mark.parametrize(("n_words", "percent"), [(5, 80), (3, 85), (1, 60)])
def test_many_groups_of_different_lengths(spark, n_words, percent):
    texts = []
    for size, length, edits in [(60, 30, 3), (60, 80, 5), (60, 400, 25), (90, 20, 2), (5, 1000, 60), (40, 60, 40), (60, 12, 1)]:
        texts += group(size, length, edits, 0.6)
    texts += texts[:40] + ["common start of a line " + t for t in group(100, 60, 70)]
    rng.shuffle(texts)
    compare(spark, list(enumerate(texts)), n_words, percent)


def test_very_long_and_awkward_texts(spark):
    long = [rng.choice(WORDS) for _ in range(900_000)]  # over 4 MB
    rows = [(1, " ".join(long)), (2, " ".join(edited(long, 20_000))), (3, " ".join(edited(long, 200_000)))]
    rows += [(4, None), (5, ""), (6, "a b"), (7, "A  B"), (8, "a b c"), (9, "x " * 500_000), (10, "X " * 400_000)]
    compare(spark, rows, 5, 80)
    df = spark.createDataFrame([(None, "a b c d e f"), (None, None), (3, "a b c d e f"), (3, "q")], "doc_id long, text string")
    got = minhash.near_duplicates(df).collect()
    assert sorted(map(str, got)) == sorted(
        ["Row(doc_id=None, n_shingles=2, component_id=3, kept=False)", "Row(doc_id=None, n_shingles=0, component_id=None, kept=True)",
         "Row(doc_id=3, n_shingles=2, component_id=3, kept=True)", "Row(doc_id=3, n_shingles=1, component_id=3, kept=True)"]
    )
