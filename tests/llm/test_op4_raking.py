"""Raking runs until the targets are met, and says what is left where they contradict one another."""

import random

import pytest
from pyspark.sql import functions as F

from seriesengine.llm import mixing


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):  # languages hang together with sources, so raking takes many rounds
        s = rng.randrange(4)
        lang = s if rng.random() < 0.97 else rng.randrange(4)
        rows.append((i, "w " * rng.choice([5, 60, 400]), f"s{s}", f"l{lang}"))
    return _docs(spark, rows)


def test_shares_are_met(skewed):
    got = mixing.mix_documents(skewed).toPandas()
    for by in ("source", "lang", "topic"):
        expected = (got.n_tokens * got.probability).groupby(got[by]).sum()
        target = got.groupby(by).n_tokens.sum() ** 0.85
        assert abs(expected / expected.sum() / (target / target.sum()) - 1).max() < 1e-5
        assert got[f"{by}_error"].max() < 1e-5


def test_targets_that_contradict_are_told(spark):
    rows = [(i, "w " * (10 + 90 * (i % 3)), f"s{i % 3}", f"l{min(i % 3, 1)}") for i in range(60)]
    got = mixing.mix_documents(_docs(spark, rows)).toPandas()
    assert got.source_error.max() > 0.01 and got.topic_error.max() < 1e-9


def test_cells_in_spark_are_raked_alike(spark, monkeypatch):
    rows = [("a", "x", 10), ("a", "y", 30), ("b", "x", 40), ("b", "y", 20)]
    cells = spark.createDataFrame(rows, "s string, l string, tokens long")
    targets = {d: mixing.tempered(cells, d, 0.5) for d in ("s", "l")}
    here = {(r.s, r.l): r.weight for r in mixing.rake(cells, targets).collect()}
    monkeypatch.setattr(mixing, "SMALL_CELLS", 0)
    there = mixing.rake(cells, targets)
    assert {(r.s, r.l): pytest.approx(r.weight, abs=1e-9) for r in there.collect()} == here
    assert max(mixing.raking_errors(there, targets).values()) <= 1e-6
    assert there.agg(F.sum("weight")).first()[0] == pytest.approx(1.0)


def test_null_categories_are_raked_alike_in_both_ways(spark, monkeypatch):
    rows = [(None, "x", 10), (None, "y", 30), ("b", "x", 40), ("b", "y", 20)]
    cells = spark.createDataFrame(rows, "s string, l string, tokens long")
    targets = {
        "s": spark.createDataFrame([(None, 0.7), ("b", 0.3)], "s string, target double"),
        "l": spark.createDataFrame([("x", 0.5), ("y", 0.5)], "l string, target double"),
    }
    here = {(r.s, r.l): r.weight for r in mixing.rake(cells, targets).collect()}
    monkeypatch.setattr(mixing, "SMALL_CELLS", 0)
    there = {(r.s, r.l): r.weight for r in mixing.rake(cells, targets).collect()}
    assert there == pytest.approx(here, abs=1e-6) and here[None, "x"] + here[None, "y"] == pytest.approx(0.7)


def plain_rake(cells, goals, budget):
    """Raking with bounds over a dict {categories: tokens}."""
    total = sum(cells.values())
    w = {c: t / total for c, t in cells.items()}
    most = {c: t / total / budget for c, t in cells.items()}
    for _ in range(5000):
        for i, goal in enumerate(goals):
            sums = {}
            for c, x in w.items():
                sums[c[i]] = sums.get(c[i], 0) + x
            w = {c: min(x * goal[c[i]] / sums[c[i]], most[c]) for c, x in w.items()}
    return w


@pytest.mark.parametrize("small", [1_000_000, 0])
def test_bounded_raking_against_a_plain_version(spark, monkeypatch, small):
    monkeypatch.setattr(mixing, "SMALL_CELLS", small)
    cells = {("a", "x"): 10, ("a", "y"): 300, ("b", "x"): 400, ("b", "y"): 200, ("c", "x"): 90}
    goals = ({"a": 0.3, "b": 0.55, "c": 0.15}, {"x": 0.5, "y": 0.5})
    df = spark.createDataFrame([(*k, t) for k, t in cells.items()], "s string, l string, tokens long")
    frames = {d: spark.createDataFrame(list(g.items()), f"{d} string, target double") for d, g in zip("sl", goals, strict=True)}
    got = {(r.s, r.l): r.weight for r in mixing.rake(df, frames, 1e-9, budget=0.5).collect()}
    assert got == pytest.approx(plain_rake(cells, goals, 0.5), abs=1e-6)
    assert all(got[c] * 0.5 * 1000 <= t * (1 + 1e-9) for c, t in cells.items())


def test_a_rare_document_does_not_set_the_rate(spark):
    rows = [(i, "w " * 100, f"s{i % 3}", f"l{i % 2}") for i in range(600)]
    plain = mixing.mix_documents(_docs(spark, rows)).toPandas()
    rare = mixing.mix_documents(_docs(spark, [*rows, (9999, "w " * 10, "new", "lnew")])).toPandas()
    share = lambda d: (d.n_tokens * d.probability).sum() / d.n_tokens.sum()
    assert share(plain) == pytest.approx(0.5, abs=1e-6) and share(rare) == pytest.approx(0.5, abs=0.01)
    assert rare[rare.doc_id == 9999].probability.iloc[0] == pytest.approx(1.0) and rare.source_error.max() > 0.1
    whole = mixing.mix_documents(_docs(spark, rows), budget=1.0).toPandas()
    assert whole.probability.min() == pytest.approx(1.0)
