"""Toxicity scores: features by hand, a planted language, held-out accuracy, awkward rows."""

import random
import zlib

import pytest

from seriesengine.llm import queries, toxicity

SF = "/root/testdata/sf0.1"


def test_features():
    lexicon = toxicity.Lexicon(frozenset(["idiot"]), {"zork": 3.0}, {"blarg": 2.0})
    x = dict(zip(toxicity.FEATURES, toxicity.features("You IDIOT! You zork. Blargish zorks, id10t!! sooo z0rk?", lexicon.rated()), strict=True))
    # Words: you idiot you zork blargish zorks id t sooo z rk.
    n = 11
    assert x["given_density"] == 1 / n and x["learned_density"] == 1 / n and x["learned_strongest"] == 3.0
    assert x["stem_density"] == 1 / n and x["stem_weight"] == 2 / n and x["second_person_density"] == 2 / n
    assert x["addressed_density"] == 2 / n and x["exclamations"] == 3 / n and x["questions"] == 1 / n
    assert x["repeated_marks"] == 1 / n and x["obfuscated_density"] == 2 / n and x["obfuscated_hits"] == 2 / n
    assert x["stretched_density"] == 1 / n and x["capital_words"] == 1 / n
    assert toxicity.features(None, lexicon.rated()) == toxicity.features("12 !", lexicon.rated()) == [0.0] * len(toxicity.FEATURES)


def test_lexicon_is_learned_from_texts_that_are_not_copies(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcde") for _ in range(5))
    clean = [(" ".join(word() for _ in range(30)), 0) for _ in range(300)]
    toxic = [(" ".join([*(word() for _ in range(30)), rng.choice(["zorkish", "zorkly", "zorkeur"]), "grunt"]), 1) for _ in range(40)]
    rows = clean + toxic + [("only copies of onetext", 1)] * 50
    got = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, y int"))
    assert {"grunt", "zorkish", "zorkly", "zorkeur"} <= set(got.words) and "zork" in got.stems and "onetext" not in got.words
    assert len(got.words) < 8
    none = toxicity.learn_lexicon(spark.createDataFrame(clean, "text string, y int"))
    assert not none.words and none.given == frozenset(toxicity.INSULTS)


def test_awkward_rows(spark):
    rng = random.Random(2)
    insults = ["moron", "scum", "zorkish"]
    rows = []
    for i in range(600):
        w = [rng.choice("the and of with from that this".split()) for _ in range(40)]
        if i % 5 == 0:
            w[3], w[20] = rng.choice(insults), rng.choice(insults)
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(None, 1, 0), (3, None, 0), (5, 1, 0)], "doc_id long, toxic int, quality int")
    odd = [(700, None), (701, ""), (702, "\n"), (703, "the and " * 600_000), (None, "you scum moron"), (10, rows[10][1]), (704, "of zorkish " * 9)]
    df = spark.createDataFrame([(i, t, "c", 0.5, 1) for i, t in [(i, t) for i, t, _ in rows] + odd], "doc_id long, text string, x string, score double, y int")
    got = toxicity.score_toxicity(df, labels, trees=8, depth=3).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    by = {r.doc_id: r.predicted for r in got}
    assert sum(by[i] == y for i, _, y in rows) >= 0.98 * len(rows)
    assert [by[k] for k in (700, 701, 702, 703, None, 704)] == [0, 0, 0, 0, 1, 1]
    # Labels are never an input: turned round on held-out rows, the scores stay.
    turned = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score_toxicity(df, turned, trees=8, depth=3).collect()}
    assert again == pytest.approx({r.doc_id: r.score for r in got}, abs=1e-9)
    assert toxicity.score_toxicity(df.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.score_toxicity(df, labels.limit(0)).collect()} == {0.5}
    clean = toxicity.score_toxicity(df, labels.filter("toxic = 0")).collect()
    assert {(r.score, r.predicted) for r in clean} == {(0.0, 0)}


def test_held_out_accuracy(spark):
    from seriesengine.llm.common import table

    truth = table(spark, SF, "labels").select("doc_id", "toxic")
    got = queries.op11_toxicity(spark, SF).join(truth, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.95 * len(got)
    assert sum(r.predicted for r in got if r.toxic) >= 0.75 * sum(r.toxic for r in got)
