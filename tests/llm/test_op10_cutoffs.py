"""Certified cutoffs and verdicts against a plain version."""

import random
from collections import defaultdict
from math import comb

import pytest
from pyspark.sql import functions as F

from seriesengine.llm import quality_rules as q


def plain_cutoffs(values, risk, error):
    """``values``: (stratum, {rule: value}) of good documents."""
    all_rules = q.rules()
    names = [r.name for r in all_rules]
    by = defaultdict(list)
    for s, v in values:
        by[s].append(v)
    share, level, out = risk / len(names), error / (len(names) * max(1, len(by))), {}
    for s, docs in by.items():
        for r in all_rules:
            n = len(docs)
            for c in r.cutoffs:
                k = sum(d[r.name] > c for d in docs)
                if k >= n * share or sum(comb(n, j) * share**j * (1 - share) ** (n - j) for j in range(k + 1)) > level:
                    break
                out[s, r.name] = c
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    rows = []
    for i in range(3000):
        words = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(300)) for _ in range(rng.randint(55, 90))]
        if i % 100 == 0:
            words = [w + "#" for w in words]
        if i % 37 == 0:
            words = words[:30] + ["\nsame line here\nsame line here\n"] + words[30:]
        rows.append((i, " ".join(words), "en" if i % 3 else None))
    return rows + [(5000, "# " * 80, "en"), (5001, None, "en"), (5002, "", None), (5003, "few words", "xx"), (None, rows[3][1], "xx")]


def test_cutoffs_and_verdicts(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(6)
    labels = spark.createDataFrame([(i, 1) for i in range(2900)] + [(5000, 0)], "doc_id long, quality int")
    held = q._with_stats(df, "text", "lang").join(labels.filter("quality = 1"), "doc_id", "left_semi").filter(~q.base_failed())
    named = [r.value.cast("double").alias(r.name) for r in q.rules()]
    names = [r.name for r in q.rules()]
    values = [(r["_stratum"], {n: r[n] for n in names}) for r in held.select("_stratum", *named).collect()]
    want = plain_cutoffs(values, 0.1, 0.1)
    got = q.certified_cutoffs(held, "_stratum", 0.1, 0.1).collect()
    assert {(r["_stratum"], r["rule"]): r["cutoff"] for r in got} == want and len(want) >= 4
    # The rules together keep the promise on the labels themselves.
    for s in {s for s, _ in values}:
        mine = [v for t, v in values if t == s]
        gone = sum(any(v[r] > c for (t, r), c in want.items() if t == s) for v in mine)
        assert gone <= 0.1 * len(mine)
    judged = {r.doc_id: r for r in q.judge_documents(df, labels, risk=0.1).collect() if r.doc_id is not None}
    stats = q._with_stats(df, "text", "lang").select("doc_id", "_stratum", q.base_failed().alias("base"), *named)
    for r in stats.filter(F.col("doc_id").isNotNull()).collect():
        broken = any(r[n] is not None and r[n] > c for (t, n), c in want.items() if t == r["_stratum"])
        assert judged[r.doc_id].base_failed == r.base and judged[r.doc_id].kept == (not r.base and not broken)
    assert not judged[5000].kept and not judged[5001].kept and judged[5002].base_failed


def test_null_key_and_stratum(spark, texts):
    df = spark.createDataFrame([t for t in texts if t[0] is None or t[0] > 2990], "doc_id long, text string, lang string")
    out = q.keep_good_documents(df, spark.createDataFrame([], "doc_id long, quality int"))
    assert out.filter("doc_id IS NULL").count() == 1 and out.columns == df.columns
