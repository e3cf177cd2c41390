"""Item ids that are null or stand on several texts, on both paths."""

import random

import pytest

from seriesengine.llm import decontaminate


def _text(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


@pytest.mark.parametrize("seeds", [1_000_000, 0])
def test_repeated_and_null_item_ids(spark, monkeypatch, seeds):
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", seeds)
    rng = random.Random(2)
    texts = [_text(rng, 20) for _ in range(6)]
    items = list(zip([1, 1, 1, 2, None, None], texts, strict=True))
    docs = [(10 + i, f"{_text(rng, 5)} {t} {_text(rng, 5)}") for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    got = [tuple(r)[:1] + tuple(r)[2:] for r in decontaminate.benchmark_overlaps(df, bench).collect()]
    assert sorted(got, key=str) == [(10 + i, x, 5, 0, 13) for i, (x, _) in enumerate(items)]
    assert decontaminate.drop_contaminated(df, bench).count() == 0
