"""Items of fewer than 13 tokens, and of scripts without spaces."""

import pytest

from seriesengine.llm import decontaminate


@pytest.mark.parametrize("seeds", [1_000_000, 0])
def test_short_items(spark, monkeypatch, seeds):
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", seeds)
    zh = "\u4eca\u5929\u5929\u6c14\u5f88\u597d"
    items = [(1, "Who wrote Hamlet?"), (1, "Name it"), (2, zh), (3, "\u6211\u4eec" * 10), (4, "never here"), (None, "x-y"), (5, "?!"), (6, None)]
    docs = [
        (10, "so: who WROTE hamlet, and who wrote hamlet"), (11, "who wrote king lear; name it"), (12, f"a{zh}\u5417 b"),
        (13, "\u4ed6\u8bf4" + "\u6211\u4eec" * 10 + "\u5417"), (14, "x y"), (15, "name"), (16, ""), (17, None), (None, "name it"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.doc_token, r.item_token, r.n_equal) for r in decontaminate.benchmark_overlaps(df, bench).collect()}
    assert got == {
        (10, 1): (1, 0, 3), (11, 1): (4, 0, 2), (12, 2): (1, 0, 6), (13, 3): (2, 0, 13), (14, None): (0, 0, 2), (None, 1): (0, 0, 2)
    }
    dropped = lambda **k: sorted(r.doc_id for r in decontaminate.drop_contaminated(df, bench, **k).collect() if r.doc_id)
    assert dropped(least=1) == [15, 16, 17]
    assert dropped(least=5) == [10, 11, 14, 15, 16, 17] and dropped() == [10, 11, 12, 14, 15, 16, 17]


def test_one_common_word_does_not_empty_a_corpus(spark):
    df = spark.createDataFrame([(i, f"the text of document {i}") for i in range(20)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert decontaminate.drop_contaminated(df, bench).count() == 20
    assert decontaminate.benchmark_overlaps(df, bench).count() == 20


def test_a_long_item(spark):
    """Its tokens go to the executors once, not with each of its seeds."""
    words = [f"w{i}" for i in range(20_000)]
    df = spark.createDataFrame([(1, " ".join(words[5000:5040])), (2, "other " * 50), (3, " ".join(words))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    got = decontaminate.benchmark_overlaps(df, bench)
    assert sorted((r.doc_id, r.doc_token, r.item_token, r.n_equal) for r in got.collect()) == [(1, 0, 5000, 13), (3, 0, 0, 13)]
