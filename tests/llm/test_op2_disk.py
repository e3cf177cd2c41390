"""What is on disk when the repeats have been found."""

import random
from pathlib import Path

import pyarrow.parquet as pq

import brute
from seriesengine.llm import suffix_dedup
from seriesengine.session import shared_dir


def test_tables_that_nothing_reads_any_more_are_deleted(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choices("abcdefgh ", k=600)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(9, f"x{texts[0][:350]}y{texts[1][200:]}"), (10, None)]
    folder = Path(shared_dir(spark))
    before = set(folder.iterdir())
    found = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    held = {frozenset(pq.ParquetDataset(p).schema.names) for p in set(folder.iterdir()) - before}
    # Neither the segments of all texts nor the contexts, with their bytes, are held until the end.
    assert held and frozenset(["m", "h", "t", "lo", "hi"]) not in held and frozenset(["m", "h", "content"]) not in held
    assert sorted(map(tuple, found.collect())) == sorted(brute.repeats(rows))
