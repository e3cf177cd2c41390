"""One document of each group stays, whatever the keys."""

import random

from seriesengine.llm import minhash


def test_null_and_repeated_keys(spark):
    rng = random.Random(8)
    bases = [[f"w{rng.randrange(10**6)}" for _ in range(200)] for _ in range(4)]
    near = lambda w, i: " ".join([*w[:i], "other", *w[i + 1 :]])
    a, b, c, d = (" ".join(w) for w in bases)
    rows = [
        (1, a), (None, near(bases[0], 3)), (None, a),  # near copies of a keyed document
        (2, b), (2, near(bases[1], 0)), (2, near(bases[1], 199)),  # one key, near texts
        (None, c), (None, near(bases[2], 9)), (None, c),  # no key at all
        (2, d), (3, near(bases[3], 50)),  # a keeper's key on another group
        (None, None), (None, ""),
    ]
    out = minhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    groups = {w[100]: g for g, w in enumerate(bases)}
    kept = sorted((next(groups[x] for x in r.text.split() if x in groups), r.doc_id) for r in out if r.text)
    assert kept == [(0, 1), (1, 2), (2, None), (3, 2)] and len(out) == 6
