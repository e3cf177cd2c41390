"""Periodic runs against a plain version, with the awkward rows named in the docstring."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from seriesengine.llm import queries
from seriesengine.llm.periodic_runs import find_runs, periodic_runs

SF = "/root/testdata/sf0.001"


def plain(w, least=12):
    n, best = len(w), {}
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                best.setdefault((i - q, j - i + q), q)
            i = j
    return sorted(((s, m, p) for (s, m), p in best.items()), key=lambda x: (x[0], x[2]))


def collapsed(w, runs):
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("seed", range(4))
def test_find_runs(seed):
    rng = random.Random(seed)
    for t in range(400):
        n = rng.randrange(120) if t % 20 else rng.randrange(700)
        kinds = rng.choice([1, 2, 2, 3, 5, 50])
        w = [rng.randrange(kinds) for _ in range(n)]
        if n and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randrange(1, max(2, n // 2))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            for _ in range(rng.randrange(3)):
                w[rng.randrange(n)] = rng.randrange(kinds)
        least = rng.choice([12, 12, 5, 2, 13])
        assert [tuple(x) for x in find_runs(np.array(w, np.int64), least).tolist()] == plain(w, least)


def test_words_repeated_throughout_stay_cheap():
    assert find_runs(np.zeros(300_000, np.int64)).tolist() == [[0, 300_000, 1]]
    blocks = ([0] * 300 + [1]) * 200
    found = find_runs(np.array(blocks))
    assert [0, len(blocks), 301] in found.tolist() and len(found) == 201


def test_awkward_rows(spark):
    long = " ".join(f"w{i % 70_001}" for i in range(600_000))  # over 4 MB
    texts = [None, "", " \n\t", "one", "x " * 12, "x " * 11, "é ß " * 40, "a\x0bb\x0ca b a b a b a b a b a b", long]
    rows = [(i, t, 1, "clash") for i, t in enumerate(texts)] + [(None, "y " * 30, 1, None), (4, "x " * 12, 2, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, runs string").repartition(3)
    got = periodic_runs(df).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(r[0]) for r in rows)
    by = {(k, t): None for k, t, *_ in rows}
    for r in got:
        t = next(t for k, t in by if k == r.doc_id)
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert r.n_words == len(w)
        if t is not long:
            runs = plain(w)
            assert [tuple(x) for x in r.runs] == runs and r.collapsed == collapsed(w, runs)
        else:
            assert [tuple(x) for x in r.runs] == [(0, 600_000, 70_001)] and r.collapsed == " ".join(w[:70_001])
    assert periodic_runs(df.limit(0)).count() == 0


def test_query(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for k, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h, n = zlib.crc32(str(k).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        r = plain(w)
        best = min(r, key=lambda x: (-x[1], x[0], x[2])) if r else (None,) * 3
        milli = 1000 * best[1] // best[2] if r else None
        want.append((k, len(r), *best, milli, sha("".join(f"{s},{m},{p}\n" for s, m, p in r)), sha(collapsed(w, r))))
    got = queries.op12_periodic_runs(spark, SF)
    assert dict(got.dtypes) == {c: "bigint" for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")} | {
        "runs_sha256": "string", "collapsed_sha256": "string"
    }
    assert sorted(map(tuple, got.collect())) == sorted(want)
