"""The trie of shared beginnings against a plain version."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from seriesengine.llm import prefix_trie, queries

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn int, role string, text string, a int, conv string, length int"


def ordered(rows):
    by = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            by[c].append((t is not None, t or 0, r or "", x or ""))
    return {c: [v[2:] for v in sorted(turns, key=lambda v: v[:2])] for c, turns in by.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def plain(sequences):
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(int)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
        ends[tuple(s)].append(c)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    up = lambda p: min(members[p[:-1]]) if p else None
    return sorted(((min(m), len(p), up(p), len(m), children[p], leaves[p], saved[p], sha(p)) for p, m in members.items()), key=lambda r: r[:2])


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[:2])


def test_query(spark):
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{SF}/conversations.parquet'").fetchall()
    got = queries.op13_prefix_trie(spark, SF)
    assert got.columns[:8] == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {t for c, t in got.dtypes if c != "ends_sha256"} == {"bigint"}
    assert rows_of(got) == plain(rebuilt(ordered(rows)))


@pytest.mark.parametrize("block", [4096, 3])
def test_awkward_conversations(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "IDS_PER_BLOCK", block)
    monkeypatch.setattr(prefix_trie, "TURNS_AT_ONCE", 50)
    rng = random.Random(5)
    rows = [(c, t, "user", "hello", 1, None, 2) for c in range(40) for t in range(rng.choice([2, 2, 5]))]  # many equal ones
    rows += [(c, t, rng.choice(["user", None, ""]), rng.choice([None, "", "é𝄞"]), 1, "x", 3) for c in range(40, 90) for t in range(rng.randrange(1, 9))]
    rows += [(200, t, "user", "hello" if t < 1500 else f"t{t}", 1, None, 0) for t in range(1600)]  # deeper than all others
    rows += [(201, t, "user", "hello", 1, None, 0) for t in range(1550)]
    rows += [(300, None, "user", "no turn", 1, None, 0), (300, 0, "user", "hello", 1, None, 0), (300, -1, "user", "y" * 5_000_000, 1, None, 0)]
    rows += [(301, 0, "user", "hello", 1, None, 0)] * 3 + [(None, 0, "user", "hello", 1, None, 0)] * 2
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    in_order = prefix_trie.conversations_in_order(df)
    assert rows_of(prefix_trie.prefix_trie(in_order)) == plain(ordered(rows))
    shared = prefix_trie.prefix_trie(queries.with_shared_beginnings(in_order))
    assert rows_of(shared) == plain(rebuilt(ordered(rows)))


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.prefix_trie(prefix_trie.conversations_in_order(none)).count() == 0
    turnless = spark.createDataFrame([(5, []), (3, [])], "conv long, turns array<struct<a:long,b:long,chars:int>>")
    ends = hashlib.sha256(b"3,5").hexdigest()
    assert rows_of(prefix_trie.prefix_trie(turnless)) == [(3, 0, None, 2, 0, 1, 0, ends)]
