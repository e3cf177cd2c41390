"""Every corpus operator against a plain version, with the awkward rows named in its docstring."""

import itertools
import random
import sys
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402

from seriesengine.llm import decontaminate, line_dedup, minhash, mixing, quality_model, quality_rules  # noqa: E402
from seriesengine.llm import queries, sharding, suffix_dedup, tokens, warc  # noqa: E402
from seriesengine.llm.graph import components  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, _key int, n_words string"


def words(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


_rng = random.Random(4)
VOCABULARY = ["".join(_rng.choice("abcdefghij") for _ in range(_rng.randint(2, 8))) for _ in range(500)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    base, passage = words(rng, 160), words(rng, 70)
    out = [(i, words(rng, 60 + i)) for i in range(30)]
    for i in range(30, 60):  # near copies, some of them of each other only
        w = base.split()
        for _ in range(i % 9):
            w[rng.randrange(len(w))] = "other"
        out.append((i, " ".join(w)))
    out += [(i, f"{words(rng, 20)} {passage}\n{words(rng, 9)}") for i in range(60, 75)]
    out += [(75, base), (76, base), (76, base), (77, None), (78, ""), (79, " \n\t"), (80, "One Two"), (81, "one two")]
    out += [(82, "a" * 900), (83, "é" * 400), (84, "x\ny\nx\n" * 300), (85, "AB! " * 400), (86, "q" * 200)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(k, t, "en" if k % 3 else None, f"s{k % 4}", 1, "clash") for k, t in rows]
    return spark.createDataFrame(full, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(k, int(k < 82), 0) for k, _ in rows if k % 2], "doc_id long, quality int, toxic int")


def test_jump_shards(spark, docs, empty):
    got = spark.range(-40, 40).select("id", sharding.jump_shards(F.col("id"), 1, 16, 1000).alias("s")).collect()
    assert all((brute.jump(r.id, 1), brute.jump(r.id, 16), brute.jump(r.id, 1000)) == tuple(r.s[x] for x in ("s1", "s16", "s1000")) for r in got)
    placed = sharding.assign_shards(docs, "doc_id", 4, grown_col="grown")
    slots = sharding.number_slots(placed, "shard", ["doc_id", "text", "grown"], buckets=3).collect()
    by = defaultdict(list)
    for r in slots:
        assert r.shard == brute.jump(r.doc_id, 4) and r.grown in (r.shard, 4)
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(slots) == docs.count()
    none = spark.createDataFrame([(None,), (None,)], "doc_id long")
    assert {r.shard for r in sharding.assign_shards(none, "doc_id", 9).collect()} == {brute.jump(0, 9)}
    assert sharding.number_slots(sharding.assign_shards(empty, "doc_id", 4), "shard", ["doc_id"]).count() == 0


def test_repeats(docs, rows, empty):
    assert sorted(map(tuple, suffix_dedup.remove_repeats(docs).collect())) == sorted(brute.repeats(rows))
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_repeats_of_a_divided_anchor(docs, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_ANCHOR", 2)
    assert sorted(map(tuple, suffix_dedup.remove_repeats(docs).collect())) == sorted(brute.repeats(rows))


def test_tokens(spark, docs, rows, empty):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.vocabulary()
    extra = [(900, "a<|endoftext|>b <|endoftext|>"), (901, "it's\x1c\x1d x\x85\xa0  y\n\n z"), (902, "\U000323b5՘b Ᲊ")]
    tok = tokenizers.Tokenizer.from_file(path)
    df = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = sorted(map(tuple, tokens.count_tokens(df, path).collect()))
    want = [(k, t, len(tok.encode(t or "", add_special_tokens=False).ids)) for k, t in rows + extra]
    assert got == sorted((k, len((t or "").encode()), n, n > 512) for k, t, n in want)
    assert tokens.count_tokens(empty, path).count() == 0


def test_mixing(docs, rows, empty):
    got = mixing.mix_documents(docs).toPandas()
    assert len(got) == len(rows) and got.probability.between(0, 1).all()
    expected = (got.n_tokens * got.probability).groupby(got.source).sum()
    target = got.groupby("source").n_tokens.sum() ** 0.85
    assert abs(expected / expected.sum() - target / target.sum()).max() < 1e-3
    kept = {r.doc_id for r in mixing.sample_documents(docs).collect()}
    assert kept == set(got[got.sampled].doc_id) and mixing.sample_documents(docs).columns == docs.columns
    assert mixing.mix_documents(empty).count() == 0


def test_warc(spark):
    long = "é" * 700
    pages = [(1, "http://a.b.c/x y?q=1", long), (2, "http://a.b.c:80/x", long), (3, None, long), (3, None, long), (4, "nohost", "")]
    pages += [(5, "http://[bad", None), (None, "http://z.com", long), (7, "https://z.com:444/", "x\r\n\r\ny" * 400)]
    pages += [(8, "http://q\n.com", "a" * 999), (9, "http://q", "a" * 999)] + [(100 + i, "http://same.com/", f"t{i % 3}" * 500) for i in range(700)]
    key = lambda x: tuple((v is None, 0 if v is None else v) for v in x)
    for table in (pages, []):
        df = spark.createDataFrame(table, "page_id long, url string, html string").withColumn("digest", F.lit(1))
        captures, shards, folder = warc.archive_pages(df)
        back = warc.read_records(warc.find_captures(captures.select("surt"), shards, folder), folder).collect()
        assert sorted(map(tuple, back), key=key) == sorted(brute.records(table), key=key)
    asked = spark.createDataFrame([("http://a.b.c/",)], "u string").select(F.lit(warc.surt("http://nowhere.org/")).alias("surt"))
    assert warc.find_captures(asked, shards, folder).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)}


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, n, percent):
    distinct = dict(rows)
    got = {tuple(r) for r in minhash.near_duplicates(docs, n_words=n, percent=percent).collect()}
    assert sorted(got) == brute.near(distinct.items(), n, percent)


def test_one_document_of_each_group_stays(docs, rows, empty):
    stay = [k for k, *_, kept in brute.near(dict(rows).items(), 5, 80) if kept]
    out = minhash.drop_near_duplicates(docs)
    assert sorted(r.doc_id for r in out.collect()) == stay and out.columns == docs.columns
    assert minhash.near_duplicates(empty).count() == 0


def test_masks_reach_every_window():
    free = [set(c) for c in itertools.combinations(range(13), 2)]
    fits = lambda m, gone: any(not gone & {o + k for k in m} for o in range(13 - m[-1]))
    assert all(any(fits(m, gone) for m in decontaminate.MASKS) for gone in free)


@pytest.mark.parametrize("seeds", [1_000_000, 0])
def test_overlaps(spark, docs, rows, empty, monkeypatch, seeds):
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", seeds)
    rng = random.Random(1)
    items = [(i, words(rng, 13 + 3 * i)) for i in range(8)] + [(8, None), (9, "too short")]
    planted = []
    for i, s in items[:8]:
        w = s.split()
        w[5] = w[9] = "zzz"
        planted.append((500 + i, f"{words(rng, 4)} {' '.join(w).upper()}! {words(rng, 9)}"))
    df = docs.select("doc_id", "text").union(spark.createDataFrame([*planted, planted[0]], "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (-r.n_equal, r.doc_token, r.item_token) for r in decontaminate.benchmark_overlaps(df, bench).collect()}
    assert got == brute.overlaps(dict(rows + planted).items(), items) and {k for k, _ in got} >= {500 + i for i in range(8)}
    left = decontaminate.drop_contaminated(df, bench)
    assert left.count() == df.count() - sum(k in {d for d, _ in got} for k, _ in [*rows, *planted, planted[0]])
    assert decontaminate.benchmark_overlaps(empty, bench).count() == 0


def test_quality_model(spark, docs, rows, labels, empty):
    got = quality_model.score_documents(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert quality_model.score_documents(empty, labels).count() == 0
    blind = quality_model.score_documents(docs, labels.limit(0)).collect()
    assert {r.score for r in blind} == {0.5}


def test_quality_model_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    from seriesengine.llm.common import table

    truth = table(spark, sf, "labels").select("doc_id", "quality")
    got = queries.op8_quality_classifier(spark, sf).join(truth, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.93 * len(got)


def test_isotonic():
    import numpy as np

    assert quality_model.isotonic(np.array([1.0, 1, 2, 1]), np.array([0.1, 0.5, 0.2, 0.9])).round(4).tolist() == [0.1, 0.3, 0.3, 0.9]


def test_fuzzy_lines(spark, docs, rows, empty):
    rng = random.Random(3)
    base = words(rng, 70).split()
    extra = [(300 + i, "short line\n" + " ".join(base[: 60 + i % 4]) + f"!\n{words(rng, 8)}") for i in range(20)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    places = defaultdict(set)
    for k, t in rows + extra:
        for j, line in enumerate(t.split("\n") if t else ()):
            norm = line_dedup.normalised(line)
            if len(norm.split(" ")) >= 5:
                places[norm].add((k, j))
    lines = sorted(places)
    sig = [int(x) for x in line_dedup.simhashes([[line_dedup._word_hash(w) for w in x.split(" ")] for x in lines])]
    groups = brute.Groups(range(len(lines)))
    for i, j in itertools.combinations(range(len(lines)), 2):
        if (sig[i] ^ sig[j]).bit_count() <= 3 and brute.distance(lines[i], lines[j]) <= max(len(lines[i]), len(lines[j])) // 10:
            groups.join(i, j)
    together, gone = defaultdict(set), defaultdict(set)
    for i, x in enumerate(lines):
        together[groups.of(i)] |= places[x]
    for v in together.values():
        for k, j in sorted(v)[1:]:
            gone[k].add(j)
    got = {r.doc_id: r.removed_lines for r in line_dedup.dropped_lines(df, min_words=5, simhash_bits=3).collect()}
    assert {k: set(v) for k, v in got.items() if v} == gone and len(got) == len(dict(rows + extra))
    assert line_dedup.dropped_lines(empty).count() == 0


def _edited(rng, line, edits):
    s = list(line)
    for _ in range(edits):
        i = rng.randrange(len(s))
        s[i : i + rng.randrange(2)] = rng.choice(["", "e", "e", "z"])
    return "".join(s)


def test_fuzzy_lines_recall():
    """Every pair within a tenth of edits should share a gram, and pass the bits."""
    import numpy as np

    rng = random.Random(12)
    missed = defaultdict(int)
    lengths = {"short": (10, 79), "medium": (80, 159), "long": (160, 900)}
    for kind, (low, high) in lengths.items():
        a = [words(rng, high // 4)[: rng.randint(low, high)] for _ in range(1000)]
        b = [_edited(rng, x, rng.choice([1, max(1, len(x) // 20), len(x) // 10])) for x in a]
        (ka, ba), (kb, bb) = line_dedup.line_grams(a), line_dedup.line_grams(b)
        apart = np.bitwise_count((ba ^ bb).view(np.uint64)).sum(axis=1)
        for i, (x, y) in enumerate(zip(a, b, strict=True)):
            missed[kind] += not set(ka[i]) & set(kb[i])
            assert apart[i] <= 4 * (max(len(x), len(y)) // 10)
    assert not missed["short"] and missed["medium"] <= 3 and missed["long"] <= 3


def test_fuzzy_lines_with_one_letter_more(spark):
    rng = random.Random(13)
    lines = [words(rng, n) for n in (3, 5, 8, 12, 20, 27, 40, 60) for _ in range(3)]
    lines = [x for x in lines if len(x) >= 10]
    more = [f"{x[: len(x) // 2]}q{x[len(x) // 2 :]}" for x in lines]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(more))], "doc_id long, text string")
    got = {r.doc_id: r.removed_lines for r in line_dedup.dropped_lines(df, min_words=1, simhash_bits=None).collect()}
    assert got == {1: [], 2: list(range(len(lines)))}


def test_quality_rules(docs, rows, labels, empty):
    out = quality_rules.judge_documents(docs, labels).collect()
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out)
    want = [(k, *s, s[0] < 50 or 100 * s[4] > 50 * s[0]) for k, s in ((k, brute.stats(t)) for k, t in rows)]
    assert got == sorted(want) and not any(r.kept and r.base_failed for r in out)
    kept = quality_rules.keep_good_documents(docs, labels)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in out if r.kept) and kept.columns == docs.columns
    assert quality_rules.judge_documents(empty, labels).count() == 0


def test_binomial_tail(spark):
    from math import comb

    cases = [(0, 90), (3, 400), (40, 2500), (60, 2500)]
    df = spark.createDataFrame(cases, "k long, n long")
    got = {(r.k, r.n): r.p for r in df.select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.02).alias("p")).collect()}
    for k, n in cases:
        exact = sum(comb(n, j) * 0.02**j * 0.98 ** (n - j) for j in range(k + 1))
        assert got[k, n] == pytest.approx(exact if k < 0.02 * n else 1.0, rel=1e-6)


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard"]
    ids = [r.doc_id for r in out.collect()]
    assert ids and len(ids) == len(set(ids))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_query(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
