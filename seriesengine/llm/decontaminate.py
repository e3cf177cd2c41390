"""Documents that carry benchmark passages, found by spaced-seed hashing. Spark SQL only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Masks over token positions; positions left out may differ. Every window of 13 tokens with at
#: most two substitutions has seven equal tokens under one of them (checked in the tests).
MASKS = ((0, 1, 2, 4, 5, 6, 8), (0, 1, 2, 4, 7, 8, 9), (0, 3, 4, 5, 7, 8, 9))
WINDOW, SUBSTITUTIONS = 13, 2
#: Benchmark seeds up to which they and the items' tokens are broadcast, at most about 60 MB; beyond,
#: both sides are shuffled.
BROADCAST_SEEDS = 1_000_000


#: Letters of scripts that put no spaces between words; each is a token.
_ALONE = "[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}\\p{IsLao}\\p{IsKhmer}\\p{IsMyanmar}]"
_BREAK, _RUN = "[^\\p{L}\\p{N}]+", "[\\p{L}\\p{N}]"


def tokens(text: Column) -> Column:
    """64-bit hashes of the lower-case runs of letters and digits, and of each letter of a script
    without spaces; none for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    single = f"{_BREAK}|(?<={_ALONE})(?={_RUN})|(?<={_RUN})(?={_ALONE})"
    wide = F.octet_length(low) > F.length(low)  # else there is no such letter, and no need to look
    runs = F.when(wide & low.rlike(_ALONE), F.split(low, single)).otherwise(F.split(low, _BREAK))
    return F.transform(F.array_remove(runs, ""), lambda t: F.xxhash64(t))


def _seeds(df: DataFrame, toks: str, keep: list[str], place: str) -> DataFrame:
    """One row for each mask and place at which it fits: ``keep``, ``place``, ``seed``."""
    masks = F.array(
        *(F.struct(F.lit(i).alias("n"), *(F.lit(k).alias(f"p{j}") for j, k in enumerate(m))) for i, m in enumerate(MASKS))
    )
    last = F.size(toks) - min(m[-1] + 1 for m in MASKS)
    at = df.select(*dict.fromkeys([*keep, toks]), F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))).alias(place))
    masked = at.select("*", F.explode(masks).alias("mask"))
    chosen = [F.get(F.col(toks), F.col(place) + F.col(f"mask.p{j}")) for j in range(len(MASKS[0]))]
    return masked.filter(chosen[-1].isNotNull()).select(*keep, place, F.xxhash64("mask.n", *chosen).alias("seed"))


def benchmark_overlaps(
    docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row (``key``, ``text_hash``, ``item``, ``doc_token``, ``item_token``, ``n_equal``) for
    each document text and benchmark item that share a window of 13 tokens, in line, with at most
    two substitutions; an item of fewer tokens must stand in the text as a whole, token for token. The places and the count are those of the best such window, the first of equals.

    Tokens are lower-case runs of letters and digits, and the single letters of scripts without
    spaces. Null and empty texts are in no row; rows repeated under one key and text count once;
    a null key is kept as null; an empty table gives no rows. Other columns are not read. An item
    id may be null or stand on several texts: each is searched, and the best window of all counts.

    The text is read once and never moved: seeds of every place meet the benchmark's seeds, and
    the hits their item's tokens, in broadcast joins as long as those are few (the tokens are counted
    first: each makes at most three seeds), and each hit is verified beside the
    document's own tokens, so that only verified rows are shuffled. A benchmark too large for
    that is joined by shuffling the seeds, and its hits then meet both texts by their keys.
    """
    whole = (
        benchmark.filter(F.col(item_text).isNotNull())
        .select(F.col(item).alias("item"), F.xxhash64(item_text).alias("item_hash"), tokens(F.col(item_text)).alias("item_toks"))
        .filter(F.size("item_toks") > 0)
        .dropDuplicates(["item", "item_hash"])
    )
    items = whole.filter(F.size("item_toks") >= WINDOW)
    seeds = _seeds(items, "item_toks", ["item", "item_hash"], "item_at")
    n_tokens = items.agg(F.sum(F.size("item_toks"))).first()[0] or 0
    small = len(MASKS) * n_tokens <= BROADCAST_SEEDS
    own = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), tokens(F.col(text)).alias("toks"))
    of_item = items.toDF("i", "i_hash", "item_toks")
    its_item = F.col("item").eqNullSafe(F.col("i")) & (F.col("item_hash") == F.col("i_hash"))
    if small:
        met = _seeds(own, "toks", ["key", "text_hash", "toks"], "doc_at").join(F.broadcast(seeds), "seed")
        found = met.join(F.broadcast(of_item), its_item)
    else:
        met = _seeds(own, "toks", ["key", "text_hash"], "doc_at").join(seeds, "seed").drop("seed").distinct()
        found = met.join(of_item, its_item).join(
            own.withColumnRenamed("key", "k").dropDuplicates(["k", "text_hash"]),
            F.col("key").eqNullSafe(F.col("k")) & (met["text_hash"] == own["text_hash"]),
        ).select("key", met["text_hash"], "toks", "doc_at", "item", "item_toks", "item_at")

    # A hit needs the tokens around it only. Cut here, before a row leaves the stage that holds the
    # whole texts: a long text would else be copied for each of its hits.
    back = WINDOW - 9
    doc_from, item_from = (F.greatest(F.col(c) - back, F.lit(0)) for c in ("doc_at", "item_at"))
    found = found.select(
        "key", "text_hash", "item", "doc_at", "item_at", doc_from.alias("doc_from"), item_from.alias("item_from"),
        F.size("toks").alias("n_doc"), F.size("item_toks").alias("n_item"),
        F.slice("toks", doc_from + 1, F.lit(WINDOW + back)).alias("near"),
        F.slice("item_toks", item_from + 1, F.lit(WINDOW + back)).alias("item_near"),
    )

    def equal(a: Column) -> Column:  # tokens that agree in the window whose item place is a
        pairs = F.transform(
            F.sequence(F.lit(0), F.lit(WINDOW - 1)),
            lambda k: F.get("item_near", a + k - F.col("item_from"))
            == F.get("near", F.col("doc_at") - F.col("item_at") + a + k - F.col("doc_from")),
        )
        return F.size(F.filter(pairs, lambda same: same))

    first = F.greatest(F.col("item_at") - back, F.lit(0), F.col("item_at") - F.col("doc_at"))
    last = F.least(
        F.col("item_at"), F.col("n_item") - WINDOW, F.col("n_doc") - WINDOW - F.col("doc_at") + F.col("item_at")
    )
    windows = F.transform(
        F.sequence(first, last), lambda a: F.struct(equal(a).alias("n_equal"), (-a).alias("a"))
    )
    # explode_outer: a plain filter would become a condition of the join and be checked, with a
    # copy of the tokens, for every seed of the corpus instead of the few that meet.
    best = found.select(
        "key", "text_hash", "item", (F.col("doc_at") - F.col("item_at")).alias("shift"),
        F.explode_outer(F.when(first <= last, windows)).alias("best"),
    ).filter(F.col("best.n_equal") >= WINDOW - SUBSTITUTIONS)
    place = F.struct("best.n_equal", (F.col("best.a") - F.col("shift")).alias("x"), F.col("best.a").alias("a"))
    best = best.select("key", "text_hash", "item", place.alias("place"))
    short = whole.filter(F.size("item_toks") < WINDOW).select("item", "item_toks", F.size("item_toks").alias("n")).distinct()
    lengths = {r.n: r["count"] for r in short.groupBy("n").count().collect()}
    if lengths:
        at = F.explode(F.sequence(F.lit(0), F.size("toks") - 1)).alias("doc_at")
        places = own.filter(F.size("toks") > 0).select("key", "text_hash", "toks", at)
        places = places.select("*", F.explode(F.array(*(F.lit(n) for n in sorted(lengths)))).alias("n"))
        runs = places.filter(F.col("doc_at") + F.col("n") <= F.size("toks")).select(
            "key", "text_hash", "doc_at", F.slice("toks", F.col("doc_at") + 1, F.col("n")).alias("item_toks")
        )
        few = F.broadcast(short) if sum(lengths.values()) <= BROADCAST_SEEDS else short
        hits = runs.join(few, "item_toks").select(
            "key", "text_hash", "item", F.struct(F.col("n").alias("n_equal"), (-F.col("doc_at")).alias("x"), F.lit(0).alias("a")).alias("place")
        )
        best = best.unionByName(hits)
    top = best.groupBy("key", "text_hash", "item").agg(F.max("place").alias("top"))
    return top.select(
        F.col("key").alias(key), "text_hash", F.col("item").alias(item),
        (-F.col("top.x")).alias("doc_token"), (-F.col("top.a")).alias("item_token"), F.col("top.n_equal").alias("n_equal"),
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text", least: int = 8,
) -> DataFrame:
    """The rows of ``docs``, with all columns, that overlap with no benchmark item.

    An overlap counts if it has ``least`` equal tokens or more: a shorter item, a word or two,
    stands in texts by chance, and one such item must not empty a corpus. ``benchmark_overlaps`` reports
    these too. Null and empty texts stay; rows repeated under one key and text go together.
    """
    found = benchmark_overlaps(docs, benchmark, key=key, text=text, item=item, item_text=item_text)
    found = found.filter(F.col("n_equal") >= least)
    bad = found.select(F.col(key).alias("_key"), F.col("text_hash").alias("_hash")).distinct()
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.col(key).alias("_id"), F.xxhash64(text).alias("_text_hash"))
    on = whole["_id"].eqNullSafe(bad["_key"]) & (whole["_text_hash"] == bad["_hash"])
    return whole.join(bad, on, "left_anti").select("_row.*")
