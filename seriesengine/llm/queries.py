"""One registered query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesengine.llm import (
    decontaminate,
    line_dedup,
    minhash,
    mixing,
    periodic_runs,
    prefix_trie,
    quality_model,
    quality_rules,
    sharding,
    suffix_dedup,
    tokens,
    toxicity,
    warc,
)
from seriesengine.llm.common import let, table, words

SHARDS = 16


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    placed = sharding.assign_shards(docs, "doc_id", SHARDS, grown_col="grown_shard")
    slots = sharding.number_slots(placed, "shard", ["doc_id", "size", "text_crc32", "grown_shard"])
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), vocabulary())


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page is looked up by its URL in the index and read back from its archive."""
    captures, shards, folder = warc.archive_pages(table(spark, sf_dir, "pages"))
    return warc.read_records(warc.find_captures(captures.select("surt"), shards, folder), folder)


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), n_words=3, percent=85)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.benchmark_overlaps(docs, benchmark)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dropped_lines(table(spark, sf_dir, "documents"), min_words=1, simhash_bits=None)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def with_planted_period(text: Column, key: Column) -> Column:
    """The text with a periodic tail of words where crc32 of the key ends in 0; others as they are."""
    hashed = F.crc32(key.cast("string"))
    g = F.floor(hashed / 10)

    def tail(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, place(i))), " ")).otherwise(text)

    return F.when(hashed % 10 == 0, let(words(text), tail)).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    planted = docs.select("doc_id", with_planted_period(F.col("text"), F.col("doc_id")).alias("text"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), -r["start"], -r["period"])))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    told = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    found = periodic_runs.periodic_runs(planted).withColumn("best", best)
    length, period = F.col("best.length"), -F.col("best.col3")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.col2")).alias("start"), length.alias("length"),
        period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_shared_beginnings(conversations: DataFrame) -> DataFrame:
    """(conv, turns) in which conversations begin with up to five turns of the first of their hundred."""
    shared = F.crc32(F.col("conv").cast("string")) % 6
    first = conversations.filter(F.col("conv") % 100 == 0).select(
        F.col("conv").alias("_base"), F.slice("turns", 1, 5).alias("_begin")
    )
    both = conversations.join(first, F.col("conv") - F.col("conv") % 100 == F.col("_base"), "left")
    own = F.slice("turns", (shared + 1).cast("int"), F.size("turns"))
    begin = F.slice(F.coalesce("_begin", F.slice("turns", 1, 0)), F.lit(1), shared.cast("int"))
    return both.select("conv", F.concat(begin, own).alias("turns"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = prefix_trie.conversations_in_order(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(with_shared_beginnings(ordered))


_ALL = (
    op1_jump_shards, op2_suffix_dedup, op3_token_counts, op4_mix_sources, op5_warc, op6_minhash_dedup,
    op7_decontaminate, op8_quality_classifier, op9_fuzzy_lines, op10_quality_rules,
    op11_toxicity, op12_periodic_runs, op13_prefix_trie,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE: dict[str, str] = {}
