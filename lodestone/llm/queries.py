"""The queries that apply each operator of this subpackage to its whole table, with the columns their contracts name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.chat import rotate
from lodestone.llm.common import read, scratch
from lodestone.llm.decontaminate import find_matches
from lodestone.llm.fingerprint import compare_with_edits
from lodestone.llm.lm import score
from lodestone.llm.mixing import mix
from lodestone.llm.quality import classify, fit, held_out
from lodestone.llm.sharding import shard
from lodestone.llm.simhash import near_duplicates
from lodestone.llm.substrings import remove_repeats
from lodestone.llm.tokens import read_tokens, write_tokens


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


def op2_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(read(spark, sf_dir, "conversations"))


def op3_quality_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = classify(docs, fit(docs, read(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = scratch(spark, "tokens")
    return read_tokens(write_tokens(read(spark, sf_dir, "documents"), uri), uri)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), ["doc_id"])
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))


def op7_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(read(spark, sf_dir, "documents"))


def op8_shard_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), ["doc_id"])


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_chat_perspectives": op2_chat_perspectives,
    "op3_quality_network": op3_quality_network,
    "op4_simple8b_tokens": op4_simple8b_tokens,
    "op5_decontaminate": op5_decontaminate,
    "op6_suffix_tree_scores": op6_suffix_tree_scores,
    "op7_multiset_fingerprints": op7_multiset_fingerprints,
    "op8_shard_bytes": op8_shard_bytes,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
}
