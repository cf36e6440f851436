"""From raw documents to token files: five stages, each an operator of lodestone.llm over all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import read, scratch
from lodestone.llm.decontaminate import find_matches
from lodestone.llm.mixing import mix_rows
from lodestone.llm.quality import classify, fit
from lodestone.llm.simhash import first_of_similar
from lodestone.llm.tokens import read_tokens, write_tokens

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network scores 0.5 or more. It learns from the labelled documents not held out.

    Rows are judged each for itself: null texts as empty ones, repeated rows alike. Without labels every text has the
    score 0.5 and stays. Empty table: no rows.
    """
    return classify(docs, fit(docs, read(spark, sf_dir, "labels")), COLUMNS).filter("score >= 0.5").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row: that of the smallest id (null ids last), then of the least hash.

    Duplicates are texts whose sets of five-word shingles have a similarity (Jaccard) of 0.8 or more, and what such links
    join. Rows decide, not ids: unlike texts of one id, or of none, stay. Null and wordless texts are one group. Of
    repeated rows one stays. Empty table: no rows.
    """
    # All columns, nulls apart, so that rows share a key only if they are the same; 128 bits of hash.
    values = [x for c in COLUMNS for x in (F.col(c).isNull(), F.col(c))]
    hashes = [F.xxhash64(F.lit(f"row{k}"), *values).alias(f"_h{k}") for k in range(2)]
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), *hashes)
    stay = first_of_similar(docs, row).select(F.col("first._h0").alias("_h0"), F.col("first._h1").alias("_h1"))
    # Only keys go through the join; the texts are shuffled once, to meet those that stay.
    return docs.select(*COLUMNS, *hashes).join(stay, ["_h0", "_h1"], "left_semi").dropDuplicates(["_h0", "_h1"]).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark.

    Null texts have none and stay; repeated rows are judged alike; a null item has no windows. Empty table: no rows.
    """
    return find_matches(docs, read(spark, sf_dir, "benchmark"), COLUMNS).filter("n_hit = 0").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the last run of a source is cut at its exact budget.

    A row is a document once. One that the cut goes through keeps its first words, up to the budget, as text. Documents
    without words, null texts among them, are not in the mix. Null sources are one source, null ids come first in theirs;
    rows that agree in id, source and size share alike what is taken of them. Empty table: no rows.
    """
    return mix_rows(docs, COLUMNS)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns each document's place in them, as it is read back.

    Every row has its place, in order of id, null ids first; repeated rows follow one another. A null text has its end id
    only. Empty table: no files and no rows.
    """
    uri = scratch(spark, "tokens")
    return read_tokens(write_tokens(docs, uri), uri)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mixed),
    ("token_files", token_files),
]

#: SQL can't express the network, the hashes and the tokenizer; the tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's rows are written to the shared folder and read again for the next."""
    docs = read(spark, sf_dir, "documents")
    uri = scratch(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return made
        made.write.parquet(f"{uri}/{number}-{name}")
        docs = spark.read.parquet(f"{uri}/{number}-{name}")
    return docs
