"""Exact lookup and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.model import kind_label, relation_label
from lodestone.plans.store import Graph


def entries(symbols: DataFrame) -> DataFrame:
    """Symbols as results show them: labels for kinds, '' for no signature or parent."""
    return symbols.select(
        "symbol_id", kind_label(F.col("kind")).alias("kind"), "name", F.coalesce("parent_class", F.lit("")).alias("parent_class"), "file_path", "start_line", "end_line",
        F.coalesce("signature", F.lit("")).alias("signature"),
    )


def lookup(graph: Graph, *names: str) -> DataFrame:
    """All symbols of exactly these names, in order of insertion."""
    return entries(graph.symbols.filter(F.col("name").isin(*names))).orderBy("symbol_id")


def symbol_count(graph: Graph) -> int:
    return graph.symbols.count()


def symbols_by_kind(graph: Graph) -> DataFrame:
    return graph.symbols.groupBy(kind_label(F.col("kind")).alias("kind")).agg(F.count("*").alias("n"))


def edges_by_relation(graph: Graph) -> DataFrame:
    return graph.edges.groupBy(relation_label(F.col("relation")).alias("relation")).agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"))


def name_statistics(graph: Graph, shown=lambda name: name) -> DataFrame:
    """names and bytes: how many distinct names symbols and edges have, files among them, and their UTF-8 bytes.

    Distinct names are combined before they are shuffled, and only sums are brought together. shown: what stands for a name.
    """
    s, e = graph.symbols, graph.edges
    every = [s.select(F.col(c).alias("name")) for c in ("name", "file_path", "signature", "parent_class")] + [e.select(F.col(c).alias("name")) for c in ("src", "dst")]
    names = reduce(DataFrame.unionByName, every).filter("name <> ''").distinct()
    return names.select(shown(F.col("name")).alias("name")).agg(F.count("*").alias("names"), F.coalesce(F.sum(F.octet_length("name")), F.lit(0)).cast("long").alias("bytes"))
