"""The smart query: what is around a symbol, widened once if that is a single lead, and how dense it is."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.model import RELATION, SEMANTIC_RELATIONS, UNKNOWN, DensityConfig, kind_of_label, relation_label
from lodestone.operators.density import goldilocks, scored
from lodestone.operators.lookup import lookup
from lodestone.operators.traverse import related_names, with_symbols
from lodestone.plans.store import Graph


@dataclass(frozen=True)
class SmartResult:
    """symbols: the name's own entries; related: names; related_symbols: see smart_query; density: one row."""

    symbols: DataFrame
    related: DataFrame
    related_symbols: DataFrame
    density: DataFrame


def smart_query(graph: Graph, name: str, config: DensityConfig | None = None, dedupe: bool = False) -> SmartResult:
    """Phase 0 goes one step forward and one back over semantic relations. If that gives one related symbol in all,
    phase 1 goes two steps each way, and what it finds is added.

    related holds each name once, where it was first found. related_symbols holds every find (with dedupe only the
    first of each name), in order, less those whose length in lines doesn't fit. The kind for the weights is that of the
    name's first symbol by its label, so a struct counts as a class. A config without weights gets the default ones.
    """
    config = config or DensityConfig()
    if not config.weights:
        config = DensityConfig(config.score_threshold, config.min_edge_types, config.max_expansions, config.goldilocks_min, config.goldilocks_max)
    own = lookup(graph, name)
    parts = [_step(graph, name, 1, back, number) for number, back in enumerate((False, True))]
    found = parts[0].unionByName(parts[1])
    leads = with_step(graph, found)
    if leads.limit(2).count() == 1:
        for number, back in ((2, False), (3, True)):
            found = found.unionByName(_step(graph, name, 2, back, number))
        leads = with_step(graph, found)
    related = found.groupBy("name").agg(F.min(F.struct("step", "ord")).alias("_at")).select(F.col("_at.step").alias("step"), F.col("_at.ord").alias("ord"), "name")
    if dedupe:
        leads = leads.join(related, ["name", "step", "ord"], "left_semi")
    fitting = leads.filter(goldilocks(config, F.col("start_line"), F.col("end_line"), F.col("relation")))
    kinds = own.orderBy("symbol_id").limit(1).select(kind_of_label(F.col("kind")).alias("kind"))
    one = graph.symbols.sparkSession.range(1).select(F.lit(name).alias("name"))
    subject = one.join(kinds, F.lit(True), "left").select("name", F.coalesce("kind", F.lit(UNKNOWN)).alias("kind"))
    ordinal = F.element_at(F.create_map(*(F.lit(x) for pair in RELATION.items() for x in pair)), F.col("relation"))
    counts = fitting.groupBy(ordinal.alias("relation")).agg(F.count("*").alias("n"))  # at most a row a relation
    joined = subject.join(F.broadcast(counts), F.lit(True), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = joined.groupBy("name").agg(F.sum("n").alias("_total")).withColumnRenamed("name", "_name")
    dense = scored(joined, config, ["name"]).join(F.broadcast(total), F.col("name") == F.col("_name"))
    density = dense.select("name", "weighted_score", "edge_type_count", "sufficient", F.when(F.col("_total") == 1, 2).otherwise(1).alias("expansions_used"))
    return SmartResult(own, related, fitting, density)


def _step(graph: Graph, name: str, depth: int, reverse: bool, number: int) -> DataFrame:
    return related_names(graph, name, depth, SEMANTIC_RELATIONS, reverse).withColumn("step", F.lit(number))


def with_step(graph: Graph, found: DataFrame) -> DataFrame:
    first = with_symbols(graph, found.select("name").distinct().selectExpr("0L as ord", "name", "0 as relation", "0 as depth")).drop("ord", "relation", "depth")
    joined = first.join(F.broadcast(found), "name")
    return joined.select("step", "ord", "name", "kind", "file_path", "start_line", "end_line", "signature", relation_label(F.col("relation")).alias("relation"), "depth")


