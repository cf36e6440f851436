"""Weighted edge counts of a symbol and whether they are enough."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.model import UNKNOWN, DensityConfig, in_mask, inverse_of
from lodestone.plans.store import Graph


def weight_table(spark: SparkSession, config: DensityConfig) -> DataFrame:
    return spark.createDataFrame([(k, r, float(w)) for (k, r), w in sorted(config.weights.items())], "_kind int, _relation int, weight double")


def goldilocks(config: DensityConfig, start: Column, end: Column, relation: Column) -> Column:
    """Whether a related symbol is of a fitting length in lines. relation: its label."""
    length = end - start
    short = (relation == "CalledBy") & (length < config.goldilocks_min)
    return (length <= 0) | ~((length > config.goldilocks_max) | F.coalesce(short, F.lit(False)))


def scored(counts: DataFrame, config: DensityConfig, by: list[str]) -> DataFrame:
    """counts: by, kind (ordinal), relation (ordinal, null for none), n. A row for each value of by: score, types, sufficient."""
    weights = F.broadcast(weight_table(counts.sparkSession, config))  # a row for each kind and relation, of which there are 13 by 14
    joined = counts.join(weights, (F.col("kind") == F.col("_kind")) & (F.col("relation") == F.col("_relation")), "left")
    fits = F.col("kind") != UNKNOWN
    score = F.sum(F.when(fits, F.col("n") * F.coalesce("weight", F.lit(0.0))).otherwise(0.0))
    types = F.sum(F.when(fits & F.col("relation").isNotNull() & (F.col("n") > 0), 1).otherwise(0))
    made = joined.groupBy(*by).agg(F.coalesce(score, F.lit(0.0)).alias("weighted_score"), types.cast("int").alias("edge_type_count"))
    enough = (F.col("weighted_score") >= config.score_threshold) & (F.col("edge_type_count") >= config.min_edge_types)
    return made.withColumn("sufficient", enough)


def density_of_all(graph: Graph, kinds: list[int], config: DensityConfig | None = None, mask: int = 0) -> DataFrame:
    """The density of every name whose first symbol is of one of these kinds, from its distinct neighbours one step away.

    Both directions at once: edges are counted where they leave and where they arrive, distinct by neighbour with the
    first relation in edge order, as a traversal of one step finds them. Counts are combined before any shuffle by name.
    """
    config = config or DensityConfig()
    edges = graph.edges.filter(in_mask(F.col("relation"), mask))
    out = edges.select(F.col("src").alias("name"), F.col("dst").alias("other"), F.lit(0).alias("way"), "edge_id", F.col("relation").cast("int").alias("relation"))
    into = edges.select(F.col("dst").alias("name"), F.col("src").alias("other"), F.lit(1).alias("way"), "edge_id", inverse_of(F.col("relation")).alias("relation"))
    first = out.unionByName(into).filter("name <> other").groupBy("name", "way", "other").agg(F.min_by("relation", "edge_id").alias("relation"))
    known = graph.symbols.select(F.col("name").alias("other")).distinct()  # a neighbour counts if it is a symbol
    counts = first.join(known, "other", "left_semi").groupBy("name", "relation").agg(F.count("*").alias("n"))
    subject = graph.first_symbols().filter(F.col("kind").isin(*kinds)).select("name", F.col("kind").cast("int").alias("kind"))
    return scored(subject.join(counts, "name", "left").withColumn("n", F.coalesce("n", F.lit(0))), config, ["name"])


