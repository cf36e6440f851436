"""Breadth-first traversal whose order is that of a queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.model import ALL_RELATIONS, VISIT_CAP, in_mask, inverse_of, kind_label, relation_label
from lodestone.plans.store import Graph

NAMES = "name string, relation int, depth int, ord long"


def related_names(graph: Graph, start: str, depth: int = 2, mask: int = ALL_RELATIONS, reverse: bool = False, cap: int = VISIT_CAP) -> DataFrame:
    """Names reached from start in at most depth steps, in the order in which a queue first meets them.

    Columns name, relation (as seen from the start: the inverse if reverse), depth, ord. The mask tests the stored
    relation in either direction. A level is one job: edges are filtered, joined with the frontier and combined to the
    first way to each new name, and the first of these in queue order are kept. Frontier and visited names are no more
    than cap, whatever the graph's size, so they come to the driver and go back by broadcast.
    """
    spark = graph.edges.sparkSession
    here, there = ("dst", "src") if reverse else ("src", "dst")
    edges = graph.edges.filter(in_mask(F.col("relation"), mask)).select(F.col(here).alias("_at"), F.col(there).alias("name"), "edge_id", F.col("relation").cast("int").alias("relation"))
    seen, frontier, found = [start], [(start, 0)], []
    for level in range(1, depth + 1):
        room = cap - len(seen)
        if not frontier or room <= 0:
            break
        front = F.broadcast(spark.createDataFrame(frontier, "_at string, _rank long"))
        visited = F.broadcast(spark.createDataFrame([(n,) for n in seen], "name string"))
        step = edges.join(front, "_at").join(visited, "name", "left_anti")
        first = step.groupBy("name").agg(F.min(F.struct("_rank", "edge_id", "relation")).alias("_first"))
        rows = first.orderBy("_first._rank", "_first.edge_id").limit(room).select("name", "_first.relation").collect()
        frontier = [(r["name"], i) for i, r in enumerate(rows)]
        seen += [r["name"] for r in rows]
        found += [(r["name"], r["relation"], level, len(found) + i + 1) for i, r in enumerate(rows)]
    names = spark.createDataFrame(found, NAMES)
    return names.withColumn("relation", inverse_of(F.col("relation"))) if reverse else names


def with_symbols(graph: Graph, names: DataFrame) -> DataFrame:
    """The names that some symbol has, with the first such symbol's data.

    Only symbols of these names are combined; the names are at most a traversal's cap, so they are broadcast, and so are
    their first symbols' ids.
    """
    wanted = graph.symbols.join(F.broadcast(names.select("name").distinct()), "name", "left_semi")
    ids = wanted.groupBy("name").agg(F.min("symbol_id").alias("symbol_id"))
    first = graph.symbols.join(F.broadcast(ids.select("symbol_id")), "symbol_id", "left_semi")
    joined = first.join(F.broadcast(names), "name")
    return joined.select(
        "ord", "name", kind_label(F.col("kind")).alias("kind"), "file_path", "start_line", "end_line", F.coalesce("signature", F.lit("")).alias("signature"),
        relation_label(F.col("relation")).alias("relation"), "depth",
    )


def query(graph: Graph, start: str, depth: int = 2, mask: int = ALL_RELATIONS, reverse: bool = False, cap: int = VISIT_CAP) -> tuple[DataFrame, DataFrame]:
    """(related names, related symbols) of start."""
    names = related_names(graph, start, depth, mask, reverse, cap)
    return names, with_symbols(graph, names)


#: Names that are sent to every task of a level; of a level that found more, edges are shuffled to them.
MOST_SENT = 100_000


def min_depths(graph: Graph, start: str, depth: int, mask: int = ALL_RELATIONS, sent: int = MOST_SENT) -> DataFrame:
    """name, depth: the least number of steps to each name reached, without an order and without a cap, by joins alone.

    Each level keeps what it has found by checkpoint, so that a lost executor doesn't cost the levels before. Edges are
    not made distinct: only the names that a level meets are. Edges stay where they are while a level has no more names
    than sent.
    """
    from lodestone.plans.numbering import cut

    edges = graph.edges.filter(in_mask(F.col("relation"), mask)).select("src", F.col("dst").alias("name"))
    reached = edges.sparkSession.createDataFrame([(start, 0)], "name string, depth int")
    front, many, total = reached, 1, 1
    for level in range(1, depth + 1):
        here = front.select(F.col("name").alias("src"))
        met = edges.join(F.broadcast(here) if many <= sent else here.hint("shuffle_hash"), "src").select("name").distinct()
        new = met.join(F.broadcast(reached) if total <= sent else reached, "name", "left_anti").withColumn("depth", F.lit(level))
        front = cut(new)
        many = front.count()
        if not many:
            break
        reached, total = reached.unionByName(front), total + many
    return reached.filter("depth > 0")
