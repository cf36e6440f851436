"""The two tables of a code graph and the relational programs that keep them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.model import EDGE_SCHEMA, SYMBOL_SCHEMA


@dataclass(frozen=True)
class Graph:
    """symbols and edges, each with the ids that order them. Values are immutable: every change is a new Graph."""

    symbols: DataFrame
    edges: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> Graph:
        return Graph(spark.createDataFrame([], SYMBOL_SCHEMA), spark.createDataFrame([], EDGE_SCHEMA))

    def cached(self) -> Graph:
        self.symbols.cache()
        self.edges.cache()
        return self

    def released(self) -> None:
        self.symbols.unpersist()
        self.edges.unpersist()

    def first_symbols(self) -> DataFrame:
        """Of each name the symbol with the smallest id.

        Only names and ids are combined, in hash tables, without a sort. The ids that are first, which are narrow, then meet
        the symbols.
        """
        ids = self.first_ids().select("symbol_id").hint("shuffle_hash")
        rest = [c for c in self.symbols.columns if c != "name"]
        return self.symbols.join(ids, "symbol_id", "left_semi").select("name", *rest)

    def first_ids(self) -> DataFrame:
        """name and symbol_id: of each name the smallest id."""
        return self.symbols.groupBy("name").agg(F.min("symbol_id").alias("symbol_id"))

    def without_files(self, paths: Iterable[str] | DataFrame) -> Graph:
        """The graph without what these files hold. A DataFrame names files in its first column."""
        if isinstance(paths, DataFrame):
            gone = paths.select(F.col(paths.columns[0]).alias("file_path")).distinct()
            return Graph(self.symbols.join(gone, "file_path", "left_anti").select(*self.symbols.columns), self.edges.join(gone, "file_path", "left_anti").select(*self.edges.columns))
        gone = list(paths)
        keep = ~F.col("file_path").isin(*gone) if gone else F.lit(True)
        keep = F.coalesce(keep, F.lit(True))
        return Graph(self.symbols.filter(keep), self.edges.filter(keep))

    def plus(self, other: Graph) -> Graph:
        """This graph with another's rows behind its own; ids are moved up beyond the largest here."""

        def append(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
            top = a.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))  # one row
            low = b.agg(F.coalesce(F.min(key), F.lit(1)).alias("_low"))
            moved = b.crossJoin(F.broadcast(top)).crossJoin(F.broadcast(low)).withColumn(key, F.col(key) - F.col("_low") + F.col("_top") + 1)
            return a.unionByName(moved.select(*a.columns))

        return Graph(append(self.symbols, other.symbols, "symbol_id"), append(self.edges, other.edges, "edge_id"))

    def reindexed(self, fresh: Graph, paths: Iterable[str] | DataFrame | None = None) -> Graph:
        """The graph with fresh's files in place of its own; paths may name more files to drop."""
        gone = fresh.symbols.select("file_path") if paths is None else paths
        return self.without_files(gone).plus(fresh)

    def edges_from(self, name: str) -> DataFrame:
        return self.edges.filter(F.col("src") == name)

    def edges_to(self, name: str) -> DataFrame:
        return self.edges.filter(F.col("dst") == name)

    def write(self, uri: str, buckets: int | None = None) -> None:
        """Symbols in ranges of name; edges twice, partitioned by relation and in ranges of src and of dst.

        So a lookup, or a step of a traversal in either direction, reads the files whose statistics admit its names.
        """

        def sorted_by(df: DataFrame, key: str) -> DataFrame:
            dealt = df.repartitionByRange(buckets, key) if buckets else df.repartitionByRange(key)
            return dealt.sortWithinPartitions(key)

        sorted_by(self.symbols, "name").write.mode("overwrite").parquet(f"{uri}/symbols")
        for key in ("src", "dst"):
            sorted_by(self.edges, key).write.mode("overwrite").partitionBy("relation").parquet(f"{uri}/edges_by_{key}")

    @staticmethod
    def read(spark: SparkSession, uri: str, reverse: bool = False) -> Graph:
        """What write() wrote; reverse reads the edges that lie in the order of dst."""
        edges = spark.read.schema(EDGE_SCHEMA).parquet(f"{uri}/edges_by_{'dst' if reverse else 'src'}")
        return Graph(spark.read.parquet(f"{uri}/symbols"), edges.select(*EDGE_SCHEMA.fieldNames()))
