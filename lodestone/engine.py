"""The engine's facade: an index of source files and the queries over it."""

from __future__ import annotations

import time
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.model import ALL_RELATIONS, DensityConfig, report_label
from lodestone.operators import lookup, search, smart, snippet, traverse
from lodestone.plans.numbering import cut
from lodestone.plans.store import Graph
from lodestone.sources.files import index_files, read_files
from lodestone.sources.preprocess import PreprocessConfig


@dataclass(frozen=True)
class SymbolEntry:
    kind: str
    name: str
    parent_class: str
    file_path: str
    start_line: int
    end_line: int
    signature: str

    def __repr__(self) -> str:
        return f"<SymbolEntry {self.kind} {self.name} @ {self.file_path}:{self.start_line}>"


@dataclass(frozen=True)
class RelatedSymbol:
    name: str
    kind: str
    file_path: str
    start_line: int
    end_line: int
    signature: str
    relation: str
    depth: int

    def __repr__(self) -> str:
        return f"<RelatedSymbol {self.kind} {self.name} depth={self.depth}>"


@dataclass(frozen=True)
class QueryResult:
    symbols: list[SymbolEntry]
    related: list[str]
    related_symbols: list[RelatedSymbol]


@dataclass(frozen=True)
class Density:
    weighted_score: float
    edge_type_count: int
    sufficient: bool
    expansions_used: int


@dataclass(frozen=True)
class SmartQueryResult:
    symbols: list[SymbolEntry]
    related: list[str]
    related_symbols: list[RelatedSymbol]
    density: Density


@dataclass(frozen=True)
class SnippetResult:
    file_path: str
    start_line: int
    end_line: int
    code: str
    pincer_applied: bool


@dataclass(frozen=True)
class IndexStats:
    files: int
    seconds: float


class Engine:
    """Holds the current graph; every change makes a new one. The DataFrames behind it are graph.symbols and graph.edges,
    for queries of any other kind. Results here are bounded (a name's entries, a capped traversal, a top-k) and come as
    Python values."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.graph = Graph.empty(spark)
        self.config = PreprocessConfig()
        self.paths: list[str] = []
        self.stats = IndexStats(0, 0.0)

    def __enter__(self) -> Engine:
        return self.initialize()

    def __exit__(self, *_: object) -> None:
        self.release()

    def initialize(self) -> Engine:
        return self

    def release(self) -> None:
        self.graph.released()

    def set_preprocess_config(self, **settings: object) -> None:
        self.config = PreprocessConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in settings.items()})

    def _keep(self, graph: Graph) -> None:
        old, self.graph = self.graph, Graph(cut(graph.symbols), cut(graph.edges)).cached()
        old.released()

    def index_files(self, paths: Iterable[str]) -> int:
        """Adds files, behind what is there; a file indexed again has its rows again."""
        began = time.monotonic()
        self.paths = list(paths)
        fresh, count = index_files(self.spark, self.paths, self.config)
        self._keep(self.graph.plus(fresh) if count else self.graph)
        self.stats = IndexStats(count, time.monotonic() - began)
        return count

    def reindex_files(self, paths: Iterable[str]) -> int:
        paths = list(paths)
        fresh, count = index_files(self.spark, paths, self.config)
        kept = self.graph.without_files(paths)
        self._keep(kept.plus(fresh) if count else kept)
        return count

    def remove_files(self, paths: Iterable[str]) -> None:
        self._keep(self.graph.without_files(list(paths)))

    def update(self) -> int:
        """Index the last list of files anew, from nothing."""
        self._keep(Graph.empty(self.spark))
        return self.index_files(self.paths)

    def symbol_count(self) -> int:
        return lookup.symbol_count(self.graph)

    def _entries(self, df: DataFrame) -> list[SymbolEntry]:
        return [SymbolEntry(**{k: v for k, v in r.asDict().items() if k != "symbol_id"}) for r in df.orderBy("symbol_id").collect()]

    def _related(self, df: DataFrame, order: list[str]) -> list[RelatedSymbol]:
        return [RelatedSymbol(**{k: v for k, v in r.asDict().items() if k not in ("ord", "step")}) for r in df.orderBy(*order).collect()]

    def lookup(self, name: str) -> list[SymbolEntry]:
        return self._entries(lookup.lookup(self.graph, name))

    def query(self, name: str, bfs_depth: int = 2, filter: int = ALL_RELATIONS, reverse: bool = False) -> QueryResult:
        names, symbols = traverse.query(self.graph, name, bfs_depth, filter, reverse)
        return QueryResult(self.lookup(name), [r["name"] for r in names.orderBy("ord").collect()], self._related(symbols, ["ord"]))

    def smart_query(self, name: str, density_config: DensityConfig | None = None) -> SmartQueryResult:
        found = smart.smart_query(self.graph, name, density_config)
        d = found.density.first()
        related = [r["name"] for r in found.related.orderBy("step", "ord").collect()]
        return SmartQueryResult(self._entries(found.symbols), related, self._related(found.related_symbols, ["step", "ord"]), Density(d["weighted_score"], d["edge_type_count"], d["sufficient"], d["expansions_used"]))

    def search_symbols(self, prefix: str, limit: int = 20) -> str:
        return search.to_json_array(search.search(self.graph, prefix, limit), ["tier", "lower", "name"], ["name", "kind", "file", "line"])

    def get_file_tree(self) -> str:
        return search.to_json_array(search.file_tree(self.graph), ["ord"], ["path", "name"])

    def get_file_symbols(self, path: str) -> str:
        return search.to_json_array(search.file_symbols(self.graph, path), ["symbol_id"], ["name", "kind", "line"])

    def language_counts(self) -> dict[str, int]:
        rows = search.language_counts(search.file_tree(self.graph)).orderBy(F.desc("n"), "language").collect()
        return {r["language"]: r["n"] for r in rows}

    def label_counts(self) -> dict[str, int]:
        """Files by the labels of reports, most first."""
        rows = search.file_tree(self.graph).groupBy(report_label(F.col("path")).alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").collect()
        return {r["label"]: r["n"] for r in rows}

    @staticmethod
    def pincer_extract(spark: SparkSession, file_path: str, start_line: int, end_line: int, target: str, radius: int = 7) -> SnippetResult:
        """A snippet of one file; needs no index."""
        raw = spark.read.text(file_path if "://" in file_path else "file://" + file_path, wholetext=True).withColumnRenamed("value", "text").withColumn("path", F.lit(file_path))
        found = snippet.pincer(raw, "path", target, start_line, end_line, radius).first()
        return SnippetResult(file_path, start_line, end_line, found["code"] if found else "", bool(found and found["applied"]))

    def opencode(self, name: str) -> list[tuple[SymbolEntry, list[tuple[int, str]]]]:
        """The numbered source lines of every symbol of a name."""
        entries = self.lookup(name)
        files = read_files(self.spark, sorted({e.file_path for e in entries})).select("file_path", F.decode("content", "utf-8").alias("text"))
        out = []
        for e in entries:
            rows = snippet.line_range(files.filter(F.col("file_path") == e.file_path), e.start_line, e.end_line).orderBy("pos").collect()
            out.append((e, [(max(1, e.start_line) + r["pos"], r["line"]) for r in rows]))
        return out
