"""Source files as tables: listing, reading and extraction."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.model import EDGE_SCHEMA, SYMBOL_SCHEMA, language_of, language_of_path
from lodestone.plans.numbering import cut, numbered
from lodestone.plans.store import Graph
from lodestone.shipping import ship
from lodestone.sources.extract import EXTRACTORS, extract
from lodestone.sources.preprocess import PreprocessConfig, preprocess_batch

#: Files that one index call takes.
MOST_FILES = 200_000
# Folders that a listing passes over, besides those that begin with a dot.
SKIPPED = frozenset({"node_modules", "__pycache__", "build", "target", "bin", "obj"})

ROWS = "file_ord long, emit_ord int, row_type string, name string, kind byte, start_line int, end_line int, signature string, parent_class string, src string, dst string, relation byte, file_path string, parse_status string"
_TYPES = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int8(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int8(), pa.string(), pa.string()]
_NAMES = [c.split()[0] for c in ROWS.split(", ")]


def collect_files(paths: Iterable[str]) -> list[str]:
    """Files as given, and under folders those of a known language, in sorted order."""
    found: list[str] = []
    for path in paths:
        if os.path.isfile(path):
            found.append(os.path.abspath(path))
            continue
        for folder, inner, names in os.walk(path):
            inner[:] = sorted(d for d in inner if not d.startswith(".") and d not in SKIPPED)
            found += [os.path.abspath(os.path.join(folder, n)) for n in sorted(names) if language_of_path(n)]
    return found


def read_files(spark: SparkSession, paths: list[str], limit: int = MOST_FILES) -> DataFrame:
    """file_ord, file_path, lang, content of the supported files among paths, in their order; a file given twice is there twice.

    Spark reads the files, wherever they are; those that are missing are left out.
    """
    known = [p for p in paths if language_of_path(p)]
    if len(known) > limit:
        raise ValueError(f"{len(known)} files; an index call takes {limit}")
    listed = spark.createDataFrame([(i, p) for i, p in enumerate(known)], "file_ord long, file_path string")
    there = [p for p in dict.fromkeys(known) if "://" in p or os.path.isfile(p)]
    if not there:
        return listed.limit(0).withColumn("lang", F.lit("")).withColumn("content", F.lit(b""))
    raw = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load([p if "://" in p else "file://" + p for p in there])
    path = F.regexp_replace("path", r"^file:/+", "/")
    contents = raw.select(path.alias("_path"), "content")
    return listed.join(contents, F.col("file_path") == F.col("_path")).select("file_ord", "file_path", language_of(F.col("file_path")).alias("lang"), "content")


def extract_rows(files: DataFrame, config: PreprocessConfig | None = None, files_only: bool = False) -> DataFrame:
    """One row for each symbol or edge of files (file_ord, file_path, lang, content), in order of file_ord and emit_ord.

    The one step that is Python: a batch of files becomes a batch of rows. A file that can't be read to its end has what
    was found before, and says so in parse_status. files_only: all of each file is extracted, and of the rows only the
    file's own, which is its first, is sent on.
    """
    ship(files.sparkSession)
    extractors = dict(EXTRACTORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in ("file_ord", "file_path", "lang", "content")), strict=True))
            changed = preprocess_batch({p: lang for _, p, lang, _ in rows if lang in ("c", "cpp")}, config) if config and config.enabled else {}
            made: list[tuple] = []
            for ord_, path, lang, content in rows:
                text, lines = changed.get(path, (None, None))
                if text is None:
                    text = (content or b"").decode("utf-8", "replace")
                found, status = extract(path, lang, text, extractors)
                if files_only:
                    del found[1:]
                for n, (kind, name, sort, start, end, sig, parent, src, dst, rel) in enumerate(found):
                    if lines and kind == "S" and start:
                        start, end = (lines[min(x, len(lines)) - 1] or x for x in (start, end))
                    made.append((ord_, n, kind, name, sort, start, end, sig, parent, src, dst, rel, path, status))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True) if made else [[]] * len(_TYPES), _TYPES, strict=True)], _NAMES)

    return files.select("file_ord", "file_path", "lang", "content").mapInArrow(run, ROWS)


def index_files(spark: SparkSession, paths: list[str], config: PreprocessConfig | None = None, limit: int = MOST_FILES) -> tuple[Graph, int]:
    """The graph of these files, and how many they are. Files are spread evenly over the cluster before they are parsed."""
    files = read_files(spark, paths, limit)
    count = files.count()
    return (graph_of_rows(spread(files, count), config), count) if count else (Graph.empty(spark), 0)


def spread(files: DataFrame, count: int) -> DataFrame:
    """files dealt evenly, some 200 to a task at most, so that parsing uses the whole cluster."""
    slots = max(files.sparkSession.sparkContext.defaultParallelism, -(-count // 200))
    return files.repartition(max(1, min(slots, count)), "file_ord", "file_path")


def graph_of_rows(files: DataFrame, config: PreprocessConfig | None = None) -> Graph:
    """The graph of files (file_ord, file_path, lang, content); rows are extracted once and numbered in file and emission order."""
    rows = cut(extract_rows(files, config))
    symbols = numbered(rows.filter("row_type = 'S'"), ["file_ord", "emit_ord"], "symbol_id").select(*SYMBOL_SCHEMA.fieldNames())
    edges = numbered(rows.filter("row_type = 'E'"), ["file_ord", "emit_ord"], "edge_id").select(*EDGE_SCHEMA.fieldNames())
    return Graph(symbols, edges)


def graph_of_files(files: DataFrame) -> Graph:
    """The graph of files (file_path, lang, content) in the order of their paths."""
    ordered = numbered(files, ["file_path"], "file_ord", first=0)
    return graph_of_rows(ordered.repartition("file_ord", "file_path"))
