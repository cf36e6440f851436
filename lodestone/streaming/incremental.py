"""An index that follows a folder: each pass lists the files, indexes what is new or changed and drops what is gone.

Spark's file source knows a file by its path alone and never brings a changed one again, so a clock stream drives passes
over the folder's listing instead. The graph and the list of (path, time, length) it was made from are kept together, a
version for each pass that found a change, below the checkpoint. A restart goes on from the last whole version.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.functions.model import language_of
from lodestone.plans.store import Graph
from lodestone.sources.files import graph_of_files

LISTED = "path string, modificationTime timestamp, length long, content binary"
KEY = ["file_path", "changed", "length"]


@dataclass(frozen=True)
class Pass:
    """What a pass found: the graph as it is after it, and how many files were indexed and dropped."""

    graph: Graph
    indexed: int
    dropped: int
    version: int


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, file_path, changed, length of the folder's files of a known language. Their contents are not read."""
    raw = spark.read.format("binaryFile").schema(LISTED).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    named = raw.select("path", F.regexp_replace("path", r"^file:/+", "/").alias("file_path"), F.col("modificationTime").alias("changed"), "length")
    return named.filter(language_of(F.col("file_path")) != "")


class _Versions:
    """Folders 1, 2, … below a URI. A version counts only if its list of files, written last, is whole."""

    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri = spark, uri.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.uri).getFileSystem(spark._jsc.hadoopConfiguration())

    def whole(self) -> list[int]:
        top = self.path(self.uri)
        names = [s.getPath().getName() for s in self.files.listStatus(top)] if self.files.exists(top) else []
        return sorted(int(n) for n in names if n.isdigit() and self.files.exists(self.path(f"{self.uri}/{n}/files/_SUCCESS")))

    def read(self, number: int) -> tuple[Graph, DataFrame]:
        return Graph.read(self.spark, f"{self.uri}/{number}"), self.spark.read.parquet(f"{self.uri}/{number}/files")

    def write(self, number: int, graph: Graph, files: DataFrame) -> None:
        graph.write(f"{self.uri}/{number}")
        files.write.mode("overwrite").parquet(f"{self.uri}/{number}/files")

    def drop_before(self, number: int) -> None:
        for old in self.whole():
            if old < number:
                self.files.delete(self.path(f"{self.uri}/{old}"), True)


def refresh(spark: SparkSession, folder: str, state: str, start: Graph | None = None, pattern: str = "*") -> Pass:
    """One pass over folder, with the versions below the URI state.

    A file is indexed if the last version hasn't its (path, time, length), and its earlier rows go; files that are gone
    lose theirs. Ids of new rows are behind all others, as when files are indexed again. start: the graph to begin with
    where there is no version yet. Without a change no version is written. The version before is kept, so that readers
    of it aren't cut off.
    """
    versions = _Versions(spark, state)
    known = versions.whole()
    now = listing(spark, folder, pattern)
    if known:
        graph, had = versions.read(known[-1])
    else:
        graph, had = start or Graph.empty(spark), now.select(*KEY).limit(0)
    had = had.select(*KEY)
    fresh = now.join(had, KEY, "left_anti")
    # A changed file is in both lists, as gone and as new: its rows are replaced.
    gone = had.join(now.select(*KEY), KEY, "left_anti").select("file_path")
    indexed, dropped = fresh.count(), gone.count()
    if known and not indexed and not dropped:
        return Pass(graph, 0, 0, known[-1])
    number = known[-1] + 1 if known else 1
    touched = gone.unionByName(fresh.select("file_path")).distinct()
    kept = graph.without_files(touched)
    made = kept.plus(graph_of_files(contents(spark, fresh))) if indexed else kept
    versions.write(number, made, now.select(*KEY).join(had, KEY, "left_semi").unionByName(fresh.select(*KEY)))
    versions.drop_before(number - 1)
    return Pass(versions.read(number)[0], indexed, dropped, number)


def contents(spark: SparkSession, files: DataFrame) -> DataFrame:
    """file_path, lang, content of listed files, which Spark reads by their paths; the list is that of one pass's changes."""
    paths = [r["path"] for r in files.select("path").toLocalIterator()]
    raw = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(paths)
    named = raw.select(F.regexp_replace("path", r"^file:/+", "/").alias("file_path"), "content")
    return named.withColumn("lang", language_of(F.col("file_path")))


def follow(spark: SparkSession, folder: str, checkpoint: str, changed: Callable[[Graph], None], start: Graph | None = None, pattern: str = "*", **trigger: object) -> StreamingQuery:
    """Start a stream of passes over folder; changed gets the graph of the first pass and of each that found a change.

    trigger: as for writeStream.trigger, by default one pass. A batch that runs again after a failure finds the version
    that it wrote, if it came so far, and nothing to do.
    """
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    told = {"version": -1}

    def batch(_: DataFrame, __: int) -> None:
        found = refresh(spark, folder, f"{checkpoint}/versions", start, pattern)
        if found.version != told["version"]:
            told["version"] = found.version
            changed(found.graph)

    return ticks.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/ticks").trigger(**(trigger or {"availableNow": True})).start()
