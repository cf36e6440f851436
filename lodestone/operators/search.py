"""Search by prefix or substring, and what files and languages there are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.model import ascii_lower, base_name, kind_label, language_of
from lodestone.plans.store import Graph


def search(graph: Graph, text: str, limit: int = 20) -> DataFrame:
    """Up to limit names that hold text, case apart: those that begin with it first, then in order of the lower-case name.

    One row for each exact name, with its first symbol. A null or empty text finds nothing. One pass, then a top-k.
    """
    low = ascii_lower(F.lit(text))
    lower = ascii_lower(F.col("name"))
    hits = graph.symbols.filter(lower.contains(low)) if text else graph.symbols.filter(F.lit(False))
    order = [~F.col("_lower").startswith(low), "_lower", "name", "symbol_id"]
    names = hits.groupBy("name").agg(F.min("symbol_id").alias("symbol_id")).withColumn("_lower", ascii_lower(F.col("name")))
    top = names.orderBy(*order).limit(limit)  # the rest of a symbol is looked up for these only
    found = graph.symbols.select("symbol_id", "kind", "file_path", "start_line").join(F.broadcast(top), "symbol_id").orderBy(*order)
    return found.select("name", kind_label(F.col("kind")).alias("kind"), F.col("file_path").alias("file"), F.col("start_line").alias("line"), (~F.col("_lower").startswith(low)).cast("int").alias("tier"), F.col("_lower").alias("lower"))


def search_prefix(graph: Graph, text: str, limit: int = 20) -> DataFrame:
    return search(graph, text, limit).filter("tier = 0")


def file_tree(graph: Graph) -> DataFrame:
    """path, name and ord (the first symbol's id) of every file."""
    return graph.symbols.groupBy(F.col("file_path").alias("path")).agg(F.min("symbol_id").alias("ord")).select("ord", "path", base_name(F.col("path")).alias("name"))


def file_symbols(graph: Graph, path: str) -> DataFrame:
    """name, kind, line and symbol_id of a file's symbols: of the file of exactly this path, else of the first that holds it.

    Which file is meant is found by one combined minimum over the distinct files, and joined back as one row.
    """
    plain = path.replace("\\", "/")
    files = graph.symbols.groupBy("file_path").agg(F.min("symbol_id").alias("ord"))
    holds = F.replace(F.col("file_path"), F.lit("\\"), F.lit("/")).contains(plain)
    meant = files.filter((F.col("file_path") == path) | holds).agg(F.min_by("file_path", F.struct(F.col("file_path") != path, F.col("ord"))).alias("_meant"))
    rows = graph.symbols.join(F.broadcast(meant), F.col("file_path") == F.col("_meant"))
    return rows.select("symbol_id", "name", kind_label(F.col("kind")).alias("kind"), F.col("start_line").alias("line"))


def language_counts(files: DataFrame, path: str = "path") -> DataFrame:
    """language and n of files by extension, without files of no language."""
    return files.select(language_of(F.col(path)).alias("language")).filter("language <> ''").groupBy("language").agg(F.count("*").alias("n"))


def to_json_array(df: DataFrame, order: list[str], columns: list[str]) -> str:
    """A bounded result (a top-k, a file's symbols) as one JSON array."""
    rows = df.orderBy(*order).select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("j")).collect()
    return "[" + ",".join(r["j"] for r in rows) + "]"
