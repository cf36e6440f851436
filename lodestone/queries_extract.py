"""Registered queries over source files: each construct that is extracted, and the engine and command line over all of them."""

from __future__ import annotations

import contextlib
import io
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import cli
from lodestone.engine import Engine
from lodestone.functions.model import base_name, kind_label, language_of, relation_label, report_label
from lodestone.operators import lookup
from lodestone.plans.shared import plain_path, scratch, write_files
from lodestone.samples import SAMPLES, sample_files
from lodestone.sources.files import collect_files, extract_rows, index_files, read_files
from lodestone.sources.linemap import MSVC, line_map
from lodestone.sources.preprocess import PreprocessConfig, command, detect_compiler, normalized, split_output

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: The samples in the order of their files' names, which is that of a listing.
IN_ORDER = sorted(SAMPLES, key=lambda n: SAMPLES[n][0])


def register(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _named(rows: DataFrame) -> DataFrame:
    kind = F.regexp_replace(kind_label(F.col("kind")), "Node$", "")
    # A struct's label is that of a class; rows keep the kinds apart.
    kind = F.when(F.col("kind") == 2, F.lit("Struct")).otherwise(kind)
    return rows.select("file_path", F.col("emit_ord").alias("n"), "row_type", "name", F.when(F.col("row_type") == "S", kind).alias("kind"), "start_line", "end_line", "signature", "parent_class", "src", F.when(F.col("row_type") == "E", relation_label(F.col("relation"))).alias("relation"), "dst")


def _extract(name: str) -> Query:
    return lambda spark, sf_dir: _named(extract_rows(sample_files(spark, [name])))


QUERIES |= {f"extract_{name}": _extract(name) for name in SAMPLES}


def _folder(spark: SparkSession) -> str:
    """The samples as files, beside some that a listing passes over."""
    uri = scratch(spark, "samples")
    passed = {"node_modules/x.js": "var a", ".hidden/y.py": "b = 1", "build/z.c": "int c;", "notes.txt": "no source", "deep/er/more.py": "def deeper(): pass\n"}
    write_files(spark, uri, {path: text for path, text in SAMPLES.values()} | passed)
    return plain_path(uri)


def _files(spark: SparkSession) -> list[str]:
    folder = _folder(spark)
    return [f"{folder}/{SAMPLES[n][0]}" for n in IN_ORDER]


@register
def collect_folder(spark, sf_dir):
    """What a listing of a folder finds, in order."""
    folder = _folder(spark)
    found = collect_files([folder, f"{folder}/node_modules/x.js"])
    return spark.createDataFrame([(i, p.removeprefix(folder + "/")) for i, p in enumerate(found)], "ord long, path string")


@register
def read_sources(spark, sf_dir):
    """Supported files as bytes; one that isn't there and one of no language are left out, one given twice is there twice."""
    files = _files(spark)
    folder = files[0].rpartition("/")[0]
    read = read_files(spark, [*files, f"{folder}/gone.py", f"{folder}/notes.txt", files[0]])
    return read.select("file_ord", base_name(F.col("file_path")).alias("path"), "lang", F.octet_length("content").cast("long").alias("bytes"))


@register
def index_symbols(spark, sf_dir):
    """Symbols of an index of all samples."""
    graph, _ = index_files(spark, _files(spark))
    return graph.symbols.select("symbol_id", F.when(F.col("kind") == 11, base_name(F.col("name"))).otherwise(F.col("name")).alias("name"), F.col("kind").cast("int").alias("kind"), base_name(F.col("file_path")).alias("file"), "start_line", "end_line", "signature", "parent_class")


def _short(name: str):
    return F.when(F.col(name).endswith(base_name(F.col("file_path"))), base_name(F.col(name))).otherwise(F.col(name)).alias(name)


@register
def index_edges(spark, sf_dir):
    """Edges of an index of all samples."""
    graph, _ = index_files(spark, _files(spark))
    return graph.edges.select("edge_id", _short("src"), _short("dst"), base_name(F.col("file_path")).alias("file"), F.col("relation").cast("int").alias("relation"))


@register
def report_labels(spark, sf_dir):
    """Files by the labels that reports give them."""
    paths = spark.createDataFrame([(p,) for p, _ in SAMPLES.values()] + [("a.h",), ("b.hpp",), ("c.jsx",), ("notes.txt",), ("Makefile",)], "path string")
    return paths.select(report_label(F.col("path")).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@register
def name_statistics(spark, sf_dir):
    """How many distinct names an index has, and their bytes."""
    graph, _ = index_files(spark, [f for f in _files(spark) if f.endswith("cs_method.cs")])
    return lookup.name_statistics(graph, lambda c: base_name(c))


_engines: dict[str, tuple[Engine, list[str]]] = {}


def _engine(spark: SparkSession, run: Callable[[Engine, list[str]], list[tuple]], schema: str) -> DataFrame:
    """What run() finds in an index of the Python and Go samples, which a session makes once."""
    key = spark.sparkContext.applicationId
    if key not in _engines:
        files = [f for f in _files(spark) if f.endswith((".py", ".go"))]
        engine = Engine(spark).initialize()
        engine.index_files(files)
        _engines[key] = engine, files
    return spark.createDataFrame(run(*_engines[key]), schema)


def _path(files: list[str], name: str) -> str:
    return next(f for f in files if f.endswith("/" + name))


def _dir(files: list[str]) -> str:
    return files[0].rpartition("/")[0] + "/"


@register
def engine_index(spark, sf_dir):
    """Counts after an index, the same index again, a reindex of a file, a removal and an update."""

    def run(whole: Engine, files: list[str]) -> list[tuple]:
        counts = [("index", whole.symbol_count())]
        again = [_path(files, "go_var.go")]
        engine = Engine(spark)
        engine.graph = whole.graph
        for name, change in (("again", engine.index_files), ("reindex", engine.reindex_files), ("remove", engine.remove_files)):
            change(again)
            counts.append((name, engine.symbol_count()))
        engine.index_files(again)
        engine.update()
        counts.append(("update", engine.symbol_count()))
        return counts

    return _engine(spark, run, "step string, symbols long")


@register
def engine_file_symbols(spark, sf_dir):
    return _engine(spark, lambda e, f: [(r["name"].removeprefix(_dir(f)), r["kind"], r["line"]) for r in json.loads(e.get_file_symbols("go_type.go"))], "name string, kind string, line int")


@register
def engine_file_tree(spark, sf_dir):
    return _engine(spark, lambda e, f: [(i, r["path"].removeprefix(_dir(f)), r["name"]) for i, r in enumerate(json.loads(e.get_file_tree()))], "ord int, path string, name string")


@register
def engine_search(spark, sf_dir):
    return _engine(spark, lambda e, f: [(i, r["name"].removeprefix(_dir(f)), r["kind"], r["file"].removeprefix(_dir(f)), r["line"]) for i, r in enumerate(json.loads(e.search_symbols("s", 12)))], "ord int, name string, kind string, file string, line int")


@register
def engine_query(spark, sf_dir):
    """What a method leads to in one step, in order."""
    return _engine(spark, lambda e, f: [(i, r.removeprefix(_dir(f))) for i, r in enumerate(e.query("Push", 1).related)], "ord int, name string")


@register
def engine_repr(spark, sf_dir):
    """How results show themselves."""

    def run(e: Engine, f: list[str]) -> list[tuple]:
        return [(repr(e.lookup("Push")[0]).replace(_dir(f), ""),), *((repr(r),) for r in e.query("side", 1).related_symbols if r.kind == "ClassNode")]

    return _engine(spark, run, "shown string")


@register
def engine_pincer(spark, sf_dir):
    """A snippet of a file around its calls."""
    uri = scratch(spark, "snippet")
    write_files(spark, uri, {"long.py": "".join(f"line{i}\n" if i != 20 else "    target(1)\n" for i in range(1, 41))})
    found = Engine.pincer_extract(spark, plain_path(uri) + "/long.py", 3, 38, "target", 2)
    return spark.createDataFrame([(found.start_line, found.end_line, found.code, found.pincer_applied)], "start_line int, end_line int, code string, applied boolean")


@register
def engine_opencode(spark, sf_dir):
    return _engine(spark, lambda e, f: [(n, line) for _, lines in e.opencode("area") for n, line in lines], "number int, line string")


def _printed(spark: SparkSession, *argv: str) -> DataFrame:
    """The lines that a command prints about the Python and Go samples, without their folder and times."""
    files = [f for f in _files(spark) if f.endswith((".py", ".go"))]
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        cli.main([a.replace("@", _dir(files)) for a in argv] + (["--path"] if argv[0] not in ("index", "repl") else []) + files)
    lines = [x.replace(_dir(files), "").split(" in ")[0].rstrip() for x in out.getvalue().splitlines()]
    return spark.createDataFrame(list(enumerate(lines)), "n int, line string")


CLI = {
    "cli_index": ("index",),
    "cli_query": ("query", "Push", "--depth", "1"),
    "cli_lookup": ("lookup", "Push"),
    "cli_search": ("search", "sha", "--limit", "5"),
    "cli_symbols": ("symbols", "@go_method.go"),
    "cli_opencode": ("opencode", "area"),
}
QUERIES |= {name: (lambda argv: lambda spark, sf_dir: _printed(spark, *argv))(argv) for name, argv in CLI.items()}


@register
def clipped_signatures(spark, sf_dir):
    """What the console shows of long texts."""
    texts = spark.createDataFrame([("a" * n, most) for n in (99, 100, 101, 120, 121, 300) for most in (100, 120)], "text string, most int")
    return texts.select(F.length("text").alias("length"), "most", cli.clipped(F.col("text"), F.col("most")).alias("shown"))


@register
def msvc_markers(spark, sf_dir):
    """Lines of a preprocessor of the other kind, and where they came from."""
    text = ['#line 1 "a.c"', "int a;", "int b;", '#line 10 "dir/b.h"', "int c;", '#line 3 "a.c"', "int d;"]
    lines = spark.createDataFrame([("u", i, t) for i, t in enumerate(text)], "unit string, pos int, line string")
    return line_map(lines, "unit", "pos", "line", MSVC).select("pos", "line", "file", F.col("original").cast("long").alias("original"))


@register
def preprocessor_commands(spark, sf_dir):
    config = PreprocessConfig(True, ("inc", "a b"), ("X=1",), ("-w",))
    made = [(c, lang, " ".join(command(c, f"bundle.{lang}", lang, config))) for c in ("gcc", "clang", "cl.exe") for lang in ("c", "cpp")]
    return spark.createDataFrame(made, "compiler string, lang string, command string")


@register
def preprocessor_output(spark, sf_dir):
    """A batch's output dealt to its files, with the line that each line came from."""
    output = '# 1 "bundle.c"\n# 1 "/s/a.c" 1\nint a;\n\n# 5 "/usr/include/x.h" 2\nhidden;\n# 7 "/s/a.c" 2\nint b;\n# 2 "/s/b.c"\nint c;\n'
    made = [(path, i, line, n) for path, (text, numbers) in sorted(split_output(output, {"/s/a.c", "/s/b.c"}).items()) for i, (line, n) in enumerate(zip(text.split("\n"), numbers, strict=False))]
    return spark.createDataFrame(made, "path string, pos int, line string, original int")


@register
def normalized_paths(spark, sf_dir):
    paths = ["a\\b\\c.h", "a/b/c.h", "C:\\x y\\z.cpp", ""]
    kinds = detect_compiler(windows=False) in ("gcc", "clang", "")
    return spark.createDataFrame([(p, normalized(p), kinds) for p in paths], "path string, shown string, known_compiler boolean")


@register
def extract_all_statuses(spark, sf_dir):
    """How the extraction of every sample, and of documents taken for sources, went: errors stay with their file."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ends = F.array(*(F.lit(x) for x in ("c", "cpp", "py", "java", "js", "ts", "tsx", "rs", "go", "cs")))
    path = F.concat(F.lit("doc"), F.col("doc_id"), F.lit("."), F.element_at(ends, (F.col("doc_id") % 10 + 1).cast("int")))
    files = docs.select(F.col("doc_id").alias("file_ord"), path.alias("file_path"), F.col("text").cast("binary").alias("content")).withColumn("lang", language_of(F.col("file_path")))
    rows = extract_rows(files.select("file_ord", "file_path", "lang", "content"), files_only=True)
    return rows.filter("emit_ord = 0").select("file_ord", F.col("name").alias("path"), F.col("kind").cast("int").alias("kind"), "start_line")
