"""The registered queries over the code graph that the input tables make."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.cli import clipped
from lodestone.functions.model import KIND, RELATIONS, SEMANTIC_RELATIONS, DensityConfig, inverse_of, kind_label, kind_of_label, language_of, relation_bit, relation_label
from lodestone.operators import density, lookup, search, smart, snippet, traverse
from lodestone.plans.store import Graph
from lodestone.sources.linemap import line_map
from lodestone.sources.projection import graph_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
START = "order_1"
HUB = "db/orders.tbl"


def register(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _symbol_columns(df: DataFrame) -> DataFrame:
    return df.select("ord", "name", "kind", "file_path", "start_line", "end_line", "signature", "relation", "depth")


@register
def lookup_exact(spark, sf_dir):
    return lookup.lookup(graph_of(spark, sf_dir), "order_7")


@register
def lookup_multi(spark, sf_dir):
    """A name that many symbols have, in order of insertion."""
    graph = graph_of(spark, sf_dir)
    many = graph.symbols.filter(F.col("kind") == KIND["Variable"]).groupBy("name").count().orderBy(F.desc("count"), "name").limit(1).select("name")
    return lookup.entries(graph.symbols.join(F.broadcast(many), "name", "left_semi"))


@register
def lookup_opencode(spark, sf_dir):
    """Source lines of all symbols of two names: documents stand for files."""
    files = _table(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id")).alias("name"), "text")
    graph = graph_of(spark, sf_dir)
    wanted = graph.symbols.filter(F.col("name").isin("doc_1", "doc_7")).select("name", "symbol_id", "start_line", "end_line")
    cut = snippet.line_range(wanted.join(files, "name"), F.lit(1), F.col("end_line") - F.col("start_line") + 1)
    return cut.select("symbol_id", "name", (F.col("pos") + 1).cast("long").alias("number"), "line")


@register
def symbol_count(spark, sf_dir):
    return graph_of(spark, sf_dir).symbols.agg(F.count("*").alias("n"))


@register
def symbols_by_kind(spark, sf_dir):
    return lookup.symbols_by_kind(graph_of(spark, sf_dir))


@register
def edges_by_relation(spark, sf_dir):
    return lookup.edges_by_relation(graph_of(spark, sf_dir))


@register
def edges_from(spark, sf_dir):
    return graph_of(spark, sf_dir).edges_from(START).select("edge_id", "src", "dst", "file_path", relation_label(F.col("relation")).alias("relation"))


@register
def edges_to(spark, sf_dir):
    return graph_of(spark, sf_dir).edges_to("NATION_1").select("edge_id", "src", "dst", "file_path", inverse_of(F.col("relation")).alias("inverse"))


@register
def first_symbol_per_name(spark, sf_dir):
    return graph_of(spark, sf_dir).first_symbols().select("name", "symbol_id", F.col("kind").cast("int").alias("kind"), "file_path", "start_line")


@register
def all_symbols(spark, sf_dir):
    return graph_of(spark, sf_dir).symbols.withColumn("kind", F.col("kind").cast("int"))


@register
def all_edges(spark, sf_dir):
    return graph_of(spark, sf_dir).edges.withColumn("relation", F.col("relation").cast("int"))


@register
def kind_round_trip(spark, sf_dir):
    kinds = spark.createDataFrame([(i,) for i in range(len(KIND))], "kind int")
    label = kind_label(F.col("kind"))
    return kinds.select("kind", label.alias("label"), kind_of_label(label).alias("back"))


@register
def relation_bits(spark, sf_dir):
    rows = [(i, relation_bit(i), i ^ 1, bool(SEMANTIC_RELATIONS >> i & 1)) for i in range(len(RELATIONS))]
    made = spark.createDataFrame(rows, "relation int, bit int, inverse int, semantic boolean")
    return made.select("relation", relation_label(F.col("relation")).alias("label"), "bit", "inverse", "semantic")


#: name: start, depth, mask, reverse, and whether names or symbols are returned.
BFS = {
    "bfs_d0": (START, 0, 0, False, "names"),
    "bfs_d1": (START, 1, 0, False, "symbols"),
    "bfs_d2": (START, 2, 0, False, "symbols"),
    "bfs_d3": (START, 3, 0, False, "symbols"),
    "bfs_reverse_d1": ("NATION_1", 1, 0, True, "symbols"),
    "bfs_reverse_d2": ("NATION_1", 2, 0, True, "symbols"),
    "bfs_semantic": ("doc_1", 2, SEMANTIC_RELATIONS, False, "symbols"),
    "bfs_reverse_semantic": ("NATION_1", 2, SEMANTIC_RELATIONS, True, "symbols"),
    "bfs_mask_calls": (START, 2, relation_bit("Calls"), False, "symbols"),
    "bfs_mask_two": (START, 2, relation_bit("Calls") | relation_bit("Inherits"), False, "names"),
    "bfs_mask_inverse_bit_empty": ("NATION_1", 2, relation_bit("HasMember"), True, "names"),
    "bfs_unknown_start": ("no such name", 3, 0, False, "names"),
    "bfs_related_names": (START, 2, 0, False, "names"),
    "bfs_related_symbols": (START, 2, 0, False, "symbols"),
    "bfs_capped": (HUB, 1, 0, True, "names"),
}


def _bfs(start: str, depth: int, mask: int, reverse: bool, what: str) -> Query:
    def run(spark, sf_dir):
        names, symbols = traverse.query(graph_of(spark, sf_dir), start, depth, mask, reverse)
        return names.select("ord", "name", relation_label(F.col("relation")).alias("relation"), "depth") if what == "names" else _symbol_columns(symbols)

    return run


QUERIES |= {name: _bfs(*how) for name, how in BFS.items()}


@register
def reach_min_depth(spark, sf_dir):
    return traverse.min_depths(graph_of(spark, sf_dir), START, 4, SEMANTIC_RELATIONS)


SMART = {"smart": START, "smart_single": "doc_1", "smart_struct": "Customer#000000000", "smart_unknown": "no such name"}


def _smart(start: str, part: str) -> Query:
    def run(spark, sf_dir):
        graph = graph_of(spark, sf_dir)
        found = smart.smart_query(graph, start)
        return found.density if part == "density" else found.related if part == "related" else found.related_symbols

    return run


QUERIES |= {f"{n}_{part}": _smart(start, part) for n, start in SMART.items() for part in ("related", "symbols", "density")}


@register
def smart_own_symbols(spark, sf_dir):
    return smart.smart_query(graph_of(spark, sf_dir), "doc_1").symbols


@register
def density_all_functions(spark, sf_dir):
    return density.density_of_all(graph_of(spark, sf_dir), [KIND["Function"]], mask=SEMANTIC_RELATIONS)


@register
def default_weights(spark, sf_dir):
    return density.weight_table(spark, DensityConfig()).select(F.col("_kind").alias("kind"), F.col("_relation").alias("relation"), "weight")


@register
def goldilocks_filter(spark, sf_dir):
    """Which order symbols fit, as callers."""
    graph = graph_of(spark, sf_dir)
    fits = density.goldilocks(DensityConfig(), F.col("start_line"), F.col("end_line"), F.lit("CalledBy"))
    return graph.symbols.filter(F.col("kind") == KIND["Function"]).filter(fits).select("symbol_id", "name", (F.col("end_line") - F.col("start_line")).alias("length"))


def _search(text: str, limit: int = 20) -> Query:
    return lambda spark, sf_dir: search.search(graph_of(spark, sf_dir), text, limit)


QUERIES |= {"search_prefix": _search("ORDER_1"), "search_substring_fallback": _search("ation"), "search_mixed": _search("r", 60), "search_none": _search("zzzz"), "search_empty": _search("")}


@register
def search_prefix_only(spark, sf_dir):
    return search.search_prefix(graph_of(spark, sf_dir), "doc_2", 50)


@register
def file_tree(spark, sf_dir):
    return search.file_tree(graph_of(spark, sf_dir))


@register
def file_symbols(spark, sf_dir):
    return search.file_symbols(graph_of(spark, sf_dir), "db/nation.tbl")


@register
def file_symbols_partial(spark, sf_dir):
    return search.file_symbols(graph_of(spark, sf_dir), "\\region")


@register
def file_symbols_none(spark, sf_dir):
    return search.file_symbols(graph_of(spark, sf_dir), "no/such/file")


@register
def json_symbols(spark, sf_dir):
    """Each file's symbol count beside one JSON object for its first symbol."""
    graph = graph_of(spark, sf_dir)
    first = F.min_by(F.struct("name", kind_label(F.col("kind")).alias("kind"), F.col("start_line").alias("line")), "symbol_id")
    made = graph.symbols.groupBy("file_path").agg(F.to_json(first).alias("first"), F.count("*").alias("n"))
    back = F.from_json("first", "name string, kind string, line int")
    return made.select("file_path", "n", back["name"].alias("name"), back["kind"].alias("kind"), back["line"].alias("line"))


@register
def detect_lang(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    ends = F.array(*(F.lit(x) for x in (".py", ".H", ".cxx", ".tsx", ".Rs", ".go", ".cs", ".jsx", ".txt", "")))
    path = F.concat(F.replace("url", F.lit("."), F.lit("_")), F.element_at(ends, (F.col("page_id") % 10 + 1).cast("int")))
    return pages.select("page_id", language_of(path).alias("language"))


@register
def lang_stats(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    ends = F.array(*(F.lit(x) for x in (".py", ".h", ".cpp", ".tsx", ".rs", ".txt")))
    return search.language_counts(pages.select(F.concat(F.lit("p"), F.col("page_id"), F.element_at(ends, (F.col("page_id") % 6 + 1).cast("int"))).alias("path")))


def _removed(spark, sf_dir) -> Graph:
    return graph_of(spark, sf_dir).without_files(["db/part.tbl", "db/nation.tbl"])


def _totals(graph: Graph) -> DataFrame:
    symbols = graph.symbols.groupBy("file_path").agg(F.count("*").alias("symbols"))
    edges = graph.edges.groupBy(F.col("file_path").alias("_f")).agg(F.count("*").alias("edges"))
    return symbols.join(edges, F.col("file_path") == F.col("_f"), "full").select(F.coalesce("file_path", "_f").alias("file_path"), F.coalesce("symbols", F.lit(0)).alias("symbols"), F.coalesce("edges", F.lit(0)).alias("edges"))


@register
def remove_file(spark, sf_dir):
    return _totals(_removed(spark, sf_dir))


@register
def remove_file_search(spark, sf_dir):
    """The search sees removals at once."""
    return search.search(_removed(spark, sf_dir), "nation", 30)


@register
def reindex_file(spark, sf_dir):
    """Nation's rows behind all others, once more with a new name each."""
    graph = graph_of(spark, sf_dir)
    own = F.col("file_path") == "db/nation.tbl"
    fresh = Graph(graph.symbols.filter(own).withColumn("name", F.concat("name", F.lit("_v2"))), graph.edges.filter(own).withColumn("src", F.concat("src", F.lit("_v2"))))
    done = graph.reindexed(fresh)
    return done.symbols.filter(own).select("symbol_id", "name", F.col("kind").cast("int").alias("kind"))


@register
def index_twice(spark, sf_dir):
    """Indexing is additive: a file given twice has its rows twice."""
    graph = graph_of(spark, sf_dir)
    own = F.col("file_path") == "db/supplier.tbl"
    return _totals(graph.plus(Graph(graph.symbols.filter(own), graph.edges.filter(own))))


@register
def include_edges_pages(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    return pages.select(F.col("url").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("n"))


@register
def call_edges_pages(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    return pages.select(F.col("url").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\("), F.lit(1))).alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("n"))


@register
def distinct_sorted_calls(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    calls = F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\("), F.lit(1))))
    return pages.select("page_id", F.array_join(calls, ",").alias("calls"), F.size(calls).cast("long").alias("n"))


@register
def snippet_lines(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return snippet.line_range(docs, 3, 9).select("doc_id", F.col("pos").cast("long").alias("pos"), "line")


def _sites(spark, sf_dir, radius: int) -> DataFrame:
    """Documents have no calls, so blanks after a common word stand for the bracket."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("the "), F.lit("the(")).alias("text"))
    return snippet.windows(snippet.line_range(docs, 1, 1 << 30), "doc_id", "the", radius)


@register
def snippet_windows(spark, sf_dir):
    return _sites(spark, sf_dir, 1).select("doc_id", F.col("c").cast("long").alias("c"), F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))


@register
def snippet_merged_regions(spark, sf_dir):
    return snippet.regions(_sites(spark, sf_dir, 1), "doc_id").select("doc_id", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))


@register
def snippet_text(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("the "), F.lit("the(")).alias("text"))
    return snippet.pincer(docs, "doc_id", "the", 1, 1 << 30, 1)


@register
def snippet_signature_clip(spark, sf_dir):
    """Signatures cut to 20 characters, as the console shows them."""
    graph = graph_of(spark, sf_dir)
    text = F.concat_ws(" ", "name", "parent_class", "signature")
    return graph.symbols.filter(F.col("kind") == KIND["Struct"]).select("symbol_id", clipped(text, F.lit(20)).alias("shown"))


@register
def line_remap(spark, sf_dir):
    """Preprocessor output with markers '# line "file"' at every fifth line: the line each line came from."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    every = docs.select("doc_id", F.posexplode("l").alias("pos", "line"))
    marked = every.withColumn("line", F.when(F.col("pos") % 5 == 0, F.concat(F.lit("# "), (F.col("pos") * 10 + 1).cast("string"), F.lit(' "f'), (F.col("pos") % 2).cast("string"), F.lit('.c"'))).otherwise(F.col("line")))
    return line_map(marked, "doc_id", "pos", "line").select("doc_id", F.col("pos").cast("long").alias("pos"), "file", F.col("original").cast("long").alias("original"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["bfs_d2"](spark, sf_dir)
