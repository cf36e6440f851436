"""Steps that grew faster than their input: what is made, and by how many exchanges."""

from pyspark.sql import functions as F

from lodestone.operators import search, traverse
from lodestone.plans.numbering import numbered, stored
from lodestone.plans.store import Graph
from lodestone.samples import SAMPLES, sample_files
from lodestone.sources.extract.lex import C, lex
from lodestone.sources.files import extract_rows
from lodestone.sources.projection import ORDER, Projection, graph_of


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbers_are_dense_and_rows_are_dealt_once(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 500).alias("a"), F.lit("x").alias("b"))
    made = numbered(rows, ["a", "b"], "n")
    assert "row_number" not in _plan(made)  # places come from the sort, without an exchange of their own
    found = [(r["a"], r["n"]) for r in made.orderBy("n").collect()]
    assert found == [(i // 2, i + 1) for i in range(1000)]


def test_rows_that_tie_are_one_if_distinct(spark):
    rows = spark.createDataFrame([("b", "1"), (None, "1"), ("a", None), ("a", "2"), ("b", "1"), ("a", None), (None, "1")], "a string, b string")
    made = numbered(rows, ["a", "b"], "n", keep=stored, rows=7, distinct=True)
    assert [tuple(r) for r in made.orderBy("n").collect()] == [(1, None, "1"), (2, "a", None), (3, "a", "2"), (4, "b", "1")]
    assert numbered(rows.limit(0), ["a", "b"], "n", keep=stored, distinct=True).count() == 0


def test_symbols_are_made_without_edges(spark, sf_dir):
    graph = Projection(spark, sf_dir)
    assert graph.symbols.count() > 0 and "edges" not in vars(graph)


def test_edges_have_whole_names(spark, sf_dir):
    edges = graph_of(spark, sf_dir).edges
    orders = edges.filter("file_path = 'db/orders.tbl' and src not like 'db/%'")
    assert orders.count() > 0 and orders.filter(~F.col("src").rlike(f"^{ORDER}[0-9]+$")).count() == 0
    assert edges.count() == edges.select("src", "dst", "file_path", "relation").distinct().count() == edges.agg(F.max("edge_id")).first()[0]


def test_first_symbols_need_no_sort(spark):
    rows = [(i, f"n{i % 3}", i % 5, "f", i, i, None, None) for i in range(1, 20)] + [(20, None, 0, "f", 0, 0, "s", "p")]
    symbols = spark.createDataFrame(rows, "symbol_id long, name string, kind int, file_path string, start_line int, end_line int, signature string, parent_class string")
    first = Graph(symbols, symbols).first_symbols()
    assert "SortAggregate" not in _plan(first)
    assert sorted((r["symbol_id"], r["name"] or "") for r in first.collect()) == [(1, "n1"), (2, "n2"), (3, "n0"), (20, "")]
    assert "SortAggregate" not in _plan(search.search(Graph(symbols, symbols), "n"))
    assert [(r["name"], r["line"]) for r in search.search(Graph(symbols, symbols), "N", 2).collect()] == [("n0", 3), ("n1", 1)]


def test_least_depths_by_either_join(spark):
    edges = spark.createDataFrame([(i, f"v{i % 17}", f"v{i * 5 % 17}", "f", 0) for i in range(60)] + [(60, "a", "v1", "f", 0)], "edge_id long, src string, dst string, file_path string, relation int")
    sent, dealt = (sorted(tuple(r) for r in traverse.min_depths(Graph(edges, edges), "a", 4, sent=n).collect()) for n in (100, 0))
    assert sent == dealt and sent[0][1] > 0


def test_only_the_files_rows_are_sent_if_wanted(spark):
    files = sample_files(spark, list(SAMPLES))
    sent, every = extract_rows(files, files_only=True), extract_rows(files)
    assert sorted(map(tuple, sent.collect())) == sorted(map(tuple, every.filter("emit_ord = 0").collect()))


def test_blanks_before_tokens_change_no_place():
    text = "\t #define A \\\n 1\n  int\t a ; // b\n /* c\n */ #x \t \n"
    assert [(t.kind, t.text, t.start, t.line) for t in lex(text, C)] == [
        ("directive", "#define A \\\n 1", 2, 1), ("name", "int", 19, 3), ("name", "a", 24, 3), ("punct", ";", 26, 3), ("punct", "#", 43, 5), ("name", "x", 44, 5),
    ]
    assert lex(" \t ", C) == []
