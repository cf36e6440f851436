"""Traversal, smart query, search and snippets against plain models, and the store's changes."""

import json
from collections import deque

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lodestone.functions import model as M
from lodestone.operators import lookup, search, smart, snippet, traverse
from lodestone.plans.store import Graph

LETTERS = "abcdefgh"


def make(spark, symbols, edges):
    """symbols: (name, kind, file, start, end); edges: (src, dst, file, relation). Ids are places from 1 on."""
    s = [(i, n, k, f, a, b, None, None) for i, (n, k, f, a, b) in enumerate(symbols, 1)]
    e = [(i, a, b, f, r) for i, (a, b, f, r) in enumerate(edges, 1)]
    return Graph(spark.createDataFrame(s, M.SYMBOL_SCHEMA), spark.createDataFrame(e, M.EDGE_SCHEMA))


def walk(edges, start, depth, mask, reverse, cap=M.VISIT_CAP):
    """A queue over edges in order of id."""
    seen, queue, out = {start}, deque([(start, 0)]), []
    while queue and depth > 0:
        name, d = queue.popleft()
        for a, b, _, r in edges:
            if (b if reverse else a) != name or (mask and not mask >> r & 1):
                continue
            other = a if reverse else b
            if other in seen:
                continue
            if len(seen) >= cap:
                return out
            seen.add(other)
            out.append((other, r ^ 1 if reverse else r, d + 1))
            if d + 1 < depth:
                queue.append((other, d + 1))
    return out


edge = st.tuples(st.sampled_from(LETTERS), st.sampled_from(LETTERS), st.just("f"), st.sampled_from([0, 2, 4, 8, 10, 12]))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(edges=st.lists(edge, max_size=40), depth=st.integers(0, 3), mask=st.sampled_from([0, M.SEMANTIC_RELATIONS, 1 << 8, 1 << 9]), reverse=st.booleans(), cap=st.sampled_from([4, M.VISIT_CAP]))
def test_traversal_is_a_queue(spark, edges, depth, mask, reverse, cap):
    graph = make(spark, [(n, 0, "f", 1, 2) for n in LETTERS], edges)
    got = [(r["name"], r["relation"], r["depth"]) for r in traverse.related_names(graph, "a", depth, mask, reverse, cap).orderBy("ord").collect()]
    assert got == walk(edges, "a", depth, mask, reverse, cap)


def test_names_without_symbols_are_related_but_not_symbols(spark):
    graph = make(spark, [("a", 0, "f", 1, 9), ("b", 1, "f", 1, 9), ("b", 2, "g", 3, 4)], [("a", "x", "f", 8), ("a", "b", "f", 8), ("x", "b", "f", 0)])
    names, symbols = traverse.query(graph, "a", 2)
    assert [r["name"] for r in names.orderBy("ord").collect()] == ["x", "b"]
    assert [(r["name"], r["kind"], r["file_path"]) for r in symbols.collect()] == [("b", "ClassNode", "f")]
    assert {(r["name"], r["depth"]) for r in traverse.min_depths(graph, "a", 3).collect()} == {("x", 1), ("b", 1)}


def test_smart_query_quirks(spark):
    # One lead: phase 1 adds it again, and what is behind it.
    graph = make(spark, [("a", 2, "f", 1, 50), ("b", 0, "f", 1, 50), ("c", 0, "f", 1, 400), ("d", 0, "f", 1, 3)], [("a", "b", "f", 0), ("b", "c", "f", 8), ("b", "d", "f", 8)])
    found = smart.smart_query(graph, "a")
    assert [r["name"] for r in found.related.orderBy("step", "ord").collect()] == ["b", "c", "d"]
    assert [r["name"] for r in found.related_symbols.orderBy("step", "ord").collect()] == ["b", "b", "d"]  # c is too long
    d = found.density.first()
    assert (d["weighted_score"], d["edge_type_count"], d["sufficient"], d["expansions_used"]) == (6.0, 2, True, 1)
    assert [r["name"] for r in smart.smart_query(graph, "a", dedupe=True).related_symbols.orderBy("step", "ord").collect()] == ["b", "d"]
    none = smart.smart_query(graph, "nothing").density.first()
    assert (none["weighted_score"], none["edge_type_count"], none["expansions_used"]) == (0.0, 0, 1)
    # A config without weights gets the default ones.
    assert smart.smart_query(graph, "a", M.DensityConfig(weights={})).density.first()["weighted_score"] == 6.0


def test_short_callers_are_dropped(spark):
    graph = make(spark, [("a", 0, "f", 1, 9), ("b", 0, "f", 1, 3), ("c", 0, "f", 1, 9), ("e", 0, "f", 5, 5)], [("b", "a", "f", 8), ("c", "a", "f", 8), ("e", "a", "f", 8)])
    assert {r["name"] for r in smart.smart_query(graph, "a").related_symbols.collect()} == {"c", "e"}


def test_store_changes(spark):
    graph = make(spark, [("a", 0, "f", 1, 2), ("b", 0, "g", 1, 2), ("a", 1, "g", 1, 2)], [("a", "b", "f", 8), ("b", "a", "g", 8)])
    assert [r["file_path"] for r in lookup.lookup(graph, "a").collect()] == ["f", "g"]
    gone = graph.without_files(["f"])
    assert gone.symbols.count() == 2 and gone.edges.count() == 1
    assert json.loads(search.to_json_array(search.search(gone, "A"), ["tier", "lower", "name"], ["name", "kind"])) == [{"name": "a", "kind": "ClassNode"}]
    again = graph.reindexed(gone)
    assert [(r["symbol_id"], r["file_path"]) for r in again.symbols.orderBy("symbol_id").collect()] == [(1, "f"), (2, "g"), (3, "g")]
    assert graph.without_files([]).symbols.count() == 3
    empty = Graph.empty(spark)
    assert [r["symbol_id"] for r in empty.plus(gone).symbols.orderBy("symbol_id").collect()] == [1, 2]


def test_written_graph_reads_back(spark, tmp_path):
    graph = make(spark, [("a", 0, "f", 1, 2), ("b", 0, "g", 1, 2)], [("a", "b", "f", 8), ("b", "a", "g", 0)])
    graph.write(str(tmp_path / "g"))
    for reverse in (False, True):
        back = Graph.read(spark, str(tmp_path / "g"), reverse)
        assert sorted(map(tuple, back.edges.collect())) == sorted(map(tuple, graph.edges.collect()))
    plan = traverse.related_names(Graph.read(spark, str(tmp_path / "g")), "a", 1, 1 << 8)
    assert [r["name"] for r in plan.collect()] == ["b"]


def model_search(names, text, limit):
    low = text.lower()
    hits = sorted((not n.lower().startswith(low), n.lower(), n) for n in set(names) if low and low in n.lower())
    return [n for _, _, n in hits[:limit]]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(names=st.lists(st.text("abAB", min_size=1, max_size=4), max_size=20), text=st.text("aB", max_size=2), limit=st.integers(1, 6))
def test_search_order(spark, names, text, limit):
    graph = make(spark, [(n, 0, "f", 1, 2) for n in names], [])
    got = [r["name"] for r in search.search(graph, text, limit).orderBy("tier", "lower", "name").collect()]
    assert got == model_search(names, text, limit)


def test_files(spark):
    graph = make(spark, [("src/a.py", 11, "src/a.py", 0, 0), ("x", 0, "src/a.py", 1, 2), ("lib\\b.py", 11, "lib\\b.py", 0, 0)], [])
    assert json.loads(search.to_json_array(search.file_tree(graph), ["ord"], ["path", "name"]))[0] == {"path": "src/a.py", "name": "a.py"}
    assert [r["name"] for r in search.file_symbols(graph, "a.py").orderBy("symbol_id").collect()] == ["src/a.py", "x"]
    assert search.file_symbols(graph, "lib/b").count() == 1 and search.file_symbols(graph, "zzz").count() == 0


def model_snippet(text, target, start, end, radius):
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    lines = lines[max(start, 1) - 1 : max(end, 0)]
    if len(lines) <= 2 * radius + 5:
        return "\n".join(lines), False
    sites = [i for i, line in enumerate(lines) if target + "(" in line]
    if not sites:
        return "\n".join(lines[: 2 * radius]), False
    regions = []
    for c in sites:
        lo, hi = max(0, c - radius), min(len(lines), c + radius + 1)
        if regions and lo <= regions[-1][1]:
            regions[-1][1] = hi
        else:
            regions.append([lo, hi])
    parts = [("// ...\n" if lo else "") + "\n".join(lines[lo:hi]) for lo, hi in regions]
    return "\n".join(parts) + ("\n// ..." if regions[-1][1] < len(lines) else ""), True


def test_snippets(spark):
    import random

    rng = random.Random(3)
    texts = ["", "one", "f(\n" * 30, "\n", "a\r\nf(x)\r\n"]
    texts += ["\n".join(rng.choice(["f(x)", "xf()", "f (", "other", ""]) if rng.random() < 0.3 else f"line {i}" for i in range(rng.randint(0, 40))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for radius, start, end in ((1, 1, 1000), (2, 3, 25), (7, 1, 1000), (1, 0, 30), (3, 9, 5)):
        got = {r["id"]: (r["code"], r["applied"]) for r in snippet.pincer(df, "id", "f", start, end, radius).collect()}
        for i, text in enumerate(texts):
            assert got[i] == model_snippet(text, "f", start, end, radius), (i, radius, start, end, text)
    assert snippet.pincer(spark.createDataFrame([(1, None)], "id int, text string"), "id", "f", 1, 9).first()["code"] == ""


def test_labels_and_masks(spark):
    assert M.SEMANTIC_RELATIONS == 16143 and M.ALL_RELATIONS == 0 and M.relation_bit("Calls") == 256
    assert all(M.RELATIONS[M.inverse(i)] != M.RELATIONS[i] and M.inverse(M.inverse(i)) == i for i in range(14))
    assert len(M.default_weights()) == 20
    for path, want in {"a.H": "cpp", "x.tsx": "tsx", "noext": "", "dir.py/x": "", "q.mjs": "javascript", ".py": "python"}.items():
        assert M.language_of_path(path) == want
        assert spark.range(1).select(M.language_of(M.F.lit(path)).alias("l")).first()["l"] == want


@pytest.mark.parametrize("text,want", [("ÄbC", "Äbc"), ("", "")])
def test_ascii_lower(spark, text, want):
    assert spark.range(1).select(M.ascii_lower(M.F.lit(text)).alias("l")).first()["l"] == want
