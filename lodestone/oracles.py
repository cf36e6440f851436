"""DuckDB SQL for the registered queries over the code graph, written apart from the Spark code."""

from __future__ import annotations

from lodestone.functions.model import KIND, KIND_LABELS, RELATIONS, SEMANTIC_RELATIONS, WEIGHTS
from lodestone.functions.model import RELATION as R
from lodestone.queries import BFS, SMART

ORACLES: dict[str, str] = {}

LABELS = ", ".join(f"({k}, '{v}')" for k, v in KIND_LABELS.items())
NAMES = ", ".join(f"({i}, '{n}')" for i, n in enumerate(RELATIONS))

GRAPH = f"""
WITH kinds(kind, label) AS (VALUES {LABELS}),
relations(relation, label) AS (VALUES {NAMES}),
files(ord, path) AS (VALUES (0, 'db/region.tbl'), (1, 'db/nation.tbl'), (2, 'db/customer.tbl'), (3, 'db/supplier.tbl'), (4, 'db/part.tbl'), (5, 'db/orders.tbl'), (6, 'db/documents.tbl')),
includes(ord, src, dst) AS (VALUES (1, 'db/nation.tbl', 'db/region.tbl'), (2, 'db/customer.tbl', 'db/nation.tbl'), (3, 'db/supplier.tbl', 'db/nation.tbl'),
  (5, 'db/orders.tbl', 'db/customer.tbl'), (5, 'db/orders.tbl', 'db/part.tbl'), (5, 'db/orders.tbl', 'db/supplier.tbl')),
raw(ord, sub, key, name, kind, file_path, a, len, signature, parent_class) AS (
  SELECT ord, -2, 0, path, 11, path, 0, 0, NULL, NULL FROM files
  UNION ALL SELECT ord, -1, 0, dst, 7, src, 1, 0, NULL, NULL FROM includes
  UNION ALL SELECT 0, 0, r_regionkey, r_name, 8, 'db/region.tbl', r_regionkey + 1, 0, NULL, NULL FROM region
  UNION ALL SELECT 1, 0, n_nationkey, n_name, 1, 'db/nation.tbl', n_nationkey + 1, n_nationkey % 7, NULL, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 2, 0, c_custkey, c_name, 2, 'db/customer.tbl', c_custkey + 1, c_custkey % 300, c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 3, 0, s_suppkey, s_name, 10, 'db/supplier.tbl', s_suppkey + 1, s_suppkey % 10, NULL, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 4, 0, p_partkey, p_name, 4, 'db/part.tbl', p_partkey + 1, p_size, p_type, p_brand FROM part
  UNION ALL SELECT 5, 0, o_orderkey, 'order_' || o_orderkey, 0, 'db/orders.tbl', o_orderkey + 1, o_orderkey % 250, o_orderpriority, c_name FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT DISTINCT 6, 1, 0, source, 8, 'db/documents.tbl', 1, 0, NULL, NULL FROM documents
  UNION ALL SELECT DISTINCT 6, 2, 0, lang, 3, 'db/documents.tbl', 1, 0, NULL, NULL FROM documents
  UNION ALL SELECT 6, 3, doc_id, 'doc_' || doc_id, 0, 'db/documents.tbl', doc_id + 1, n_chars % 400, lang, source FROM documents),
symbols AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY ord, sub, key, name) AS symbol_id, name, kind, file_path, a::INT AS start_line, (a + len)::INT AS end_line, signature::VARCHAR AS signature, parent_class::VARCHAR AS parent_class FROM raw),
ways(relation, file_path, src, dst) AS (
  SELECT {R['Inherits']}, 'db/part.tbl', p_name, p_brand FROM part
  UNION SELECT {R['MemberOf']}, 'db/nation.tbl', n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION SELECT {R['MemberOf']}, 'db/customer.tbl', c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION SELECT {R['MemberOf']}, 'db/supplier.tbl', s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION SELECT {R['MemberOf']}, 'db/documents.tbl', 'doc_' || doc_id, source FROM documents
  UNION SELECT {R['DefinedIn']}, file_path, name, file_path FROM raw WHERE kind NOT IN (7, 11)
  UNION SELECT {R['Includes']}, src, src, dst FROM includes
  UNION SELECT {R['Calls']}, 'db/orders.tbl', 'order_' || l_orderkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey
  UNION SELECT {R['Returns']}, 'db/orders.tbl', 'order_' || l_orderkey, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  UNION SELECT {R['TypedAs']}, 'db/orders.tbl', 'order_' || o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey
  UNION SELECT {R['TypedAs']}, 'db/documents.tbl', source, lang FROM documents),
edges AS MATERIALIZED (SELECT row_number() OVER (ORDER BY relation, file_path, src, dst) AS edge_id, src, dst, file_path, relation FROM ways),
first_symbols AS MATERIALIZED (
  SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY symbol_id) AS n FROM symbols) WHERE n = 1)
"""

ENTRY = "symbol_id, label AS kind, name, coalesce(parent_class, '') AS parent_class, file_path, start_line, end_line, coalesce(signature, '') AS signature"


def graph(sql: str, more: str = "") -> str:
    return f"{GRAPH}{',' + more if more else ''}\n{sql}"


def bfs(start: str, depth: int, mask: int, reverse: bool, tag: str = "", cap: int = 9999) -> str:
    """CTEs that end in <tag>found(ord, name, relation, depth): the levels of a queue, unrolled."""
    here, there = ("dst", "src") if reverse else ("src", "dst")
    ctes = [f"{tag}l0(n, rel, rk) AS (SELECT '{start}', -1, 0)"]
    for d in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT n FROM {tag}l{k}" for k in range(d))
        test = f" AND (1 << e.relation) & {mask} <> 0" if mask else ""
        ctes.append(
            f"{tag}c{d} AS (SELECT e.{there} AS n, e.relation AS rel, e.edge_id AS eid, l.rk AS prk, row_number() OVER (PARTITION BY e.{there} ORDER BY l.rk, e.edge_id) AS o "
            f"FROM {tag}l{d - 1} l JOIN edges e ON e.{here} = l.n WHERE e.{there} NOT IN ({seen}){test})"
        )
        ctes.append(f"{tag}l{d} AS (SELECT n, rel, row_number() OVER (ORDER BY prk, eid) AS rk FROM {tag}c{d} WHERE o = 1)")
    levels = " UNION ALL ".join(f"SELECT {d} AS depth, n, rel, rk FROM {tag}l{d}" for d in range(1, depth + 1)) or f"SELECT 1 AS depth, n, rel, rk FROM {tag}l0 WHERE false"
    rel = "xor(rel::INT, 1)" if reverse else "rel"
    ctes.append(f"{tag}found AS (SELECT row_number() OVER (ORDER BY depth, rk) AS ord, n AS name, {rel} AS relation, depth FROM ({levels}) ORDER BY depth, rk LIMIT {cap})")
    return ", ".join(ctes)


RELATED = "name, k.label AS kind, file_path, start_line, end_line, coalesce(signature, '') AS signature, r.label AS relation, depth"

for _name, (_start, _depth, _mask, _reverse, _what) in BFS.items():
    _ctes = bfs(_start, _depth, _mask, _reverse)
    ORACLES[_name] = (
        graph("SELECT ord, name, label AS relation, depth FROM found JOIN relations USING (relation)", _ctes)
        if _what == "names"
        else graph(f"SELECT ord, {RELATED} FROM found f JOIN first_symbols s USING (name) JOIN kinds k USING (kind) JOIN relations r ON r.relation = f.relation", _ctes)
    )

ORACLES["reach_min_depth"] = graph(
    "SELECT name, min(depth)::INT AS depth FROM reach WHERE name <> 'order_1' GROUP BY name",
    f"reach(name, depth) AS (WITH RECURSIVE w(name, depth) AS (SELECT 'order_1', 0 UNION SELECT e.dst, depth + 1 FROM w JOIN edges e ON e.src = w.name WHERE depth < 4 AND (1 << e.relation) & {SEMANTIC_RELATIONS} <> 0) SELECT * FROM w)",
)

_WEIGHTS = ", ".join(f"({KIND[k]}, {R[r]}, {w}.0::DOUBLE)" for k, row in WEIGHTS.items() for r, w in row.items())


def smart(start: str, part: str) -> str:
    ctes = ", ".join(
        [bfs(start, d, SEMANTIC_RELATIONS, back, tag) for tag, d, back in (("a", 1, False), ("b", 1, True), ("x", 2, False), ("y", 2, True))]
        + [
            "base AS (SELECT 0 AS step, * FROM afound UNION ALL SELECT 1, * FROM bfound)",
            "leads AS (SELECT count(*) AS n FROM base JOIN first_symbols USING (name))",
            "every AS (SELECT * FROM base UNION ALL SELECT 2, xfound.* FROM xfound, leads WHERE n = 1 UNION ALL SELECT 3, yfound.* FROM yfound, leads WHERE n = 1)",
            f"kept AS (SELECT step, ord, {RELATED}, f.relation AS rel FROM every f JOIN first_symbols s USING (name) JOIN kinds k USING (kind) JOIN relations r ON r.relation = f.relation "
            "WHERE end_line - start_line <= 0 OR NOT (end_line - start_line > 200 OR (r.label = 'CalledBy' AND end_line - start_line < 5)))",
            f"weights(kind, relation, w) AS (VALUES {_WEIGHTS})",
            f"own AS (SELECT coalesce((SELECT CASE kind WHEN 2 THEN 1 ELSE kind END FROM symbols WHERE name = '{start}' ORDER BY symbol_id LIMIT 1), 12) AS kind)",
            "counts AS (SELECT rel, count(*) AS n FROM kept GROUP BY rel)",
        ]
    )
    if part == "related":
        return graph("SELECT step, ord, name FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY step, ord) AS o FROM every) WHERE o = 1", ctes)
    if part == "symbols":
        return graph("SELECT * EXCLUDE rel FROM kept", ctes)
    return graph(
        f"""SELECT '{start}' AS name, score AS weighted_score, types AS edge_type_count, score >= 5 AND types >= 2 AS sufficient, CASE WHEN total = 1 THEN 2 ELSE 1 END AS expansions_used
        FROM (SELECT coalesce(sum(CASE WHEN own.kind = 12 THEN 0 ELSE n * coalesce(w, 0) END), 0)::DOUBLE AS score, coalesce(sum(CASE WHEN own.kind = 12 OR n IS NULL THEN 0 ELSE 1 END), 0)::INT AS types, coalesce(sum(n), 0) AS total
              FROM own LEFT JOIN counts ON true LEFT JOIN weights ON weights.kind = own.kind AND weights.relation = counts.rel)""",
        ctes,
    )


for _n, _s in SMART.items():
    for _part in ("related", "symbols", "density"):
        ORACLES[f"{_n}_{_part}"] = smart(_s, _part)

ORACLES |= {
    "lookup_exact": graph(f"SELECT {ENTRY} FROM symbols JOIN kinds USING (kind) WHERE name = 'order_7'"),
    "lookup_multi": graph(f"SELECT {ENTRY} FROM symbols JOIN kinds USING (kind) WHERE name = (SELECT name FROM symbols WHERE kind = 4 GROUP BY name ORDER BY count(*) DESC, name LIMIT 1)"),
    "lookup_opencode": graph(
        "SELECT symbol_id, name, number, line FROM (SELECT symbol_id, name, end_line - start_line + 1 AS total, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS number FROM src) WHERE number <= total",
        "src AS (SELECT s.*, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT symbol_id, s.name, start_line, end_line, string_split(text, chr(10)) AS l FROM symbols s JOIN documents d ON s.name = 'doc_' || d.doc_id WHERE s.name IN ('doc_1', 'doc_7')) s)",
    ),
    "smart_own_symbols": graph(f"SELECT {ENTRY} FROM symbols JOIN kinds USING (kind) WHERE name = 'doc_1'"),
    "symbol_count": graph("SELECT count(*) AS n FROM symbols"),
    "symbols_by_kind": graph("SELECT label AS kind, count(*) AS n FROM symbols JOIN kinds USING (kind) GROUP BY label"),
    "edges_by_relation": graph("SELECT label AS relation, count(*) AS n, count(DISTINCT src) AS sources FROM edges JOIN relations USING (relation) GROUP BY label"),
    "edges_from": graph("SELECT edge_id, src, dst, file_path, label AS relation FROM edges JOIN relations USING (relation) WHERE src = 'order_1'"),
    "edges_to": graph("SELECT edge_id, src, dst, file_path, xor(relation::INT, 1) AS inverse FROM edges WHERE dst = 'NATION_1'"),
    "first_symbol_per_name": graph("SELECT name, min(symbol_id) AS symbol_id, arg_min(kind, symbol_id) AS kind, arg_min(file_path, symbol_id) AS file_path, arg_min(start_line, symbol_id) AS start_line FROM symbols GROUP BY name"),
    "all_symbols": graph("SELECT * FROM symbols"),
    "all_edges": graph("SELECT * FROM edges"),
    "kind_round_trip": graph("SELECT kind, label, CASE WHEN kind = 2 THEN 1 ELSE kind END AS back FROM kinds"),
    "relation_bits": graph(f"SELECT relation, label, (1 << relation)::INT AS bit, xor(relation::INT, 1) AS inverse, (1 << relation) & {SEMANTIC_RELATIONS} <> 0 AS semantic FROM relations"),
    "density_all_functions": graph(
        """SELECT s.name, coalesce(sum(n * coalesce(w, 0)), 0)::DOUBLE AS weighted_score, count(c.relation)::INT AS edge_type_count,
                  coalesce(sum(n * coalesce(w, 0)), 0) >= 5 AND count(c.relation) >= 2 AS sufficient
           FROM first_symbols s LEFT JOIN counts c USING (name) LEFT JOIN weights ON weights.kind = s.kind AND weights.relation = c.relation WHERE s.kind = 0 GROUP BY s.name""",
        f"""weights(kind, relation, w) AS (VALUES {_WEIGHTS}),
        step AS (SELECT src AS name, dst AS other, 0 AS way, relation, edge_id FROM edges WHERE (1 << relation) & {SEMANTIC_RELATIONS} <> 0
                 UNION ALL SELECT dst, src, 1, xor(relation::INT, 1), edge_id FROM edges WHERE (1 << relation) & {SEMANTIC_RELATIONS} <> 0),
        once AS (SELECT name, other, way, arg_min(relation, edge_id) AS relation FROM step WHERE name <> other GROUP BY ALL),
        counts AS (SELECT name, relation, count(*) AS n FROM once WHERE other IN (SELECT name FROM symbols) GROUP BY ALL)""",
    ),
    "default_weights": f"SELECT kind, relation, weight FROM (VALUES {_WEIGHTS}) t(kind, relation, weight)",
    "goldilocks_filter": graph("SELECT symbol_id, name, end_line - start_line AS length FROM symbols WHERE kind = 0 AND (end_line = start_line OR end_line - start_line BETWEEN 5 AND 200)"),
    "file_tree": graph("SELECT min(symbol_id) AS ord, file_path AS path, string_split(file_path, '/')[-1] AS name FROM symbols GROUP BY file_path"),
    "file_symbols": graph("SELECT symbol_id, name, label AS kind, start_line AS line FROM symbols JOIN kinds USING (kind) WHERE file_path = 'db/nation.tbl'"),
    "file_symbols_partial": graph("SELECT symbol_id, name, label AS kind, start_line AS line FROM symbols JOIN kinds USING (kind) WHERE file_path = 'db/region.tbl'"),
    "file_symbols_none": graph("SELECT symbol_id, name, label AS kind, start_line AS line FROM symbols JOIN kinds USING (kind) WHERE false"),
    "json_symbols": graph("SELECT file_path, count(*) AS n, arg_min(name, symbol_id) AS name, arg_min(label, symbol_id) AS kind, arg_min(start_line, symbol_id) AS line FROM symbols JOIN kinds USING (kind) GROUP BY file_path"),
    "detect_lang": """SELECT page_id, CASE page_id % 10 WHEN 0 THEN 'python' WHEN 1 THEN 'cpp' WHEN 2 THEN 'cpp' WHEN 3 THEN 'tsx' WHEN 4 THEN 'rust' WHEN 5 THEN 'go' WHEN 6 THEN 'csharp' WHEN 7 THEN 'javascript' ELSE '' END AS language FROM pages""",
    "lang_stats": """SELECT language, count(*) AS n FROM (SELECT CASE page_id % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'cpp' WHEN 2 THEN 'cpp' WHEN 3 THEN 'tsx' WHEN 4 THEN 'rust' END AS language FROM pages) WHERE language IS NOT NULL GROUP BY language""",
    "include_edges_pages": """SELECT src, dst, count(*) AS n FROM (SELECT url AS src, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS dst FROM pages) GROUP BY ALL""",
    "call_edges_pages": r"""SELECT src, dst, count(*) AS n FROM (SELECT url AS src, unnest(regexp_extract_all(html, '([A-Za-z_][A-Za-z0-9_]*)\(', 1)) AS dst FROM pages) GROUP BY ALL""",
    "distinct_sorted_calls": r"""SELECT page_id, array_to_string(c, ',') AS calls, len(c)::BIGINT AS n FROM (SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, '([A-Za-z_][A-Za-z0-9_]*)\(', 1))) AS c FROM pages)""",
    "snippet_signature_clip": graph(
        "SELECT symbol_id, CASE WHEN length(t) > 20 THEN left(t, 17) || '...' ELSE t END AS shown FROM (SELECT symbol_id, concat_ws(' ', name, parent_class, signature) AS t FROM symbols WHERE kind = 2)"
    ),
}


def search(text: str, limit: int, where: str = "true") -> str:
    low = text.lower()
    return graph(
        f"""SELECT * FROM (SELECT name, label AS kind, file_path AS file, start_line AS line, CASE WHEN starts_with(l, '{low}') THEN 0 ELSE 1 END AS tier, l AS lower
            FROM (SELECT *, translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS l FROM first_symbols) JOIN kinds USING (kind)
            WHERE {f"contains(l, '{low}')" if text else 'false'} ORDER BY tier, l, name, symbol_id LIMIT {limit}) WHERE {where}"""
    )


ORACLES |= {"search_prefix": search("ORDER_1", 20), "search_substring_fallback": search("ation", 20), "search_mixed": search("r", 60), "search_none": search("zzzz", 20), "search_empty": search("", 20), "search_prefix_only": search("doc_2", 50, "tier = 0")}

_GONE = "('db/part.tbl', 'db/nation.tbl')"
_TOTALS = "SELECT coalesce(s.file_path, e.file_path) AS file_path, coalesce(s.n, 0) AS symbols, coalesce(e.n, 0) AS edges FROM ({0}) s FULL JOIN ({1}) e ON s.file_path = e.file_path"
ORACLES["remove_file"] = graph(_TOTALS.format(*(f"SELECT file_path, count(*) AS n FROM {t} WHERE file_path NOT IN {_GONE} GROUP BY file_path" for t in ("symbols", "edges"))))
ORACLES["index_twice"] = graph(_TOTALS.format(*(f"SELECT file_path, count(*) * CASE file_path WHEN 'db/supplier.tbl' THEN 2 ELSE 1 END AS n FROM {t} GROUP BY file_path" for t in ("symbols", "edges"))))
ORACLES["remove_file_search"] = graph(
    f"""SELECT name, label AS kind, file_path AS file, start_line AS line, CASE WHEN starts_with(lower(name), 'nation') THEN 0 ELSE 1 END AS tier, lower(name) AS lower
    FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY symbol_id) AS o FROM symbols WHERE file_path NOT IN {_GONE}) JOIN kinds USING (kind)
    WHERE o = 1 AND contains(lower(name), 'nation') ORDER BY tier, lower, name, symbol_id LIMIT 30"""
)
ORACLES["reindex_file"] = graph(
    "SELECT symbol_id - (SELECT min(symbol_id) FROM symbols WHERE file_path = 'db/nation.tbl') + (SELECT max(symbol_id) FROM symbols WHERE file_path <> 'db/nation.tbl') + 1 AS symbol_id, name || '_v2' AS name, kind FROM symbols WHERE file_path = 'db/nation.tbl'"
)

_LINES = """WITH src AS (SELECT doc_id, string_split({text}, chr(10)) AS l0 FROM documents),
src2 AS (SELECT doc_id, CASE WHEN l0[-1] = '' THEN l0[:-2] ELSE l0 END AS l FROM src),
lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS pos, len(l) AS total FROM src2)"""
_CALLS = "replace(text, 'the ', 'the(')"
_WINDOWS = f"""{_LINES.format(text=_CALLS)},
w AS (SELECT doc_id, total, pos AS c, greatest(0, pos - 1) AS lo, least(total, pos + 2) AS hi FROM lines WHERE contains(line, 'the(')),
m AS (SELECT *, CASE WHEN lo > coalesce(max(hi) OVER (PARTITION BY doc_id ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS new FROM w),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY c) AS island FROM m),
g AS (SELECT doc_id, island, min(lo) AS lo, max(hi) AS hi, max(total) AS total FROM i GROUP BY doc_id, island)"""
ORACLES |= {
    "snippet_lines": f"{_LINES.format(text='text')} SELECT doc_id, pos - 2 AS pos, line FROM lines WHERE pos BETWEEN 2 AND 8",
    "snippet_windows": f"{_WINDOWS} SELECT doc_id, c, lo, hi FROM w",
    "snippet_merged_regions": f"{_WINDOWS} SELECT doc_id, lo, hi FROM g",
    "snippet_text": f"""{_WINDOWS},
        blocks AS (SELECT g.doc_id, g.lo, g.hi, CASE WHEN g.lo > 0 THEN '// ...' || chr(10) ELSE '' END || array_to_string(s.l[g.lo + 1:g.hi], chr(10)) AS b FROM g JOIN src2 s USING (doc_id)),
        joined AS (SELECT doc_id, string_agg(b, chr(10) ORDER BY lo) AS code, max(hi) AS hi FROM blocks GROUP BY doc_id)
        SELECT s.doc_id, CASE WHEN len(l) <= 7 THEN array_to_string(l, chr(10)) WHEN j.doc_id IS NULL THEN array_to_string(l[1:2], chr(10)) ELSE code || CASE WHEN hi < len(l) THEN chr(10) || '// ...' ELSE '' END END AS code,
               len(l) > 7 AND j.doc_id IS NOT NULL AS applied
        FROM src2 s LEFT JOIN joined j USING (doc_id)""",
    "line_remap": """WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents)
        SELECT doc_id, pos, 'f' || ((pos - pos % 5) % 2) || '.c' AS file, (pos - pos % 5) * 10 + pos % 5 AS original FROM l WHERE pos % 5 <> 0""",
}

