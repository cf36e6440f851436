"""Any tables as a code graph: the star-schema tables and documents, projected to symbols and edges."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.model import KIND, RELATION
from lodestone.plans.numbering import numbered, stored
from lodestone.plans.store import Graph

FILES = {t: f"db/{t}.tbl" for t in ("region", "nation", "customer", "supplier", "part", "orders", "documents")}
ORDINAL = {t: i for i, t in enumerate(FILES)}
#: What the names of all orders begin with.
ORDER = "order_"
INCLUDES = {"nation": ["region"], "customer": ["nation"], "supplier": ["nation"], "orders": ["customer", "part", "supplier"]}


def _symbols(df: DataFrame, table: str, kind: str, sub: int, key: Column, name: Column, parent: Column, length: Column, signature: Column) -> DataFrame:
    start = (key + 1).cast("int") if sub in (0, 3) else F.lit(1)
    return df.select(
        F.lit(ORDINAL[table]).alias("file_ord"), F.lit(sub).alias("sub_ord"), key.cast("long").alias("key"), name.alias("name"), F.lit(KIND[kind]).cast("byte").alias("kind"),
        F.lit(FILES[table]).alias("file_path"), start.alias("start_line"), (start + length).cast("int").alias("end_line"), signature.cast("string").alias("signature"), parent.cast("string").alias("parent_class"),
    )


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in (*FILES, "lineitem")}


def _declared(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The symbols of each table's rows, and those of the documents' sources and languages."""
    none, zero = F.lit(None), F.lit(0)
    c = F.col
    nation = t["nation"].join(t["region"], c("n_regionkey") == c("r_regionkey"))
    customer = t["customer"].join(t["nation"].select("n_nationkey", "n_name"), c("c_nationkey") == c("n_nationkey"))
    supplier = t["supplier"].join(t["nation"].select("n_nationkey", "n_name"), c("s_nationkey") == c("n_nationkey"))
    orders = t["orders"].select("o_orderkey", "o_custkey", "o_orderpriority").join(t["customer"].select("c_custkey", "c_name").hint("shuffle_hash"), c("o_custkey") == c("c_custkey"))
    docs = t["documents"]
    return {
        "region": _symbols(t["region"], "region", "Namespace", 0, c("r_regionkey"), c("r_name"), none, zero, none),
        "nation": _symbols(nation, "nation", "Class", 0, c("n_nationkey"), c("n_name"), c("r_name"), c("n_nationkey") % 7, none),
        "customer": _symbols(customer, "customer", "Struct", 0, c("c_custkey"), c("c_name"), c("n_name"), c("c_custkey") % 300, c("c_mktsegment")),
        "supplier": _symbols(supplier, "supplier", "Interface", 0, c("s_suppkey"), c("s_name"), c("n_name"), c("s_suppkey") % 10, none),
        "part": _symbols(t["part"], "part", "Variable", 0, c("p_partkey"), c("p_name"), c("p_brand"), c("p_size"), c("p_type")),
        "orders": _symbols(orders, "orders", "Function", 0, c("o_orderkey"), F.concat(F.lit(ORDER), c("o_orderkey")), c("c_name"), c("o_orderkey") % 250, c("o_orderpriority")),
        "sources": _symbols(docs.select("source").distinct(), "documents", "Namespace", 1, zero, c("source"), none, zero, none),
        "langs": _symbols(docs.select("lang").distinct(), "documents", "Enum", 2, zero, c("lang"), none, zero, none),
        "documents": _symbols(docs, "documents", "Function", 3, c("doc_id"), F.concat(F.lit("doc_"), c("doc_id")), c("source"), c("n_chars") % 400, c("lang")),
    }


def project_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of the tables; ids are their places in (file, sub-order, key, name)."""
    t = _tables(spark, sf_dir)
    parts = list(_declared(t).values())
    fixed = [(ORDINAL[n], -2, 0, path, KIND["File"], path, 0, 0, None, None) for n, path in FILES.items()]
    fixed += [(ORDINAL[n], -1, 0, FILES[to], KIND["Include"], FILES[n], 1, 1, None, None) for n, many in INCLUDES.items() for to in many]
    parts.append(spark.createDataFrame(fixed, parts[0].schema))
    rows = sum(t[n].count() for n in FILES)  # the files' footers tell
    made = numbered(reduce(DataFrame.unionByName, parts), ["file_ord", "sub_ord", "key", "name"], "symbol_id", keep=stored, rows=rows)
    return made.drop("file_ord", "sub_ord", "key")


#: What a table's symbols are to their parents.
PARENTS = {"part": "Inherits", "nation": "MemberOf", "customer": "MemberOf", "supplier": "MemberOf", "documents": "MemberOf", "orders": "TypedAs"}


def project_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the tables, each once; ids are their places in (relation, file, src, dst).

    Items meet parts and suppliers by their keys; names are made behind the joins. Up to the store one sign, in front of
    src, stands for relation, file and what all names of an order begin with; the signs have the order of relation and file.
    """
    t = _tables(spark, sf_dir)
    c = F.col
    kinds = {(RELATION["DefinedIn"], FILES[n]) for n in FILES} | {(RELATION[r], FILES[n]) for n, r in PARENTS.items()} | {(RELATION["Includes"], FILES[n]) for n in INCLUDES}
    kinds |= {(RELATION["Calls"], FILES["orders"]), (RELATION["Returns"], FILES["orders"]), (RELATION["TypedAs"], FILES["documents"])}
    ways = sorted(kinds)
    begins = [ORDER if path == FILES["orders"] and relation != RELATION["Includes"] else "" for relation, path in ways]

    def edge(relation: str, table: str, src: Column, dst: Column) -> Column:
        """An edge whose src is without what it begins with. Each way has two signs, of which the first is for a null."""
        sign = 2 * ways.index((RELATION[relation], FILES[table])) + 1
        return F.struct(F.coalesce(F.concat(F.lit(chr(sign + 1)), src), F.lit(chr(sign))).alias("key"), dst.alias("dst"))

    parts = []
    for name, rows in _declared(t).items():
        table = name if name in FILES else "documents"
        own = F.substring("name", len(ORDER) + 1, 1 << 30) if name == "orders" else c("name")
        found = [edge("DefinedIn", table, own, F.lit(FILES[table]))]
        if name in PARENTS:
            found.append(edge(PARENTS[name], table, own, c("parent_class")))
        made = rows.select(F.inline(F.array(*found)))
        parts.append(made.distinct() if name == "part" else made)  # few names, in many rows each
    includes = spark.createDataFrame([(n, FILES[n], FILES[to]) for n, targets in INCLUDES.items() for to in targets], "n string, src string, dst string")
    parts += [includes.filter(c("n") == n).select(F.inline(F.array(edge("Includes", n, c("src"), c("dst"))))) for n in INCLUDES]
    parts.append(t["documents"].select("source", "lang").distinct().select(F.inline(F.array(edge("TypedAs", "documents", c("source"), c("lang"))))))
    for relation, table, key, number, name in (("Calls", "part", "l_partkey", "p_partkey", "p_name"), ("Returns", "supplier", "l_suppkey", "s_suppkey", "s_name")):
        met = t["lineitem"].select("l_orderkey", key).join(t[table].select(number, name).hint("shuffle_hash"), c(key) == c(number))
        parts.append(met.select(edge(relation, "orders", c("l_orderkey").cast("string"), c(name)).alias("e")).select("e.*"))
    rows = sum(t[n].count() for n in FILES) * 2 + t["lineitem"].count() * 2  # the files' footers tell

    def spelled(df: DataFrame) -> DataFrame:
        sign = F.ascii("key") - 1

        def of_way(values: list) -> Column:
            return F.element_at(F.array(*(F.lit(x) for x in values)), F.shiftright(sign, 1) + 1)

        src = F.when(sign.bitwiseAND(F.lit(1)) == 1, F.concat(of_way(begins), F.substring("key", 2, 1 << 30)))
        return stored(df.select(src.alias("src"), "dst", of_way([path for _, path in ways]).alias("file_path"), of_way([relation for relation, _ in ways]).cast("byte").alias("relation"), "_part", "_n"))

    return numbered(reduce(DataFrame.unionByName, parts), ["key", "dst"], "edge_id", keep=spelled, rows=rows, distinct=True)


class Projection(Graph):
    """The graph of the tables, of which symbols and edges are each made, whole, when they are first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        object.__setattr__(self, "_of", (spark, sf_dir))

    @cached_property
    def symbols(self) -> DataFrame:
        return project_symbols(*self._of)

    @cached_property
    def edges(self) -> DataFrame:
        return project_edges(*self._of)


_made: dict[tuple[str, str], Graph] = {}


def graph_of(spark: SparkSession, sf_dir: str) -> Graph:
    """The projection, made once for each session and folder and kept as files in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _made:
        _made[key] = Projection(spark, sf_dir)
    return _made[key]
