"""Snippets of source lines around call sites, for any number of files at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP = "// ..."


def lines(files: DataFrame, text: str = "text") -> DataFrame:
    """files with pos (from 0) and line instead of text. Lines end with \\n; an empty piece after the last is none."""
    pieces = F.split(F.col(text), "\n", -1)
    trimmed = F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)
    return files.select("*", F.posexplode(trimmed).alias("pos", "line")).drop(text)


def line_range(files: DataFrame, start: Column | int, end: Column | int, text: str = "text") -> DataFrame:
    """Lines start to end, from 1, both included, with pos from 0 on in the range."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    low = F.greatest(low, F.lit(1))
    chosen = lines(files, text).filter((F.col("pos") + 1 >= low) & (F.col("pos") + 1 <= high))
    return chosen.withColumn("pos", F.col("pos") - low + 1)


def windows(ranged: DataFrame, key: str, target: str, radius: int) -> DataFrame:
    """key, lo, hi, c: the lines around each line that holds target and an opening bracket, lo to hi - 1, within the range."""
    total = ranged.groupBy(F.col(key).alias("_key")).agg((F.max("pos") + 1).alias("total"))
    sites = ranged.filter(F.col("line").contains(target + "(")).select(key, F.col("pos").alias("c"))
    met = sites.join(total, F.col(key) == F.col("_key"))
    return met.select(key, "total", "c", F.greatest(F.lit(0), F.col("c") - radius).alias("lo"), F.least(F.col("total"), F.col("c") + radius + 1).alias("hi"))


def regions(found: DataFrame, key: str) -> DataFrame:
    """Windows that overlap or touch made one: key, lo, hi, total."""
    order = Window.partitionBy(key).orderBy("c")
    last = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum("_new").over(order)
    marked = found.withColumn("_new", F.when(F.col("lo") > F.coalesce(last, F.lit(-1)), 1).otherwise(0)).withColumn("_island", island)
    return marked.groupBy(key, "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("total").alias("total")).drop("_island")


def pincer(files: DataFrame, key: str, target: str, start: Column | int, end: Column | int, radius: int = 7, text: str = "text") -> DataFrame:
    """key, code, applied: a snippet of each file's lines start to end around the calls of target.

    A range of at most 2 * radius + 5 lines is given whole. Without a call its first 2 * radius lines are. Else the
    regions around the calls, with a line '// ...' where lines are left out; only then applied is true. A file without
    such lines, or a null text, has the code ''. A file is the unit of work: its lines, and no other's, meet in one row.
    """
    if radius < 0:
        raise ValueError("radius is negative")
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    pieces = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    trimmed = F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)
    from_ = F.greatest(low, F.lit(1))
    ranged = F.when(high >= from_, F.slice(trimmed, from_, F.greatest(F.lit(0), high - from_ + 1))).otherwise(F.array().cast("array<string>"))
    base = files.select(key, ranged.alias("_lines")).withColumn("_total", F.size("_lines"))
    sites = F.filter(F.sequence(F.lit(0), F.col("_total") - 1), lambda i: F.get(F.col("_lines"), i).contains(target + "("))
    sites = F.when(F.col("_total") > 0, sites).otherwise(F.array().cast("array<int>"))
    base = base.withColumn("_sites", sites)

    def low_of(c: Column) -> Column:
        return F.greatest(F.lit(0), c - radius)

    def high_of(c: Column) -> Column:
        return F.least(F.col("_total"), c + radius + 1)

    # Windows are equally wide and ordered, so one begins a region if it doesn't touch that of the call before.
    begins = F.filter("_sites", lambda c, i: (i == 0) | (low_of(c) > high_of(F.get(F.col("_sites"), i - 1))))
    ends = F.filter("_sites", lambda c, i: (i == F.size("_sites") - 1) | (low_of(F.get(F.col("_sites"), i + 1)) > high_of(c)))
    base = base.withColumn("_regions", F.zip_with(begins, ends, lambda b, e: F.struct(low_of(b).alias("lo"), high_of(e).alias("hi"))))

    def block(r: Column) -> Column:
        body = F.array_join(F.slice(F.col("_lines"), r["lo"] + 1, r["hi"] - r["lo"]), "\n")
        return F.concat(F.when(r["lo"] > 0, F.lit(GAP + "\n")).otherwise(F.lit("")), body)

    more = F.get(F.col("_regions"), F.size("_regions") - 1)["hi"] < F.col("_total")
    cut = F.concat(F.array_join(F.transform("_regions", block), "\n"), F.when(more, F.lit("\n" + GAP)).otherwise(F.lit("")))

    def joined(n: Column) -> Column:
        return F.array_join(F.slice(F.col("_lines"), 1, n), "\n")

    short, found = F.col("_total") <= 2 * radius + 5, F.size("_sites") > 0
    code = F.when(short, joined(F.col("_total"))).when(~found, joined(F.least(F.col("_total"), F.lit(2 * radius)))).otherwise(cut)
    return base.select(key, code.alias("code"), (~short & found).alias("applied"))
