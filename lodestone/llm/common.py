"""What the operators of this subpackage share: the cluster's shared folder, lineage cuts and distributed prefix sums."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.plans.numbering import cut
from lodestone.plans.shared import scratch, shared_dir

__all__ = ["crc_of_id", "cut", "prefix_sums", "ranged", "read", "refuse", "release", "scratch", "shared_dir"]

#: Separators of words where a contract says `[^\x20\x09-\x0D]+`; the same set that bytes.split() uses.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the input tables; only Spark opens the path, so any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def release() -> None:
    """Give memory that a Python worker no longer uses back to the machine, between one large piece of work and the next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Rows of a range partition, and the most range partitions; beyond that they grow.
RANGE_ROWS, MOST_RANGES = 250_000, 20_000


def refuse(keep: Sequence[str], made: Sequence[str]) -> None:
    """Raise if a column to keep has the name of one that an operator makes."""
    clash = sorted(set(keep) & set(made))
    if clash:
        raise ValueError(f"columns {clash} would be there twice; rename them first")


def crc_of_id(mod: int) -> Column:
    """crc32 of doc_id as text, modulo mod; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % F.lit(mod), F.lit(0))


def ranged(df: DataFrame, order: Sequence[str], rows: int | None = None, most: int = MOST_RANGES) -> DataFrame:
    """df in range partitions of about RANGE_ROWS rows, numbered by _part in the order of the columns.

    Rows should be narrow (keys and sizes, no texts). There are as many partitions as the session uses at least, and no
    more than most, so that neither the driver's sample for the bounds nor the blocks of the shuffle grow without bound.
    The result is checkpointed: _part is then a stored value which a retry can't change.
    """
    least = df.sparkSession.sparkContext.defaultParallelism
    n = min(most, max(2, least, -(-df.count() // (rows or RANGE_ROWS))))
    return cut(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))


def prefix_sums(df: DataFrame, order: Sequence[str], sums: dict[str, str], by: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """df with, for each new column in sums, the total of the named column over all rows before in this order.

    by: groups that are summed apart; they must be what order begins with. No group, however large, meets in one task:
    rows are dealt by range, each range sums its own rows, and only one total for each range and group is summed again.
    Rows equal in all order columns follow one another in any order. Null values count as 0.
    """
    dealt = ranged(df, order, rows)
    keys = ["_part", *by]
    totals = dealt.groupBy(*keys).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"_t_{new}") for new, c in sums.items()))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *(F.col(k).alias(f"_k_{k}") for k in keys),
        *(F.coalesce(F.sum(f"_t_{new}").over(before), F.lit(0)).alias(f"_o_{new}") for new in sums),
    )
    here = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.select("*", *(F.coalesce(F.sum(c).over(here), F.lit(0)).alias(f"_i_{new}") for new, c in sums.items()))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    joined = inside.join(offsets, same)
    return joined.select(*df.columns, *((F.col(f"_i_{new}") + F.col(f"_o_{new}")).alias(new) for new in sums))
