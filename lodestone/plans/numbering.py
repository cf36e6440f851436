"""Dense row numbers in a global order, without one task that holds all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.shared import scratch, shared_dir

#: Rows of a range, so that its sort fits in a task's memory, and the most ranges; beyond that they grow.
RANGE_ROWS, MOST_RANGES = 500_000, 20_000


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed in the folder that the cluster shares."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df as Parquet in the folder that the cluster shares, until the driver ends: smaller than a checkpoint, and filters prune it."""
    uri = scratch(df.sparkSession, "stored")
    # Version 2 writes sorted names and numbers as differences.
    df.write.mode("append").option("parquet.writer.version", "v2").parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def numbered(df: DataFrame, order: Sequence[str], name: str, first: int = 1, keep=cut, rows: int | None = None, distinct: bool = False) -> DataFrame:
    """df with name: its place in this order, from first on.

    One exchange deals rows to ranges, where each is sorted; a row's place there is kept with it, so only the ranges' row
    counts are summed in one place. Rows that tie in all order columns get their numbers in any order. distinct: of rows
    that tie one is kept; order has to be all columns then. rows: how many there are about, for the number of ranges.
    keep: cut or stored.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = [min(MOST_RANGES, -(-rows // RANGE_ROWS))] if rows and rows > least * RANGE_ROWS else []
    dealt = df.repartitionByRange(*ranges, *order)
    if distinct:
        dealt = dealt.distinct()  # equal rows are in one range, so this needs no other exchange
    # The low 33 bits of such a number are the row's place in its range.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = keep(dealt.sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), place.alias("_n")))
    counts = dealt.groupBy("_part").count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))  # a row for each range
    joined = dealt.join(F.broadcast(offsets), F.col("_part") == F.col("_p"))
    return joined.select((F.col("_offset") + F.col("_n") + F.lit(first)).cast("long").alias(name), *(x for x in dealt.columns if x not in ("_part", "_n")))
