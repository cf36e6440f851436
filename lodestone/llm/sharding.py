"""Contiguous shards of near equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, prefix_sums


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Cut docs, in doc_id order, into contiguous shards of near equal bytes.

    Returns a row for each row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard. size is the UTF-8
    bytes of the text plus 1 for its end. Each range partition sums its sizes, the totals give every row its global
    offset, and a document goes to the shard that the middle of its bytes falls in; so a shard misses the equal target by
    no more than its two documents at the cuts. slot counts from 0 in each shard in doc_id order.

    Nulls: a null text has size 1 and a null crc is that of no bytes; null ids come first. Equal ids are ordered by crc
    and size. Empty table: no rows. Only doc_id and text are looked at.
    """
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    # Texts are read for their sizes once; what follows reads the narrow rows.
    narrow = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit(1).alias("_one"))
    narrow = cut(narrow)
    placed = cut(prefix_sums(narrow, ["doc_id", "text_crc32", "size"], {"_offset": "size", "_index": "_one"}))
    total = narrow.agg(F.sum("size").alias("_total"))  # one row
    middle = (2 * F.col("_offset") + F.col("size")).cast("double") / (2 * F.col("_total")).cast("double")
    dealt = placed.crossJoin(F.broadcast(total)).withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards)).cast("int"))
    starts = dealt.groupBy("shard").agg(F.min("_index").alias("_start"))  # a row for each shard
    return dealt.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_index") - F.col("_start")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
