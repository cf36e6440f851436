"""Mixing sources to target weights by hash-random order and distributed prefix sums. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import SPACE_WORD, cut, prefix_sums, refuse

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)  # 150% of all sizes
MOST_EPOCHS = 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def random_key(seed: str) -> Column:
    """60 bits of an md5 of the id: the same in any engine and for any partitioning. A null id has key -1."""
    return F.coalesce(F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("doc_id").cast("string")).cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(-1))


def targets(sizes: DataFrame, weights: Sequence[int], share: tuple[int, int], epochs: int) -> DataFrame:
    """source, source_size -> with target (double).

    Source k in code point order, null last, weighs weights[k mod len(weights)]. share[0]/share[1] of the total is dealt
    by weight; a target stops at epochs times its source's size and what is above goes to the others by weight. The
    fixed point is found in one pass: in the order of stop per weight, a source stops iff its own stop per weight is
    not above what a unit of weight would get if all before it had stopped. Holds one row for each source, in one task.
    """
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*(F.lit(int(w)) for w in weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    num, den = share
    every = Window.partitionBy()
    # All in units of 1/den words, so that every sum is a whole number.
    stops = ranked.select("*", weight.alias("_w"), (F.lit(epochs * den) * F.col("source_size")).alias("_stop"), (F.lit(num) * F.sum("source_size").over(every)).alias("_all"))
    stops = stops.withColumn("_per", F.col("_stop").cast("double") / F.col("_w"))
    up = Window.orderBy("_per", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("_per", "_rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = stops.select("*", (F.col("_all") - F.coalesce(F.sum("_stop").over(up), F.lit(0))).alias("_left"), F.sum("_w").over(rest).alias("_weights"))
    stays = F.col("_left").cast("double") / F.col("_weights") <= F.col("_per")
    first = F.min(F.when(stays, F.struct("_per", "_rank", "_left", "_weights"))).over(every)
    open_ = level.withColumn("_first", first)
    reached = F.struct("_per", "_rank") >= F.struct("_first._per", "_first._rank")
    dealt = (F.col("_first._left") * F.col("_w")).cast("double") / (F.col("_first._weights") * F.lit(den)).cast("double")
    stopped = (F.lit(epochs) * F.col("source_size")).cast("double")
    return open_.select("source", "source_size", F.when(F.col("_first").isNotNull() & reached, F.least(dealt, stopped)).otherwise(stopped).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, epochs: int = MOST_EPOCHS, seed: str = "mix:", size: str | None = None) -> DataFrame:
    """How much of each document a mix of the sources takes.

    Returns a row for each row of docs: doc_id, source, size, source_size, target, taken. Each source is put in a
    hash-random order and run through as often as its target needs; the last run is cut at the exact budget, inside a
    document if need be, so a source's taken words add up to floor(target). size: column to weigh by instead of the
    number of words of text.

    Nulls: a null text has size 0; null sources are one source, last in the order; null ids come first in their source.
    Equal ids in a source are ordered by size. Documents of size 0 have taken 0. Empty table: no rows. Columns of docs
    other than doc_id, source, text and size are not looked at.
    """
    # Texts are read for their sizes once; what follows reads the narrow rows.
    narrow = cut(docs.select("doc_id", "source", (word_count(F.col("text")) if size is None else F.col(size).cast("long")).alias("size")))
    keyed = narrow.withColumn("_key", random_key(seed))
    run = prefix_sums(keyed, ["source", "_key", "doc_id", "size"], {"_before": "size"}, by=["source"])
    sizes = narrow.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    goals = targets(sizes, weights, share, epochs).withColumnRenamed("source", "_source")
    # One row a source: small beside the rows, and split from hot sources by Spark itself where it isn't broadcast.
    with_goal = run.join(goals, run["source"].eqNullSafe(goals["_source"]))
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size")).cast("long")).otherwise(0)
    part = F.greatest(F.lit(0), F.least(F.col("size"), budget - whole * F.col("source_size") - F.col("_before")))
    return with_goal.select("doc_id", "source", "size", "source_size", "target", (whole * F.col("size") + part).cast("long").alias("taken"))


def mix_rows(docs: DataFrame, keep: Sequence[str], weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, epochs: int = MOST_EPOCHS, seed: str = "mix:") -> DataFrame:
    """The mix itself: the columns in keep (text among them) of every document, a row for each time it is taken.

    A document of size s of which the mix takes t words makes t // s whole rows, and if words are left over one row with
    its first t % s words: the cut of its source's last run. Documents without words are not in the mix. n_chars, if kept, is that of the row's text. Only sizes are sorted and summed; texts are shuffled once, to
    meet what is taken of them. Nulls and repeated rows as in mix(): rows that agree in doc_id, source and size share
    alike what is taken of them, whichever of them comes first. Columns to keep that are named like those made on the way
    are refused.
    """
    refuse(keep, ["size", "_taken", "_n", "_t", "_words", "_doc_id", "_source", "_size"])
    plan = mix(docs, weights, share, epochs, seed)
    key = ["doc_id", "source", "size"]
    # Rows that agree in the key are as good as each other: what they take is listed, most first, and dealt in order.
    taken = plan.groupBy(*(F.col(k).alias(f"_{k}") for k in key)).agg(F.sort_array(F.collect_list("taken"), asc=False).alias("_taken"))
    sized = docs.select(*keep, *(c for c in ("doc_id", "source") if c not in keep), word_count(F.col("text")).alias("size"))
    numbered = sized.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("text"))))
    met = numbered.join(taken, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]).withColumn("_t", F.element_at("_taken", F.col("_n")))
    whole = F.when(F.col("size") > 0, F.floor(F.col("_t") / F.col("size"))).otherwise(0).cast("int")
    rest = F.when(F.col("size") > 0, F.col("_t") % F.col("size")).otherwise(0)
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    each = met.withColumn("_words", F.explode(copies))
    # The words before the cut, with what stands between them.
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("_words").cast("int")), "")
    text = F.when(F.col("_words") > 0, head).otherwise(F.col("text"))
    out = {"text": text, "n_chars": F.length(text).cast("long")}
    return each.select(*(out[c].alias(c) if c in out else F.col(c) for c in keep))
