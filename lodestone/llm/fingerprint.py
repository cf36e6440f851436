"""Document fingerprints: a homomorphic multiset hash of paragraphs. DataFrame functions only.

A paragraph (a line, or a sentence of one) has a wide vector: EXACT lanes of 32 bits and LIKE lanes that are 0 or 1,
all modulo 2^32 and from its hashes. A text's vector is the sum of its paragraphs' vectors and of 1 in a lane
that counts them. So it doesn't hang on their order, and a paragraph is put in or taken out by one addition (see add()).
Equal texts have equal vectors, and unequal multisets of paragraphs differ but for a chance of about 2^-128. The LIKE
lanes tell how alike two multisets are: twice a lane less the count is a sum of random signs, and the cosine of two such
vectors estimates that of the multisets to about LIKE ** -0.5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, ranged, refuse

EXACT, LIKE = 4, 128
MOD = 1 << 32
#: Ends of paragraphs: line ends, and white space after a sentence's end. They are no part of a paragraph.
BETWEEN = r"\n+|(?<=[.!?])[ \t]+"


def paragraphs(text: Column) -> Column:
    """The text's paragraphs that aren't empty."""
    return F.filter(F.split(text, BETWEEN), lambda p: p != "")


def _sum(values: Column, term) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda total, x: total + term(x))


#: Bit 0 of each byte of a long, and how many such longs add up without running over a byte's 7 lower bits.
BYTES, MOST = int("01" * 8, 16), 127


def _bit_counts(hashes: Column) -> Column:
    """For each of the 64 bits, how many of the hashes have it.

    Eight lanes are counted at a time, one in each byte of a long, over MOST hashes; then the bytes are summed apart.
    """

    def eight_at_a_time(start: Column) -> Column:
        some = F.slice(hashes, start, F.lit(MOST))
        return F.array(*(_sum(some, lambda x, i=i: F.shiftright(x, i).bitwiseAND(F.lit(BYTES))) for i in range(8)))

    def lane(bit: Column, held: Column) -> Column:
        return _sum(held, lambda c: F.call_function("shiftrightunsigned", F.get(c, bit.bitwiseAND(F.lit(7))), bit.bitwiseAND(F.lit(56))).bitwiseAND(F.lit(255)))

    starts = F.sequence(F.lit(1), F.greatest(F.size(hashes), F.lit(1)), F.lit(MOST))
    bound = F.array(F.transform(starts, eight_at_a_time))
    return F.element_at(F.transform(bound, lambda held: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda bit: lane(bit, held))), 1)


def vector_of(units: Column) -> Column:
    """The vector of an array of paragraphs: their count, the EXACT lanes, the LIKE lanes, as longs."""
    words = EXACT // 2 + LIKE // 64

    def hashes(k: int) -> Column:
        return F.transform(units, lambda p: F.xxhash64(F.lit(f"lane{k}"), p))

    hashed = F.struct(*(hashes(k).alias(f"h{k}") for k in range(words)))

    def lanes(h: Column) -> Column:
        parts = [F.array(F.size(h["h0"]).cast("long"))]
        for k in range(EXACT // 2):
            parts.append(F.array(_sum(h[f"h{k}"], lambda x: x.bitwiseAND(F.lit(MOD - 1))) % MOD, _sum(h[f"h{k}"], lambda x: F.shiftrightunsigned(x, 32)) % MOD))
        return F.concat(*parts, *(_bit_counts(h[f"h{k}"]) for k in range(EXACT // 2, words)))

    # Hashes are bound once; in an expression used many times they would be made anew each time.
    return F.element_at(F.transform(F.array(hashed), lanes), 1)


def vector(text: Column) -> Column:
    """The vector of a text's paragraphs. A null text is empty: all 0."""
    return vector_of(paragraphs(F.coalesce(text, F.lit(""))))


def add(one: Column, other: Column, sign: int = 1) -> Column:
    """The vector of both texts' paragraphs together, or with sign -1 of the first without the second's."""
    return F.zip_with(one, other, lambda a, b: F.pmod(a + b if sign > 0 else a - b, F.lit(MOD)))


def edited_vector(own: Column, before: Column, after: Column) -> Column:
    """The vector of paragraphs after, from that of paragraphs before: all behind what both begin with is taken out and put in."""

    def changed(x: Column) -> Column:
        first = F.array_position(F.zip_with(x["before"], x["after"], lambda a, b: ~a.eqNullSafe(b)), True).cast("int")
        rest = lambda units: F.when(first > 0, F.slice(units, first, F.greatest(F.size(units) - first + 1, F.lit(0)))).otherwise(F.slice(units, 1, 0))
        return F.struct(rest(x["before"]).alias("out"), rest(x["after"]).alias("put"))

    both = F.transform(F.array(F.struct(before.alias("before"), after.alias("after"))), changed)
    return F.element_at(F.transform(both, lambda x: add(add(own, vector_of(x["put"])), vector_of(x["out"]), -1)), 1)


def shown(v: Column) -> Column:
    """The vector as text: lanes in hexadecimal."""
    return F.lower(F.array_join(F.transform(v, lambda x: F.hex(x)), "."))


def likeness(one: Column, other: Column) -> Column:
    """From 0 to 1; 1 for equal vectors.

    Give columns that hold vectors, and don't call a result in the same select by the name of one of them: Spark would
    take the result for the vector.
    """

    def signs(v: Column) -> Column:
        return F.transform(F.slice(v, 2 + EXACT, LIKE), lambda x: (2 * x - v[0]).cast("double"))

    def cosine(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
        sizes = F.sqrt(F.aggregate(a, F.lit(0.0), lambda t, x: t + x * x)) * F.sqrt(F.aggregate(b, F.lit(0.0), lambda t, x: t + x * x))
        return F.when(sizes > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / sizes))).otherwise(F.lit(0.0))

    alike = F.element_at(F.transform(F.array(F.struct(signs(one).alias("a"), signs(other).alias("b"))), cosine), 1)
    return F.when(one == other, F.lit(1.0)).otherwise(alike)


def fingerprint(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in keep and vector of every whole text; a column to keep named vector is refused."""
    refuse(keep, ["vector"])
    return docs.select(*keep, vector(F.col("text")).alias("vector"))


def next_rows(ids: DataFrame) -> DataFrame:
    """For each distinct (doc_id, tie): the one after it in descending order, after the last the first.

    Returns prev_id, prev_tie, prev_chars, next_id, next_tie. Only ids are moved: they are dealt by range, and each range
    looks no further than the first row of the next range that has any.
    """
    dealt = ranged(ids, ["doc_id", "tie"])
    down = [F.col("doc_id").desc_nulls_last(), F.col("tie").desc()]
    row = F.struct("doc_id", "tie")
    here = dealt.select("_part", "doc_id", "tie", "n_chars", F.lead(row).over(Window.partitionBy("_part").orderBy(*down)).alias("_next"))
    # One row a range: its first in descending order, and that of the range below it.
    order = F.struct(F.col("doc_id").isNotNull().alias("a"), F.col("doc_id").alias("b"), F.col("tie").alias("c"))
    firsts = dealt.groupBy("_part").agg(F.max_by(row, order).alias("_first"))
    below = Window.orderBy(F.col("_part").desc())
    top = F.first("_first").over(below.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = firsts.select(F.col("_part").alias("_p"), F.coalesce(F.lead("_first").over(below), top).alias("_after"))
    joined = here.join(after, F.col("_part") == F.col("_p")).withColumn("_to", F.coalesce("_next", "_after"))
    return joined.select(F.col("doc_id").alias("prev_id"), F.col("tie").alias("prev_tie"), F.col("n_chars").alias("prev_chars"), F.col("_to.doc_id").alias("next_id"), F.col("_to.tie").alias("next_tie"))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of an edit of it and how alike they are, as the query's contract has it.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all) of the next
    document in descending doc_id, after the last by those of the first. Returns doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next and next_id.

    Each text's vector is made once; the edited text's is had from it by taking out and putting in the paragraphs that the
    edit changes. Texts and vectors are shuffled by id once, and both joins read that one shuffle; to the document before
    goes only as much of a text as its edit takes, and its vector.

    Nulls: a null text is empty; null ids come after all others. Rows of equal id follow one another by a hash of their
    text; equal rows follow one another, so that all but the last have their like as the next. A single row is its own
    next. Empty table: no rows. Only doc_id and text are looked at.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    texts = texts.select("doc_id", "text", F.xxhash64("text").alias("tie"), vector(F.col("text")).alias("_v"))
    ids = cut(texts.groupBy("doc_id", "tie").agg(F.max(F.length("text")).cast("long").alias("n_chars"), F.count("*").alias("copies")))
    repeated = (ids.agg(F.max("copies")).first()[0] or 0) > 1
    order = cut(next_rows(ids.drop("copies")))
    third = F.floor(F.col("prev_chars") / 3).cast("int")
    asked = texts.join(order, F.col("doc_id").eqNullSafe(F.col("next_id")) & (F.col("tie") == F.col("next_tie")))
    given = asked.select("prev_id", "prev_tie", F.col("doc_id").alias("next_id"), F.substring(F.col("text"), F.lit(1), third).alias("_head"), F.col("_v").alias("_next_vector"))
    if repeated:  # the next row may be there more than once, and is the same each time
        given = given.dropDuplicates(["prev_id", "prev_tie"])
    met = texts.join(given, F.col("doc_id").eqNullSafe(F.col("prev_id")) & (F.col("tie") == F.col("prev_tie")))
    n = F.length("text").cast("long")
    head, next_vector, next_id = F.col("_head"), F.col("_next_vector"), F.col("next_id")
    if repeated:
        met = met.withColumn("_copy", F.row_number().over(Window.partitionBy("doc_id", "tie").orderBy("tie")))
        head = F.when(F.col("_copy") > 1, F.substring(F.col("text"), F.lit(1), F.floor(n / 3).cast("int"))).otherwise(head)
        next_vector = F.when(F.col("_copy") > 1, F.col("_v")).otherwise(next_vector)
        next_id = F.when(F.col("_copy") > 1, F.col("doc_id")).otherwise(next_id)
    kept = F.substring(F.col("text"), F.lit(1), (n - F.floor(n / 3)).cast("int"))
    edited = met.select("doc_id", "text", n.alias("n_chars"), "_v", F.concat(kept, head).alias("_edited"), next_vector.alias("_n"), next_id.alias("next_id"))
    after = edited_vector(F.col("_v"), paragraphs(F.col("text")), paragraphs(F.col("_edited")))
    seen = edited.select("doc_id", "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), "_v", after.alias("_e"), "_n", "next_id")
    return seen.select(
        "doc_id", "n_chars", "edited_sha256", shown(F.col("_v")).alias("fingerprint"), shown(F.col("_e")).alias("edited_fingerprint"),
        likeness(F.col("_v"), F.col("_e")).alias("near_edited"), likeness(F.col("_v"), F.col("_n")).alias("near_next"), "next_id",
    )
