import hashlib

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm.fingerprint import add, compare_with_edits, edited_vector, fingerprint, likeness, paragraphs, vector
from lodestone.llm.queries import QUERIES


def alike(a, b):
    """The cosine of the random signs' sums."""
    x, y = 2 * a[5:] - a[0], 2 * b[5:] - b[0]
    sizes = np.linalg.norm(x) * np.linalg.norm(y)
    return 1.0 if (a == b).all() else min(1.0, max(0.0, x @ y / sizes)) if sizes else 0.0


def test_query(spark, sf_dir, plain):
    got = {r["doc_id"]: r for r in QUERIES["op7_multiset_fingerprints"](spark, sf_dir).collect()}
    down = plain[::-1]
    shown = {}
    for k, (key, text) in enumerate(down):
        third = len(text) // 3
        edited = text[: len(text) - third] + down[(k + 1) % len(down)][1][:third]
        r = got[key]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert shown.setdefault(text, r["fingerprint"]) == r["fingerprint"] and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert len(set(shown.values())) == len(shown)
    assert sum(r["near_edited"] for r in got.values()) > 5 * sum(r["near_next"] for r in got.values())
    for r in got.values():
        one, two, three = (np.array([int(x, 16) for x in s.split(".")]) for s in (r["fingerprint"], r["edited_fingerprint"], got[r["next_id"]]["fingerprint"]))
        assert abs(alike(one, two) - r["near_edited"]) < 1e-9 and abs(alike(one, three) - r["near_next"]) < 1e-9


def vectors(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [tuple(r["vector"]) for r in fingerprint(df, ["doc_id"]).orderBy("doc_id").collect()]


def test_multiset(spark):
    a, b, c, d, e = vectors(spark, "x one\ny two\nz three", "z three\nx one\ny two", "x one\ny two\nz three\nz three", "x one. y two\nz three", None)
    assert a == b and a != c and d != a and set(e) == {0} and len(a) == 1 + 4 + 128


def test_insertion_and_deletion(spark):
    df = spark.createDataFrame([("p one\nq two\n" * 40, "r three\np one", "p one\nq two\n" * 40 + "r three\np one")], "a string, b string, both string")
    r = df.select((add(vector(F.col("a")), vector(F.col("b"))) == vector(F.col("both"))).alias("i"), (add(vector(F.col("both")), vector(F.col("b")), -1) == vector(F.col("a"))).alias("d")).first()
    assert r["i"] and r["d"]


def test_edited_vector(spark):
    """An edit's vector from the text's is that of the edited text, wherever the edit begins or ends, ends of paragraphs too."""
    text = "a one. b two!  c three\n\nd four.\ne five? f six\n" * 9
    pairs = [(text, text[:k] + head) for k in range(0, len(text), 7) for head in ("", " x. y", "\n\nz", text[:k])]
    pairs += [("", ""), ("", "x. y"), ("x. y", ""), (text, text), ("\n" * 300, "a\n" * 300)]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", vector(F.col("a")).alias("v"), vector(F.col("b")).alias("w"))
    got = df.select(edited_vector(F.col("v"), paragraphs(F.col("a")), paragraphs(F.col("b"))).alias("e"), "w")
    assert got.filter("e <> w").count() == 0 and got.count() == len(pairs)


def test_likeness(spark):
    lines = [f"line number {i} of it" for i in range(60)]
    df = spark.createDataFrame([("\n".join(lines), "\n".join(lines[:40] + [f"new {i}" for i in range(20)]), "\n".join(f"other {i}" for i in range(60)))], "a string, b string, c string")
    held = df.select(*(vector(F.col(x)).alias(x) for x in "abc"))
    r = held.select(*(likeness(F.col("a"), F.col(x)).alias(f"like_{x}") for x in "abc")).first()
    assert r["like_a"] == 1.0 and abs(r["like_b"] - 2 / 3) < 0.25 and r["like_c"] < 0.3


def test_likeness_of_very_long_texts(spark):
    """Texts of 2^16 paragraphs and more, two thirds of which are the same; the lanes count beyond 2^16."""
    lines = [f"line {i}" for i in range(66_000)]
    a, b, c = (np.array(v) for v in vectors(spark, "\n".join(lines), "\n".join(lines[:44_000] + [f"new {i}" for i in range(22_000)]), "same\n" * 70_000))
    df = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<long>, b array<long>")
    r = df.select(likeness(F.col("a"), F.col("b")).alias("like")).first()
    assert abs(r["like"] - alike(a, b)) < 1e-9 and abs(r["like"] - 2 / 3) < 0.25
    assert set(c[5:].tolist()) == {0, 70_000}


def test_odd_rows(odd, none, odd_rows):
    got = compare_with_edits(odd).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in got) == sorted((str(r[0]), len(r[1] or "")) for r in odd_rows)
    next_ids = {str(r["doc_id"]): str(r["next_id"]) for r in got if r["doc_id"] not in (1, None)}
    assert next_ids == {"10": "9", "9": "8", "8": "7", "7": "6", "6": "5", "5": "4", "4": "3", "3": "2", "2": "1"}
    assert sorted(str(r["next_id"]) for r in got if r["doc_id"] in (1, None)) == ["1", "1", "10", "None", "None"]
    assert compare_with_edits(none).count() == 0
    assert compare_with_edits(odd.filter("doc_id = 8")).first()["near_next"] == 1.0
