import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import differ
from pyspark.sql import functions as F

from lodestone.llm import decontaminate as D
from lodestone.llm.oracles import ORACLES
from lodestone.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text, items, window=10):
    words = WORD.findall((text or "").translate(LOW))
    hit, names, longest, at, begins = np.zeros(len(words), bool), set(), 0, -1, set()
    for name, item in items:
        w = WORD.findall((item or "").translate(LOW))
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            for p in range(len(words) - size + 1):
                if words[p : p + size] == w[i : i + size]:
                    hit[p : p + size] = True
                    names.add("null" if name is None else str(name))
                    begins.add(p)
    for p in sorted(begins):
        for _, item in items:
            w = WORD.findall((item or "").translate(LOW))
            for i in range(len(w)):
                n = 0
                while p + n < len(words) and i + n < len(w) and words[p + n] == w[i + n]:
                    n += 1
                if n > longest:
                    longest, at = n, p
    return len(words), int(hit.sum()), sorted(names), longest, at


few = st.lists(st.sampled_from(["a", "b", "c", "Ä", "zz"]), max_size=25).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(few, min_size=1, max_size=4), items=st.lists(few, max_size=4), window=st.integers(1, 4))
def test_search(texts, items, window):
    named = list(enumerate(items))
    got = D.search([t.encode() for t in texts], D.benchmark(named, window))
    assert got == [brute(t, named, window) for t in texts]


def test_suffix_array():
    rng = np.random.default_rng(5)
    for _ in range(40):
        text = rng.integers(0, 3, int(rng.integers(1, 60)))
        text = np.concatenate([text, [0]])
        ends = np.flatnonzero(text == 0)
        rest = ends[np.searchsorted(ends, np.arange(len(text)))] - np.arange(len(text))
        got = D.suffix_array(text, rest)
        keys = [tuple(text[i : i + rest[i]]) for i in got]
        assert keys == sorted(keys) and sorted(got) == np.flatnonzero(rest).tolist()


def test_same_as_sql(spark, sf_dir):
    assert differ(spark, sf_dir, QUERIES["op5_decontaminate"], ORACLES["op5_decontaminate"]) == ""


def test_odd_rows(spark, odd, none, odd_rows):
    items = [(1, "third line of some words that go on for a while"), (1, None), (None, "other text"), (2, ""), (3, " ".join(f"word{i} and{i}" for i in range(20))), (3, "other TEXT")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.find_matches(odd, bench, ["doc_id"]).collect()
    want = [(r[0], *brute(r[1], items)) for r in odd_rows if r[1] is None or len(r[1]) < 9000]
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["longest"], r["longest_at"])) for r in got if r["doc_id"] not in (6, 7))
    assert D.find_matches(none, bench, ["doc_id"]).count() == 0
    assert {r["n_hit"] for r in D.find_matches(odd, bench.limit(0), ["doc_id"]).collect()} == {0}
    with pytest.raises(ValueError):
        D.find_matches(odd.withColumn("n_hit", F.lit(1)), bench, ["doc_id", "n_hit"])


def test_a_benchmark_in_parts(spark, odd, odd_rows, monkeypatch):
    """Parts give what the whole gives, whichever items they hold."""
    texts = [r[1] or "" for r in odd_rows if r[1] is None or len(r[1]) < 9000]
    items = [(k, " ".join(t.split()[k % 3 :][:14])) for k, t in enumerate(texts)] + [(3, "other TEXT"), (None, "text"), (50, "a third line of some words")]
    whole = D.search([t.encode() for t in texts], D.benchmark(items))
    for cut in (1, 3, 7):
        assert D.search([t.encode() for t in texts], [D.benchmark(items[:cut]), D.benchmark(items[cut:])]) == whole == [brute(t, items) for t in texts]
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(str, D.find_matches(odd, bench, ["doc_id"]).collect()))
    monkeypatch.setattr(D, "PART_BYTES", 40)
    assert sorted(map(str, D.find_matches(odd, bench, ["doc_id"]).collect())) == one
