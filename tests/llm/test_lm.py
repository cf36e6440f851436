import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyarrow.fs import FileSelector

from lodestone.llm import lm
from lodestone.llm.queries import QUERIES

BEGIN, END = " begin", " end"


def held(key):
    return key is not None and zlib.crc32(str(key).encode()) % 7 == 2


def symbols(text):
    return [*(text or "").encode().lower().split(), END]


def check(got, rows):
    words = [(k, symbols(t)) for k, t in rows]
    count = Counter(w for k, x in words if not held(k) for w in x)
    n, v = sum(count.values()), len(count)
    want = sorted((str(k), held(k), len(x), sum(w in count for w in x), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in x), 6)) for k, x in words)
    assert want == sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got)


def plain_tree(rows, depth, least):
    """Retained contexts of a suffix tree over dictionaries: context (oldest first) -> Counter of next symbols; and the root."""
    follows = defaultdict(Counter)
    for key, text in rows:
        if held(key):
            continue
        row = [BEGIN, *symbols(text)]
        for i in range(1, len(row)):
            for d in range(min(depth, i) + 1):
                follows[tuple(row[i - d : i])][row[i]] += 1
    retained = {}
    for context, after in follows.items():
        total = sum(after.values())
        if not context or total < least:
            continue
        above = follows[context[1:]]
        every = sum(above.values())
        apart = sum(n / total * math.log(n / total / (above[s] / every)) for s, n in after.items())
        if apart > max(0.01, 0.5 * len(after) * math.log(total) / total):
            retained[context] = after
    return retained, follows[()]


def plain_score(text, retained, root, depth):
    once = max(1, sum(n == 1 and w != END for w, n in root.items()))
    whole = sum(root.values()) + 1 + once
    row, out = [BEGIN, *symbols(text)], 0.0
    for i in range(1, len(row)):
        s = row[i]
        p = (root[s] + 1 if s == END else root[s] or once) / whole
        for d in range(1, min(depth, i) + 1):
            after = retained.get(tuple(row[i - d : i]))
            if after:
                p = (after[s] + len(after) * p) / (sum(after.values()) + len(after))
        out += math.log10(p)
    return out


@pytest.mark.parametrize(("depth", "least"), [(3, 3), (3, 50), (1, 2), (5, 4)])
def test_against_a_plain_tree(spark, plain, depth, least):
    retained, root = plain_tree(plain, depth, least)
    assert {len(c) for c in retained} >= {1} and (least > 4 or depth < 3 or max(len(c) for c in retained) >= 3)
    docs = spark.createDataFrame(plain, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["score"] for r in lm.score(docs, depth, least).collect()}
    for key, text in plain:
        want = plain_score(text, retained, root, depth)
        assert abs(got[key] - want) < 1e-6 * max(1, abs(want)), (key, got[key], want)


def test_query(spark, sf_dir, plain):
    got = QUERIES["op6_suffix_tree_scores"](spark, sf_dir).collect()
    check(got, plain)
    seen = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in seen) > sum(r["base_score"] for r in seen)
    assert np.mean([r["score"] > r["base_score"] for r in seen]) > 0.9


def test_odd_rows(odd, none, odd_rows):
    for least in (lm.LEAST, 2):
        got = lm.score(odd, least=least).collect()
        check(got, [(r[0], r[1]) for r in odd_rows])
        assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in got)
    retained, root = plain_tree([(r[0], r[1]) for r in odd_rows], 3, 2)
    want = sorted(round(plain_score(r[1], retained, root, 3), 4) for r in odd_rows)
    assert want == sorted(round(r["score"], 4) for r in got)
    assert lm.score(none).count() == 0


def test_nothing_to_learn_from(spark):
    keys = [k for k in range(200) if held(k)][:3]
    got = lm.score(spark.createDataFrame([(k, "some words here") for k in keys], "doc_id long, text string")).collect()
    check(got, [(k, "some words here") for k in keys])
    assert all(abs(r["score"] - 4 * math.log10(0.5)) < 1e-9 for r in got)


def test_scores_are_those_of_the_rows(spark, sf_dir, monkeypatch):
    """However they are dealt: to 1 or 16 partitions, in stretches large or small, in few buckets or many."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    one = {r["doc_id"]: r["score"] for r in lm.score(docs.coalesce(1), least=5).collect()}
    monkeypatch.setattr(lm, "BUCKET_BYTES", 20_000)
    many = {r["doc_id"]: r["score"] for r in lm.score(docs.repartition(16, "doc_id"), least=5).collect()}
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-7 * abs(one[k]) for k in one)


def test_stretches_of_a_task(spark, plain, monkeypatch):
    """A task with several stretches: their numbers and files are apart."""
    monkeypatch.setattr(lm, "STRETCH_BYTES", 30_000)
    source = {}
    rows = [(k, True, t.encode()) for k, t in plain]
    import pyarrow as pa

    class Task:
        def partitionId(self):
            return 5

    monkeypatch.setattr(lm, "TaskContext", type("T", (), {"get": staticmethod(lambda: Task())}))
    uri = lm.scratch(spark, "test-stretches")
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([k % 2 == 0 for k, _, _ in rows]), pa.array([r[2] for r in rows])], ["a", "b", "c"])
    for made in lm._reader(uri, 7, 50)(iter([batch])):
        for r in made.to_pylist():
            if r["kind"] == lm.TEXT:
                source[r["at"]] = lm._opened(uri, r["data"], 50)
    assert len(source) > 5 and all(k & 0xFF == 5 for k in source)
    assert [d for k in sorted(source) for d in source[k].docs["doc"].tolist()] == [k for k, _ in plain]


def test_contexts_grow_with_the_corpus(spark):
    """A context counts by its own occurrences, whatever share of the corpus they are."""
    rows = [(k, f"{'a' if k % 2 else 'b'} m m {'x' if k % 2 else 'y'}") for k in range(200)]
    more = [(1000 + k, " ".join(f"w{(k * 50 + i) % 9000}" for i in range(400))) for k in range(400)]
    for these in (rows, rows + more):
        got = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame([*these, (9999, "a m m x"), (9998, "a m m y")], "doc_id long, text string").coalesce(2)).collect()}
        assert got[9999] > got[9998] + 1


def test_numbers_that_are_sent():
    rng = np.random.default_rng(0)
    n, held = (np.concatenate((rng.integers(0, most, 1000), [0, most])) for most in (3, 1 << 30))
    assert all((a == b).all() for a, b in zip(lm._untimes(lm._times(n, held)), (n, held), strict=True))
    bucket = np.sort(rng.integers(0, 5, 1000))
    context, word = rng.integers(0, 1 << 40, 300)[rng.integers(0, 300, 1000)], rng.integers(0, 1 << 30, 1000)
    order = np.lexsort((word, context, bucket))
    context, word = context[order], word[order]
    rows = list(lm._bucketed(1, 7, lm._ASK_PAIR, {"context": context, "word": word, "times": np.ones(1000, np.int64)}, bucket))
    back = [lm._unbucketed(lm._ASK_PAIR, r[3]) for r in rows]
    assert [r[1] for r in rows for _ in lm._unbucketed(lm._ASK_PAIR, r[3])["word"]] == bucket.tolist()
    assert (np.concatenate([b["context"] for b in back]) == context).all() and (np.concatenate([b["word"] for b in back]) == word).all()
    assert not list(lm._bucketed(1, 7, lm._ASK_PAIR, {"context": context[:0], "word": word[:0], "times": word[:0]}, bucket[:0]))


def test_what_is_written(spark, docs, plain, monkeypatch):
    """All that is shuffled and kept is less than the text; by hashes it was 1.56 times that."""
    store, folders, scratch = spark.sparkContext._jsc.sc().statusStore(), [], lm.scratch

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        found = store.executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    monkeypatch.setattr(lm, "scratch", lambda *a: folders.append(scratch(*a)) or folders[-1])
    dealt = docs.select("doc_id", "text").coalesce(2).cache()
    dealt.count()
    before = shuffled()
    lm.score(dealt, least=5).write.format("noop").mode("overwrite").save()
    files, folder = lm.filesystem(folders[0])
    kept = sum(f.size for f in files.get_file_info(FileSelector(folder, recursive=True)))
    text = sum(len(t.encode()) for _, t in plain if t)
    assert shuffled() - before + kept < text
