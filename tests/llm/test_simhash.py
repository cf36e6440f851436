import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import simhash as S
from lodestone.llm.queries import QUERIES

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes) > 0)


def plain_shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def roots(codes, budget=4):
    """Smallest place of each code's component, from all pairs."""
    v, parent = np.array(codes, np.uint64), list(range(len(codes)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[i] ^ v[i + 1 :]) <= budget):
            a, b = find(i), find(i + 1 + int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(v))]


def check(got, rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    codes = [plain_fingerprint(t) for _, t in rows]
    want = sorted((str(k), f"{c:016x}", str(rows[r][0])) for (k, _), c, r in zip(rows, codes, roots(codes), strict=True))
    assert want == sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got)


def test_query(spark, sf_dir, plain):
    check(QUERIES["op9_simhash_near_dedup"](spark, sf_dir).collect(), plain)


def test_odd_rows(odd, none, odd_rows):
    check(S.near_duplicates(odd, ["doc_id"]).collect(), [(r[0], r[1]) for r in odd_rows])
    assert S.near_duplicates(none, ["doc_id"]).count() == 0
    assert S.near_duplicates(odd, ["doc_id", "lang"]).columns == ["doc_id", "lang", "fingerprint", "component_id"]


def kept(docs):
    return {r["first"]["id"] for r in S.first_of_similar(docs, F.struct(F.col("doc_id").alias("id"))).collect()}


def test_similar_texts_are_found(spark):
    """Of pairs of similarity 0.8 and more, nine in ten and more are found; texts below 0.6 are left alone."""
    rng = np.random.default_rng(3)
    rows, pairs, lone = [], {}, []
    for k in range(300):
        words = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(60, 400)))]
        other = list(words)
        for p in rng.choice(len(words), max(1, len(words) // (60 if k % 2 else 15)), replace=False):
            other[p] = f"new{p}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        like = jaccard(plain_shingles(rows[-2][1]), plain_shingles(rows[-1][1]))
        if like >= 0.8:
            pairs[2 * k + 1] = like
        elif like < 0.6:
            lone.append(2 * k + 1)
    stay = kept(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert len(pairs) > 100 and len(lone) > 50
    assert sum(k not in stay for k in pairs) >= 0.9 * len(pairs) and all(k in stay for k in lone) and all(2 * k in stay for k in range(300))


def test_a_group_of_copies(spark):
    """A third of the rows are near copies of one text, in many partitions: one of them stays."""
    words = [f"w{i * i}" for i in range(400)]
    rows = [(k, " ".join([*words[: k % 390], f"x{k}", *words[k % 390 + 1 :]])) for k in range(600)] + [(1000 + k, " ".join(f"{k}-{i}" for i in range(50))) for k in range(1200)]
    stay = kept(spark.createDataFrame(rows, "doc_id long, text string").repartition(16, "doc_id"))
    assert stay == {0, *range(1000, 2200)}


def test_led():
    rows = np.array([[0] * 96, [1] * 96, [0] * 90 + [7] * 6, [1] * 50 + [2] * 46, [0] * 96], np.uint8)
    like, leader, leads = S.led(rows, 0.8)
    assert dict(zip(like.tolist(), leader.tolist(), strict=True)) == {2: 0, 4: 0} and leads.tolist() == [0, 1, 3]


def test_names_that_clash_are_refused(odd):
    with pytest.raises(ValueError):
        S.near_duplicates(odd.withColumn("fingerprint", F.lit(1)), ["doc_id", "fingerprint"])


def clumped(n, seed=0):
    """Codes with many near each other."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**64, max(1, n // 20), dtype=np.uint64)
    codes = centres[rng.integers(0, len(centres), n)]
    for _ in range(5):
        codes ^= np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64) * rng.integers(0, 2, n, dtype=np.uint64)
    return np.unique(codes)


@pytest.mark.parametrize("n", [1, 2, 300])
def test_near_pairs(n):
    for seed in range(4):
        codes = clumped(n, seed)
        for budget in (0, 1, 4):
            x, y = S.near_pairs(codes, ([0], [len(codes)]), None, budget)
            got = {(min(a, b), max(a, b)) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
            want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if int(codes[i] ^ codes[j]).bit_count() <= budget}
            assert got == want and len(x) == len(want)
        half = len(codes) // 2
        x, y = S.near_pairs(codes, ([0], [half]), ([half], [len(codes)]), 4)
        assert set(zip(x.tolist(), y.tolist(), strict=True)) == {(i, j) for i in range(half) for j in range(half, len(codes)) if int(codes[i] ^ codes[j]).bit_count() <= 4}


def batches(columns, names, size):
    table = pa.table([pa.array(c, pa.int64()) for c in columns], names)
    return iter(table.to_batches(max_chunksize=size))


def test_large_buckets_go_in_parts(monkeypatch):
    """All links of a bucket over PART are found: between its parts and inside them."""
    monkeypatch.setattr(S, "PART", 30)
    codes = clumped(400, 9)
    signed = codes.view(np.int64)
    made = [b.to_pylist() for b in S._join_buckets(4)(batches([np.zeros(len(codes), np.int64), signed], ["key", "fp"], 64))]
    rows = [r for b in made for r in b]
    assert all(r["key"] is not None for r in rows) and {r["a"] for r in rows} == set(signed.tolist())
    last = max(r["part"] for r in rows)
    pairs = sorted({(0, min(r["part"], o), max(r["part"], o), r["part"], r["a"]) for r in rows for o in range(last + 1)})
    links = [(r["a"], r["b"]) for b in S._join_parts(4)(batches(list(zip(*pairs, strict=True)), ["key", "i", "j", "part", "fp"], 50)) for r in b.to_pylist()]
    place = {c: i for i, c in enumerate(signed.tolist())}
    label = S.forest(np.array([place[a] for a, _ in links]), np.array([place[b] for _, b in links]), len(codes))
    assert label.tolist() == roots(codes.tolist())


def test_buckets_in_signed_order():
    """All links of small buckets are found, though their rows come sorted as signed longs."""
    three = np.array([0x8000000000000000, 0xF800000000000000, 0x7800000000000000], np.uint64)
    for codes in (three, *(clumped(n, seed) for n in (5, 60, 300) for seed in range(4))):
        signed = np.sort(codes.view(np.int64))
        rows = [r for b in S._join_buckets(4)(batches([np.zeros(len(codes), np.int64), signed], ["key", "fp"], 64)) for r in b.to_pylist()]
        place = {c: i for i, c in enumerate(signed.tolist())}
        label = S.forest(np.array([place[r["a"]] for r in rows], np.int64), np.array([place[r["b"]] for r in rows], np.int64), len(codes))
        assert label.tolist() == roots(signed.view(np.uint64).tolist())


def test_tables_leave_no_pair_out():
    for n in (1, 10**6, 10**9, 10**12):
        tables = S._tables(n, 4)
        rng = np.random.default_rng(1)
        for _ in range(200):
            bits = {int(b) for b in rng.choice(64, 4, replace=False)}
            assert any(not any(low <= b < low + width for b in bits for low, width in blocks) for _, blocks in tables)
        assert {b for _, blocks in tables for low, width in blocks for b in range(low, low + width)} == set(range(64))


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90 + i) for i in range(9)] + [(int(a), int(b)) for a, b in rng.integers(200, 260, (40, 2))]
    got = {r["node"]: r["root"] for r in S.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges for x in e})
    at = {x: i for i, x in enumerate(nodes)}
    label = S.forest(np.array([at[a] for a, _ in edges]), np.array([at[b] for _, b in edges]), len(nodes))
    assert all(got.get(x, x) == nodes[label[at[x]]] for x in nodes)
