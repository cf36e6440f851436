import hashlib

import numpy as np
import pytest

from lodestone.llm import substrings as S
from lodestone.llm.queries import QUERIES


def brute(rows, width=100):
    """(n_bytes, n_removed, n_spans, kept) of each text, in the order given."""
    seen, out = set(), []
    for _, text in rows:
        n, change = len(text), np.zeros(len(text) + 1, int)
        for p in range(n - width + 1):
            s = text[p : p + width]
            if s in seen:
                change[p] += 1
                change[p + width] -= 1
            seen.add(s)
        gone = np.cumsum(change)[:n] > 0
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        out.append((n, int(gone.sum()), spans, bytes(np.frombuffer(text, np.uint8)[~gone])))
    return out


def check(got, rows, width=100):
    want = sorted((str(k), n, r, s, hashlib.sha256(kept).hexdigest()) for (k, _), (n, r, s, kept) in zip(rows, brute(rows, width), strict=True))
    assert want == sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got)


def test_query(spark, sf_dir, plain):
    check(QUERIES["op10_suffix_array_dedup"](spark, sf_dir).collect(), [(k, t.encode()) for k, t in plain])


def planted(seed=0):
    rng = np.random.default_rng(seed)
    base = [bytes(rng.integers(97, 123, int(rng.integers(50, 400))).astype(np.uint8)) for _ in range(6)]
    rows = []
    for i in range(80):
        parts = [base[j][int(rng.integers(0, 60)) :] for j in rng.integers(0, 6, int(rng.integers(0, 4)))] + [b"ab" * int(rng.integers(0, 200)), b"x" * int(rng.integers(0, 250))]
        rng.shuffle(parts)
        rows.append((int(i), b"".join(parts)))
    return rows


@pytest.mark.parametrize("width", [100, 40])
def test_planted(spark, width):
    rows = planted()
    df = spark.createDataFrame([(k, t.decode()) for k, t in rows], "doc_id long, text string").repartition(7)
    check(S.remove_repeats(df, width).collect(), rows, width)


def test_odd_rows(spark, odd, none, odd_rows):
    got = S.remove_repeats(odd, with_text=True).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"]) for r in got) == sorted((str(r[0]), len((r[1] or "").encode())) for r in odd_rows)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and len(r["kept"]) == r["n_bytes"] - r["n_removed"] for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[2]["n_removed"] == by[2]["n_bytes"] and by[9]["n_removed"] == 4999 and by[6]["n_removed"] > 0 and by[8]["n_removed"] == 0
    assert sorted(r["n_removed"] > 0 for r in got if r["doc_id"] == 1) == [False, False, True]
    assert S.remove_repeats(none).count() == 0
    with pytest.raises(ValueError):
        S.remove_repeats(odd, 16)


def test_runs_cover_all_windows(monkeypatch):
    monkeypatch.setattr(S, "PIECE", 700)
    rows = [t for _, t in planted(3)] + [b"", b"q" * 99, b"q" * 100, b"q" * 3000]
    runs = S.runs_of(rows)
    for row, text in enumerate(rows):
        mine = np.flatnonzero(runs["row"] == row)
        first = runs["q"][mine] - runs["left"][mine]
        windows = sorted(w for f, m in zip(first.tolist(), runs["more"][mine].tolist(), strict=True) for w in range(f, f + m + 1))
        assert windows == list(range(max(0, len(text) - 99)))
        for q, a in zip(runs["q"][mine].tolist(), runs["a"][mine].tolist(), strict=True):
            assert int.from_bytes(text[q : q + 8], "big") == a


def test_multikey_order_and_merge():
    rng = np.random.default_rng(1)
    keys = [rng.integers(0, 4, 500) for _ in range(4)]
    got = S.multikey_order(*keys)
    want = np.lexsort(keys[::-1])
    assert all((k[got] == k[want]).all() for k in keys)
    assert len(S.multikey_order(np.empty(0, int), np.empty(0, int))) == 0
    row, start, end = S.merge(np.array([1, 0, 1, 1]), np.array([5, 0, 0, 9]), np.array([9, 2, 6, 12]))
    assert (row.tolist(), start.tolist(), end.tolist()) == ([0, 1], [0, 0], [2, 12])
