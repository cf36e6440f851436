import re
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from oracle import differ

from lodestone.llm.mixing import mix, mix_rows, targets
from lodestone.llm.oracles import ORACLES
from lodestone.llm.queries import QUERIES


def fill(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by the words of the contract: deal, stop, deal the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, open_ = {}, share * sum(sizes.values()), set(order)
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > most * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        out |= {s: float(most * sizes[s]) for s in over}
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
    return out


def test_same_as_sql(spark, sf_dir):
    assert differ(spark, sf_dir, QUERIES["op1_mix_sources"], ORACLES["op1_mix_sources"]) == ""


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(sizes=st.dictionaries(st.one_of(st.none(), st.text("abé", min_size=1, max_size=2)), st.integers(0, 1000), min_size=1, max_size=7))
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r["source"]: r["target"] for r in targets(df, (5, 2, 1), (3, 2), 2).collect()}
    want = fill(sizes)
    assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in sizes), (got, want)


def test_odd_rows(odd, none, odd_rows):
    rows = mix(odd).collect()
    assert len(rows) == len(odd_rows) and mix(none).count() == 0
    sums, goal, size = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        sums[r["source"]] += r["taken"]
        goal[r["source"]] = r["target"]
        size[r["source"]] += r["size"]
    want = fill(size)
    assert all(sums[s] == int(goal[s]) and abs(goal[s] - want[s]) < 1e-6 for s in goal)
    assert sorted(map(str, rows)) == sorted(map(str, mix(odd.repartition(1)).collect()))


def test_rows_of_the_mix(docs, odd):
    words = re.compile(r"[^\x20\x09-\x0D]+")
    for df in (docs, odd):
        plan = {}
        for r in mix(df).collect():
            plan.setdefault((r["doc_id"], r["source"]), []).append(r["taken"])
        got = defaultdict(int)
        for r in mix_rows(df, ["doc_id", "text", "source", "n_chars"]).collect():
            got[r["doc_id"], r["source"]] += len(words.findall(r["text"]))
            assert r["n_chars"] == len(r["text"])
        assert {k: sum(v) for k, v in plan.items() if sum(v)} == dict(got)
