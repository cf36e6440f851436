"""Each stage of the pipeline on what the one before kept, against the operators' plain versions."""

import numpy as np
from test_decontaminate import brute as hits
from test_simhash import jaccard, plain_shingles
from test_tokens import expected

import corpus_pipeline as P
from lodestone.llm.mixing import mix
from lodestone.llm.quality import classify, fit


def test_stages(spark, sf_dir):
    assert [name for name, _ in P.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "token_files"] and P.ORACLE_SQL is None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(P.STAGES)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = stages["quality"](spark, docs, sf_dir).cache()
    scored = {r["doc_id"]: r["score"] for r in classify(docs, fit(docs, labels), ["doc_id"]).collect()}
    assert sorted(r["doc_id"] for r in good.collect()) == sorted(i for i, s in scored.items() if s >= 0.5) and good.columns == docs.columns

    single = stages["near_dedup"](spark, good, sf_dir).cache()
    rows = sorted((r["doc_id"], r["text"]) for r in good.collect())
    first = sorted(r["doc_id"] for r in single.collect())
    sets = {k: plain_shingles(t) for k, t in rows}
    stay = set(first)
    # What stays has no like of 0.8 or more; what goes has one near that, which comes before it or goes itself.
    assert all(jaccard(sets[a], sets[b]) < 0.8 for a in first for b in first if a < b)
    for k, _ in rows:
        assert k in stay or max(jaccard(sets[k], sets[o]) for o, _ in rows if o != k) > 0.65
    assert min(sets) in stay and len(first) < len(rows) and single.columns == docs.columns

    clean = stages["decontaminate"](spark, single, sf_dir).cache()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    texts = dict(rows)
    some = first[:60]  # the plain search is slow; the operator's own test covers all documents
    kept = {r["doc_id"] for r in clean.collect()}
    assert all((i in kept) == (hits(texts[i], items)[1] == 0) for i in some) and clean.columns == docs.columns

    mixed = stages["mix"](spark, clean, sf_dir).cache()
    plan = {r["doc_id"]: (r["taken"], r["size"]) for r in mix(clean).collect()}
    copies = {}
    for r in mixed.collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + len(r["text"].encode().split())
    assert copies == {i: t for i, (t, _) in plan.items() if t} and mixed.columns == docs.columns

    files = sorted(stages["token_files"](spark, mixed, sf_dir).collect(), key=lambda r: r["start"])
    want = expected(sorted((r["doc_id"], r["text"]) for r in mixed.collect()))
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in files) == sorted((k, n, c) for k, _, n, c in want)
    assert [r["start"] for r in files] == np.cumsum([0, *(r["n_tokens"] for r in files[:-1])]).tolist()


def test_odd_rows(spark, odd, none, tmp_path):
    bench = spark.createDataFrame([(1, "no id at all")], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for start in (odd, none):
        docs = start
        for k, (_, stage) in enumerate(P.STAGES):
            made = stage(spark, docs, str(tmp_path))
            made.write.mode("overwrite").parquet(str(tmp_path / f"{start.isEmpty()}-{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{start.isEmpty()}-{k}"))
        assert (docs.count() > 0) == (start is odd)


def test_near_dedup_keeps_a_row_of_each_component(spark, tmp_path):
    """Rows of one id, or of none, with texts that are no duplicates stay; a null text goes if it has a like with an id."""
    text = {k: " ".join(f"{k}{i * i}" for i in range(60)) for k in "abcdef"}
    rows = [(1, text["a"]), (1, text["b"]), (None, text["c"]), (None, text["d"]), (None, text["c"]), (2, text["e"]), (None, text["e"]), (3, ""), (None, None), (4, text["f"]), (4, text["f"])]
    docs = spark.createDataFrame([(k, t, "en", "s", None) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = P.near_dedup(spark, docs, str(tmp_path))
    want = [(1, text["a"]), (1, text["b"]), (None, text["c"]), (None, text["d"]), (2, text["e"]), (3, ""), (4, text["f"])]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(str, want)) and got.columns == docs.columns


def test_run(spark, sf_dir):
    """run() is its stages one after the other; the files hold the tokens of what the last but one gave."""
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in P.run(spark, sf_dir).collect())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    want = expected(sorted((r["doc_id"], r["text"]) for r in docs.collect()))
    assert [g[0] for g in got] == [w[0] for w in want] and sorted((g[0], g[2], g[3]) for g in got) == sorted((k, n, c) for k, _, n, c in want)
    by_start = sorted(got, key=lambda g: g[1])
    assert [g[1] for g in by_start] == np.cumsum([0, *(g[2] for g in by_start[:-1])]).tolist()
