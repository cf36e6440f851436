import zlib

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import quality as Q
from lodestone.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    """Judged on labelled documents that the fit has never seen."""
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op3_quality_network"](spark, sf).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count() and got.score.between(0, 1).all()
    assert all(got.held_out[i] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got.index)
    assert ((got.score >= 0.5).astype(int) == got.predicted).all()
    seen = labels[[got.held_out[i] for i in labels.doc_id]]
    right = np.mean([got.predicted[i] == q for i, q in zip(seen.doc_id, seen.quality, strict=True)])
    assert right >= 0.95 and right > seen.quality.mean()


def test_chunks_cover_the_text():
    for n in (0, 1, 63, 64, 65, 511, 512, 513, 960, 961, 5000):
        text = bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8))
        rows, lengths = Q.cut_chunks(text)
        back = {}
        for k, (row, length) in enumerate(zip(rows, lengths, strict=True)):
            back |= {k * Q.STRIDE + i: int(row[i]) for i in range(length)}
            assert (row[length:] == Q.PAD).all() or length == Q.CHUNK
        assert bytes(back[i] for i in range(n)) == text


def plain(net, text):
    """The network's probability, place by place."""
    logits = []
    for row, length in zip(*Q.cut_chunks(text), strict=True):
        answers = [sum(net.tables[k][row[i + k]] for k in range(Q.KERNEL)) for i in range(max(1, length))]
        h = np.maximum(np.max(answers, axis=0) + net.bias, 0)
        logits.append(np.maximum(h @ net.hidden + net.hidden_bias, 0) @ net.out + net.out_bias)
    return 1 / (1 + np.exp(-np.mean(logits)))


def test_scores_are_those_of_the_network():
    rng = np.random.default_rng(0)
    texts = [b"", b"a", b"plain words here " * 90, bytes(rng.integers(0, 256, 1500, dtype=np.uint8))]
    cut = [Q.cut_chunks(t) for t in texts]
    net = Q.train(np.concatenate([c for c, _ in cut]), np.concatenate([n for _, n in cut]), np.repeat(np.arange(4), [len(c) for c, _ in cut]), np.array([0, 1, 1, 0], np.float32), epochs=3)
    assert np.allclose(Q.probabilities(net, texts, block=2), [plain(net, t) for t in texts], atol=1e-5)
    assert np.allclose(Q.probabilities(net, texts, block=2), Q.probabilities(net, texts, block=64), atol=1e-6)


def test_no_or_one_label(spark, odd, none):
    labels = "doc_id long, quality int, toxic int"
    for rows, want in (([], 0.5), ([(i, 1, 0) for i in range(1, 10)] + [(None, 0, 0), (3, None, 0)], None)):
        net = Q.fit(odd, spark.createDataFrame(rows, labels))
        got = Q.classify(odd, net, ["doc_id"]).collect()
        assert len(got) == odd.count() and len({r["score"] for r in got}) == 1
        assert want is None or got[0]["score"] == want
        assert want is not None or got[0]["score"] > 0.5
    assert Q.classify(none, net, ["doc_id", "text"]).count() == 0
    assert odd.select(Q.held_out()).filter(F.col(odd.select(Q.held_out()).columns[0])).count() >= 0
