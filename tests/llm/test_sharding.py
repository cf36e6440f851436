import zlib
from collections import defaultdict

from lodestone.llm.queries import QUERIES
from lodestone.llm.sharding import shard


def check(got, rows, shards=8):
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(k), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in rows)
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["shard"], r["slot"])):
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        by[r["shard"]].append(r)
    order = []
    for s in sorted(by):
        assert [r["slot"] for r in by[s]] == list(range(len(by[s])))
        order += [r["doc_id"] for r in by[s]]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))  # contiguous in order of id
    total, most = sum(r["size"] for r in got), max(r["size"] for r in got)
    assert all(abs(sum(r["size"] for r in by.get(s, [])) - total / shards) <= most for s in range(shards))


def test_query(spark, sf_dir, plain):
    got = QUERIES["op8_shard_bytes"](spark, sf_dir).collect()
    check(got, plain)
    assert sorted(map(str, got)) == sorted(map(str, QUERIES["op8_shard_bytes"](spark, sf_dir).collect()))


def test_odd_rows(odd, none, odd_rows):
    check(shard(odd).collect(), [(r[0], r[1]) for r in odd_rows])
    check(shard(odd, 3).collect(), [(r[0], r[1]) for r in odd_rows], 3)
    assert shard(none).count() == 0
