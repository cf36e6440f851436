import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import tokens as T
from lodestone.llm.common import scratch
from lodestone.llm.queries import QUERIES

ODD = ["", "  ", "a<|endoftext|>b", "It's I'LL x'dy", "Ångström é ÉÈ á", "日本語 テスト Σας ΟΔΟΣ", "İstanbul ß ẞ", "\x1c\x1d a\x1fb \x85 ²³½", "don't 'S 'sx", "😀😀 👩‍👩‍👧", "x̀́y\tz\r\n\x0b\x0c q", "<|startoftext|><|endoftext|> <| |>", "ŉ ǆ ſ K Å", "end. word, (a) b! c; d:"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=3000))
def test_pack_round_trip(values):
    v = np.array(values, np.uint64)
    words, offsets = T.pack(v)
    assert (T.unpack(words, offsets, len(v)) == v).all()


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 600_000])
def test_file_round_trip(n):
    ids = np.random.default_rng(n).integers(0, 49_408, n, dtype=np.uint32)
    keys, lengths, back = T.from_file(T.to_file([5, None], [n // 2, n - n // 2], ids))
    assert keys == [5, None] and lengths.tolist() == [n // 2, n - n // 2] and (back == ids).all()
    if n > 1000:
        assert len(T.to_file([1], [n], ids)) < 3 * n + 200
    with pytest.raises(ValueError):
        T.from_file(b"x" * 64)


def test_pieces_are_encoded_as_the_library_does(plain, monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 400)  # so that pieces are forgotten and met again
    encoder = T.Encoder(T.vocabulary_path())
    for text in [*ODD, *(t for _, t in plain)]:
        assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == encoder.whole.encode(text, add_special_tokens=False).ids, text[:80]


def expected(rows):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(T.vocabulary_path())
    out, start = [], 0
    for key, text in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query(spark, sf_dir, plain):
    got = sorted(map(tuple, QUERIES["op4_simple8b_tokens"](spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    assert got == expected(plain)


def test_odd_rows(spark, odd, none, odd_rows):
    uri = scratch(spark, "t")
    got = sorted(T.read_tokens(T.write_tokens(odd, uri), uri).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in odd_rows), key=lambda i: (i is not None, i or 0))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(k), n, c) for k, _, n, c in expected([(r[0], r[1]) for r in odd_rows]))
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(got, got[1:], strict=False)) and got[0]["start"] == 0
    uri = scratch(spark, "t")
    assert T.read_tokens(T.write_tokens(none, uri), uri).count() == 0
