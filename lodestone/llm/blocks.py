"""Blocks: columns of numbers packed into one binary value, so that many small rows travel as one, and files of them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard

from lodestone.llm.common import release


def pack(fields: list[tuple[str, str]], columns: dict[str, np.ndarray], tail: bytes = b"") -> bytes:
    n = len(columns[fields[0][0]])
    parts = [np.ascontiguousarray(columns[f].astype("<" + k).view(np.uint8).reshape(n, int(k[1])).T).tobytes() for f, k in fields]
    return zstandard.ZstdCompressor(1).compress(b"".join((n.to_bytes(8, "little"), *parts, tail)))


def unpack(fields: list[tuple[str, str]], data: bytes) -> tuple[dict[str, np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, {}
    for f, k in fields:
        width = int(k[1])
        out[f] = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view("<" + k).reshape(n)
        at += n * width
    return out, raw[at:]


def joined(fields: list[tuple[str, str]], found: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {f: np.concatenate([x[f] for x in found]) if found else np.empty(0, k) for f, k in fields}


def take(columns: dict[str, np.ndarray], which: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[which] for k, v in columns.items()}


def batch_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["kind", "at", "data"])


def split(fields: list[tuple[str, str]], columns: dict[str, np.ndarray], key: np.ndarray, kind: int) -> Iterator[tuple[int, int, bytes]]:
    """A row for each value of key, with the columns of its places."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else []
    for s, e in pairwise([*cuts, len(key)]):
        yield kind, int(key[s]), pack(fields, take(columns, order[s:e]))


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """Rows of one value of at, which come together."""
    held_key, held = None, []
    for b in batches:
        for kind, key, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            if held and key != held_key:
                yield held_key, held
                held = []
                release()
            held_key = key
            held.append((kind, data.as_py()))
    if held:
        yield held_key, held
