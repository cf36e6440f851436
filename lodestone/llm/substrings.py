"""Exact removal of repeated substrings with a sparse suffix array that is dealt by range.

A document's windows are its strings of WIDTH bytes. Of all suffixes, only those at anchors are sorted: a window's anchor
is the place in it whose KGRAM bytes have the least hash, so equal windows have equal anchors and every window has one.
Successive windows with one anchor are a run. Equal windows therefore meet as runs whose suffixes begin with the same
KGRAM bytes. Five steps, each a mapInArrow over rows that are dealt by key:

1. read: cut texts into runs; of runs with equal bytes in one stretch of documents only the first goes on, the others
   are repeats already. Suffixes are dealt to buckets between splitters sampled from their leading bytes. The texts go
   into files in the shared folder.
2. sort: order each bucket's suffixes by multikey quicksort and compare neighbours. A run equal to an earlier one is
   a repeat as a whole. Of runs that share an anchor and differ, the first of each kind is asked for.
3. fetch: read the bytes of what was asked for.
4. compare: each window of those runs against the earliest equal window.
5. keep: per file, merge what was found and cut it out of the texts.

Splitters are distinct leading bytes, so suffixes that agree in them never lie on two sides of a bucket's boundary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.blocks import batch_of, by_key, filesystem, joined, pack, split, take, unpack
from lodestone.llm.common import release, scratch
from lodestone.shipping import ship

WIDTH, KGRAM = 100, 16
#: Text that is cut into runs at once; longer texts are cut in pieces, whose windows are those that begin in the piece.
PIECE = 1 << 20
#: A file of texts holds so much text, or so many runs, if no single document is larger.
FILE_BYTES, FILE_RUNS = 8 << 20, 300_000
#: Suffixes of a bucket.
BUCKET = 250_000
SAMPLED_TEXTS, SAMPLED_SUFFIXES = 400, 200

KINDS = "kind int, at long, data binary"
RUNS, MARK, SPANS, ASKED, BYTES = range(5)

_RUN = [("a", "u8"), ("b", "u8"), ("c", "u8"), ("d", "u8"), ("doc", "i8"), ("loc", "i8"), ("q", "i8"), ("left", "u1"), ("more", "u1")]
_SPAN = [("loc", "i8"), ("start", "i8"), ("end", "i8")]
_ASK = [("a", "u8"), ("b", "u8"), ("doc", "i8"), ("loc", "i8"), ("q", "i8"), ("left", "u1"), ("more", "u1")]


def multikey_order(*keys: np.ndarray) -> np.ndarray:
    """The order by the first key, then only where that ties by the next, and so on, as multikey quicksort does."""
    order = np.argsort(keys[0], kind="stable")
    ties = np.zeros(len(order), np.int64)
    for last, key in pairwise(keys):
        new = np.concatenate(([True], (last[order][1:] != last[order][:-1]) | (ties[1:] != ties[:-1]))) if len(order) else np.empty(0, bool)
        ties = np.cumsum(new)
        open_ = np.flatnonzero(~(new & np.concatenate((new[1:], [True])))) if len(order) else np.empty(0, np.int64)
        if not open_.size:
            return order
        order[open_] = order[open_][np.lexsort((key[order[open_]], ties[open_]))]
    return order


def cut_runs(buffer: np.ndarray, valid: list[tuple[int, int]], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window, last window, anchor. valid: ranges of places where windows begin."""
    n = len(buffer) - width + 1
    if n <= 0 or not valid:
        return (np.empty(0, np.int64),) * 3
    eight = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))
    h = eight[: len(buffer) - KGRAM + 1] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    h += eight[KGRAM - 8 :] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    place = np.uint64((1 << 24) - 1)  # a buffer has fewer places than that
    h &= ~place
    h |= np.arange(len(h), dtype=np.uint64)
    reach, least = 1, h
    while 2 * reach <= width - KGRAM + 1:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    over = width - KGRAM + 1 - reach
    if over:
        least = np.minimum(least[:-over], least[over:])
    anchor = (least & place).astype(np.int32)
    begins = np.zeros(n + 1, np.int8)
    inside = np.zeros(n, bool)
    for s, e in valid:
        inside[s:e] = True
        begins[s] = 1
    new = inside & (begins[:n].astype(bool) | np.concatenate(([True], anchor[1:] != anchor[:-1])))
    first = np.flatnonzero(new)
    stop = np.flatnonzero(inside & ~np.concatenate((inside[1:] & ~new[1:], [False])))
    return first, stop, anchor[first].astype(np.int64)


def _read_big(buffer: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.ndarray((len(buffer) - 7,), ">u8", buffer, strides=(1,))[places].astype(np.uint64)


def runs_of(texts: list[bytes], width: int = WIDTH) -> dict[str, np.ndarray]:
    """All runs of texts: a, b (the first KGRAM bytes at the anchor), c (a hash of the run's bytes), row, q, left, more."""
    out: list[dict[str, np.ndarray]] = []
    waiting: list[tuple[int, int, bytes, int]] = []  # row, place of the piece in its text, bytes, windows
    held = 0

    def flush() -> None:
        nonlocal held
        buffer = np.frombuffer(b"".join(w[2] for w in waiting) + b"\0" * 8, np.uint8)
        begins = np.cumsum([0, *(len(w[2]) for w in waiting)])
        first, last, q = cut_runs(buffer[: begins[-1]], [(int(s), int(s) + w[3]) for s, w in zip(begins, waiting, strict=False)], width)
        owner = np.searchsorted(begins, first, "right") - 1
        rows, at = np.array([w[0] for w in waiting]), np.array([w[1] for w in waiting])
        view = memoryview(buffer)
        both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[s : e + width]) for s, e in zip(first.tolist(), last.tolist(), strict=True)]), ">u8").reshape(-1, 2).astype(np.uint64)
        shift = at[owner] - begins[owner]
        out.append({"a": _read_big(buffer, q), "b": _read_big(buffer, q + 8), "c": both[:, 0], "d": both[:, 1], "row": rows[owner], "q": q + shift, "left": (q - first).astype(np.uint8), "more": (last - first).astype(np.uint8)})
        waiting.clear()
        held = 0

    for row, text in enumerate(texts):
        windows = len(text) - width + 1
        for at in range(0, windows, PIECE):
            many = min(PIECE, windows - at)
            waiting.append((row, at, text[at : at + many + width - 1], many))
            held += len(waiting[-1][2])
            if held >= PIECE:
                flush()
    if waiting:
        flush()
    names = [("a", "u8"), ("b", "u8"), ("c", "u8"), ("d", "u8"), ("row", "i8"), ("q", "i8"), ("left", "u1"), ("more", "u1")]
    return joined(names, out)


def merge(rows: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each row, with those that overlap or touch made one."""
    order = np.lexsort((start, rows))
    rows, start, end = rows[order], start[order], end[order]
    if not len(rows):
        return rows, start, end
    # Rows are laid out one behind the other, so that one running maximum serves all.
    _, number = np.unique(rows, return_inverse=True)
    far = number * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + far)
    new = np.concatenate(([True], (start + far)[1:] > reach[:-1]))
    first = np.flatnonzero(new)
    return rows[first], start[first], (reach - far)[np.concatenate((first[1:], [len(rows)])) - 1]


def _order_of(columns: dict[str, np.ndarray]) -> np.ndarray:
    return multikey_order(columns["a"], columns["b"], columns["c"], columns["d"], columns["doc"], columns["loc"], columns["q"])


def _firsts(columns: dict[str, np.ndarray], *names: str) -> np.ndarray:
    new = np.zeros(len(columns[names[0]]), bool)
    new[:1] = True
    for n in names:
        new[1:] |= columns[n][1:] != columns[n][:-1]
    return new


def _reader(uri: str, splitters: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = filesystem(uri)
        task = TaskContext.get()
        keys: list[int | None] = []
        texts: list[bytes] = []
        found: list[dict[str, np.ndarray]] = []
        waiting: list[tuple[int | None, bytes]] = []
        held = many = serial = fresh = 0

        def digest() -> None:
            nonlocal many, fresh
            if waiting:
                runs = runs_of([t for _, t in waiting], width)
                runs["row"] = runs["row"] + len(texts)
                keys.extend(k for k, _ in waiting)
                texts.extend(t for _, t in waiting)
                found.append(runs)
                many += len(runs["a"])
                waiting.clear()
                fresh = 0

        def close() -> pa.RecordBatch:
            nonlocal held, many, serial
            file = task.partitionId() << 16 | serial
            runs = joined([*_RUN[:4], ("row", "i8"), *_RUN[6:]], found)
            ids = np.array([-(2**63) if k is None else k for k in keys], np.int64)
            runs["doc"], runs["loc"] = ids[runs["row"]], np.int64(file) << 24 | runs["row"]
            runs = take(runs, _order_of(runs))
            first = _firsts(runs, "a", "b", "c", "d")
            begin = runs["q"] - runs["left"]
            spans = merge(runs["row"][~first], begin[~first], (begin + runs["more"] + width)[~first])
            table = pa.table({"doc_id": pa.array(keys, pa.int64()), "text": pa.array(texts, pa.binary())})
            table = table.replace_schema_metadata({"spans": pack(_SPAN, dict(zip(("loc", "start", "end"), spans, strict=True)))})
            name = f"{file}-{task.taskAttemptId()}"  # an attempt's own: nothing is written over, on any store
            with files.open_output_stream(f"{folder}/{name}") as out:
                pq.write_table(table, out, compression="zstd", compression_level=1, use_dictionary=False, write_statistics=False)
            sent = take(runs, np.flatnonzero(first))
            rows = [(MARK, file, name.encode()), *split(_RUN, sent, np.searchsorted(splitters, sent["a"], "right"), RUNS)]
            keys.clear(), texts.clear(), found.clear()
            held, many, serial = 0, 0, serial + 1
            release()
            return batch_of(rows)

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = text.as_py()
                waiting.append((key, raw))
                held += len(raw)
                fresh += len(raw)
                if fresh >= PIECE or len(waiting) >= 4096:
                    digest()
                    if held >= FILE_BYTES or many >= FILE_RUNS or len(texts) >= 1 << 20:
                        yield close()
        digest()
        if texts:
            yield close()

    return run


def _name(rows: list[tuple[int, bytes]]) -> str:
    """The name of the file that rows belong to."""
    return next(d for k, d in rows if k == MARK).decode()


def _sorter(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in by_key(batches):
            out = [(k, key, d) for k, d in rows if k != RUNS]
            runs = joined(_RUN, [unpack(_RUN, d)[0] for k, d in rows if k == RUNS])
            runs = take(runs, _order_of(runs))
            kind = _firsts(runs, "a", "b", "c", "d")
            group = np.cumsum(_firsts(runs, "a", "b"))
            begin = runs["q"] - runs["left"]
            again = np.flatnonzero(~kind)
            out += split(_SPAN, {"loc": runs["loc"][again], "start": begin[again], "end": (begin + runs["more"] + width)[again]}, runs["loc"][again] >> 24, SPANS)
            kinds = np.bincount(group[kind], minlength=1) if len(group) else np.zeros(1, np.int64)
            ask = np.flatnonzero(kind & (kinds[group] > 1))
            asked = take(runs, ask)
            out += split(_ASK, asked, asked["loc"] >> 24, ASKED)
            if out:
                yield batch_of(out)

    return run


def _fetcher(uri: str, splitters: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = filesystem(uri)
        for key, rows in by_key(batches):
            yield batch_of([(k, key, d) for k, d in rows if k != ASKED] or [])
            asked = joined(_ASK, [unpack(_ASK, d)[0] for k, d in rows if k == ASKED])
            if not len(asked["a"]):
                continue
            with files.open_input_file(f"{folder}/{_name(rows)}") as f:
                texts = pq.read_table(f, columns=["text"]).column("text").combine_chunks()
            bucket = np.searchsorted(splitters, asked["a"], "right")
            order = np.lexsort((asked["loc"], bucket))
            asked, bucket = take(asked, order), bucket[order]
            cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            begin = asked["q"] - asked["left"]
            for s, e in pairwise([*cuts, len(bucket)]):
                parts, row, text = [], -1, b""
                for loc, at, more in zip(asked["loc"][s:e].tolist(), begin[s:e].tolist(), asked["more"][s:e].tolist(), strict=True):
                    if loc & 0xFFFFFF != row:
                        row = loc & 0xFFFFFF
                        text = texts[row].as_buffer()
                    parts.append(text.slice(at, more + width).to_pybytes())
                yield batch_of([(BYTES, int(bucket[s]), pack(_ASK, {k: v[s:e] for k, v in asked.items()}, b"".join(parts)))])

    return run


def repeated_windows(asked: dict[str, np.ndarray], data: bytes, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows of runs, those that equal an earlier window: the run's index and the window's number in its run.

    Windows are equal if they lie alike about equal anchors and their bytes have the same two 64-bit hashes, polynomials
    over random tables.
    """
    raw = np.frombuffer(data, np.uint8)
    n = len(raw)
    many = asked["more"].astype(np.int64) + 1
    length = many + width - 1
    begin = np.cumsum(length) - length
    run = np.repeat(np.arange(len(many)), many)
    number = np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many)
    at = begin[run] + number

    def hashed(seed: int, base: int) -> np.ndarray:
        """Each window's hash; what it takes is given back before the next is made."""
        table = np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))), dtype=np.uint64)
        sums = table[raw]
        sums *= power[:n]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(sums, dtype=np.uint64)))
        out = sums[at + width]
        out -= sums[at]
        del sums
        power[1:] = pow(base, -1, 1 << 64)
        out *= np.cumprod(power, dtype=np.uint64)[at]
        return out

    value, more = hashed(100, 0x2545F4914F6CDD1D), hashed(101, 0x9E3779B97F4A7C15)
    group = np.zeros(len(many), np.int64)
    order = multikey_order(asked["a"], asked["b"])
    group[order] = np.cumsum(_firsts(take({"a": asked["a"], "b": asked["b"]}, order), "a", "b"))
    earlier = np.empty(len(many), np.int64)
    earlier[np.lexsort((asked["q"], asked["loc"], asked["doc"]))] = np.arange(len(many))
    place = group[run] * 256 + asked["left"][run].astype(np.int64) - number  # group, and the anchor's place in the window
    order = multikey_order(value, more, place, earlier[run])
    first = np.ones(len(order), bool)
    first[1:] = (value[order][1:] != value[order][:-1]) | (more[order][1:] != more[order][:-1]) | (place[order][1:] != place[order][:-1])
    again = np.sort(order[~first])
    return run[again], number[again]


def _comparer(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in by_key(batches):
            out = [(k, key, d) for k, d in rows if k != BYTES]
            got = [unpack(_ASK, d) for k, d in rows if k == BYTES]
            if got:
                asked = joined(_ASK, [g[0] for g in got])
                which, number = repeated_windows(asked, b"".join(g[1] for g in got), width)
                start = (asked["q"] - asked["left"])[which] + number
                loc, start, end = merge(asked["loc"][which], start, start + width)
                out += split(_SPAN, {"loc": loc, "start": start, "end": end}, loc >> 24, SPANS)
            if out:
                yield batch_of(out)

    return run


def _keeper(uri: str, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = filesystem(uri)
        for key, rows in by_key(batches):
            with files.open_input_file(f"{folder}/{_name(rows)}") as f:
                table = pq.read_table(f)
            own = unpack(_SPAN, table.schema.metadata[b"spans"])[0]
            spans = joined(_SPAN, [own, *(unpack(_SPAN, d)[0] for k, d in rows if k == SPANS)])
            row, start, end = merge(spans["loc"] & 0xFFFFFF, spans["start"], spans["end"])
            ends = np.searchsorted(row, np.arange(table.num_rows), "right").tolist()
            begins = np.searchsorted(row, np.arange(table.num_rows)).tolist()
            start, end = start.tolist(), end.tolist()
            ids = table.column("doc_id").to_pylist()
            texts = table.column("text").combine_chunks()
            made: list[tuple] = []
            size = 0
            for i in range(table.num_rows):
                text = texts[i].as_buffer()
                view, at, parts = memoryview(text), 0, []
                for k in range(begins[i], ends[i]):
                    parts.append(view[at : start[k]])
                    at = end[k]
                parts.append(view[at:])
                sha = hashlib.sha256()
                for p in parts:
                    sha.update(p)
                kept = b"".join(parts) if with_text else b""
                made.append((ids[i], len(view), sum(end[k] - start[k] for k in range(begins[i], ends[i])), ends[i] - begins[i], sha.hexdigest(), kept))
                size += len(kept)
                if size > PIECE or i == table.num_rows - 1:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
                    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names)
                    yield batch if with_text else batch.drop_columns(["kept"])
                    made, size = [], 0

    return run


def _sampler(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column(0).to_pylist():
                a = runs_of([text], width)["a"]
                a = a[np.random.default_rng(len(text)).permutation(len(a))[:SAMPLED_SUFFIXES]]
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64), pa.int64())], ["a"])

    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, with_text: bool = False) -> DataFrame:
    """Cut every byte out of docs' texts that a string of width bytes covers which also starts earlier.

    Earlier is a smaller doc_id, or the same document and an earlier start; strings are judged on the input and never
    cross documents. Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256, and with_text
    kept, the remaining bytes.

    A stretch of FILE_BYTES of text sends each distinct run once, so that a passage in most documents makes no more rows
    of one key than there are stretches. width: from KGRAM + 1 to 200.

    Nulls: a null text is empty; null ids are before all others. Rows of equal id are in the order in which Spark reads
    them. Texts shorter than width have no windows and stay whole. Repeated rows: all but the first lose what is as long
    as width. Empty table: no rows. Only doc_id and text are looked at.
    """
    if not KGRAM < width <= 200:
        raise ValueError("width must be from 17 to 200")
    spark = docs.sparkSession
    ship(spark)
    uri = scratch(spark, "substrings")
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("_bytes"))
    count, size = raw.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_bytes")), F.lit(0))).first()
    buckets = max(4, -(-2 * size // ((width - KGRAM + 1) * BUCKET)))
    sample = raw.select("_bytes").sample(min(1.0, SAMPLED_TEXTS / max(1, count)), seed=1).mapInArrow(_sampler(width), "a long").toPandas()["a"].to_numpy()
    sampled = np.sort(sample.astype(np.int64).view(np.uint64))
    splitters = np.unique(sampled[np.linspace(0, len(sampled) - 1, buckets + 1)[1:-1].astype(int)]) if len(sampled) else sampled

    def deal(df: DataFrame) -> DataFrame:
        # Buckets are numbered from 0; a file's number has its task in the high bits and its place there in the low ones.
        to = F.shiftright("at", 16) + F.col("at").bitwiseAND(F.lit(0xFFFF))
        return df.repartitionById(buckets, (to % buckets).cast("int")).sortWithinPartitions("at")

    runs = raw.mapInArrow(_reader(uri, splitters, width), KINDS)
    found = deal(runs).mapInArrow(_sorter(width), KINDS)
    fetched = deal(found).mapInArrow(_fetcher(uri, splitters, width), KINDS)
    compared = deal(fetched).mapInArrow(_comparer(width), KINDS)
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return deal(compared).mapInArrow(_keeper(uri, with_text), result)
