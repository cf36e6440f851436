"""Token ids in word-aligned binary files (Simple-8b), written by Spark tasks and read back."""

from __future__ import annotations

import functools
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.blocks import filesystem
from lodestone.llm.common import prefix_sums, release
from lodestone.shipping import ship

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
BLOCK = 1024
#: A file is closed when it holds so many ids; a longer document still goes into one file.
FILE_IDS = 1_000_000
#: Blocks that are packed at once.
AT_ONCE = 256
#: Text of a range partition, which one task writes.
PART_BYTES = 24 << 20
#: A worker remembers the ids of so many pieces of text: when half as many are new, those not met since the last time go.
REMEMBERED = 800_000

MAGIC = b"LS8B\x01\x00\x00\x00"
HEADER = struct.Struct("<8sQQQ")  # magic, documents, ids, words

# Simple-8b's selectors, as (values in a word, bits of each). 0 is the escape: the next word is one raw
# value. 1 isn't used.
SELECTORS = {2: (60, 1), 3: (30, 2), 4: (20, 3), 5: (15, 4), 6: (12, 5), 7: (10, 6), 8: (8, 7), 9: (7, 8), 10: (6, 10), 11: (5, 12), 12: (4, 15), 13: (3, 20), 14: (2, 30), 15: (1, 60)}


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits of each value."""
    top = (values >> np.uint64(32)) if values.size and int(values.max()) >> 32 else None
    low = np.frexp((values & np.uint64(0xFFFFFFFF)).astype(np.float64))[1].astype(np.uint8)
    return low if top is None else np.where(top > 0, np.frexp(top.astype(np.float64))[1].astype(np.uint8) + np.uint8(32), low)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values (uint64) as words, and the word at which each block of BLOCK values begins.

    Each word takes as many of the next values as fit its selector; a block's last word may stand for fewer. All blocks
    are cut into words side by side, a word of each at a time; then all words of a selector are filled at once. Values of
    over 60 bits are escaped.
    """
    n = len(values)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    grid = np.zeros((blocks, BLOCK + 64), np.uint64)
    whole = n // BLOCK
    grid[:whole, :BLOCK] = values[: whole * BLOCK].reshape(whole, BLOCK)
    if whole < blocks:
        grid[whole, : n - whole * BLOCK] = values[whole * BLOCK :]
    size = np.full(blocks, BLOCK)
    size[-1] = n - (blocks - 1) * BLOCK
    choice = np.zeros(grid.shape, np.uint8)  # the escape where nothing else fits
    spread = {1: _bits(grid)}  # the most bits of any of the next so many values
    for count in (2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60):
        half = min(c for c in spread if 2 * c >= count)
        wide = spread[half].copy()
        np.maximum(wide[:, : half - count], spread[half][:, count - half :], out=wide[:, : half - count])
        spread[count] = wide
    for selector in range(15, 1, -1):
        count, bits = SELECTORS[selector]
        np.copyto(choice, np.uint8(selector), where=spread[count] <= bits)
    counts = np.array([SELECTORS.get(s, (1, 64))[0] for s in range(16)])
    at, rows, steps = np.zeros(blocks, np.int64), np.arange(blocks), []
    while len(rows):
        pick = choice[rows, at]
        steps.append((rows, at, pick))
        at = at + counts[pick]
        more = at < size[rows]
        rows, at = rows[more], at[more]
    rows, at, pick = (np.concatenate(x) for x in zip(*steps, strict=True))
    order = np.argsort(rows, kind="stable")
    rows, at, pick = rows[order], at[order], pick[order]
    words = pick.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(pick[pick > 0]).tolist():
        mine = np.flatnonzero(pick == selector)
        count, bits = SELECTORS[selector]
        for k in range(count):
            words[mine] |= grid[rows[mine], at[mine] + k] << np.uint64(k * bits)
    begins = np.searchsorted(rows, np.arange(blocks))
    if (raw := np.flatnonzero(pick == 0)).size:
        words = np.insert(words, raw + 1, grid[rows[raw], at[raw]])
        begins = begins + np.searchsorted(raw, begins)
    return words, begins


def unpack(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n values of pack(), all words of a selector at a time."""
    if not n:
        return np.empty(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (selector == 0).any():  # a raw word may look like an escape: each is told by walking the escapes in order
        for i in np.flatnonzero(selector == 0):
            raw[i + 1 : i + 2] |= not raw[i]
    counts = np.array([SELECTORS.get(s, (1, 64))[0] for s in range(16)])[selector]
    counts[raw] = 0
    upto = np.cumsum(counts) - counts
    block = np.searchsorted(offsets, np.arange(len(words)), "right") - 1
    place = upto - upto[offsets][block] + block * BLOCK
    end = np.minimum((block + 1) * BLOCK, n)
    out = np.zeros(n, np.uint64)
    for s in np.unique(selector[~raw]).tolist():
        mine = np.flatnonzero((selector == s) & ~raw)
        if s == 0:
            out[place[mine]] = words[mine + 1]
            continue
        count, bits = SELECTORS.get(s, (0, 0))
        if not count:
            raise ValueError("unknown selector")
        where = place[mine, None] + np.arange(count)
        value = (words[mine, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(bits))) & np.uint64((1 << bits) - 1)
        fits = where < end[mine, None]
        out[where[fits]] = value[fits]
    return out


def to_file(keys: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """A file's bytes: header; keys (int64), null flags (bytes, padded to 8) and lengths (uint64) of documents; offsets of blocks (uint64); words."""
    packed = [pack(ids[at : at + AT_ONCE * BLOCK].astype(np.uint64)) for at in range(0, len(ids), AT_ONCE * BLOCK)]
    before = np.cumsum([0, *(len(w) for w, _ in packed)])
    words = np.concatenate([w for w, _ in packed]) if packed else np.empty(0, np.uint64)
    offsets = np.concatenate([o + at for (_, o), at in zip(packed, before, strict=False)]) if packed else np.empty(0, np.int64)
    null = np.zeros(-(-len(keys) // 8) * 8, np.uint8)
    null[: len(keys)] = [k is None for k in keys]
    return b"".join((HEADER.pack(MAGIC, len(keys), len(ids), len(words)), np.array([k or 0 for k in keys], "<i8").tobytes(), null.tobytes(), np.array(lengths, "<u8").tobytes(), offsets.astype("<u8").tobytes(), words.astype("<u8").tobytes()))


def from_file(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Keys, lengths and all ids of a file."""
    magic, docs, n, many = HEADER.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a file of ids")
    at = HEADER.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, count, at)
        at += out.nbytes
        return out

    keys, null, lengths = take("<i8", docs), take("u1", -(-docs // 8) * 8)[:docs], take("<u8", docs)
    offsets, words = take("<u8", -(-n // BLOCK)), take("<u8", many)
    return [None if x else int(k) for k, x in zip(keys, null, strict=True)], lengths.astype(np.int64), unpack(words.astype(np.uint64), offsets.astype(np.int64), n)


class Encoder(dict):
    """Ids of pieces of text between ASCII white space, as bytes (uint32).

    The tokenizer's own steps never look across white space: normalisation has no composition with it and the splitting
    pattern and the special tokens hold none. So pieces are encoded apart and remembered. Of pieces below U+0250 the
    steps are done here and only the merges by the library; other pieces go through the whole library.
    """

    # The vocabulary's splitting pattern, for characters below U+0250.
    PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\t-\r \x85\xa0\p{L}\p{N}]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.older: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.older_parts: dict[str, bytes] = {}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level letters: the rest follow from 256 on
        rest = iter(range(256, 512))
        self.letters = {b: b if b in plain else next(rest) for b in range(256)}

    def __missing__(self, piece: bytes) -> bytes:
        found = self.older.get(piece)
        if found is None:
            found = self.pieces(piece.decode("utf-8", "replace"))
        if 2 * len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[piece] = found
        return found

    def pieces(self, text: str) -> bytes:
        if text.isascii() or max(text) < "ɐ" and "İ" not in text:
            if "<|" not in text:
                text = (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()
                if text.isalpha():  # letters only are one part
                    return self.parts.get(text) or self.part(text)
                if text[-1] in ".,!?;:" and text[:-1].isalpha():
                    return (self.parts.get(text[:-1]) or self.part(text[:-1])) + (self.parts.get(text[-1]) or self.part(text[-1]))
                return b"".join([self.parts.get(p) or self.part(p) for p in self.PATTERN.findall(text)])
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def part(self, part: str) -> bytes:
        found = self.older_parts.get(part)
        if found is None:
            tokens = self.model.tokenize(part.encode().decode("latin-1").translate(self.letters))
            found = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        if 4 * len(self.parts) >= REMEMBERED:
            self.older_parts, self.parts = self.parts, {}
        self.parts[part] = found
        return found

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


@functools.cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _writer(uri: str, path: str | None, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path or vocabulary_path())
        files, folder = filesystem(uri)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        keys, lengths, ids, held, serial = [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal keys, lengths, ids, held, serial
            name = f"part-{part:06d}-{serial:05d}-{attempt}.s8b"  # an attempt's own; the list names those that count
            raw = to_file(keys, lengths, np.frombuffer(b"".join(ids), "<u4"))
            with files.open_output_stream(f"{folder}/{name}") as out:
                out.write(raw)
            row = pa.RecordBatch.from_pylist([{"part": part, "serial": serial, "file": name, "docs": len(keys), "ids": held, "bytes": len(raw)}])
            keys, lengths, ids, held, serial = [], [], [], 0, serial + 1
            release()
            return row

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = encoder.encode(text.as_py()) + end
                keys.append(key)
                lengths.append(len(found) // 4)
                ids.append(found)
                held += lengths[-1]
                if held >= FILE_IDS:
                    yield close()
        if keys:
            yield close()

    return run


def write_tokens(docs: DataFrame, uri: str, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode the whole text of every row and write files of ids in ascending doc_id order to the shared folder uri.

    Returns their list: file, docs, ids, bytes, and start, the ids in all files before; it is also in uri/list. Each range
    of ids is one task's files, so no task holds more than a file's ids. vocabulary: path of a tokenizers file, by default
    the public word_bpe_49k.json. Nulls: a null text is empty and still gets its end id; null ids come first. Equal ids
    are ordered by text. Empty table: no files.
    """
    spark = docs.sparkSession
    ship(spark)
    raw = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("_bytes"))
    size = raw.agg(F.coalesce(F.sum(F.octet_length("_bytes") + 64), F.lit(0))).first()[0]
    dealt = raw.repartitionByRange(max(2, -(-size // PART_BYTES)), "doc_id", F.crc32("_bytes")).sortWithinPartitions("doc_id", F.crc32("_bytes"), "_bytes")
    written = dealt.mapInArrow(_writer(uri, vocabulary, end_id), "part long, serial long, file string, docs long, ids long, bytes long")
    written.write.parquet(f"{uri}/list")
    listed = spark.read.parquet(f"{uri}/list")
    return prefix_sums(listed, ["part", "serial"], {"start": "ids"}).select("file", "docs", "ids", "bytes", "start")


def read_tokens(files: DataFrame, uri: str) -> DataFrame:
    """From the files that write_tokens() listed: doc_id, start, n_tokens and ids_crc32 of each document."""
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, folder = filesystem(uri)
        _encoder.cache_clear()  # a worker that wrote has no more need of what it remembers
        for b in batches:
            for name, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with source.open_input_stream(f"{folder}/{name}") as f:
                    keys, lengths, ids = from_file(f.read())
                raw = memoryview(ids.astype("<u4").tobytes())
                ends = np.cumsum(lengths)
                sums = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(start + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    ship(files.sparkSession)
    total = files.count()
    dealt = files.select("file", "start").repartition(max(1, -(-total // 4)), "file")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
