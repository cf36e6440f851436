"""Benchmark decontamination with suffix arrays of the training shards."""

from __future__ import annotations

import functools
import pickle
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.blocks import filesystem
from lodestone.llm.common import refuse, scratch
from lodestone.shipping import ship

#: Words of lower-cased UTF-8: digits, a to z and whatever isn't ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WINDOW = 10
SHARD_BYTES = 4 << 20
#: The benchmark is a stated query set, searched in parts of so much text; a worker holds one part at a time, or a few.
PART_BYTES, HELD_PARTS = 1 << 20, 4


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())  # bytes.lower() changes A to Z only


@dataclass
class Benchmark:
    """All distinct windows of a benchmark: starts of its suffixes, each window words long (fewer: a whole short item)."""

    vocabulary: dict[bytes, int]  # ids from 1
    tokens: np.ndarray  # ids of all items, each item followed by 0
    starts: np.ndarray  # where each distinct window begins in tokens
    lengths: np.ndarray
    names: list[str]
    of: np.ndarray  # items that have the windows, by window:
    of_first: np.ndarray  # of[of_first[w]:of_first[w + 1]]
    order: np.ndarray  # the suffix array of tokens


def benchmark(items: list[tuple[object, str | None]], window: int = WINDOW) -> Benchmark:
    """items: (id, text). Null or wordless texts have no window; a null id is named 'null'; equal ids are one item."""
    vocabulary: dict[bytes, int] = {}
    names = sorted({"null" if i is None else str(i) for i, _ in items})
    number = {n: k for k, n in enumerate(names)}
    tokens: list[int] = []
    found: dict[tuple[int, ...], tuple[int, set[int]]] = {}
    for i, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of((text or "").encode("utf-8", "surrogatepass"))]
        size = min(window, len(ids))
        for at in range(len(ids) - size + 1 if ids else 0):
            found.setdefault(tuple(ids[at : at + size]), (len(tokens) + at, set()))[1].add(number["null" if i is None else str(i)])
        tokens += [*ids, 0]
    owners = [sorted(x[1]) for x in found.values()]
    text = np.array([*tokens, 0], np.int64)
    return Benchmark(
        vocabulary, text, np.array([x[0] for x in found.values()], np.int64), np.array([len(k) for k in found], np.int64), names,
        np.array([o for x in owners for o in x], np.int64), np.cumsum([0, *map(len, owners)]), suffix_array(text, to_end(text)),
    )


def to_end(text: np.ndarray) -> np.ndarray:
    """Words from each place to the next 0."""
    ends = np.flatnonzero(text == 0)
    return ends[np.searchsorted(ends, np.arange(len(text)))] - np.arange(len(text))


def suffix_array(text: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by prefix doubling. rest: words from each place to the 0 that ends its suffix."""
    at = np.flatnonzero(rest)
    rank = text.copy()
    depth = 1
    longest = int(rest.max(initial=0))
    while True:
        beyond = np.where(rest[at] > depth, rank[np.minimum(at + depth, len(text) - 1)], 0)
        order = np.lexsort((beyond, rank[at]))
        one, two = rank[at][order], beyond[order]
        new = np.concatenate(([1], 1 + np.cumsum((one[1:] != one[:-1]) | (two[1:] != two[:-1])))) if len(at) else one
        if depth * 2 >= longest or not len(at) or new[-1] == len(at):
            return at[order]
        rank = np.zeros_like(rank)
        rank[at[order]] = new
        depth *= 2


def _side(text: np.ndarray, suffixes: np.ndarray, pattern: np.ndarray, starts: np.ndarray, lengths: np.ndarray, above: bool) -> np.ndarray:
    """For each pattern by binary search: how many suffixes are below it, with above also those that begin with it."""
    low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(suffixes), np.int64)
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) // 2
        place = suffixes[middle]
        less = np.full(len(open_), above)
        alike = np.arange(len(open_))
        for k in range(int(lengths[open_].max())):
            alike = alike[lengths[open_[alike]] > k]
            if not alike.size:
                break
            mine = text[np.minimum(place[alike] + k, len(text) - 1)]
            theirs = pattern[starts[open_[alike]] + k]
            differs = mine != theirs
            less[alike[differs]] = mine[differs] < theirs[differs]
            alike = alike[~differs]
        low[open_] = np.where(less, middle + 1, low[open_])
        high[open_] = np.where(less, high[open_], middle)
    return low


def _longest(bench: Benchmark, text: np.ndarray, places: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The words that each place shares with the test suffix most like it: one of its two neighbours in their order."""
    at = _side(bench.tokens, bench.order, text, places, rest, False)
    best = np.zeros(len(places), np.int64)
    for neighbour in (at - 1, at):
        alive = np.flatnonzero((neighbour >= 0) & (neighbour < len(bench.order)))
        other, length = bench.order[np.clip(neighbour, 0, max(0, len(bench.order) - 1))], np.zeros(len(places), np.int64)
        while alive.size:
            mine, theirs = text[places[alive] + length[alive]], bench.tokens[other[alive] + length[alive]]
            alive = alive[(mine == theirs) & (mine != 0)]
            length[alive] += 1
        best = np.maximum(best, length)
    return best


def search(texts: list[bytes], bench: Benchmark | Iterable[Benchmark]) -> list[tuple[int, int, list[str], int, int]]:
    """For each text: words, words hit, names of items with a window in it, longest verbatim match in words, its place.

    The texts are one shard, and bench all parts of a benchmark. Only runs of words that a part knows can hold one of its
    windows, so only their suffixes are put in the array; a run ends its suffixes.
    """
    words = [words_of(t) for t in texts]
    counts = [len(w) for w in words]
    first = np.cumsum([0, *(n + 1 for n in counts)])
    hit = np.zeros(int(first[-1]) + 2, np.int64)
    named: list[set[str]] = [set() for _ in texts]
    longest, longest_at = np.zeros(len(texts), np.int64), np.full(len(texts), -1, np.int64)
    for part in [bench] if isinstance(bench, Benchmark) else bench:
        if len(part.starts):
            _search_part(words, part, first, hit, named, longest, longest_at)
    covered = np.cumsum(hit) > 0
    return [(n, int(covered[first[d] : first[d] + n].sum()), sorted(named[d]), int(longest[d]), int(longest_at[d])) for d, n in enumerate(counts)]


def _search_part(words: list[list[bytes]], bench: Benchmark, first: np.ndarray, hit: np.ndarray, named: list[set[str]], longest: np.ndarray, longest_at: np.ndarray) -> None:
    """Add what one part of the benchmark finds: hit has 1 where a match begins and -1 behind it."""
    known = bench.vocabulary.get
    text = np.array([i for w in words for i in (*(known(x, 0) for x in w), 0)] + [0], np.int64)
    ends = np.flatnonzero(text == 0)
    rest = to_end(text)
    run = ends - np.concatenate(([-1], ends[:-1])) - 1
    rest[np.repeat(run < bench.lengths.min(), run + 1)] = 0
    suffixes = suffix_array(text, rest)
    here = np.zeros(len(bench.vocabulary) + 1, bool)
    here[text[suffixes]] = True
    asked = np.flatnonzero(here[bench.tokens[bench.starts]])
    starts, lengths = bench.starts[asked], bench.lengths[asked]
    low = _side(text, suffixes, bench.tokens, starts, lengths, False)
    high = _side(text, suffixes, bench.tokens, starts, lengths, True)
    many = high - low
    which = np.repeat(np.arange(len(asked)), many)
    places = suffixes[np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(len(which))]
    np.add.at(hit, places, 1)
    np.add.at(hit, places + lengths[which], -1)
    doc = np.searchsorted(first, places, "right") - 1
    for d, w in np.unique(np.stack([doc, asked[which]], 1), axis=0).tolist():
        named[d].update(bench.names[i] for i in bench.of[bench.of_first[w] : bench.of_first[w + 1]].tolist())
    places = np.unique(places)
    doc = np.searchsorted(first, places, "right") - 1
    length = _longest(bench, text, places, rest[places])
    order = np.lexsort((-places, length))  # the longest last; of equals, the first place
    best, best_at = np.zeros_like(longest), np.full_like(longest_at, -1)
    best[doc[order]], best_at[doc[order]] = length[order], places[order] - first[doc[order]]
    better = (best > longest) | ((best == longest) & (best > 0) & (best_at < longest_at))
    longest[better], longest_at[better] = best[better], best_at[better]


def _builder(uri: str, window: int):
    """Writes the benchmark's parts as files and gives their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = filesystem(uri)
        held, size = [], 0

        def close() -> pa.RecordBatch:
            nonlocal held, size
            name = uuid.uuid4().hex  # an attempt's own
            with files.open_output_stream(f"{folder}/{name}") as out:
                out.write(pickle.dumps(benchmark(held, window)))
            held, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

        for b in batches:
            for key, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append((key, text))
                size += len(text or "")
                if size >= PART_BYTES:
                    yield close()
        if held:
            yield close()

    return run


@functools.lru_cache(maxsize=HELD_PARTS)
def _part(uri: str, name: str) -> Benchmark:
    files, folder = filesystem(uri)
    with files.open_input_file(f"{folder}/{name}") as f:
        return pickle.loads(f.read())  # written by _builder


FOUND = [("n_words", pa.int64(), "long"), ("n_hit", pa.int64(), "long"), ("items", pa.list_(pa.string()), "array<string>"), ("longest", pa.int64(), "long"), ("longest_at", pa.int64(), "long")]


def find_matches(docs: DataFrame, items: DataFrame, keep: list[str], window: int = WINDOW) -> DataFrame:
    """The columns in keep of every row of docs, and what the benchmark shares with its whole text.

    n_words, n_hit: words, and words inside any occurrence of a window; items: sorted names of the items with a window in
    the text; longest, longest_at: the longest verbatim match from where a window begins, in words, and its first place
    (-1: none). Every shard of documents gets a suffix array, in which all the benchmark's windows are searched, a part of
    the benchmark after the other, however many there are; documents aren't shuffled, so no passage, however common,
    makes a large group.

    Nulls: null texts have no words, nor have null items; a null item id is named 'null'. Empty tables: no rows, or no
    hits. Repeated rows are answered alike. Columns to keep that are named like
    the new ones are refused.
    """
    refuse(keep, [n for n, _, _ in FOUND] + ["_bytes"])
    spark = docs.sparkSession
    ship(spark)
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    uri = scratch(spark, "benchmark")
    # Only names come here; the parts are built by tasks, and there are as many as the benchmark has bytes for.
    built = items.select(F.col("item_id").cast("string").alias("item_id"), "text").repartition(max(1, -(-size // PART_BYTES))).mapInArrow(_builder(uri, window), "name string")
    names = [r["name"] for r in built.collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(b.num_columns - 1)
            texts = [t or b"" for t in sizes.to_pylist()]
            at = 0
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and (end == at or held + len(texts[end]) <= SHARD_BYTES):
                    held += len(texts[end])
                    end += 1
                found = search(texts[at:end], (_part(uri, n) for n in names))
                new = [pa.array(c, k) for c, (_, k, _) in zip(zip(*found, strict=True), FOUND, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.slice(at, end - at).columns[:-1], *new], [*b.schema.names[:-1], *(n for n, _, _ in FOUND)])
                at = end

    chosen = docs.select(*keep, F.col("text").cast("binary").alias("_bytes"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]] + [f"{n} {k}" for n, _, k in FOUND]
    return chosen.mapInArrow(run, ", ".join(kinds))
