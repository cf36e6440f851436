"""SimHash near-duplicates: fingerprints, a trie self-join of them and the components of its links.

Sixty-four bits tell near copies apart from others only where these are very near. For a similarity like 0.8 (Jaccard, of
sets of shingles), whose fingerprints differ in some ten bits, similar_links() finds more links beside those of the
tries: signatures of PERMUTATIONS least hashes are dealt by bands, and what meets in a band is linked if the signatures
say that it is similar enough.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, refuse
from lodestone.shipping import ship

SHINGLE, BUDGET, SEED = 4, 4, 42
#: Of a signature: least hashes, and those of a band. Two sets of similarity 0.8 meet in a band with a chance of 0.99.
PERMUTATIONS, BAND = 96, 6
#: What an estimate may lack to the similarity asked for: one deviation of PERMUTATIONS least hashes at 0.8.
SLACK = 0.04
_RANDOM = np.random.default_rng(9)
FACTORS = _RANDOM.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _RANDOM.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
#: Fingerprints that share the bits of a bucket meet in one task up to this number; more are dealt in pairs of parts.
PART = 2048
#: Pairs of fingerprints that a traversal may begin with at once, for bounded memory.
AT_ONCE = 4_000_000


def shingle_hashes(text: bytes, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of the text's shingles, repeats included, in parts; nothing for a text without words."""
    words = text.lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) < size:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    for at in range(0, len(starts), 1 << 16):
        yield np.array([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[at : at + (1 << 16)].tolist(), ends[at : at + (1 << 16)].tolist(), strict=True)], np.uint64)


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Bit i is 1 if it is set in over half the XXH64 of the text's shingles; 0 for a text without words."""
    return _majority(shingle_hashes(text, size))


def _majority(parts: Iterable[np.ndarray]) -> int:
    ones, n = np.zeros(64, np.int64), 0
    for hashes in parts:
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least of each of PERMUTATIONS hashes of a set of shingles; the largest number where there are none."""
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        np.minimum(least, (FACTORS[:, None] * shingles[None, at : at + 4096] + TERMS[:, None]).min(axis=1), out=least)
    return least


def _folded(values: np.ndarray) -> np.ndarray:
    """One hash of each row of values (uint64)."""
    x = np.full(len(values), 0x9E3779B97F4A7C15, np.uint64)
    for column in values.T:
        x = (x ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
    return x


def marks(docs: DataFrame, keep: list[str], size: int) -> DataFrame:
    """The columns in keep; _fp; _node, a hash of the set of shingles of size words; _mark: band keys and a byte of each least hash."""
    bands = PERMUTATIONS // BAND

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, nodes, made = [], [], []
            for text in b.column(b.num_columns - 1):
                parts = list(shingle_hashes(text.as_py() or b"", size))
                fps.append(_majority(parts))
                shingles = np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)
                nodes.append(xxhash.xxh64_intdigest(shingles.tobytes(), SEED))
                least = signature(shingles)
                keys = _folded(np.column_stack([np.arange(bands, dtype=np.uint64), least.reshape(bands, BAND)]))
                # Least values begin with zeros, so the byte is of all their bits.
                byte = (least * np.uint64(0x94D049BB133111EB)) >> np.uint64(56)
                made.append(keys.astype("<u8").tobytes() + byte.astype(np.uint8).tobytes())
            longs = [pa.array(np.array(x, np.uint64).view(np.int64), pa.int64()) for x in (fps, nodes)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *longs, pa.array(made, pa.binary())], [*b.schema.names[:-1], "_fp", "_node", "_mark"])

    ship(docs.sparkSession)
    chosen = docs.select(*keep, F.col("text").cast("binary").alias("_bytes"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]]
    return chosen.mapInArrow(run, ", ".join([*kinds, "_fp long", "_node long", "_mark binary"]))


def led(bytes_of: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of equal band key: which are like one before them, which that is, and which lead, being like none that leads."""
    rest, like, leader, leads = np.arange(len(bytes_of)), [], [], []
    while len(rest):
        first = rest[0]
        near = (bytes_of[rest] == bytes_of[first]).mean(axis=1) >= similarity - SLACK
        near[0] = False
        like.append(rest[near])
        leader.append(np.full(int(near.sum()), first))
        leads.append(first)
        near[0] = True
        rest = rest[~near]
    return np.concatenate(like), np.concatenate(leader), np.array(leads)


def _banded(similarity: float):
    """Each batch's nodes by bands; those like another of the batch are linked and go no further, so that a large group of copies shrinks before it is dealt."""
    bands = PERMUTATIONS // BAND

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            nodes = b.column(0).to_numpy()
            mark = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            keys, least = np.ascontiguousarray(mark[:, : 8 * bands]).view("<u8"), mark[:, 8 * bands :]
            for band in range(bands):
                key = keys[:, band]
                order = np.argsort(key, kind="stable")
                cuts = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
                sizes = np.diff(np.concatenate((cuts, [len(order)])))
                alone = order[cuts[sizes == 1]]
                lead, links = [alone], []
                for s, n in zip(cuts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
                    here = order[s : s + n]
                    like, of, leads = led(least[here], similarity)
                    links.append((nodes[here[like]], nodes[here[of]]))
                    lead.append(here[leads])
                lead = np.concatenate(lead)
                yield _marked(nodes[lead], None, key[lead].astype(np.uint64).view(np.int64), least[lead])
                if links:
                    yield _marked(np.concatenate([a for a, _ in links]), np.concatenate([a for _, a in links]))

    return run


def _marked(a: np.ndarray, b: np.ndarray | None, key: np.ndarray | None = None, least: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(a)
    data = pa.nulls(n, pa.binary()) if least is None else pa.array([x.tobytes() for x in least], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.nulls(n, pa.int64()) if b is None else pa.array(b, pa.int64()), pa.nulls(n, pa.int64()) if key is None else pa.array(key, pa.int64()), data], ["a", "b", "key", "least"])


def _band_links(similarity: float):
    """Links of the nodes that meet in a band. Rows come by key; only those that lead are held, PART rows at a time with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held, found = None, [], []

        def settle() -> None:
            nonlocal held
            if len(held) > 1:
                like, of, leads = led(np.frombuffer(b"".join(x for _, x in held), np.uint8).reshape(len(held), -1), similarity)
                found.extend((held[i][0], held[j][0]) for i, j in zip(like.tolist(), of.tolist(), strict=True))
                held = [held[i] for i in leads.tolist()]

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["a", "b"])
            found.clear()
            return made

        fresh = 0
        for b in batches:
            for node, key, least in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if key != held_key or fresh >= PART:
                    settle()
                    fresh = 0
                    if key != held_key:
                        held_key, held = key, []
                held.append((node, least))
                fresh += 1
            if found:
                yield out()
        settle()
        yield out()

    return run


def similar_links(nodes: DataFrame, n: int, similarity: float) -> DataFrame:
    """Links (a, b) between nodes (_node, _mark; n of them, distinct) whose signatures meet in a band and are similar.

    A node is compared with those that lead in its bands, not with all: copies of a leader are linked to it and held no
    longer. So a band's group costs its rows times the unlike ones in it.
    """
    dealt = cut(nodes.select("_node", "_mark").mapInArrow(_banded(similarity), "a long, b long, key long, least binary"))
    parts = max(4, -(-n * (PERMUTATIONS // BAND) // 200_000))
    met = dealt.filter("key is not null").select("a", "key", "least").repartition(parts, "key").sortWithinPartitions("key", "a").mapInArrow(_band_links(similarity), "a long, b long")
    return dealt.filter("key is null").select("a", "b").unionByName(met)


def first_of_similar(docs: DataFrame, row: Column, shingle: int = 5, similarity: float = 0.8, budget: int = BUDGET) -> DataFrame:
    """Of each group of similar texts the least row, a struct that orders them, as column first.

    Texts are linked if their sets of shingles are equal, if their fingerprints (of such shingles) differ in at most
    budget bits, or if their signatures say that their sets are as similar. Texts without words are one group.
    """
    marked = cut(marks(docs.select(row.alias("_row"), "text"), ["_row"], shingle))
    nodes = cut(marked.groupBy("_node").agg(F.min("_row").alias("_first"), F.min("_fp").alias("_fp"), F.min("_mark").alias("_mark")))
    n = nodes.count()
    # A fingerprint stands for the least node that has it; its links become links of nodes.
    codes = cut(nodes.groupBy("_fp").agg(F.min("_node").alias("_rep")))
    same = nodes.join(codes, "_fp").filter("_node <> _rep").select(F.col("_node").alias("a"), F.col("_rep").alias("b"))
    near = links(codes, codes.count(), budget)
    near = near.join(codes.select(F.col("_fp").alias("a"), F.col("_rep").alias("_a")), "a").join(codes.select(F.col("_fp").alias("b"), F.col("_rep").alias("_b")), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    stars = components(same.unionByName(near).unionByName(similar_links(nodes, n, similarity)))
    rooted = nodes.join(stars, nodes["_node"] == stars["node"], "left").select("_first", F.coalesce("root", "_node").alias("_root"))
    return rooted.groupBy("_root").agg(F.min("_first").alias("first")).select("first")


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in keep, and _fp (the fingerprint's 64 bits as a long) of every whole text; null texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t or b"") for t in b.column(b.num_columns - 1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found.view(np.int64), pa.int64())], [*b.schema.names[:-1], "_fp"])

    ship(docs.sparkSession)
    chosen = docs.select(*keep, F.col("text").cast("binary").alias("_bytes"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]]
    return chosen.mapInArrow(run, ", ".join([*kinds, "_fp long"]))


def near_pairs(codes: np.ndarray, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray] | None = None, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in codes whose codes differ in at most budget bits, by going down binary tries two nodes at a time.

    codes: uint64, ascending and distinct in each range; left: begins and ends of ranges, each a trie. Without right each
    trie is joined with itself, else with the trie of right at the same index. A node is a range of codes that agree in
    the bits above; a pair of nodes carries the number of those bits in which it differs and is dropped above the budget.
    Pairs of single codes are settled at once.
    """
    own = right is None
    a0, a1 = (np.asarray(x, np.int64) for x in left)
    b0, b1 = (a0, a1) if own else (np.asarray(x, np.int64) for x in right)
    differ = np.zeros(len(a0), np.int64)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for bit in range(63, -2, -1):
        same = (a0 == b0) & (a1 == b1) if own else np.zeros(len(a0), bool)
        full = (a1 > a0) & (b1 > b0) & ~(same & (a1 - a0 == 1))
        single = full & (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            x, y = a0[single], b0[single]
            near = np.bitwise_count(codes[x] ^ codes[y]) <= budget
            out.append((x[near], y[near]))
        go = full & ~single
        a0, a1, b0, b1, differ, same = a0[go], a1[go], b0[go], b1[go], differ[go], same[go]
        if bit < 0 or not len(a0):
            break
        ones = np.concatenate(([0], np.cumsum((codes >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        cross = differ < budget
        other = cross & ~same
        a0, a1, b0, b1, differ = (
            np.concatenate(x)
            for x in (
                (a0, am, a0[cross], am[other]),
                (am, a1, am[cross], a1[other]),
                (b0, bm, bm[cross], b0[other]),
                (bm, b1, b1[cross], bm[other]),
                (differ, differ, differ[cross] + 1, differ[other] + 1),
            )
        )
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def forest(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The smallest place that each of n places reaches over the links x-y."""
    label = np.arange(n)
    while len(x):
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while not np.array_equal(label, jumped := label[label]):
            label = jumped
        if np.array_equal(before, label):
            break
        open_ = label[x] != label[y]
        x, y = x[open_], y[open_]
    return label


def _tables(n: int, budget: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Which bits two fingerprints within the budget must share: of budget + j blocks, some j are equal.

    j grows with the number n of fingerprints, so that a bucket holds some dozens if bits are even. For each choice of
    j blocks: its number, and (lowest bit, width) of its blocks.
    """
    j = 1
    while j < 4 and n >> (64 * j // (budget + j)) > 64:
        j += 1
    edges = [round(64 * i / (budget + j)) for i in range(budget + j + 1)]
    blocks = [(a, b - a) for a, b in pairwise(edges)]
    return list(enumerate([list(c) for c in combinations(blocks, j)]))


def _deal(tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for number, blocks in tables:
                key = np.full(len(fp), number, np.uint64)
                for low, width in blocks:
                    key = (key << np.uint64(width)) | ((fp >> np.uint64(low)) & np.uint64((1 << width) - 1))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp.view(np.int64))], ["key", "fp"])

    return run


def _links(codes: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    label = forest(*pairs, len(codes))
    linked = np.flatnonzero(label != np.arange(len(codes)))
    return codes[linked].view(np.int64), codes[label[linked]].view(np.int64)


def _batch(a, b, key=None, part=None) -> pa.RecordBatch:
    n = len(a)
    none = pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), none if b is None else pa.array(b, pa.int64()), none if key is None else pa.array(key, pa.int64()), none if part is None else pa.array(part, pa.int64())], ["a", "b", "key", "part"])


def _join_buckets(budget: int):
    """Links of buckets up to PART, as a spanning forest of each batch of buckets; larger buckets go on in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, np.empty(0, np.uint64)
        full = 0  # parts already sent on of the held bucket
        ready: list[np.ndarray] = []
        cost = 0

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal cost
            if ready:
                codes = np.concatenate(ready)
                ends = np.cumsum([len(r) for r in ready])
                yield _batch(*_links(codes, near_pairs(codes, (ends - [len(r) for r in ready], ends), None, budget)))
            ready.clear()
            cost = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal cost, full
            if full:
                yield _batch(held.view(np.int64), None, np.full(len(held), held_key), np.full(len(held), full))
            elif len(held) > 1:
                ready.append(np.sort(held))  # rows come in signed order, the trie needs unsigned
                cost += len(held) ** 2
                if cost > AT_ONCE:
                    yield from settle()
            full = 0

        for b in batches:
            keys, fps = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else []
            for s, e in pairwise([*starts, len(keys)]):
                if held_key is not None and keys[s] == held_key:
                    held = np.concatenate([held, fps[s:e]])
                else:
                    if held_key is not None:
                        yield from close()
                    held_key, held = int(keys[s]), fps[s:e]
                while len(held) > PART:
                    yield _batch(held[:PART].view(np.int64), None, np.full(PART, held_key), np.full(PART, full))
                    held, full = held[PART:], full + 1
        if held_key is not None:
            yield from close()
        yield from settle()

    return run


def _join_parts(budget: int):
    """Links between two parts of a large bucket, or inside one; rows come ordered by the pair of parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(held)
            (_, i, j), part, fp = held_key, rows[:, 0], rows[:, 1].view(np.uint64)
            one, two = np.sort(fp[part == i]), np.sort(fp[part == j])
            if i == j:
                codes, pairs = one, near_pairs(one, ([0], [len(one)]), None, budget)
            else:
                codes = np.concatenate([one, two])
                pairs = near_pairs(codes, ([0], [len(one)]), ([len(one)], [len(codes)]), budget)
            # A link goes to the smaller fingerprint's place, so that places must be in order.
            order = np.argsort(codes, kind="stable")
            back = np.empty(len(codes), np.int64)
            back[order] = np.arange(len(codes))
            a, b = _links(codes[order], (back[pairs[0]], back[pairs[1]]))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for b in batches:
            key, i, j, part, fp = (c.to_numpy() for c in b.columns)
            starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))) if len(key) else []
            for s, e in pairwise([*starts, len(key)]):
                now = (int(key[s]), int(i[s]), int(j[s]))
                if held_key is not None and now != held_key:
                    yield from close()
                    held = []
                held_key = now
                held.append(np.stack([part[s:e], fp[s:e]], 1))
        if held_key is not None:
            yield from close()

    return run


def links(distinct: DataFrame, n: int, budget: int = BUDGET) -> DataFrame:
    """Links (a, b) that join all of the n distinct fingerprints _fp that differ in at most budget bits.

    Not every pair: of each batch of buckets a spanning forest, so there are no more links than dealt fingerprints.
    """
    ship(distinct.sparkSession)
    tables = _tables(n, budget)
    parts = max(4, -(-n * len(tables) // 200_000))
    dealt = distinct.select("_fp").mapInArrow(_deal(tables), "key long, fp long")
    joined = cut(dealt.repartition(parts, "key").sortWithinPartitions("key", "fp").mapInArrow(_join_buckets(budget), "a long, b long, key long, part long"))
    small = joined.filter("key is null").select("a", "b")
    rest = joined.filter("key is not null").select("key", F.col("a").alias("fp"), "part")
    if rest.isEmpty():
        return small
    counts = rest.groupBy("key").agg(F.max("part").alias("_last")).withColumnRenamed("key", "_key")
    spread = rest.join(counts, F.col("key") == F.col("_key")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_last"))))
    pairs = spread.select("key", F.least("part", "_other").alias("i"), F.greatest("part", "_other").alias("j"), "part", "fp")
    wide = pairs.repartition(max(parts, 32), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return small.unionByName(wide.mapInArrow(_join_parts(budget), "a long, b long"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): for every node with a link, the smallest node that it reaches.

    Large-star and small-star rounds (Kiveris et al., 2014) until the links no longer change; each round's links go to
    the shared folder. Minima are combined before they are shuffled, and a node with very many links is a skewed join key
    that Spark splits, not a group in one task.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("_m"))
        large = both.join(least, F.col("a") == F.col("_a")).filter("b > a").select(F.col("b").alias("a"), F.least("a", "_m").alias("b")).distinct()
        least = large.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("_m"))
        met = large.join(least, F.col("a") == F.col("_a"))
        small = met.select("a", F.col("_m").alias("b")).unionByName(met.filter("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b")))
        now = cut(small.distinct())
        found = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).cast("string")).first()
        if tuple(found) == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = tuple(found)
    raise RuntimeError("components didn't settle")


def _rooted(nodes: DataFrame, budget: int) -> DataFrame:
    """nodes (_fp, _first) with _root, the fingerprint that names the component."""
    stars = components(links(nodes, nodes.count(), budget))
    return nodes.join(stars, nodes["_fp"] == stars["node"], "left").select("_fp", "_first", F.coalesce("root", "_fp").alias("_root"))


def near_duplicates(docs: DataFrame, keep: list[str], budget: int = BUDGET) -> DataFrame:
    """The columns in keep of every row of docs, fingerprint (16 hex digits) and component_id.

    component_id is the smallest doc_id among all rows that links reach, the row itself included; fingerprints link at
    budget or fewer differing bits. Rows of one fingerprint are one node, so copies are never paired.

    Nulls: a null text has fingerprint 0, as has a wordless one, and they link like any other; null ids are kept, and
    are a component's id only if it has no other. Repeated rows are answered alike. Empty table: no rows. Columns to keep
    that are named like the new ones are refused.
    """
    refuse(keep, ["_fp", "fingerprint", "component_id", "_bytes"])
    marked = cut(fingerprints(docs, ["doc_id", *(c for c in keep if c != "doc_id")]))
    nodes = cut(marked.groupBy("_fp").agg(F.min("doc_id").alias("_first")))
    rooted = _rooted(nodes, budget)
    ids = rooted.groupBy("_root").agg(F.min("_first").alias("component_id")).withColumnRenamed("_root", "_r")
    named = rooted.join(ids, rooted["_root"] == ids["_r"]).select(F.col("_fp").alias("_f"), "component_id")
    shown = F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint")
    return marked.join(named, marked["_fp"] == named["_f"]).select(*keep, shown, "component_id")
