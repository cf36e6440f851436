"""LM scoring with a probabilistic suffix tree over all words of the training texts.

Symbols are all words, the end, and a beginning that is only ever part of a context. A context is a string of up to DEPTH
symbols that occurs LEAST times or more in the training texts, an absolute number, so the tree grows with the corpus. Of
these a context is retained if its next symbols diverge from its parent's (the context without its oldest symbol). A
symbol's probability is that of the longest retained suffix of what is before it; each distribution is smoothed with that
of the next shorter retained suffix, the more the more kinds of symbols follow it (Witten and Bell's estimate), and the
root with one unknown word, which has the mass of the words that occur once (Good and Turing's). So the whole is a
distribution over texts in which all words that weren't seen are one, as they are in the base score.

The tree is nowhere in one place. Texts are kept in stretches, files in the shared folder. For each depth a stretch asks
for the counts of its distinct (context, next symbol), each at one bucket; buckets add up what the stretches ask with, and
answer. Contexts are the pairs of the depth before, so only those that are frequent enough are asked for. Words are asked
for by 64-bit hashes. Whatever may be part of a longer string gets a number with its answer, and longer strings are asked
for by the numbers of their context and of their last word, which are shorter than a hash and never clash. A pair's
divergence is computed from its answer by the one stretch that the bucket names its owner, and buckets add those up by
context. Sums are of whole numbers, so what is retained doesn't hang on how rows are dealt.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.blocks import filesystem, pack, unpack
from lodestone.llm.common import crc_of_id, cut, release, scratch
from lodestone.shipping import ship

HELD_OUT = 7, 2  # crc32 of the id mod 7 is 2
DEPTH = 3
#: Occurrences in the training texts that a context has at least; with fewer its next symbols tell too little.
LEAST = 50
#: A context is retained if the Kullback-Leibler divergence (nats) of its next symbols from its parent's is above this,
#: and above what so many samples give by chance.
DIVERGENCE = 0.01
#: Text of a stretch and of a bucket; they set memory and balance, not results.
STRETCH_BYTES, BUCKET_BYTES = 40 << 20, 8 << 20#: Places of a stretch that are scored at a time.
PLACES = 1 << 18

KINDS = "kind int, at long, who long, data binary"
#: Kinds of rows: a stretch's file; asked and answered counts; asked and answered divergences; totals of words.
TEXT, ASK, COUNT, TEST, KEPT, TOTALS = range(6)
#: The first column ascends and is sent as its differences; so is the word, for each context.
_ASK_WORD = [("key", "u8"), ("times", "i8")]
_ASK_PAIR = [("context", "u8"), ("word", "i8"), ("times", "i8")]
_TEST = [("key", "u8"), ("apart", "i8"), ("kinds", "i8"), ("total", "i8")]
_ANSWER = [("value", "i8")]
_SIZES = [("bucket", "i8"), ("size", "i8")]
_TOKENS = [("token", "u4")]
_WORDS = [("magnitude", "u1")]
_DOCS = [("doc", "i8"), ("null", "u1"), ("held", "u1"), ("size", "i8")]

#: Words hold no blanks, so these are no word's.
BEGIN, END = (np.uint64(xxhash.xxh3_64_intdigest(s)) for s in (b" begin", b" end"))
#: Divergences are added up as whole multiples of 2^-40 nats.
UNIT = float(1 << 40)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # ASCII only, both


class _Numbers(dict):
    """Words to numbers in order of appearance; 0 and 1 are the beginning and the end."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 2
        return n


def _spread(number: np.ndarray) -> np.ndarray:
    x = number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _magnitude(count: np.ndarray) -> np.ndarray:
    """The number of binary digits."""
    return np.frexp(count.astype(np.float64))[1]


def _by_magnitude(count: np.ndarray) -> np.ndarray:
    """The order in which strings are numbered: frequent ones first, so that most numbers sent are low, else as they are."""
    return np.argsort(-_magnitude(count), kind="stable")


def _batch(made: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*made, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["kind", "at", "who", "data"])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[tuple[int, bytes]]]]]:
    """For each at, whose rows come together: (who, data) by kind, in order of who."""

    def rows() -> Iterator[tuple[int, int, int, bytes]]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    for at, group in groupby(rows(), lambda r: r[1]):
        found: dict[int, list[tuple[int, bytes]]] = {}
        for kind, _, who, data in group:
            found.setdefault(kind, []).append((who, data))
        yield at, {k: sorted(v, key=lambda x: x[0]) for k, v in found.items()}
        release()


def _level(kind: int, depth: int) -> int:
    return kind + 8 * depth


def _times(n: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Two numbers as one, which is low if both are (Cantor's pairing): mostly one of them is 1 and the other 0."""
    both = n + held
    return both * (both + 1) // 2 + held


def _untimes(times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = ((np.sqrt(8.0 * times + 1) - 1) / 2).astype(np.int64)
    both -= both * (both + 1) // 2 > times
    both += (both + 1) * (both + 2) // 2 <= times
    held = times - both * (both + 1) // 2
    return both - held, held


def _begins(key: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[: len(key)])


def _summed(steps: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sums of the steps so far in each run."""
    total = np.cumsum(steps)
    return total - np.repeat(total[begins] - steps[begins], np.diff(np.append(begins, len(steps))))


def _bucketed(kind: int, who: int, fields: list[tuple[str, str]], columns: dict[str, np.ndarray], bucket: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
    """A row for each bucket; bucket ascends, and in each the first column."""
    first = fields[0][0]
    for s, e in pairwise([*_begins(bucket).tolist(), len(bucket)]):
        part = {k: v[s:e] for k, v in columns.items()}
        if "word" in part:
            steps, begins = np.diff(part["word"], prepend=0), _begins(part[first])
            steps[begins] = part["word"][begins]
            part["word"] = steps
        yield kind, int(bucket[s]), who, pack(fields, part | {first: np.diff(part[first].astype(np.uint64), prepend=np.uint64(0))})


def _unbucketed(fields: list[tuple[str, str]], data: bytes) -> dict[str, np.ndarray]:
    columns, first = unpack(fields, data)[0], fields[0][0]
    columns[first] = np.cumsum(columns[first], dtype=np.uint64)
    if "word" in columns:
        columns["word"] = _summed(columns["word"], _begins(columns[first]))
    if "times" in columns:
        columns["n"], columns["held"] = _untimes(columns["times"])
    return columns


def _ask_words(hashes: np.ndarray, n: np.ndarray, every: np.ndarray, buckets: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """What a stretch asks for its words with (ascending hashes), and at which buckets: these are ranges of hashes."""
    edges = (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(np.uint64)
    return {"key": hashes, "times": _times(n, every - n)}, np.searchsorted(edges, hashes, side="right")


class _Stretch:
    """Some documents as one row of symbols, with what the buckets have told of them so far.

    A string of depth d ends at a place and has d symbols before it. Of one that occurs once in all texts, nothing longer
    that ends there needs to be asked for: that occurs once too, here. What is known of a string is kept once, in the order
    in which it was asked for; places only know which string theirs is.

    magnitudes are of the words' counts here, in the order of the words' hashes; tokens are numbers by magnitude.
    """

    def __init__(self, docs: dict[str, np.ndarray], token: np.ndarray, magnitudes: np.ndarray, least: int, buckets: int):
        self.docs, self.least, self.buckets = docs, least, buckets
        self.first = np.cumsum(docs["size"]) - docs["size"]
        self.train = np.repeat(docs["held"] == 0, docs["size"])
        #: By depth: which string each place has (-1: none that was asked for), and how many strings there are.
        self.where = [np.argsort(255 - magnitudes, kind="stable").astype(np.int32)[token]]
        self.size = [len(magnitudes)]
        #: By depth: places with a frequent context of so many symbols, and which string of the depth before it is.
        self.on: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int32),) * 2]
        #: By depth, of each string: its count, whether that is frequent, whether it is this stretch's own, its number.
        self.count: list[np.ndarray] = []
        self.frequent: list[np.ndarray] = []
        self.owned: list[np.ndarray] = []
        self.number: list[np.ndarray] = []
        #: By depth, at each place: whether its string occurs once in all.
        self.once: list[np.ndarray] = []
        #: By depth, of each string of the depth before: how many kinds follow it, if it is retained as a context.
        self.kinds: list[np.ndarray] = [np.empty(0, np.int64)]

    def _contexts(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.on) <= depth:
            before = np.roll(self.where[depth - 1], 1)
            before[self.first] = -1
            on = np.flatnonzero(np.append(self.frequent[depth - 1], False)[before]).astype(np.int32)
            self.on.append((on, before[on]))
        return self.on[depth]

    def _sorted(self, depth: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those strings that known says by number, and each string's place among them."""
        which = np.flatnonzero(known)
        order = which[np.argsort(self.number[depth][which])]
        place = np.zeros(len(known), np.int32)
        place[order] = np.arange(len(order))
        return order, place

    def _ask(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct strings to ask for by bucket, context and word, as one key; numbers of the contexts and words in it.

        A context's words are dealt to all buckets in turn by their numbers.
        """
        on, of = self._contexts(depth)
        new = ~self.once[depth - 1][on]
        at, of = on[new], of[new]
        contexts, context = self._sorted(depth - 1, self.frequent[depth - 1])
        words, word = self._sorted(0, self.number[0] >= 0)
        if self.buckets * len(contexts) * len(words) >= 1 << 63:
            raise ValueError("a stretch has too many strings")
        contexts, words = self.number[depth - 1][contexts], self.number[0][words]
        start = (_spread(contexts) % np.uint64(self.buckets)).astype(np.int32)
        key = self._keys(context[of], word[self.where[0][at]], start, (words % self.buckets).astype(np.int32), len(contexts), len(words))
        # np.unique takes twice the memory.
        order = np.argsort(key)
        key = key[order]
        begins = _begins(key)
        where = np.full(len(self.train), -1, np.int32)
        where[at[order]] = np.repeat(np.arange(len(begins), dtype=np.int32), np.diff(np.append(begins, len(key))))
        distinct = key[begins]
        self.where.append(where)
        self.size.append(len(distinct))
        return distinct, contexts, words

    def _keys(self, c: np.ndarray, w: np.ndarray, start: np.ndarray, end: np.ndarray, contexts: int, words: int) -> np.ndarray:
        """Bucket, context and word as one number."""
        key = (start[c] + end[w]).astype(np.int64)
        key %= self.buckets
        key *= contexts
        key += c
        key *= words
        key += w
        return key

    def request(self, depth: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Each distinct string with a frequent context, and how often it is here in training texts and in others; buckets."""
        distinct, contexts, words = self._ask(depth)
        rest, w = np.divmod(distinct, max(1, len(words)))
        bucket, c = np.divmod(rest, max(1, len(contexts)))
        # In one bucket a context has words of only one remainder.
        asked, where = {"context": contexts[c], "word": words[w] // self.buckets}, self.where[depth]
        del distinct, rest, c, w
        n, held = (np.bincount(where[(where >= 0) & x], minlength=len(bucket)) for x in (self.train, ~self.train))
        return asked | {"times": _times(n, held)}, bucket

    def told(self, depth: int, bucket: np.ndarray, value: np.ndarray, number: np.ndarray) -> None:
        """Takes the answer to what was asked for, with each string's bucket.

        value: for each string, in order: 4 times its count, plus 2 if it occurs once, plus 1 if it is own. number: for
        those that may be part of a longer string, by bucket and magnitude: differences of their numbers there.
        """
        if depth:
            self._ask(depth)
        if self.size[depth] != len(value):
            raise ValueError("a stretch isn't answered in full")
        count, single = value >> 2, (value & 2) > 0
        once = np.append(single, False)[self.where[depth]]
        if depth:
            on = self.on[depth][0]
            once[on[self.once[depth - 1][on]]] = True
        self.once.append(once)
        self.count.append(count)
        self.frequent.append(count >= self.least)
        self.owned.append((value & 1) > 0)
        numbers = np.full(len(value), -1)
        if len(number):
            which = np.flatnonzero(_numbered(depth, count, single, self.least))
            which = which[np.lexsort((-_magnitude(count[which]), bucket[which]))]
            at = bucket[which]
            numbers[which] = _summed(number, _begins(at)) * self.buckets + at
        self.number.append(numbers)

    def _tested(self, depth: int) -> np.ndarray:
        """Frequent contexts of depth symbols, by bucket and number."""
        which = np.flatnonzero(self.frequent[depth - 1])
        number = self.number[depth - 1][which]
        return which[np.lexsort((number // self.buckets, number % self.buckets))]

    def divergence(self, depth: int, tokens: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of each frequent context of depth symbols: its number, and what this stretch's own strings add to its divergence; buckets."""
        on, _ = self._contexts(depth)
        where, above = self.where[depth], self.where[depth - 1]
        first, places = np.zeros(self.size[depth], np.int64), np.flatnonzero(where >= 0)[::-1]
        first[where[places]] = places
        own = np.flatnonzero(self.owned[depth] & (self.count[depth] > 0))
        lone = on[self.once[depth - 1][on] & self.train[on]]
        at, ones = np.concatenate((first[own], lone)), np.ones(len(lone), np.int64)
        of = above[at - 1]
        share = np.concatenate((self.count[depth][own], ones)) / self.count[depth - 1][of]
        parent = self.count[depth - 2][self.where[depth - 2][at - 1]] if depth > 1 else max(1, tokens)
        other = np.concatenate((self.count[depth - 1][above[first[own]]], ones)) / parent
        part = np.rint(share * np.log(share / other) * UNIT).astype(np.int64)
        apart = np.zeros(self.size[depth - 1], np.int64)
        np.add.at(apart, of, part)
        kinds = np.bincount(of, minlength=len(apart))
        which = self._tested(depth)
        number = self.number[depth - 1][which]
        total = np.where(self.owned[depth - 1], self.count[depth - 1], 0)
        return {"key": number // self.buckets, "apart": apart[which], "kinds": kinds[which], "total": total[which]}, number % self.buckets

    def kept(self, depth: int, values: np.ndarray) -> None:
        """values: for each frequent context, in order of divergence(), how many kinds follow it; 0 if it isn't retained."""
        kinds = np.zeros(self.size[depth - 1], np.int64)
        kinds[self._tested(depth)] = values
        self.kinds.append(kinds)

    def scores(self, depth: int, tokens: int, vocabulary: int, once: int) -> dict[str, np.ndarray]:
        word, size, known = self.where[0], self.docs["size"], self.count[0] > 0
        end = self.first + size - 1
        once = max(1, once)
        # The end is a known symbol even if there was nothing to learn from; the unknown word's mass is that of once.
        p = np.where(known, self.count[0], float(once))[word]
        p[end] = self.count[0][word[end]] + 1.0
        p /= tokens + 1.0 + once
        for d in range(1, depth + 1):
            on, of = self._contexts(d)
            retained = self.kinds[d][of] > 0
            on, of = on[retained], of[retained]
            count = np.append(self.count[d], 0)
            for s in range(0, len(on), PLACES):  # some at a time, for the sake of memory
                at, before = on[s : s + PLACES], of[s : s + PLACES]
                kinds, where = self.kinds[d][before], self.where[d][at]
                # A string that wasn't asked for occurs once, here.
                n = np.where(where < 0, self.train[at], count[where])
                p[at] = (n + kinds * p[at]) / (self.count[d - 1][before] + kinds)
        np.log10(p, out=p)
        gain = (np.log10(self.count[0] + 1.0) - np.log10(tokens + vocabulary + 1.0))[word]
        known = known[word]
        p[self.first], gain[self.first], known[self.first] = 0, 0, False
        return {"n_tokens": size - 1, "n_known": np.add.reduceat(known, self.first, dtype=np.int64), "base_score": np.add.reduceat(gain, self.first), "score": np.add.reduceat(p, self.first)}


def _numbered(depth: int, count: np.ndarray, single: np.ndarray, least: int) -> np.ndarray:
    """Which strings may be part of a longer one that is asked for: words that don't occur once, else frequent ones."""
    return count >= least if depth else ~single


def _reader(uri: str, buckets: int, least: int):
    """Cuts texts into stretches, writes each one's file and asks for the counts of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0
        numbers, tokens, docs, held = _Numbers(), [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal numbers, tokens, docs, held, serial
            who = serial << 40 | part
            columns = {f: np.array([d[i] for d in docs]) for i, (f, _) in enumerate(_DOCS)}
            hashes = np.array([BEGIN, END, *(xxhash.xxh3_64_intdigest(w) for w in numbers)], np.uint64)
            row = np.concatenate(tokens)
            numbers, tokens, docs, held, serial = _Numbers(), [], [], 0, serial + 1
            order = np.argsort(hashes)
            n, every = (np.bincount(r, minlength=len(hashes))[order] for r in (row[np.repeat(columns["held"] == 0, columns["size"])], row))
            number = np.empty(len(hashes), np.uint32)
            number[order[_by_magnitude(every)]] = np.arange(len(hashes))
            name = _write(uri, who, [pack(_DOCS, columns), pack(_TOKENS, {"token": number[row]}), pack(_WORDS, {"magnitude": _magnitude(every)})])
            made = [(TEXT, who, 0, name), *_bucketed(_level(ASK, 0), who, _ASK_WORD, *_ask_words(hashes[order], n, every, buckets))]
            release()
            return _batch(made)

        for b in batches:
            for key, out, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                raw = text.as_py()
                words = words_of(raw)
                row = np.empty(len(words) + 2, np.uint32)
                row[0], row[-1] = 0, 1
                row[1:-1] = [numbers[w] for w in words]
                tokens.append(row)
                docs.append((key or 0, key is None, out, len(row)))
                held += len(raw) + 64
                if held >= STRETCH_BYTES:
                    yield close()
        if docs:
            yield close()

    return run


def _write(uri: str, who: int, parts: list[bytes]) -> bytes:
    """Write a file of a stretch and return its name, which no other attempt at the same work shares."""
    files, folder = filesystem(uri)
    name = f"{who}-{uuid.uuid4().hex}"
    with files.open_output_stream(f"{folder}/{name}") as out:
        for p in parts:
            out.write(len(p).to_bytes(8, "little") + p)
    return name.encode()


def _parts(uri: str, name: bytes) -> list[bytes]:
    files, folder = filesystem(uri)
    with files.open_input_file(f"{folder}/{name.decode()}") as f:
        raw = f.read()
    parts, at = [], 0
    while at < len(raw):
        end = at + 8 + int.from_bytes(raw[at : at + 8], "little")
        parts.append(raw[at + 8 : end])
        at = end
    return parts


def _opened(uri: str, name: bytes, least: int, buckets: int = 1) -> _Stretch:
    docs, token, words = (unpack(f, p)[0] for f, p in zip((_DOCS, _TOKENS, _WORDS), _parts(uri, name), strict=True))
    return _Stretch(docs, token["token"], words["magnitude"], least, buckets)


def _adder(depth: int, least: int, deepest: int):
    """A bucket's work: adds up the counts of depth and the divergences of the depth before, and answers each stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, rows in _grouped(batches):
            made = [(k, at, who, d) for k, many in rows.items() if k not in (_level(ASK, depth), _level(TEST, depth - 1)) for who, d in many]
            for kind, answer in ((_level(ASK, depth), _level(COUNT, depth)), (_level(TEST, depth - 1), _level(KEPT, depth - 1))):
                if kind not in rows:
                    continue
                asked = [_unbucketed(_TEST if answer != _level(COUNT, depth) else _ASK_PAIR if depth else _ASK_WORD, d) for _, d in rows[kind]]
                if "word" in asked[0]:
                    key, word = (np.concatenate([a[f] for a in asked]).astype(np.uint64) for f in ("context", "word"))
                    if (int(key.max()) + 1) * (int(word.max()) + 1) >= 1 << 64:
                        raise ValueError("a bucket has too many words")
                    key = key * (word.max() + np.uint64(1)) + word
                else:
                    key = np.concatenate([a["key"] for a in asked])
                ends = np.cumsum([len(next(iter(a.values()))) for a in asked])[:-1]
                order = np.argsort(key, kind="stable")  # so that equal keys are in the order of stretches
                key = key[order]
                new = np.concatenate(([True], key[1:] != key[:-1]))
                begins, group = np.flatnonzero(new), np.cumsum(new) - 1
                value, numbers = np.empty(len(key), np.int64), [b""] * len(asked)
                if answer == _level(COUNT, depth):
                    n = np.concatenate([a["n"] for a in asked])[order]
                    total = np.add.reduceat(n, begins)
                    trained = np.flatnonzero(n > 0)
                    owner = np.zeros(len(key), np.int64)
                    owner[trained[np.flatnonzero(np.concatenate(([True], group[trained][1:] != group[trained][:-1])))] if len(trained) else trained] = 1
                    single = total + np.add.reduceat(np.concatenate([a["held"] for a in asked])[order], begins) == 1
                    value[order] = total[group] << 2 | single[group] << 1 | owner
                    if depth < deepest:
                        which = np.flatnonzero(_numbered(depth, total, single, least))
                        number, told = np.full(len(total), -1), np.empty(len(key), np.int64)
                        number[which[_by_magnitude(total[which])]] = np.arange(len(which))
                        told[order] = number[group]
                        numbers = [np.sort(x[x >= 0]) for x in np.split(told, ends)]
                        numbers = [pack(_ANSWER, {"value": np.diff(x, prepend=0)}) for x in numbers]
                    if depth == 0:
                        words = key[begins] != BEGIN
                        seen, once = words & (total > 0), words & (total == 1) & (key[begins] != END)
                        made.append((TOTALS, at, 0, np.array([total[words].sum(), seen.sum(), once.sum()], "<i8").tobytes()))
                else:
                    apart, kinds, total = (np.add.reduceat(np.concatenate([a[f] for a in asked])[order], begins) for f in ("apart", "kinds", "total"))
                    chance = 0.5 * kinds * np.log(np.maximum(total, 2)) / np.maximum(total, 1)
                    retained = apart / UNIT > np.maximum(DIVERGENCE, chance)
                    value[order] = np.where(retained, kinds, 0)[group]
                made += [(answer, who, at, pack(_ANSWER, {"value": v}, x)) for (who, _), v, x in zip(rows[kind], np.split(value, ends), numbers, strict=True)]
            if made:
                yield _batch(made)

    return run


def _asker(uri: str, buckets: int, least: int, deepest: int, depth: int, totals: tuple[int, int, int]):
    """A stretch's work at a depth: takes the answers so far, and asks for the next counts and divergences.

    After the deepest counts only their divergences are asked for, and after these (depth is deepest + 2) texts are scored.
    """
    tokens, vocabulary, once = totals

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for who, rows in _grouped(batches):
            # The first file is the text; each step's answers are one more.
            names = rows[TEXT][0][1].split()
            stretch = _opened(uri, names[0], least, buckets)

            def answer(kind: int, d: int, rows: dict = rows) -> list[bytes]:
                """All buckets' answers as three blocks: values, numbers, and buckets with how many values each has."""
                values, numbers, sizes = [np.empty(0, np.int64)], [np.empty(0, np.int64)], []
                for bucket, data in rows.get(_level(kind, d), []):
                    value, more = unpack(_ANSWER, data)
                    values.append(value["value"])
                    numbers += [unpack(_ANSWER, more)[0]["value"]] if more else []
                    sizes.append((bucket, len(value["value"])))
                blocks = [pack(_ANSWER, {"value": np.concatenate(x)}) for x in (values, numbers)]
                return [*blocks, pack(_SIZES, {f: np.array([x[i] for x in sizes], np.int64) for i, (f, _) in enumerate(_SIZES)})]

            told = [_parts(uri, n) for n in names[1:]]
            told.append([*answer(COUNT, depth - 1), answer(KEPT, depth - 2)[0]])
            for d in range(min(depth, deepest + 1)):
                (value, number), sizes = (unpack(_ANSWER, x)[0]["value"] for x in told[d][:2]), unpack(_SIZES, told[d][2])[0]
                stretch.told(d, np.repeat(sizes["bucket"].astype(np.int32), sizes["size"]), value, number)
                release()
            if depth == deepest + 2:
                for d in range(1, deepest + 1):
                    stretch.kept(d, unpack(_ANSWER, told[d + 1][3])[0]["value"])
                docs, made = stretch.docs, stretch.scores(deepest, tokens, vocabulary, once)
                key = pa.array(docs["doc"], pa.int64(), mask=docs["null"] > 0)
                train = pa.array(np.full(len(docs["doc"]), tokens, np.int64))
                yield pa.RecordBatch.from_arrays([key, pa.array(docs["held"] > 0), pa.array(made["n_tokens"]), pa.array(made["n_known"]), train, pa.array(made["base_score"]), pa.array(made["score"])], [c.split()[0] for c in SCORED.split(", ")])
                continue
            names.append(_write(uri, who, told[-1]))
            out = [(TEXT, who, 0, b" ".join(names))]
            if depth <= deepest:
                out += _bucketed(_level(ASK, depth), who, _ASK_PAIR, *stretch.request(depth))
            if depth > 1:
                out += _bucketed(_level(TEST, depth - 1), who, _TEST, *stretch.divergence(depth - 1, tokens))
            yield _batch(out)

    return run


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, depth: int = DEPTH, least: int = LEAST) -> DataFrame:
    """Learn from the rows of docs that aren't held out and score the whole text of every row.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, as the query's contract has them: base
    by add-one word counts, score by the tree. Distinct words are told apart by 64-bit hashes. Results don't
    hang on how rows are dealt, but for the last digits of sums of logarithms.

    A word or pair of words, however frequent, is one row of each stretch, so no key gathers its documents. A stretch
    holds whole documents, the longest with all that comes with it.

    Nulls: a null text is empty, so its only token is the end; a null id is not held out. Repeated rows are scored alike
    and count each. No rows to learn from: the end and the unknown word are as likely. Empty table: no rows. Only doc_id
    and text are looked at.
    """
    if least < 2:
        raise ValueError("a context has to occur twice at least")
    spark = docs.sparkSession
    ship(spark)
    uri = scratch(spark, "suffix-tree")
    mod, out = HELD_OUT
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_of_id(mod) == out).alias("held"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("_bytes"))
    size = raw.agg(F.coalesce(F.sum(F.octet_length("_bytes") + 16), F.lit(0))).first()[0]
    buckets = max(4, -(-size // BUCKET_BYTES))

    def deal(df: DataFrame, parts: int) -> DataFrame:
        # Buckets are numbered from 0; a stretch's number has its task in the low bits and its place there in the high ones.
        to = F.col("at").bitwiseAND(F.lit((1 << 40) - 1)) + F.shiftright("at", 40) * 31
        return df.repartitionById(parts, (to % parts).cast("int")).sortWithinPartitions("at", "kind", "who")

    # The words' counts are cut off here: file names and answers are then fixed, and the totals are known.
    first = cut(deal(raw.mapInArrow(_reader(uri, buckets, least), KINDS), buckets).mapInArrow(_adder(0, least, depth), KINDS))
    sums = first.filter(F.col("kind") == TOTALS).mapInArrow(_totals, "a long, b long, c long").agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in "abc")).first()
    stretches = max(2, first.filter(F.col("kind") == TEXT).count())
    rows, totals = first.filter(F.col("kind") != TOTALS), tuple(sums)
    for d in range(1, depth + 2):
        asked = deal(rows, stretches).mapInArrow(_asker(uri, buckets, least, depth, d, totals), KINDS)
        rows = deal(asked, buckets).mapInArrow(_adder(d, least, depth), KINDS)
    return deal(rows, stretches).mapInArrow(_asker(uri, buckets, least, depth, depth + 2, totals), SCORED)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.frombuffer(b"".join(b.column(3).to_pylist()), "<i8").reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, i])) for i in range(3)], ["a", "b", "c"])
