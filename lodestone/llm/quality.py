"""Quality classifier: a byte-level convolutional network in numpy.

A byte has a learned vector; learned filters over KERNEL bytes run along overlapping chunks that cover the whole text;
each filter's largest answer in a chunk goes through one hidden layer to a logit; the mean of a text's chunk logits gives
its probability. For use, vectors and filters are multiplied out into one table a kernel place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import crc_of_id, refuse
from lodestone.shipping import ship

CHUNK, STRIDE, KERNEL, FILTERS, DIM, HIDDEN = 512, 448, 6, 32, 8, 16
PAD = 256  # stands for what is beyond a text's end
SPAN = CHUNK + KERNEL - 1
HELD_OUT = 3, 1  # crc32 of the id mod 3 is 1

#: The classifier is fitted on so many labelled rows at most, and on so many chunks of each, drawn from its whole text.
SAMPLE_ROWS, SAMPLE_CHUNKS = 2000, 8


@dataclass
class Network:
    """tables: KERNEL x 257 x FILTERS; the rest are the filters' biases and the two layers above."""

    tables: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float

    def chunk_logits(self, chunks: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """chunks: n x SPAN of 0 to PAD; lengths: places of each that are in the text."""
        pooled = _convolve(self.tables, chunks)
        pooled = np.maximum(_pool(pooled, lengths)[0] + self.bias, 0)
        return np.maximum(pooled @ self.hidden + self.hidden_bias, 0) @ self.out + self.out_bias


def _convolve(tables: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    total = np.take(tables[0], chunks[:, :CHUNK], axis=0)
    place = np.empty_like(total)
    for k in range(1, KERNEL):
        np.take(tables[k], chunks[:, k : CHUNK + k], axis=0, out=place, mode="clip")
        total += place
    return total


def _pool(answers: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    for row in np.flatnonzero(lengths < CHUNK):
        answers[row, max(1, int(lengths[row])) :] = -np.inf
    return answers.max(axis=1), answers


def cut_chunks(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping chunks that cover the whole text, one of padding if it is empty; and how much of each is text."""
    n = len(text)
    count = max(1, -(-(n - (CHUNK - STRIDE)) // STRIDE))
    padded = np.full((count - 1) * STRIDE + SPAN, PAD, dtype=np.int16)
    padded[:n] = np.frombuffer(text, dtype=np.uint8)[: len(padded)]
    rows = np.lib.stride_tricks.as_strided(padded, (count, SPAN), (padded.strides[0] * STRIDE, padded.strides[0]))
    return rows, np.minimum(CHUNK, np.maximum(0, n - STRIDE * np.arange(count)))


def probabilities(network: Network, texts: list[bytes], block: int = 12) -> np.ndarray:
    """A probability for each text, from all its chunks; memory holds one block of chunks at a time."""
    out = np.empty(len(texts))
    waiting: list[tuple[int, np.ndarray, np.ndarray]] = []
    total = np.zeros(len(texts))
    count = np.zeros(len(texts))

    def flush() -> None:
        if waiting:
            logits = network.chunk_logits(np.concatenate([w[1] for w in waiting]), np.concatenate([w[2] for w in waiting]))
            owners = np.concatenate([np.full(len(w[1]), w[0]) for w in waiting])
            np.add.at(total, owners, logits)
            np.add.at(count, owners, 1)
            waiting.clear()

    held = 0
    for i, text in enumerate(texts):
        rows, lengths = cut_chunks(text)
        for at in range(0, len(rows), block):
            waiting.append((i, rows[at : at + block], lengths[at : at + block]))
            held += len(waiting[-1][1])
            if held >= block:
                flush()
                held = 0
    flush()
    np.divide(total, np.maximum(count, 1), out=out)
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def train(chunks: np.ndarray, lengths: np.ndarray, owner: np.ndarray, label: np.ndarray, epochs: int = 24, batch: int = 32, rate: float = 6e-3, seed: int = 7) -> Network:
    """Adam on the log loss of texts. owner: text of each chunk, ascending; label: 0 or 1 of each text.

    With no texts, or texts of one label only, the network answers the smoothed share of label 1 for any text.
    """
    rng = np.random.default_rng(seed)
    p = {
        "vectors": rng.normal(0, 0.5, (PAD + 1, DIM)), "kernel": rng.normal(0, (KERNEL * DIM) ** -0.5, (KERNEL, DIM, FILTERS)), "bias": np.zeros(FILTERS),
        "hidden": rng.normal(0, (2 / FILTERS) ** 0.5, (FILTERS, HIDDEN)), "hidden_bias": np.zeros(HIDDEN), "out": rng.normal(0, HIDDEN**-0.5, HIDDEN), "out_bias": np.zeros(1),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    texts, ones = len(label), int(label.sum())
    prior = float(np.log((ones + 1) / (texts - ones + 1)))

    def network() -> Network:
        vectors = p["vectors"].copy()
        vectors[PAD] = 0
        tables = np.einsum("vd,kdf->kvf", vectors, p["kernel"]).astype(np.float32)
        return Network(np.ascontiguousarray(tables), p["bias"].copy(), p["hidden"].copy(), p["hidden_bias"].copy(), p["out"].copy(), float(p["out_bias"][0]))

    if ones in (0, texts):
        p["out"][:] = 0
        p["out_bias"][0] = prior
        return network()
    p["out_bias"][0] = prior
    first = np.searchsorted(owner, np.arange(texts))
    count = np.searchsorted(owner, np.arange(texts), "right") - first
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step, steps = 0, epochs * -(-texts // batch)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(texts), -(-texts // batch)):
            picked = np.concatenate([first[t] + rng.permutation(count[t])[:3] for t in part])
            which = np.repeat(np.arange(len(part)), np.minimum(count[part], 3))
            net, g = network(), {}
            x, n = chunks[picked], lengths[picked]
            answers = _convolve(net.tables, x)
            pooled, answers = _pool(answers, n)
            where = answers.argmax(axis=1)
            h0 = pooled + p["bias"]
            h = np.maximum(h0, 0)
            u0 = h @ p["hidden"] + p["hidden_bias"]
            u = np.maximum(u0, 0)
            z = u @ p["out"] + p["out_bias"][0]
            share = 1 / np.bincount(which)
            logit = np.bincount(which, z) * share
            wrong = (1 / (1 + np.exp(-logit)) - label[part]) / len(part)
            dz = (wrong * share)[which].astype(np.float32)
            g["out"], g["out_bias"] = u.T @ dz, dz.sum(keepdims=True)
            du = np.outer(dz, p["out"]) * (u0 > 0)
            g["hidden"], g["hidden_bias"] = h.T @ du, du.sum(axis=0)
            dh = (du @ p["hidden"].T) * (h0 > 0)
            g["bias"] = dh.sum(axis=0)
            vectors = p["vectors"].copy()
            vectors[PAD] = 0
            g["vectors"], g["kernel"] = np.zeros_like(vectors), np.zeros_like(p["kernel"])
            rows = np.arange(len(picked))[:, None]
            for k in range(KERNEL):
                seen = x[rows, where + k]  # chunks x FILTERS: the byte under place k where each filter answered most
                g["kernel"][k] = np.einsum("cfd,cf->df", vectors[seen], dh)
                np.add.at(g["vectors"], seen, dh[..., None] * p["kernel"][k].T[None])
            g["vectors"][PAD] = 0
            step += 1
            slow = rate * (1 - 0.9 * step / steps)
            for k, v in p.items():
                grad = g[k] + (1e-4 * v if v.ndim > 1 else 0)
                m, s = moment[k]
                m += 0.1 * (grad - m)
                s += 0.001 * (grad * grad - s)
                v -= (slow * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return network()


def _draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks for the fit: at most SAMPLE_CHUNKS of each text, drawn evenly from its whole length."""
    for b in batches:
        rows: list[tuple] = []
        for key, quality, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            cut, lengths = cut_chunks(text or b"")
            rng = np.random.default_rng(key & 0xFFFFFFFF)
            for i in sorted(rng.permutation(len(cut))[:SAMPLE_CHUNKS]):
                rows.append((key, quality, np.ascontiguousarray(cut[i]).tobytes(), int(lengths[i])))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 4, (pa.int64(), pa.int32(), pa.binary(), pa.int32()), strict=True)], ["key", "quality", "chunk", "length"])


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", rows: int = SAMPLE_ROWS) -> Network:
    """Fit on at most so many labelled texts, the first in the order of a hash of the id, without those held out.

    Rows with a null label or id, and labels without a text, are left out. Rows of equal id and text are one text; labels
    that differ for one id are two rows of the sample. No labels: see train(). Each step of the fit draws 3 of a text's
    chunks.
    """
    ship(docs.sparkSession)
    mod, out = HELD_OUT
    labels = labels.select("doc_id", F.col(column).cast("int").alias("_label"))
    usable = labels.filter((crc_of_id(mod) != out) & F.col("_label").isin(0, 1) & F.col("doc_id").isNotNull())
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "_label").limit(rows)
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("_text")).filter(F.col("_text").isNotNull())
    # The sample's bound is a parameter, so it may be sent to every executor.
    drawn = texts.join(F.broadcast(sample), "doc_id").select(F.xxhash64("doc_id", "_text", "_label").alias("key"), "_label", "_text")
    got = drawn.mapInArrow(_draw, "key long, quality int, chunk binary, length int").toPandas().sort_values(["key", "quality", "chunk"], kind="stable")
    chunks = np.frombuffer(b"".join(got["chunk"]), dtype=np.int16).reshape(-1, SPAN)
    owner, first = np.unique(got["key"].to_numpy(), return_index=True)
    return train(chunks, got["length"].to_numpy(), np.searchsorted(owner, got["key"].to_numpy()), got["quality"].to_numpy()[first].astype(np.float32))


def _scorer(network: Network):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [t or b"" for t in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(probabilities(network, texts), pa.float64())], [*part.schema.names[:-1], "score"])

    return score


def classify(docs: DataFrame, network: Network, keep: list[str]) -> DataFrame:
    """The columns in keep, and score (double, 0 to 1) of each row's whole text; a null text scores as an empty one.

    Empty table: no rows. Repeated rows score alike. Columns to keep that are named like the new ones are refused.
    """
    refuse(keep, ["score", "_bytes"])
    ship(docs.sparkSession)
    chosen = docs.select(*keep, F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("_bytes"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(_scorer(network), f"{kinds}, score double")


def held_out() -> Column:
    mod, out = HELD_OUT
    return crc_of_id(mod) == out
