"""Quality scores: random-indexing word vectors pooled per document and a small network.

Random indexing: every word has a fixed sparse index vector (SEEDS entries of +1 or -1 among
DIMS), and a context vector, the sum of the index vectors of its left and right neighbours
over all rows. Words are hashed to WORDS slots; next to its spelling every word has a shape
(letters, digits or signs, capitals, length), which has vectors of its own, so that unseen
words are known by their shape. A document pools the context vectors of its words (mean over
spellings, mean over shapes) with three repetition measures of its index vectors: how far the
words concentrate, how often a word follows itself, and the document's length.

A network of two layers is fitted to the labels in numpy, on at most SAMPLE labelled rows (of
least id hash) that are not held out. A fifth of them is set aside to calibrate: the
temperature that divides the log-odds is the one of least log loss there.

Defined results: null, empty and blank texts pool to zeros and get the score of that; repeated
rows score alike; null ids are kept and count as held out; other columns are not read; without
labels of both kinds every score is the share of ones (0.5 without labels); an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut_lineage
from .hashing import U
from .tokens import DIGIT, SIGN, Tokens, held_out, labelled, parts, utf8

SAMPLE = 20_000             # labelled rows that are fitted
WORDS = 1 << 13
SHAPES = 256
SLOTS = WORDS + SHAPES
DIMS = 48
SEEDS = 2
BLOCK = 64                  # slots whose sums travel as one row
WIDTH = 2 * DIMS + 4
HIDDEN = 32

_rng = np.random.default_rng(7)
PLACES = _rng.integers(0, DIMS, (SLOTS, SEEDS))
SIGNS = _rng.choice([-1.0, 1.0], (SLOTS, SEEDS))


def slots(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Slot of the spelling and of the shape of each word."""
    spelling = (t.word >> U(64 - 13)).astype(np.int64)
    short = np.minimum(t.length, 15)
    shape = short + 16 * np.minimum(t.upper, 2)                 # lower case, one capital, several
    shape = np.where(t.kind == DIGIT, 48 + short, shape)
    shape = np.where(t.kind == SIGN, 64 + (t.first & 31) * 4 + np.minimum(t.length, 4) - 1, shape)
    return spelling, WORDS + shape


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's sums of index vectors of neighbours, by block of slots."""
    total = np.zeros(SLOTS * DIMS)
    for batch in batches:
        for _, some in parts(utf8(batch.column("text"))):
            t = Tokens(some)
            near = t.owner[1:] == t.owner[:-1]
            both = slots(t)
            for one in both:
                for other in both:
                    for a, b in ((one[1:][near], other[:-1][near]), (one[:-1][near], other[1:][near])):
                        for k in range(SEEDS):
                            total += np.bincount(a * DIMS + PLACES[b, k], SIGNS[b, k], minlength=len(total))
    sums = total.reshape(SLOTS, DIMS).astype(np.int64)
    filled = [i for i in range(0, SLOTS, BLOCK) if sums[i : i + BLOCK].any()]
    yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int64()), pa.array([sums[i : i + BLOCK].tobytes() for i in filled], pa.binary())], names=["block", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block: its sums. A task holds no more than the blocks it owns."""
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for block, sums in zip(b.column("block").to_pylist(), b.column("sums")):
            sums = np.frombuffer(sums.as_buffer(), np.int64)
            held[block] = held[block] + sums if block in held else sums.copy()
    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["block", "sums"])


def context_vectors(docs: DataFrame) -> np.ndarray:
    """The unit context vector of each slot, from all rows of ``docs``."""
    kinds = "block long, sums binary"
    found = docs.select("text").mapInArrow(_neighbours, kinds).repartition("block").mapInArrow(_added, kinds).toPandas()
    vectors = np.zeros((SLOTS, DIMS))
    for block, sums in zip(found["block"], found["sums"]):
        part = np.frombuffer(sums, np.int64).reshape(-1, DIMS)
        vectors[block : block + len(part)] += part
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """The features of each text."""
    n, sums, follow = np.zeros(len(texts)), np.zeros((len(texts), 2 * DIMS)), np.zeros(len(texts))
    keys: list[np.ndarray] = []
    for places, some in parts(texts):
        t = Tokens(some)
        spelling, shape = slots(t)
        owner = places[t.owner]
        n += np.bincount(owner, minlength=len(texts))
        near = owner[1:] == owner[:-1]
        follow += np.bincount(owner[1:][near], (t.word[1:] == t.word[:-1])[near], minlength=len(texts))
        head = np.flatnonzero(np.concatenate((np.ones(min(1, len(owner)), bool), ~near)))
        if len(head):
            sums[owner[head], :DIMS] += np.add.reduceat(vectors[spelling], head)
            sums[owner[head], DIMS:] += np.add.reduceat(vectors[shape], head)
        keys.append(owner * WORDS + spelling)
    key, count = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
    most = np.maximum(n, 1)
    squares = np.bincount(key // WORDS, count.astype(float) ** 2, minlength=len(texts)) / most**2
    out = np.zeros((len(texts), WIDTH), np.float32)
    out[:, : 2 * DIMS] = sums / most[:, None]
    full = n > 0
    out[:, -4] = np.where(full, np.log(np.where(full, squares, 1)), 0)
    out[:, -3] = follow / most
    out[:, -2] = np.log1p(n)
    out[:, -1] = np.where(full, np.log(np.where(full, squares, 1) * most), 0)
    return out


class Network:
    """Two layers and a temperature; ``score`` is the probability of label 1."""

    def __init__(self, share: float):
        self.share = share
        self.layers: list[np.ndarray] = []
        self.temperature = 1.0

    def _odds(self, z: np.ndarray) -> np.ndarray:
        w, b, v, c = self.layers
        return np.maximum(0, z @ w + b) @ v + c[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), self.share)
        odds = self._odds((x - self.mean) / self.scale) / self.temperature
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, passes: int = 40, batch: int = 64, rate: float = 3e-3, decay: float = 1e-3) -> "Network":
        net = cls(float(y.mean()) if len(y) else 0.5)
        if len(np.unique(y)) < 2:
            return net
        rng = np.random.default_rng(0)
        order = rng.permutation(len(y))
        check, order = order[: len(y) // 5], order[len(y) // 5 :]
        net.mean, net.scale = x[order].mean(axis=0), x[order].std(axis=0) + 1e-3
        z = (x - net.mean) / net.scale
        net.layers = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        first, second, step = [np.zeros_like(p) for p in net.layers], [np.zeros_like(p) for p in net.layers], 0
        for _ in range(passes):
            rng.shuffle(order)
            for at in range(0, len(order), batch):
                i = order[at : at + batch]
                w, b, v, c = net.layers
                hidden = np.maximum(0, z[i] @ w + b)
                error = (1 / (1 + np.exp(-np.clip(hidden @ v + c[0], -40, 40))) - y[i]) / len(i)
                back = np.outer(error, v) * (hidden > 0)
                step += 1
                for p, m, s, g in zip(net.layers, first, second, (z[i].T @ back + decay * w, back.sum(axis=0), hidden.T @ error + decay * v, np.array([error.sum()]))):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        if len(check):
            odds, label = net._odds(z[check]), y[check]
            tried = np.geomspace(0.25, 16, 61)
            loss = [np.mean(np.logaddexp(0, odds / t) - label * odds / t) for t in tried]
            net.temperature = float(tried[int(np.argmin(loss))])
        return net


def scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted; a row per row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    vectors = spark.sparkContext.broadcast(context_vectors(rows).astype(np.float32))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                flat = pooled(utf8(b.column("text")), vectors.value)
                ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * WIDTH)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(flat.ravel()))], names=["doc_id", "x"])

    book = cut_lineage(rows.mapInArrow(pool, "doc_id long, x array<float>"), "quality-pooled")
    known = book.join(labelled(labels, "quality", sample), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").select("y", "x").toPandas()
    x = np.array(known["x"].to_list(), np.float64).reshape(len(known), WIDTH)
    network = spark.sparkContext.broadcast(Network.fit(x, known["y"].to_numpy(float)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column("x").flatten().to_numpy().reshape(b.num_rows, WIDTH).astype(np.float64)
            p = network.value.score(flat)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = book.mapInArrow(score, "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
