"""Toxicity as a severity grade, by cumulative-link ordinal regression on sparse text features.

Features are the lower-cased words of a text and their prefixes of 4 to 8 bytes, as
64-bit hashes. Over the labelled rows the number of toxic and other texts with each feature
is counted, and the FEATURES most telling ones (chi-square, TELLING at least) are the columns of the model; a
text's value is the logarithm of one plus the count.

The labels hold one bit. Grade 0 is not toxic; toxic rows get the grades 1 to GRADES by equal
shares of the amount in them of features telling for toxic texts. The model is P(grade > k) =
logistic(w.x - t_k): one weight vector for all ordered thresholds. The expected severity is
the sum of these probabilities, 0 to GRADES; a text is toxic when P(grade > 0) >= 0.5.

At most SAMPLE labelled rows are fitted (those of least id hash), never held-out ones; every
row is scored over its whole text. Defined results: null or empty texts have no features and
get the score of the thresholds alone; repeated rows score alike; a null id is kept; other
columns are not read; without labels of both kinds every severity is 0; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut_lineage
from .hashing import U, mix
from .tokens import LETTER, Tokens, held_out, learnt, parts, utf8

SAMPLE = 20_000             # labelled rows that are fitted
FEATURES = 1 << 14
GRADES = 3
TELLING = 30                # least chi-square of a feature: chance passes few of the many rare ones
PREFIXES = (4, 5, 6, 7, 8)
LEAST = 5                   # toxic texts that must have a feature


def features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text and hash of each word and prefix of a word."""
    for places, some in parts(texts):
        t = Tokens(some, lower=True)
        word = t.kind == LETTER
        start, end, owner = t.start[word], t.end[word], t.owner[word]
        hashes, owners = [t.word[word]], [owner]
        for k in PREFIXES:
            longer = end - start > k
            hashes.append(mix(t.prefixes.hashed(start[longer], start[longer] + k) ^ U(k)))
            owners.append(owner[longer])
        yield places[np.concatenate(owners)], np.concatenate(hashes)


def _present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct feature of each text, with its label."""
    for batch in batches:
        for b in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
            y = b.column("y").to_numpy()
            rows = [np.stack((o.astype(np.uint64), h)) for o, h in features(utf8(b.column("text")))]
            each = np.unique(np.concatenate(rows, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(each[1].view(np.int64)), pa.array(y[each[0].astype(np.int64)], pa.int32())], names=["f", "y"])


class Columns:
    """Sparse columns of chosen features."""

    def __init__(self, hashes: np.ndarray, toxic: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.toxic = hashes[order], toxic[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.hashes >> U(44)).astype(np.int64)] = True

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, column and value of the entries; amount of features telling for toxic texts by row."""
        keys = [np.zeros(0, np.int64)]
        for owner, h in features(texts):
            may = self.seen[(h >> U(44)).astype(np.int64)]
            owner, h = owner[may], h[may]
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = self.hashes[at] == h if len(self.hashes) else np.zeros(0, bool)
            keys.append(owner[hit] * len(self.hashes) + at[hit])
        key, count = np.unique(np.concatenate(keys), return_counts=True)
        row, col = np.divmod(key, max(1, len(self.hashes)))
        value = np.log1p(count)
        marked = np.bincount(row, np.log1p(count) * self.toxic[col], minlength=len(texts)).astype(float)
        return row, col, value, marked


class Ordinal:
    """P(grade > k) = logistic(w.x - t_k) with ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def above(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        score = np.bincount(row, self.weights[col] * value, minlength=n)
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None], -40, 40)))

    @classmethod
    def fit(cls, row, col, value, grade: np.ndarray, n_cols: int, rounds: int = 500, rate: float = 0.05, decay: float = 1e-5) -> "Ordinal":
        n = len(grade)
        weights, free = np.zeros(n_cols), np.array([1.0] + [0.0] * (GRADES - 1))    # steps between thresholds as logarithms
        state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(free), np.zeros_like(free)]
        for i in range(1, rounds + 1):
            steps = np.exp(free[1:])
            thresholds = free[0] + np.concatenate(([0.0], np.cumsum(steps)))
            p = cls(weights, thresholds).above(row, col, value, n)
            # likelihood of a grade: the difference of two successive probabilities
            full = np.concatenate((np.ones((n, 1)), p, np.zeros((n, 1))), axis=1)
            slope = full * (1 - full)
            at = np.arange(n)
            chance = np.maximum(full[at, grade] - full[at, grade + 1], 1e-12)
            by_score = -(slope[at, grade] - slope[at, grade + 1]) / chance / n
            by_threshold = np.zeros((n, GRADES + 2))
            by_threshold[at, grade] += slope[at, grade] / chance / n
            by_threshold[at, grade + 1] -= slope[at, grade + 1] / chance / n
            by_threshold = by_threshold[:, 1:-1].sum(axis=0)
            tail = np.cumsum(by_threshold[::-1])[::-1]
            grads = (np.bincount(col, by_score[row] * value, minlength=n_cols) + decay * weights, np.concatenate(([tail[0]], tail[1:] * steps)))
            for k, (x, g) in enumerate(((weights, grads[0]), (free, grads[1]))):
                m, v = state[2 * k], state[2 * k + 1]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x -= rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
        return cls(weights, free[0] + np.concatenate(([0.0], np.cumsum(np.exp(free[1:])))))


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Columns, Ordinal] | None:
    """Columns and model from labelled rows; None without rows of both kinds."""
    rows = cut_lineage(learnt(docs, labels, "toxic", sample, "text"), "toxic-sample")
    size = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    pos, neg = size.get(1, 0), size.get(0, 0)
    if not pos or not neg:
        return None
    with_f = rows.mapInArrow(_present, "f long, y int").groupBy("f").agg(F.sum("y").cast("double").alias("a"), (F.count("*") - F.sum("y")).cast("double").alias("b"))
    a, b, n = F.col("a"), F.col("b"), float(pos + neg)
    chi = F.lit(n) * F.pow(a * (neg - b) - b * (pos - a), 2) / ((a + b) * (n - a - b + 1e-9) * pos * neg)
    top = with_f.where((a >= LEAST) & (chi >= TELLING)).orderBy(chi.desc(), "f").limit(FEATURES).toPandas()
    odds = np.log((top["a"] + 0.5) / (pos + 1)) - np.log((top["b"] + 0.5) / (neg + 1))
    columns = Columns(top["f"].to_numpy(np.int64).view(np.uint64), (odds.to_numpy() > 2).astype(float))
    entries = rows.mapInArrow(lambda batches: _entries(batches, columns), "y int, marked double, col array<int>, value array<double>").toPandas()
    y, marked = entries["y"].to_numpy(), entries["marked"].to_numpy()
    grade = np.where(y > 0, 1 + np.searchsorted(np.quantile(marked[y > 0], np.arange(1, GRADES) / GRADES), marked), 0)
    row = np.repeat(np.arange(len(entries)), entries["col"].map(len))
    col = np.concatenate(entries["col"].to_list()).astype(np.int64)
    return columns, Ordinal.fit(row, col, np.concatenate(entries["value"].to_list()), grade, len(columns.hashes))


def _entries(batches: Iterator[pa.RecordBatch], columns: Columns) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
            row, col, value, marked = columns.of(utf8(b.column("text")))
            ends = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column("y"), pa.array(marked), pa.ListArray.from_arrays(ends, pa.array(col.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(value))], names=["y", "marked", "col", "value"],
            )


def severity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, severity (expected grade), grade (likeliest), p_toxic, toxic (0 or 1), held_out; a row per row of ``docs``."""
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    model = fitted(rows, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)    # FEATURES hashes and weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                if shared.value:
                    columns, ordinal = shared.value
                    row, col, value, _ = columns.of(utf8(b.column("text")))
                    above = ordinal.above(row, col, value, b.num_rows)
                else:
                    above = np.zeros((b.num_rows, GRADES))
                each = np.concatenate((1 - above[:, :1], above[:, :-1] - above[:, 1:], above[:, -1:]), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(above.sum(axis=1)), pa.array(each.argmax(axis=1), pa.int32()), pa.array(above[:, 0].copy()), pa.array((above[:, 0] >= 0.5).astype(np.int32))],
                    names=["doc_id", "severity", "grade", "p_toxic", "toxic"],
                )

    scored = rows.mapInArrow(run, "doc_id long, severity double, grade int, p_toxic double, toxic int")
    return scored.withColumn("held_out", held_out(F.col("doc_id")))
