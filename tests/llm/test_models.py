"""Classifiers and nearest neighbours: held-out accuracy, recall, defined results."""

from __future__ import annotations

import numpy as np
import pytest

from marquee.llm import neighbours, quality, toxicity

from .common import awkward, empty, frame

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def corpus(spark):
    read = lambda n: spark.read.parquet(f"{SF}/{n}.parquet")
    return read("documents"), read("labels")


def test_held_out_quality(corpus):
    docs, labels = corpus
    got = quality.scores(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert ((held.predicted == held.quality).mean()) > 0.95
    assert got.score.between(0, 1).all()


def test_held_out_toxicity(corpus):
    docs, labels = corpus
    found = toxicity.severity(docs, labels)
    assert found.count() == docs.count()
    got = found.withColumnRenamed("toxic", "said").join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.said == held.toxic).mean() > 0.93
    assert got.severity.between(0, toxicity.GRADES).all()
    assert got[got.toxic == 1].severity.mean() > 5 * got[got.toxic == 0].severity.mean()


def test_thresholds_are_ordered_and_weights_shared():
    rng = np.random.default_rng(0)
    grade = rng.integers(0, toxicity.GRADES + 1, 500)
    model = toxicity.Ordinal.fit(np.arange(500), np.zeros(500, int), grade.astype(float), grade, 1)
    assert (np.diff(model.thresholds) > 0).all() and model.weights[0] > 0
    severity = model.above(np.arange(500), np.zeros(500, int), grade.astype(float), 500).sum(axis=1)
    assert np.corrcoef(severity, grade)[0, 1] > 0.9


@pytest.mark.parametrize("op", ["quality", "toxicity"])
def test_awkward_rows_are_scored(spark, op):
    rows = awkward(5)
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i, _, _ in rows if i is not None] + [(None, 1, None)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    run = quality.scores if op == "quality" else toxicity.severity
    column = "score" if op == "quality" else "severity"
    for known in (labels, none):
        got = run(docs, known).collect()
        assert len(got) == len(rows) and all(np.isfinite(r[column]) for r in got)
        assert all(r.held_out for r in got if r.doc_id is None)
    assert run(empty(spark), labels).count() == 0


def model(rows, k=5, every=50):
    good = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        good[i, tuple(v)] = np.array(v, float)
    width = max((len(v) for v in good.values()), default=1)
    ids = np.array([i for i, _ in good])
    x = np.array([np.pad(v, (0, width - len(v))) for v in good.values()])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = np.round(x @ x[q], 12)
        others = np.flatnonzero(ids != ids[q])
        out[ids[q]] = [int(i) for i in ids[others[np.lexsort((ids[others], -s[others]))]][:k]]
    return out


def test_nearest_of_awkward_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.normal(size=12).astype(np.float32).tolist()) for i in range(1, 400)]
    rows += [(i, rows[0][1]) for i in range(1000, 1200)]                       # a very common vector
    rows += [(None, rows[1][1]), (500, None), (501, []), (502, [0.0] * 12), (503, [float("nan")] * 12), (504, [None] * 12), (550, [float("inf")] * 12)]
    rows += [(600, rows[5][1][:7]), (50, rows[48][1]) if rows[48][0] == 50 else (650, rows[7][1]), rows[3], rows[3]]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, n int")
    got = {}
    for r in neighbours.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == model(rows)


def test_recall_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {}
    for r in neighbours.nearest(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = model([(r.vec_id, r.embedding) for r in df.collect()])
    assert got.keys() == want.keys()
    assert sum(len(got[q] & set(w)) for q, w in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_few_and_no_vectors(spark):
    kind = "vec_id long, embedding array<double>"
    assert neighbours.nearest(spark.createDataFrame([], kind)).count() == 0
    few = spark.createDataFrame([(50, [1.0, 0.0]), (1, [1.0, 1.0]), (100, [0.0, 2.0])], kind)
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in neighbours.nearest(few).collect())
    assert got == [(50, 1, 1, 0.707107), (50, 2, 100, 0.0), (100, 1, 1, 0.707107), (100, 2, 50, 0.0)]


def test_hilbert_curve_is_a_walk():
    side = np.arange(8)
    cells = np.array(np.meshgrid(side, side, side)).reshape(3, -1).T
    order = np.argsort(neighbours.hilbert(cells, 3))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()
