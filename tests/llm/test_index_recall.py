"""Recall against brute force where lengths and directions spread in different ways."""

import numpy as np
import pytest

from veriglyph.llm import permutation_index as index


def recall(spark, x):
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = {}
    for r in index.nearest(frame).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in range(0, len(x), 20):
        score = x @ x[q]
        score[q] = -np.inf
        hit += len(got[q] & set(np.lexsort((np.arange(len(x)), -score))[:20].tolist()))
    return hit / (20 * len(got))


@pytest.mark.parametrize("kind", ["unit", "lognormal", "clusters"])
def test_recall(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 32))
    if kind == "clusters":
        x = rng.normal(size=(40, 32))[rng.integers(0, 40, 2000)] + 0.3 * x
    if kind != "lognormal":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind != "unit":
        x *= np.exp(rng.normal(size=(2000, 1)))
    assert recall(spark, x) >= 0.9


def test_a_third_of_all_vectors_are_equal(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 8))
    x[::3] = x[0]
    assert recall(spark, x) >= 0.95


def test_blocks_of_lists_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 8))
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(index, "BLOCK", 7)
    monkeypatch.setattr(index, "QUERIES", 3)
    got = {(r.query_id, r.rank): r.vec_id for r in index.brute_force(frame).collect()}
    for q in range(0, 500, 20):
        score = x @ x[q]
        score[q] = -np.inf
        assert [got[q, k + 1] for k in range(20)] == np.lexsort((np.arange(500), -score))[:20].tolist()
