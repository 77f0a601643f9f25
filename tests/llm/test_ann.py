"""The forest: recall against rows read, order of the queue, clustered vectors, and leaves dealt to several bins."""

from __future__ import annotations

import numpy as np
import pytest

from tessella.llm import ann


def neighbours(unit, own, wanted=5):
    near = unit[own] @ unit.T
    near[np.arange(len(own)), own] = -9
    return np.argsort(-near, axis=1)[:, :wanted]


def searched(unit, own, forest):
    """Recall of the neighbours and the share of distinct rows read."""
    leaves, best = forest.place(unit), neighbours(unit, own)
    recall, read = [], []
    for k, took in enumerate(forest.visit(unit[own])):
        taken = np.zeros(forest.leaves * forest.trees, bool)
        taken[took] = True
        got = taken[leaves].any(1)
        recall.append(got[best[k]].mean())
        read.append(got.mean())
    return np.mean(recall), np.mean(read)


def test_recall_and_rows_read():
    rng = np.random.default_rng(3)
    unit = ann._unit(rng.normal(size=(12_000, 64)))
    forest = ann.Forest(unit)
    forest.tune(unit)
    recall, read = searched(unit, np.arange(5, 12_000, 240), forest)
    assert recall >= 0.9 and read < 0.45
    centres = rng.normal(size=(300, 64))
    close = ann._unit(centres[rng.integers(0, 300, 12_000)] + 0.2 * rng.normal(size=(12_000, 64)))
    forest = ann.Forest(close)
    forest.tune(close)
    recall, read = searched(close, np.arange(5, 12_000, 240), forest)
    assert recall >= 0.9 and read < 0.1


def test_the_queue_takes_leaves_in_the_order_of_their_costs():
    rng = np.random.default_rng(5)
    unit = ann._unit(rng.normal(size=(900, 16)))
    forest = ann.Forest(unit, trees=5)
    forest.share = 1.0
    for q in range(4):
        order, costs = forest.visit(unit[q : q + 1])[0], forest.costs(unit[q : q + 1])[0]
        assert sorted(order.tolist()) == list(range(forest.leaves * 5))
        assert (np.diff(costs[order]) > -1e-9).all()


@pytest.mark.parametrize("bin_rows", [1 << 16, 40])
def test_search_on_spark_against_brute_force(spark, monkeypatch, bin_rows):
    monkeypatch.setattr(ann, "BIN_ROWS", bin_rows)  # 40: a leaf's rows are dealt to several bins
    monkeypatch.setattr(ann, "LEAF", 64)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1000, 12)).astype(np.float32)
    x[500:520] = x[3]  # many equal vectors
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, leaves string")
    out = ann.nearest(df, share=1.0, every=100).collect()
    wide = x.astype(np.float64)
    for q in range(0, 1000, 100):
        score = wide @ wide[q] / np.sqrt((wide @ wide[q] * 0 + (wide**2).sum(1)) * (wide[q] @ wide[q]))
        score[q] = -9
        best = np.lexsort((np.arange(1000), -score.round(12)))[:5]
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        assert [g[1] for g in got] == best.tolist()
        assert np.allclose([g[2] for g in got], score[best], atol=1e-12)
