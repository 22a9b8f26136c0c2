"""Leaf-wise trees against a plain single-process version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from drywell.operators import boosting

NAMES = ["a", "b", "c", "d"]


def data_of(n=2000, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 4))
    x[:, 3] = rng.integers(0, 4, n)
    y = np.where(x[:, 0] > 0.3, 2.0, -1.0) * (x[:, 1] > -0.5) + 0.5 * x[:, 3] + rng.normal(0, 0.2, n)
    x[rng.random((n, 4)) < 0.1] = np.nan
    y += np.where(np.isnan(x[:, 2]), 1.5, 0.0)
    return x, y


def plain_forest(x, y, edges, trees, leaves, least, l2, rate):
    """Best-first growth where every leaf's histogram is counted from its rows, one cut after the other."""
    bins = np.stack([boosting.binned(x[:, j], e) for j, e in enumerate(edges)], axis=1).astype(int)
    pred, steps = np.full(len(y), y.mean()), []

    def best(rows, error):
        found = (0.0, 0, -1, False)
        g, n = error[rows].sum() / boosting.FIXED, len(rows)
        for j in range(bins.shape[1]):
            b = bins[rows, j]
            for missing_left in (False, True):
                if missing_left and not (b == 255).any():
                    continue
                for cut in range(255):
                    left = (b <= cut) & (b != 255) | (b == 255) & missing_left
                    m = left.sum()
                    if m < least or n - m < least:
                        continue
                    lg = error[rows[left]].sum() / boosting.FIXED
                    gain = lg**2 / (m + l2) + (g - lg) ** 2 / (n - m + l2) - g**2 / (n + l2)
                    if gain > found[0] + 1e-9:
                        found = (gain, j, cut, missing_left)
        return found

    for _ in range(trees):
        error = np.rint((pred - y) * boosting.FIXED)
        ends = {1: (np.arange(len(y)), best(np.arange(len(y)), error))}
        while len(ends) < leaves:
            i = max(ends, key=lambda k: (ends[k][1][0], -k))
            rows, (gain, j, cut, missing_left) = ends[i]
            if gain <= 0:
                break
            del ends[i]
            b = bins[rows, j]
            left = (b <= cut) & (b != 255) | (b == 255) & missing_left
            for k, own in ((2 * i, rows[left]), (2 * i + 1, rows[~left])):
                ends[k] = (own, best(own, error))
        for rows, _ in ends.values():
            pred[rows] -= rate * (error[rows].sum() / boosting.FIXED) / (len(rows) + l2)
        steps.append((pred.copy(), len(ends)))
    return steps


def table_of(spark, x, y, parts=5):
    none = lambda v: None if np.isnan(v) else float(v)
    return spark.createDataFrame([(*map(none, r), float(v), k) for k, (r, v) in enumerate(zip(x, y))], "a double, b double, c double, d double, spei double, k int").repartition(parts)


def test_equal_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(boosting, "REFRESH", 1)
    x, y = data_of()
    df = table_of(spark, x, y)
    edges = [np.unique(np.nanquantile(x[:, j], np.linspace(0.05, 0.95, 12))) for j in range(4)]
    forest = boosting.fit(df, NAMES, edges=edges, trees=2, leaves=9, least=25, l2=1.0, rate=0.5)
    want = plain_forest(x, y, edges, 2, 9, 25, 1.0, 0.5)
    assert [(t.feature < 0).sum() for t in forest.trees] == [n for _, n in want]
    got = {r["k"]: r["pred"] for r in forest.predict(df, ["k"]).collect()}
    assert np.allclose([got[k] for k in range(len(y))], want[-1][0], atol=1e-9)
    # The same rows dealt otherwise, and predictions not stored in between, give the same trees.
    monkeypatch.setattr(boosting, "REFRESH", 8)
    again = boosting.fit(table_of(spark, x, y, 2), NAMES, edges=edges, trees=2, leaves=9, least=25, l2=1.0, rate=0.5)
    for s, t in zip(forest.trees, again.trees):
        assert s.nodes == t.nodes and (s.feature == t.feature).all() and (s.cut == t.cut).all() and (s.value == t.value).all()


def test_bins_and_missing_values(spark):
    x, y = data_of(500)
    df = table_of(spark, x, y).withColumn("e", F.lit(None).cast("double"))
    edges = boosting.edges_of(df, [*NAMES, "e"], 16)
    assert all((np.diff(e) > 0).all() for e in edges) and len(edges[4]) == 0 and set(edges[3]) <= {0.0, 1.0, 2.0, 3.0}
    assert boosting.binned(np.array([np.nan, -9.0, edges[0][3], 9.0, np.inf]), edges[0]).tolist() == [255, 0, 3, len(edges[0]), 255]
    g, n = np.zeros(256), np.zeros(256)
    g[[0, 1, 255]], n[[0, 1, 255]] = np.array([-10, 10, -10]) * boosting.FIXED, 10
    assert boosting.best_cut(g, n, 1, 0.0)[1:] == (0, True)
    assert boosting.best_cut(g, n, 100, 0.0)[0] == 0.0


def test_forests_refuse_what_they_cannot_use(spark):
    df = table_of(spark, *data_of(50))
    with pytest.raises(ValueError):
        boosting.fit(df.withColumn("spei", F.lit(None).cast("double")), NAMES, trees=1)
    with pytest.raises(ValueError):
        boosting.fit(df, NAMES, tree=1)
    forest = boosting.fit(df, NAMES, trees=1, least=1000)
    assert len(forest.trees[0].nodes) == 1 and forest({n: np.zeros(2) for n in NAMES}) == pytest.approx([forest.first] * 2)
    with pytest.raises(ValueError):
        forest({"a": np.zeros(1)})
    with pytest.raises(ValueError):
        forest.predict(df.drop("a"))
