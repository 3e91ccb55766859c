"""Trees and forests against an exhaustive search, small and large nodes alike."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from tabloom.operators import trees
from tabloom.operators.trees import Growth, draws, fit_trees, node_features, row_hash


def brute(x, y, w, growth, tree=0):
    """Nodes ``{number: (feature, threshold side values, n)}`` by trying every split."""
    labels = trees.one_hot(y, growth)
    out = {}

    def grow(node, rows):
        yy, ww = labels[rows], w[rows]
        sums, n = (ww[:, None] * yy).sum(axis=0), ww.sum()
        out[node] = (None, n, tuple(sums))
        depth = node.bit_length() - 1
        if depth >= growth.max_depth or n < growth.min_split or len(np.unique(y[rows])) < 2:
            return
        best = None
        for f in node_features(tree, node, growth.features, growth.wanted):
            for v in np.unique(x[rows, f])[:-1]:
                low = x[rows, f] <= v
                n_low = ww[low].sum()
                if n_low < growth.min_leaf or n - n_low < growth.min_leaf:
                    continue
                a = (ww[low, None] * yy[low]).sum(axis=0)
                score = (a * a).sum() / n_low + ((sums - a) ** 2).sum() / (n - n_low)
                if best is None or score > best[0] * (1 + 1e-12):
                    best = (score, f, v)
        if best:
            _, f, v = best
            low = x[rows, f] <= v
            out[node] = ((int(f), float(x[rows[low], f].max()), float(x[rows[~low], f].min())), n, tuple(sums))
            grow(2 * node, rows[low])
            grow(2 * node + 1, rows[~low])

    grow(1, np.flatnonzero(w > 0))
    return out


def table(spark, x, y):
    rows = [(f"k{i}", Vectors.dense(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ["__id", "features", "label"]).repartition(5)


def check(model, expected, tree=0):
    t = model.trees
    mine = np.flatnonzero(t.tree == tree)
    assert {int(t.node[k]) for k in mine} == set(expected)
    for k in mine:
        split, n, sums = expected[int(t.node[k])]
        assert t.n[k] == n and np.allclose(t.sums[k], sums)
        if split is None:
            assert t.feature[k] == -1
        else:
            feature, low, high = split
            assert t.feature[k] == feature and low <= t.threshold[k] < high


@pytest.fixture(scope="module")
def noisy():
    """Continuous, few-valued, constant and widely spread features."""
    rng = np.random.default_rng(6)
    n = 700
    x = np.column_stack(
        [rng.normal(0, 1, n), rng.integers(0, 4, n), np.zeros(n), np.exp(rng.normal(0, 9, n)) * rng.choice([-1, 1], n), rng.random(n)]
    )
    cls = ((x[:, 0] > 0.3).astype(int) + (x[:, 3] > 2) + (rng.random(n) < 0.2)) % 3
    return x, cls.astype(float), np.round(3 * x[:, 4] + x[:, 1] + rng.normal(0, 0.2, n), 2)


@pytest.mark.parametrize("small_rows, bins", [(20_000, 256), (60, 8), (0, 256)])
@pytest.mark.parametrize("limits", [{"max_depth": 3}, {"max_depth": 6, "min_samples_split": 90, "min_samples_leaf": 20}])
def test_trees_equal_an_exhaustive_search(spark, noisy, monkeypatch, small_rows, bins, limits):
    """Whole trees in a task, both ways mixed, and every node by bins that are cut again."""
    monkeypatch.setattr(trees, "SMALL_ROWS", small_rows)
    monkeypatch.setattr(trees, "BINS", bins)
    if small_rows == 0:
        limits = {**limits, "max_depth": 2}
    x, cls, price = noisy
    for y, classes in ((cls, 3), (price, 0)):
        model = fit_trees(table(spark, x, y), "t", classes, **limits)
        growth = Growth(
            classes, 5, 1, 5, False, limits["max_depth"], limits.get("min_samples_split", 2), limits.get("min_samples_leaf", 1)
        )
        check(model, brute(x, y, np.ones(len(y)), growth))


@pytest.mark.parametrize("small_rows", [20_000, 150])
def test_forests_equal_an_exhaustive_search(spark, noisy, monkeypatch, small_rows):
    monkeypatch.setattr(trees, "SMALL_ROWS", small_rows)
    x, cls, _ = noisy
    data = table(spark, x, cls)
    model = fit_trees(data, "f", 3, n_trees=6, wanted="sqrt", drawn=True, max_depth=3)
    keys = {r[0]: r[1] for r in data.select("__id", row_hash("__id")).collect()}
    keys = np.array([keys[f"k{i}"] for i in range(len(x))])
    growth = Growth(3, 5, 6, 3, True, 3, 2, 1)
    for tree in range(6):
        check(model, brute(x, cls, draws(keys, tree), growth, tree), tree)
    assert abs(sum(model.importance()) - 1) < 1e-12
    again = fit_trees(data.repartition(2), "f", 3, n_trees=6, wanted="sqrt", drawn=True, max_depth=3)
    assert np.array_equal(again.trees.threshold, model.trees.threshold)


def test_draws_are_poisson():
    keys = np.random.default_rng(0).integers(0, 2**32, 50_000)
    seen = [draws(keys, t) for t in range(8)]
    for w in seen:
        assert abs(w.mean() - 1) < 0.03 and abs(w.var() - 1) < 0.05
    assert abs(np.corrcoef(seen)[np.triu_indices(8, 1)]).max() < 0.03
    picked = [tuple(node_features(t, 1, 64, 8)) for t in range(200)]
    assert len(set(picked)) > 150 and all(len(set(p)) == 8 for p in picked)
    counts = np.bincount(np.array(picked).ravel(), minlength=64)
    assert counts.min() > 5 and counts.max() < 60


def test_odd_tables(spark):
    one = fit_trees(table(spark, [[1.0, 2.0]], [1.0]), "t", 2, n_trees=5, drawn=True)
    assert one.predict(table(spark, [[0.0, 0.0]], [0.0])).first()["prediction"] == 1.0
    same = fit_trees(table(spark, [[1.0]] * 9, [0, 1, 1] * 3), "t", 2)
    assert len(same.trees.node) == 1 and same.importance() == [0.0]
    with pytest.raises(ValueError):
        fit_trees(table(spark, [[1.0]], [1.0]).limit(0), "t", 2)


def test_a_level_takes_two_passes_whatever_the_labels(spark, monkeypatch):
    """Labels that no feature tells apart: no bin can be ruled out, all are looked into once."""
    monkeypatch.setattr(trees, "SMALL_ROWS", 0)
    monkeypatch.setattr(trees, "BINS", 8)
    passes = []
    real = trees._cells
    monkeypatch.setattr(trees, "_cells", lambda *a: passes.append(1) or real(*a))
    rng = np.random.default_rng(4)
    x, y = rng.normal(0, 1, (600, 2)), rng.integers(0, 3, 600).astype(float)
    model = fit_trees(table(spark, x, y), "t", 3, max_depth=2)
    check(model, brute(x, y, np.ones(600), Growth(3, 2, 1, 2, False, 2, 2, 1)))
    assert len(passes) == 2


def test_draws_follow_their_formula():
    keys = np.random.default_rng(3).integers(0, 2**32, 50_000)
    for tree in (0, 7, 299):
        mix = (keys % trees.PRIME * trees.MIX_FACTOR + (tree + 1) * trees.TREE_FACTOR) % trees.PRIME
        for _ in range(2):
            mix = mix * mix % trees.PRIME * trees.MIX_FACTOR % trees.PRIME
        assert (draws(keys, tree) == np.searchsorted(trees.POISSON, mix / trees.PRIME, side="right")).all()


def test_few_bins_are_looked_into_where_labels_hardly_follow_features(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.random((20_000, 2))
    labels = np.where(rng.random(len(x)) < 0.7, rng.integers(0, 4, len(x)), 2 * (x[:, 0] > 0.4))
    rows = [(Vectors.dense(v.tolist()), float(y), str(k)) for k, (v, y) in enumerate(zip(x, labels))]
    df = spark.createDataFrame(rows, ["features", "label", "__id"])
    monkeypatch.setattr(trees, "SMALL_ROWS", 4_000)
    real, seen = trees._scanned, []
    monkeypatch.setattr(trees, "_scanned", lambda *a: seen.append(len(a[3])) or real(*a))
    fit_trees(df, "t", 4, max_depth=1)
    fit_trees(df, "t", 0, max_depth=1)
    # Two features have 512 bins.
    assert seen and max(seen) < 200


def test_equal_rows_grow_the_trees_of_single_ones(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(Vectors.dense(rng.integers(0, 6, 2).tolist()), float(rng.integers(0, 3)), str(k)) for k in range(6_000)]
    df = spark.createDataFrame(rows, ["features", "label", "__id"]).repartition(3)
    monkeypatch.setattr(trees, "SMALL_ROWS", 500)
    real, used = trees._equal_rows, []
    monkeypatch.setattr(trees, "_equal_rows", lambda *a: used.append(1) or real(*a))
    for classes in (0, 3):
        grown = []
        for each in (True, False):
            if not each:
                monkeypatch.setattr(trees, "_equal_rows", lambda r, g: r)
            held = fit_trees(df, "f", classes, n_trees=3, drawn=True, max_depth=4, min_samples_split=10).trees
            grown.append((held.tree.tolist(), held.node.tolist(), held.feature.tolist(), held.threshold.tolist(), held.n.tolist()))
            monkeypatch.setattr(trees, "_equal_rows", lambda *a: used.append(1) or real(*a))
        assert grown[0] == grown[1]
    assert len(used) == 2
