"""Grown trees against brute force: splits of a level, gradients, leaf order, falling loss, models that come back from disk."""

import numpy as np
import pytest

from chronopanel.plans import trees as TR
from chronopanel.session import scratch_path


def frame(spark, x, y, w=None, parts=3):
    w = np.ones(len(y)) if w is None else w
    rows = [(a.tolist(), float(b), float(c)) for a, b, c in zip(x, y, w)]
    return spark.createDataFrame(rows, "x array<double>, y double, w double").repartition(parts)


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(0)
    x = np.column_stack([r.normal(size=160), r.normal(size=160), r.integers(0, 4, 160), np.ones(160)])
    y = (x[:, 0] > 0.4).astype(int) + ((x[:, 1] > 0) & (x[:, 2] > 1)).astype(int)
    return x, y, r.uniform(0.5, 2.0, 160)


def worth(y, w, classes):
    if not len(y):
        return 0.0
    if classes:
        sums = np.array([w[y == c].sum() for c in range(classes)])
        return (sums**2).sum() / sums.sum()
    return y.sum() ** 2 / len(y)


@pytest.mark.parametrize("classes,per_split", [(3, 2), (0, 4)])
def test_every_split_is_the_best_of_its_draws(spark, data, classes, per_split):
    x, y, w = data
    y = y if classes else x[:, 0] * 2 + y
    seed, least = 5, 4
    forest = TR.grow_extra(frame(spark, x, y, w), 4, classes, trees=6, depth=4, min_leaf=least, seed=seed, per_split=per_split)
    again = TR.grow_extra(frame(spark, x, y, w, 5), 4, classes, trees=6, depth=4, min_leaf=least, seed=seed, per_split=per_split)
    assert (forest.feature == again.feature).all() and np.allclose(forest.threshold, again.threshold)
    splits = 0
    for t in range(6):
        rows_at = {1: np.arange(len(x))}
        for node in range(1, 16):
            if node not in rows_at:
                continue
            rows, level = rows_at[node], node.bit_length() - 1
            features, place = TR.drawn(seed, t, level, 4, per_split)
            options = []
            for f, u in zip(features[node - (1 << level)], place[node - (1 << level)]):
                v = x[rows, f]
                if len(rows) < 2 * least or v.min() == v.max():
                    continue
                cut = v.min() + u * (v.max() - v.min())
                left, right = rows[v <= cut], rows[v > cut]
                if min(len(left), len(right)) >= least:
                    options.append((worth(y[left], w[left], classes) + worth(y[right], w[right], classes) - worth(y[rows], w[rows], classes), f, cut))
            best = max(options, default=(0.0, -1, 0.0))
            if forest.feature[t, node] < 0:
                assert best[0] <= 1e-9
                continue
            splits += 1
            assert (forest.feature[t, node], forest.threshold[t, node]) == (best[1], pytest.approx(best[2]))
            go = x[rows, best[1]] > best[2]
            rows_at[2 * node], rows_at[2 * node + 1] = rows[~go], rows[go]
            for child in (2 * node, 2 * node + 1):
                part = rows_at[child]
                mean = [w[part][y[part] == c].sum() / w[part].sum() for c in range(classes)] if classes else [y[part].mean()]
                assert forest.value[t, child] == pytest.approx(mean)
    assert splits > 20


def test_passes_over_some_trees_at_a_time_give_the_same_forest(spark, data, monkeypatch):
    x, y, w = data
    whole = TR.grow_extra(frame(spark, x, y, w), 4, 3, 5, 3, 3, 1, 2)
    monkeypatch.setattr(TR, "CANDIDATES", 5)
    parts = TR.grow_extra(frame(spark, x, y, w), 4, 3, 5, 3, 3, 1, 2)
    assert (whole.feature == parts.feature).all() and np.allclose(whole.threshold, parts.threshold) and np.allclose(whole.value, parts.value)


def test_best_splits_equal_brute_force():
    r = np.random.default_rng(3)
    spec = TR.Boosting(1, 0.1, 3, 8, min_leaf=3, l1=0.4, l2=1.5)
    n, bins, features = 60, 5, 3
    code, g, h, node = r.integers(0, bins, (n, features)), r.normal(size=n), r.uniform(0.1, 1, n), r.integers(0, 2, n)
    hist = np.zeros((2, features, bins, 3))
    for i in range(n):
        for f in range(features):
            hist[node[i], f, code[i, f]] += (g[i], h[i], 1)
    allowed = np.array([True, True, False])
    gain, feature, cut = TR.best_splits(hist, spec, allowed)
    value = lambda m: (np.sign(g[m].sum()) * max(abs(g[m].sum()) - 0.4, 0)) ** 2 / (h[m].sum() + 1.5)
    for k in range(2):
        options = []
        for f in (0, 1):
            for b in range(bins - 1):
                left, right = (node == k) & (code[:, f] <= b), (node == k) & (code[:, f] > b)
                if min(left.sum(), right.sum()) >= 3:
                    options.append((value(left) + value(right) - value(node == k), f, b))
        best = max(options)
        assert (gain[k], feature[k], cut[k]) == (pytest.approx(best[0]), best[1], best[2])


def test_leaf_with_the_greatest_gain_goes_first():
    gain = np.full(16, -np.inf)
    gain[1:8] = [5.0, 1.0, 4.0, 9.0, 0.5, 2.0, 3.0]  # node 4 is worth most but lies below node 2
    assert np.flatnonzero(TR.kept_splits(gain, 4)).tolist() == [1, 3, 7]
    assert np.flatnonzero(TR.kept_splits(gain, 6)).tolist() == [1, 2, 3, 6, 7]
    assert np.flatnonzero(TR.kept_splits(gain, 7)).tolist() == [1, 2, 3, 4, 6, 7]
    assert np.flatnonzero(TR.kept_splits(gain, 99)).tolist() == [1, 2, 3, 4, 5, 6, 7]
    assert not TR.kept_splits(np.full(4, -np.inf), 9).any()


@pytest.mark.parametrize("classes", [0, 2, 3])
def test_gradients_are_those_of_the_loss(classes):
    r = np.random.default_rng(classes)
    outputs = 1 if classes in (0, 2) else classes
    score, w = r.normal(size=(7, outputs)), r.uniform(0.5, 2, 7)
    y = r.normal(size=7) if classes == 0 else r.integers(0, classes, 7).astype(float)

    def loss(s):
        if classes == 0:
            return 0.5 * (s[:, 0] - y) ** 2
        if classes == 2:
            return w * (np.log1p(np.exp(s[:, 0])) - y * s[:, 0])
        return w * (np.log(np.exp(s).sum(1)) - s[np.arange(7), y.astype(int)])

    g, h = TR.gradients(score, y, w, classes)
    e = 1e-5
    for k in range(outputs):
        step = np.zeros_like(score)
        step[:, k] = e
        assert np.allclose(g[:, k], (loss(score + step) - loss(score - step)) / (2 * e), atol=1e-6)
        assert np.allclose(h[:, k], (loss(score + step) - 2 * loss(score) + loss(score - step)) / e**2, atol=1e-3)


@pytest.mark.parametrize("classes,link", [(3, "softmax"), (2, "logistic"), (0, "sum")])
def test_loss_falls_every_round(spark, data, monkeypatch, classes, link):
    """All classes in one model; rows written with their scores in between change nothing."""
    x, y, w = data
    y = np.minimum(y, 1) if classes == 2 else y if classes else x[:, 0] + y
    spec = TR.Boosting(7, 0.3, 3, 6, min_leaf=4, l1=0.1, l2=1.0, columns=0.8, seed=2)
    outputs = classes if classes == 3 else 1
    monkeypatch.setattr(TR, "KEEP_EVERY", 3)
    trees, base = TR.grow_boosted(frame(spark, x, y, w), 4, classes, spec)
    monkeypatch.setattr(TR, "KEEP_EVERY", 100)
    same, _ = TR.grow_boosted(frame(spark, x, y, w), 4, classes, spec)
    assert (trees.feature == same.feature).all() and np.allclose(trees.value, same.value)
    losses = []
    for rounds in range(8):
        model = TR.TreeModel(trees.some(slice(0, rounds * outputs)), link, base)
        p = model.scores(x)
        losses.append(((p[:, 0] - y) ** 2).mean() if classes == 0 else -(w * np.log(p[np.arange(len(y)), y])).sum())
    assert all(b < a for a, b in zip(losses, losses[1:]))
    assert max((trees.feature[t] >= 0).sum() + 1 for t in range(len(trees.feature))) <= 6
    model = TR.TreeModel(trees, link, base)
    path = scratch_path(spark, "trees")
    model.save(spark, path)
    back = TR.TreeModel.load(spark, path)
    assert np.array_equal(back.scores(x), model.scores(x))
    got = np.array([r.p for r in model.transform(frame(spark, x, np.arange(len(x)), parts=2), "x", "p").orderBy("y").collect()])
    assert np.allclose(got, model.scores(x))
