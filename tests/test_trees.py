"""Trees grown from histograms of all folds against plain recursion on the same bins and weights."""

import random

import numpy as np
import pytest

from tickloom.operators.trees import Grow, _binned, grow, tree_predictions


def grown(y, w, bins, depth, spec):
    """Leaf value of every row by recursive splitting."""
    out = np.full(len(y), (w * y).sum() / w.sum() if w.sum() else 0.0)
    if depth == 0 or not w.sum():
        return out
    best = None
    for f in range(bins.shape[1]):
        for cut in range(spec.bins):
            left = bins[:, f] <= cut
            lw, rw = w[left].sum(), w[~left].sum()
            if min(lw, rw) < spec.least:
                continue
            gain = (w * y)[left].sum() ** 2 / lw + (w * y)[~left].sum() ** 2 / rw - (w * y).sum() ** 2 / w.sum()
            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                best = gain, f, cut
    if best is None:
        return out
    left = bins[:, best[1]] <= best[2]
    for side in (left, ~left):
        out[side] = grown(y[side], w[side], bins[side], depth - 1, spec)
    return out


@pytest.fixture(scope="module")
def splits(spark):
    rng, rows = random.Random(4), []
    for fold in (2, 5):
        for i in range(260):
            a, b = rng.gauss(0, 1), rng.choice([0.0, 1.0, 2.0])
            rows.append((fold, "train" if i < 200 else "test", a, b, float(round(8 * (a > 0.3) + 4 * b * (a < 0) + rng.gauss(0, 1), 3))))
    return spark.createDataFrame(rows, "fold long, role string, a double, b double, y double").repartition(4)


@pytest.mark.parametrize("spec", [Grow(trees=5, depth=3, bins=8), Grow(trees=4, depth=2, bins=8, boosted=True, rate=0.5, sample=0.8)])
def test_equals_recursion(splits, spec):
    rows = _binned(splits, ["a", "b"], "y", spec.bins)
    model = grow(rows, [2, 5], 2, spec)
    got = rows.collect()
    for at, fold in enumerate((2, 5)):
        mine = [r for r in got if r.fold == fold]
        train = np.array([r.role == "train" for r in mine])
        bins, y = np.array([r.bins for r in mine]), np.array([r.y for r in mine])
        hashes = np.array([r.row for r in mine], np.int64).view(np.uint64)
        left = y - y[train].mean() if spec.boosted else y
        total = np.zeros(len(y))
        for t in range(spec.trees):
            w = np.where(train, model.weights(hashes, t), 0.0)
            # rows outside the training part follow the cuts that the others made
            value = grown(left, w, bins, spec.depth, spec)
            total += value
            if spec.boosted:
                left = left - spec.rate * value
        want = y[train].mean() + spec.rate * total if spec.boosted else total / spec.trees
        assert np.abs(model.predict(np.full(len(y), at), bins) - want).max() < 1e-6


def test_predictions_learn(splits):
    for spec in (Grow(trees=30, depth=4), Grow(trees=25, depth=3, boosted=True, rate=0.2, sample=0.8)):
        rows = tree_predictions(splits, ["a", "b"], "y", spec).collect()
        y, p = np.array([r.y for r in rows]), np.array([r["__pred"] for r in rows])
        assert len(rows) == 120 and ((y - p) ** 2).mean() < 0.2 * y.var()
    assert tree_predictions(splits.where("role = 'test'"), ["a", "b"], "y", Grow(trees=2)).count() == 0


def test_weights_are_poisson(splits):
    from tickloom.operators.trees import Trees

    rows = np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64)
    w = Trees(1, Grow(trees=2, depth=1)).weights(rows, 1)
    assert abs(w.mean() - 1) < 0.03 and abs(w.var() - 1) < 0.06


@pytest.mark.parametrize("spec", [Grow(trees=6, depth=3, bins=8), Grow(trees=5, depth=2, bins=8, boosted=True, rate=0.5, sample=0.8)])
def test_combined_rows_grow_the_same_trees(splits, spec):
    """Sums over combinations of bins hold what all levels of all trees need of the rows."""
    from tickloom.operators.trees import Trees, _combined

    rows = _binned(splits, ["a", "b"], "y", spec.bins)
    fold_at = np.array([0, 0, 0, 0, 0, 1])
    cells = _combined(rows, Trees(2, spec), fold_at, 2).collect()
    assert len(cells) <= 2 * spec.trees * 64
    got = [r for r in rows.where("role = 'train'").collect()]
    w = sum(Trees(2, spec).weights(np.array([r.row for r in got], np.int64).view(np.uint64), t).sum() for t in range(spec.trees))
    assert sum(c.w for c in cells) == w
    a, b = grow(rows, [2, 5], 2, spec), grow(rows, [2, 5], 2, spec, combine=False)
    assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and np.abs(a.value - b.value).max() < 1e-9


def test_many_combinations_are_not_held(spark):
    from tickloom.operators.trees import Trees, _combined

    assert _combined(None, Trees(1, Grow(trees=2, bins=32)), np.zeros(1, np.int64), 5) is None
