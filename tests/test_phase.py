"""The blockwise transform against numpy on whole series, and the layout on its own."""

import tracemalloc

import numpy as np
import pytest

from tickloom.operators.axis import Axis
from tickloom.operators.phase import Layout, analytic_phase, hilbert_kernel, phase

BY = Axis(("k",), "i", (), grain=50.0, block_rows=300, numeric=True)


@pytest.mark.parametrize("n", [5, 6, 97, 256, 1000])
@pytest.mark.parametrize("block", [8, 64])
def test_layout_convolves(n, block):
    x = np.random.default_rng(n).normal(size=n)
    to = Layout(n, block)
    flat = np.zeros(to.size)
    flat[:n] = x
    sides = {"x": flat.reshape(to.rows, to.columns), "h": hilbert_kernel(np.arange(to.size), n, to.size).reshape(to.rows, to.columns)}
    down = {s: [to.down(m[:, c:c + to.wide], c) for c in range(0, to.columns, to.wide)] for s, m in sides.items()}
    across = [to.across([p[r] for p in down["x"]], [p[r] for p in down["h"]], r * to.tall) for r in range(to.rows // to.tall)]
    y = np.concatenate([to.up([p[c] for p in across]) for c in range(to.columns // to.wide)], axis=1).ravel()[:n]
    assert np.abs(np.arctan2(y, x) - analytic_phase(x)).max() < 1e-9


@pytest.mark.parametrize("detrend", [False, True])
def test_long_series_in_blocks(spark, detrend):
    rng, rows, want = np.random.default_rng(3), [], {}
    for k, n in (("a", 1), ("b", 2), ("c", 63), ("d", 900), ("e", 2001), (None, 700)):
        x = np.cumsum(rng.normal(size=n))
        missing = rng.random(n) < (0.05 if n > 2 else 0)
        rows += [(k, i, None if gone else float(v)) for i, (v, gone) in enumerate(zip(x, missing))]
        x = np.where(missing, x[~missing].mean() if detrend else 0.0, x)
        want[k] = analytic_phase(x, detrend)
    df = spark.createDataFrame(rows, "k string, i long, x double").repartition(5)
    for block in (128, 1 << 20):
        got = {k: np.empty(len(v)) for k, v in want.items()}
        for r in phase(df, BY, "x", detrend=detrend, block_points=block).collect():
            got[r.k][r.i] = r.phase
        for k, v in want.items():
            assert np.abs(np.exp(1j * got[k]) - np.exp(1j * v)).max() < 1e-9, (block, k)


def test_a_task_of_the_transform_is_small():
    from tickloom.operators.phase import BLOCK_POINTS
    to = Layout(3_000_000, BLOCK_POINTS)
    tracemalloc.start()
    try:
        x = np.zeros((to.rows, to.wide))
        h = hilbert_kernel(np.arange(to.rows)[:, None] * to.columns + np.arange(to.wide), to.n, to.size)
        pieces = [to.down(x, 0), to.down(h, 0)]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(pieces[0]) * to.tall == to.rows
    assert peak < 40e6  # four tasks share an executor's Python; 2^20 points took several times as much
