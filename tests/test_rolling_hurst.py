"""The rolling Hurst exponent against each row's own window, over blocks and small batches."""

import math
import random

import numpy as np

from tickloom.operators.axis import Axis
from tickloom.operators.entropy import rolling_hurst


def of_window(values, window, low):
    size = min(len(values), window)
    values, pts = np.array(values[-window:]), []
    for k in range(low, size // 2 + 1):
        moved = values[k:] - values[:-k]
        pts.append((math.log(k), math.log(moved.std()) if moved.max() > moved.min() else None))
    if size // 2 <= low or any(y is None for _, y in pts):
        return 0.5
    x, y = np.array(pts).T
    n = len(x)
    return min(max((n * (x * y).sum() - x.sum() * y.sum()) / (n * (x * x).sum() - x.sum() ** 2), 0.0), 1.0)


def test_windows_are_streamed(spark):
    """A series of many blocks, a flat one, short ones; no deviation is a window function of Spark."""
    rng, series = random.Random(4), {}
    for key, n in (("hot", 700), ("b", 45), ("c", 3), ("d", 1)):
        at = 0.0
        series[key] = [at := at + rng.choice([-1.0, 0.25, 1.5]) for _ in range(n)]
    series["flat"] = [0.1] * 60
    df = spark.createDataFrame([(k, i, v) for k, vs in series.items() for i, v in enumerate(vs)], "k string, i long, v double").repartition(5)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        for size in (80, 1_000_000):
            out = rolling_hurst(df, Axis(("k",), "i", (), grain=10.0, block_rows=size, numeric=True), "v", 20)
            assert "stddev" not in out._jdf.queryExecution().toString()
            got = {(r.k, r.i): r.hurst for r in out.collect()}
            assert len(got) == sum(map(len, series.values()))
            assert all(abs(h - of_window(series[k][:i + 1], 20, 2)) < 1e-9 for (k, i), h in got.items())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
