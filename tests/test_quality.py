"""Scores that equal a threshold."""

import itertools
import math

from pyspark.sql import functions as F

from tickloom.operators.axis import Axis
from tickloom.operators.quality import quarantine


def test_score_equal_to_the_threshold_is_no_spike(spark):
    """Five whole numbers and a sixth exactly two deviations off: every such row is judged as Welford's update judges it."""
    series = []
    for values in itertools.product(range(1, 40, 4), repeat=5):
        total, squares = sum(values), sum(x * x for x in values)
        root = math.isqrt(4 * (5 * squares - total * total))
        if root and root * root == 4 * (5 * squares - total * total) and (total + root) % 5 == 0:
            series.append((*values, (total + root) // 5))
    rows = [(k, i, i, float(x)) for k, s in enumerate(series[:300]) for i, x in enumerate(s)]
    df = spark.createDataFrame(rows, "part int, day int, seq int, quantity double").withColumn("ts", F.timestamp_seconds(F.col("day") * 86400))
    got = {r.part for r in quarantine(df, Axis(("part",), "ts", ("seq",), grain=86400.0), "quantity", threshold=2.0, window=5).collect() if r.verdict == "spike" and r.day == 5}

    def spike(s):
        mean = squares = 0.0
        for n, x in enumerate(s[:5]):
            old, mean = mean, mean + (x - mean) / (n + 1)
            squares += (x - mean) * (x - old)
        return abs((s[5] - sum(s[:5]) / 5) / math.sqrt(squares / 5)) > 2

    assert len(series) > 100 and got == {k for k, s in enumerate(series[:300]) if spike(s)}
