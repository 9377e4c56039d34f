"""Distinct values of a trailing time frame, against sets gathered by hand."""

import random

from tickloom.operators.axis import Axis
from tickloom.operators.risk import retraining
from tickloom.operators.windows import time_distinct


def test_stays_equal_gathered_sets(spark):
    """A dense series of many blocks, equal times, frames that end on a row's own time, NULL values, a NULL series."""
    rng = random.Random(3)
    rows = [(key, i, rng.randrange(0, n), rng.choice([None, *"abcdefg"])) for key, n in (("hot", 400), ("b", 2000), (None, 50)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i long, at long, v string").selectExpr("k", "i", "v", "timestamp_seconds(at) as ts")
    want = {(k, i): len({r[3] for r in rows if r[0] == k and at - 7 <= r[2] <= at} - {None}) for k, i, at, _ in rows}
    for size in (40, 1_000_000):
        axis = Axis(("k",), "ts", ("i",), grain=5.0, block_rows=size)
        got = time_distinct(df, axis, 7.0, "v", "n").collect()
        assert {(r.k, r.i): r.n for r in got if r.k is not None} == {k: n for k, n in want.items() if k[0] is not None} and len(got) == len(rows)


def test_retraining_makes_no_sets(spark):
    df = spark.createDataFrame([("a", i, f"f{i % 3}") for i in range(20)], "k string, i long, v string").selectExpr("k", "i", "v", "timestamp_seconds(i) as ts")
    out = retraining(df, Axis(("k",), "ts", ("i",)), "v", span=1.0)
    assert "collect_set" not in out._jdf.queryExecution().toString()
    assert {r.i: (r.events, r.features) for r in out.collect()} == {i: (min(i + 1, 2), min(i + 1, 2)) for i in range(20)}
