"""Ordered operators with tiny blocks (hot series cut into many) against pandas on the whole series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators.axis import Axis, ewm, row_numbers, running, windowed
from tickloom.operators.bars import interpolate
from tickloom.operators.joins import asof
from tickloom.operators.quantiles import quantiles

N = 400


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    rows = []
    for key, n in (("hot", N), ("cold", 7), ("one", 1)):
        t = np.sort(rng.integers(0, 4000, n))
        for i in range(n):
            rows.append((key, int(t[i]), i, float(rng.normal()) if rng.random() > 0.15 else None))
    return pd.DataFrame(rows, columns=["k", "t", "seq", "x"])


def axis(block_rows=20, grain=40.0):
    return Axis(("k",), "t", ("seq",), grain, block_rows, numeric=True)


def spark_frame(spark, frame):
    return spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "k string, t long, seq long, x double")


def merged(frame, sdf, cols):
    return frame.merge(sdf.toPandas()[["k", "seq", *cols]], on=["k", "seq"], suffixes=("", "_s"))


def close(a, b):
    np.testing.assert_allclose(np.asarray(a, float), np.asarray(b, float), rtol=1e-9, atol=1e-9)


def test_running_values_cross_blocks(spark, frame):
    d = running(spark_frame(spark, frame), axis(), {
        "s": ("sum", F.col("x")), "n": ("count", F.lit(1)), "hi": ("max", F.col("x")), "ff": ("last", F.col("x")), "bf": ("last", F.col("x"), True)})
    m = merged(frame, d, ["s", "n", "hi", "ff", "bf"])
    g = m.groupby("k")["x"]
    close(m["s"].fillna(0), g.transform(lambda v: v.fillna(0).cumsum()))
    close(m["n"], m.groupby("k").cumcount() + 1)
    close(m["hi"].fillna(-9), g.transform(lambda v: v.cummax().ffill()).fillna(-9))
    close(m["ff"].fillna(-9), g.transform(lambda v: v.ffill()).fillna(-9))
    close(m["bf"].fillna(-9), g.transform(lambda v: v.bfill()).fillna(-9))


@pytest.mark.parametrize("back,fwd", [(1, 1), (9, 3), (60, 45)])
def test_row_frames_see_over_several_blocks(spark, frame, back, fwd):
    def build(d, w):
        return d.withColumn("m", F.avg("x").over(w.rowsBetween(-back, 0))).withColumn("l", F.lead("x", fwd).over(w))
    m = merged(frame, windowed(spark_frame(spark, frame), axis(), build, back=back, fwd=fwd), ["m", "l"])
    assert len(m) == len(frame)
    close(m["m"].fillna(-9), m.groupby("k")["x"].transform(lambda v: v.rolling(back + 1, min_periods=1).mean()).fillna(-9))
    close(m["l"].fillna(-9), m.groupby("k")["x"].shift(-fwd).fillna(-9))


@pytest.mark.parametrize("alpha", [0.02, 0.2, 0.9])
def test_ewm_matches_pandas_with_gaps(spark, frame, alpha):
    m = merged(frame, ewm(spark_frame(spark, frame), axis(), {"e": ("x", alpha)}), ["e"])
    want = m.groupby("k")["x"].transform(lambda v: v.ewm(alpha=alpha, adjust=False).mean())
    close(m["e"].fillna(-9), want.fillna(-9))


@pytest.mark.parametrize("nulls", [0.1, 0.5, 0.9, 0.98])
@pytest.mark.parametrize("block_rows", [20, 500, 1_000_000])
def test_ewm_does_not_depend_on_blocks(spark, nulls, block_rows):
    """Long runs of NULLs, many NULLs, and a count that must reach over blocks."""
    rng = np.random.default_rng(int(nulls * 100))
    n = 1500
    x = np.where(rng.random(n) < nulls, np.nan, rng.normal(size=n))
    x[300:1000] = np.nan
    pdf = pd.DataFrame({"k": "hot", "t": np.arange(n), "seq": np.arange(n), "x": x})
    d = ewm(spark_frame(spark, pdf), axis(block_rows), {"e": ("x", 0.05), "f": ("x", 0.3)}, min_periods={"f": 12})
    m = merged(pdf, d, ["e", "f"])
    for name, alpha, least in (("e", 0.05, 1), ("f", 0.3, 12)):
        want = m["x"].ewm(alpha=alpha, adjust=False, min_periods=least).mean()
        assert (m[name].isna() == want.isna()).all()
        close(m[name].fillna(-9), want.fillna(-9))


def test_row_numbers_and_interpolation(spark, frame):
    d = interpolate(row_numbers(spark_frame(spark, frame), axis(), "p"), axis(), ["x"], at=F.col("p"))
    m = merged(frame, d, ["x", "p"])
    want = m.groupby("k")["x"].transform(lambda v: v.interpolate(limit_direction="both"))
    close(m["x_s"].fillna(-9), want.fillna(-9))


def test_asof_matches_merge_asof(spark, frame):
    left = frame[frame.seq % 3 == 0].drop(columns="x")
    right = frame[(frame.seq % 3 == 1) & frame.x.notna()].drop_duplicates(["k", "t"], keep="last")
    got = asof(spark.createDataFrame(left), spark.createDataFrame(right), keys=["k"], ts="t", values=["x"], right_seq=["seq"],
               grain=40.0, block_rows=20, numeric=True).toPandas().sort_values(["k", "t", "seq"])
    want = pd.merge_asof(left.sort_values("t"), right.sort_values("t")[["k", "t", "x"]], on="t", by="k").sort_values(["k", "t", "seq"])
    close(got["x"].fillna(-9), want["x"].fillna(-9))


def test_quantiles_by_bracket_are_exact(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": ["a"] * 6000 + ["b"] * 5, "v": np.r_[np.round(rng.normal(size=6000), 2), np.arange(5.0)]})
    got = quantiles(spark.createDataFrame(pdf), ["g"], "v", {"p1": 0.01, "p50": 0.5, "p93": 0.93}, small=100, accuracy=500).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        close(got.loc[g, ["p1", "p50", "p93"]], np.quantile(part["v"], [0.01, 0.5, 0.93]))


def test_no_window_runs_in_one_partition(spark, frame):
    plan = running(spark_frame(spark, frame), axis(), {"s": ("sum", F.col("x"))})._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
