"""Scores of a history without spread."""

from tickloom.operators.regime import _robust


def test_rounding_errors_are_no_deviation(spark):
    history = spark.createDataFrame([(x,) for x in (0.1, 0.09999999999999998, 0.10000000000000002, 0.09999999999999994, 0.09999999999999999)], "x double")
    now = spark.createDataFrame([(0.1,)], "current double")
    assert abs(_robust(now, history, "x", "z").first().z) < 1e-6
    wide = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double")
    assert _robust(spark.createDataFrame([(5.0,)], "current double"), wide, "x", "z").first().z == 3.0
