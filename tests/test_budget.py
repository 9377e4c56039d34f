"""Budget alerts whose sums meet a level exactly."""

from pyspark.sql import functions as F

from tickloom.operators.axis import Axis
from tickloom.operators.risk import budget_alerts

BY = Axis(("k",), "ts", ("seq",))
DAY = 86400


def crossed(spark, rows, limit):
    d = spark.createDataFrame([("a", i, day, cost) for i, (day, cost) in enumerate(rows)], "k string, seq long, day long, cost double")
    out = budget_alerts(d.withColumn("ts", F.timestamp_seconds(F.col("day") * DAY)), BY, "cost", period=7.0 * DAY, limit=limit)
    return [list(r.crossed) for r in out.orderBy("seq").collect()]


def test_a_share_of_64_percent_does_not_rearm(spark):
    assert crossed(spark, [(0, 850.0), (8, 640.0), (9, 200.0)], 1000.0) == [[0.8], [], []]
    assert crossed(spark, [(0, 850.0), (8, 639.99), (9, 200.0)], 1000.0) == [[0.8], [], [0.8]]


def test_a_sum_equal_to_the_limit_reaches_it(spark):
    got = crossed(spark, [(1, 0.1)] + [(1 + i // 9, 0.1) for i in range(1, 10)], 1.0)  # 0.1 ten times adds up to 0.9999999999999999
    assert sorted(sum(got, [])) == [0.8, 1.0]
