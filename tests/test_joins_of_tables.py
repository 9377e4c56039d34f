"""Joins whose sides both grow with the tables are not broadcast, and statistics of few keys are."""

from conftest import SF
from tickloom.plans.registry import all_queries
from tickloom.plans.tables import Tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_orders_are_not_broadcast(spark):
    t = Tables(spark, SF)
    for df in (t.parents, t.strategy_pnl):
        assert "SortMergeJoin" in plan(df) and "BroadcastHashJoin" not in plan(df)


def test_statistics_of_few_keys_are_broadcast(spark):
    """With many partitions most are empty for three venues; their rows must not meet in three tasks for it."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        df = all_queries()["a4_latency_distribution"](spark, SF)
        assert len(df.collect()) == 3
        final = plan(df).split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    # the one left is that of lineitem and orders, in each of its uses
    assert "BroadcastHashJoin" in final
    for line in final.splitlines():
        if "SortMergeJoin" in line:
            assert "l_orderkey" in line or "o_orderkey" in line, line
