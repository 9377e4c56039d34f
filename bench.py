"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Every query is run to a
``noop`` sink, so all of its rows and columns are computed; short ones are warmed once. ``many_series`` multiplies the ticks into many
keys and reports rows per second, since single short series measure only the fixed cost of a Spark job.
"""

from __future__ import annotations

import json
import os
import sys
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "flagship_bars_features", "c6_ohlcv_bars", "c3_forward_backward_fill", "j1_asof_backward", "p11_scale_zscore", "q2_quarantine",
    "a3_exact_quantiles", "w2_rolling_full", "w7_macd", "i3_entropy", "i5_hurst", "i7_phase", "i8_kuramoto_order", "i15_mean_ricci",
    "g6_mean_reversion_score", "g8_pnl_pipeline", "x5_cost_breakdown", "x11_walk_book", "r6_tail_risk", "d1_text_sentiment", "d7_ks_statistic"]


def many_series(spark, copies: int):
    """Rows per second of bars and rolling features over ``copies`` times as many keys."""
    from pyspark.sql import functions as F

    from tickloom.operators.axis import Axis, trailing, windowed
    from tickloom.plans.tables import Tables

    t = Tables(spark, SF_DIR)
    big = t.ticks.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).withColumn("symbol", F.concat_ws(":", "venue", "copy"))
    axis = Axis(("symbol",), "ts", ("seq",))

    def build(d, w):
        s = trailing(w, 20)
        return d.withColumn("m", F.avg("price").over(s)).withColumn("v", F.stddev_samp("price").over(s))

    start = time.time()
    windowed(big, axis, build, back=19).write.format("noop").mode("overwrite").save()
    took = time.time() - start
    return took, t.ticks.count() * copies / took


def main() -> None:
    from tickloom import build_session
    from tickloom.plans.registry import all_queries

    spark = build_session("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    found, seconds = all_queries(), {}
    found[HEADLINE[0]](spark, SF_DIR).write.format("noop").mode("overwrite").save()  # start up workers and code caches
    for name in HEADLINE:
        for _ in range(2):
            start = time.time()
            found[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.time() - start, 3)
            print(name, seconds[name], file=sys.stderr, flush=True)
            if seconds[name] > 6:  # long enough that warming up no longer shows
                break
    took, rate = many_series(spark, 20)
    seconds["many_series_rolling"] = round(took, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(SF_DIR.rstrip("/")), "many_series_rows_per_sec": round(rate)}))


if __name__ == "__main__":
    main()
