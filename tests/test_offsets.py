import glob

from pyspark.sql import functions as F

from tickloom.session import scratch_dir
from tickloom.streaming import offsets as O


def test_steps_follow_their_size_and_gaps_cross_cells(spark, monkeypatch):
    monkeypatch.setattr(O, "CELL", 10, raising=False)
    kept = [o for o in range(100) if o not in (0, 9, 10, 11, 49, 55)]
    batches = [[o for o in kept if o < 50], [o for o in kept if o >= 40] + [77, 77], [3, 4]]
    base = scratch_dir(spark, "offsets")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        for i, some in enumerate(batches):
            d = spark.createDataFrame([("a", p, o, "x", None) for p in (0, 1) for o in some], "topic string, partition int, offset long, value string, headers map<string, string>")
            O.take(d, i, base, lambda m: m.withColumn("error", F.when(F.col("offset") % 7 == 0, "bad")), 3)
        files = len(glob.glob(f"{base}/rows/batch=0/**/*.parquet", recursive=True))
        got = {r["partition"]: r for r in O.reached(spark, base).collect()}
        gaps = sorted((r["expected"], r["observed"]) for r in spark.read.parquet(f"{base}/gaps").where("partition = 1").collect())
        rows = spark.read.parquet(f"{base}/rows").where("partition = 0").select("offset", "route").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert files <= 16  # a cached plan wrote one for each of 50 partitions and route
    assert gaps == [(0, 1), (9, 12), (49, 50), (55, 56)]
    assert sorted(r["offset"] for r in rows) == kept and all((r["route"] == "good") == (r["offset"] % 7 > 0) for r in rows)
    seen = sum(map(len, batches))
    assert (got[1]["expected"], got[1]["taken"], got[1]["replayed"], got[1]["gaps"], got[1]["missing"]) == (100, len(kept), seen - len(kept), 4, 6)
