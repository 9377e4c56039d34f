"""Live books: many of them share few stored states and go on over micro-batches."""

from tickloom.streaming import core as S
from tickloom.streaming.book import Images, live_books

MESSAGE = "k string, kind string, sequence_start long, sequence_end long, at long, levels array<struct<side:string,price:double,quantity:double>>"
BIG = 1 << 60


def test_many_books_share_few_states(spark, tmp_path):
    snapshot = [("bid", 9.0, 1.0), ("bid", 8.0, 2.0), ("ask", 11.0, 3.0)]
    first = [(f"k{i}", "snapshot", BIG, BIG + 1, 0, snapshot) for i in range(600)] + [("late", "diff", 5, 5, 0, [("bid", 1.0, 1.0)])]
    then = [(f"k{i}", "diff", BIG + 2, BIG + 2, 1, [("bid", 9.0, 0.0), ("ask", 10.5, float(i + 1))]) for i in range(600)]
    then += [("k0", "diff", BIG + 2, BIG + 2, 2, []), ("k1", "diff", BIG + 9, BIG + 9, 2, [])]
    for b, rows in enumerate((first, then)):
        spark.createDataFrame(rows, MESSAGE).selectExpr("*", "timestamp_seconds(at) as ts").drop("at").coalesce(1).write.parquet(f"{tmp_path}/in/b={b}")
    S.stamp_files(spark, f"{tmp_path}/in")
    out = live_books(S.stream_table(spark, f"{tmp_path}/in", files_per_batch=1).drop("b"), ["k"], Images(interval=60.0, diffs=1))
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()}
    want = {("late", "baseline", 5, None, 0, None, None, None, None), ("k0", "stale", BIG + 2, BIG + 3, 2_000_000, None, None, None, None),
            ("k1", "gap", BIG + 9, BIG + 3, 2_000_000, None, None, None, None)}
    for i in range(600):
        want |= {(f"k{i}", "image", BIG + 2, None, 1_000_000, *level) for level in (("bid", 8.0, 2.0, 1), ("ask", 10.5, float(i + 1), 1), ("ask", 11.0, 3.0, 2))}
    assert got == want
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= S.KEY_BUCKETS
