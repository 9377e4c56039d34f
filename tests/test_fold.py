"""The keyed state machine: many keys share the values of the state store, and each keeps its own state over micro-batches."""

from pyspark.sql import types as T

from tickloom.streaming import core as S


def test_many_keys_share_few_states(spark, tmp_path):
    """2,000 keys (and a NULL one) in three micro-batches: running counts and sums as by walking each key, in at most ``buckets`` stored states."""
    rows = [(None if k == 0 else f"k{k}", i, float((k * 7 + i) % 13)) for k in range(2000) for i in range(1 + k % 3)]
    for b in range(3):
        spark.createDataFrame([r for r in rows if r[1] == b], "k string, i long, x double").coalesce(1).write.parquet(f"{tmp_path}/in/b={b}")
    S.stamp_files(spark, f"{tmp_path}/in")

    def step(state, row):
        state = state[0] + 1, state[1] + row["x"]
        return state, [(row["i"], *state)]

    df = S.stream_table(spark, f"{tmp_path}/in", files_per_batch=1).drop("b")
    out = S.fold(df, ["k"], ["i"], lambda: (0, 0.0), step, {"i": T.LongType(), "n": T.LongType(), "total": T.DoubleType()}, ["i", "x"], buckets=16)
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    want, state = [], {}
    for k, i, x in sorted(rows, key=lambda r: r[1]):
        n, total = state.get(k, (0, 0.0))
        state[k] = n + 1, total + x
        want.append((k, i, *state[k]))
    got = [tuple(r) for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 16
