"""Streaming forms: watermarked bars, deduplication, late data, keyed state, exactly-once sinks.

A stream runs to a Parquet table with its checkpoint beside it, both in the shared scratch folder.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Mapping, Sequence

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.exprs import micros
from tickloom.session import scratch_dir


def stream_table(spark: SparkSession, path: str, *, glob: str | None = None, files_per_batch: int = 64) -> DataFrame:
    """A folder of Parquet files as a stream; the schema is read from the files once."""
    schema = spark.read.parquet(f"{path}/{glob}" if glob else path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def drain(df: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Process all available input into a table and return the table."""
    spark, base = df.sparkSession, scratch_dir(df.sparkSession, label)
    q = df.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option(
        "checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def drain_each(streams: Mapping[str, DataFrame], label: str) -> tuple[DataFrame, dict[str, str]]:
    """Process several streams of one schema side by side, each as a query of its own, so that one that fails does not stop the others; their rows with their name as ``stream``, and the failures by name.

    What a failed stream had committed before it failed is kept.
    """
    spark = next(iter(streams.values())).sparkSession
    base, queries, failed = scratch_dir(spark, label), {}, {}
    for name, df in streams.items():
        queries[name] = df.writeStream.format("parquet").option("path", f"{base}/{name}/out").option("checkpointLocation", f"{base}/{name}/ckpt").trigger(availableNow=True).start()
    for name, q in queries.items():
        try:
            q.awaitTermination()
        except StreamingQueryException as e:
            failed[name] = str(e)
    rows = None
    for name, df in streams.items():
        if exists(spark, f"{base}/{name}/out"):
            part = spark.read.schema(df.schema).parquet(f"{base}/{name}/out").withColumn("stream", F.lit(name))
            rows = part if rows is None else rows.unionByName(part)
    return rows, failed


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table's folder is there, by its own file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def stamp_files(spark: SparkSession, path: str) -> int:
    """Give the files of a folder's partitions (``.../name=0``, ``name=1``, ...) modification times in the partitions' order, in which a file source takes them; returns
    how many files the largest partition has. Writers finish in any order."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(conf)
    folders = sorted((f.getPath() for f in fs.listStatus(top) if f.isDirectory()), key=lambda p: int(p.getName().split("=")[1]))
    begin, most, place = fs.getFileStatus(top).getModificationTime() - 3_600_000, 0, 0
    for folder in folders:
        files = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().endswith(".parquet")]
        for file in files:
            fs.setTimes(file, begin + place * 1000, -1)
            place += 1
        most = max(most, len(files))
    return most


def merge_streams(streams: Iterable[DataFrame]) -> DataFrame:
    """Union of tick streams. With several watermarks the smallest one counts (Spark's default policy)."""
    out = None
    for s in streams:
        out = s if out is None else out.unionByName(s)
    return out


def stream_bars(ticks: DataFrame, keys: Sequence[str], *, width: str = "1 minute", delay: str = "5 minutes", ts: str = "ts") -> DataFrame:
    """Tumbling bars; a bar is emitted once the watermark has passed its end."""
    rank = F.struct(ts, "seq") if "seq" in ticks.columns else F.col(ts)
    return ticks.withWatermark(ts, delay).groupBy(*keys, F.window(ts, width).alias("w")).agg(
        F.min_by("price", rank).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", rank).alias("close"),
        F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("trade_count")).select(*keys, F.col("w.start").alias("bucket"), "open", "high", "low", "close", "volume", "trade_count")


def sliding(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column], *, width: str, slide: str, delay: str, ts: str = "ts") -> DataFrame:
    return df.withWatermark(ts, delay).groupBy(*keys, F.window(ts, width, slide).alias("w")).agg(*[a.alias(n) for n, a in aggs.items()]).select(
        *keys, F.col("w.start").alias("bucket"), *aggs)


def dedupe(df: DataFrame, ids: Sequence[str], *, delay: str, ts: str = "ts") -> DataFrame:
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(ids))


def drop_late(df: DataFrame, *, expiration: float, event: str = "event_time", arrival: str = "arrival_time") -> DataFrame:
    """Rows that arrived within ``expiration`` seconds of their event time, the rest is dropped (and counted by ``late_counts``)."""
    return df.filter(micros(arrival) - micros(event) <= int(expiration * 1e6))


def late_counts(df: DataFrame, keys: Sequence[str], *, expiration: float, event: str = "event_time", arrival: str = "arrival_time") -> DataFrame:
    late = micros(arrival) - micros(event) > int(expiration * 1e6)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("seen"), F.count_if(late).alias("dropped"))


KEY_BUCKETS = 256  # values of the state store that the states of all keys are kept in


def fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: Callable[[], object], step: Callable[[object, dict], list],
         columns: Mapping[str, T.DataType], inputs: Sequence[str], buckets: int = KEY_BUCKETS) -> DataFrame:
    """Keyed state machine over a stream: ``step(state, row)`` returns (state, rows to emit).

    Rows of a key are put in order within each micro-batch; the state lives in the state store between batches. Keys share ``buckets`` groups by their hash, and a group keeps the states of its
    keys, so many keys of few rows each do not cost a call and a table each. The number of buckets may not change between runs of one checkpoint.
    """
    keys, order, inputs = list(keys), list(order), list(inputs)
    slim = df.select(*dict.fromkeys([*keys, *order, *inputs]), F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("__bucket"))
    out = T.StructType([slim.schema[k] for k in keys] + [T.StructField(n, t) for n, t in columns.items()])

    def run(bucket, batches, state):
        held = pickle.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        lists = {c: rows[c].astype(object).where(rows[c].notna(), None).tolist() for c in {*keys, *inputs}}
        emitted = []
        for key, values in zip(zip(*[lists[k] for k in keys]), zip(*[lists[c] for c in inputs])):
            held[key], more = step(held[key] if key in held else start(), dict(zip(inputs, values)))
            emitted += [(*key, *m) for m in more]
        state.update((pickle.dumps(held),))
        yield pd.DataFrame(emitted, columns=[*keys, *columns], dtype=object)  # whole numbers beside NULLs stay whole

    from pyspark.sql.streaming.state import GroupStateTimeout
    return slim.groupBy("__bucket").applyInPandasWithState(run, out, T.StructType([T.StructField("s", T.BinaryType())]), "append", GroupStateTimeout.NoTimeout)


def online_ema(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, alpha: float) -> DataFrame:
    def step(y, row):
        y = row[x] if y is None else (1 - alpha) * y + alpha * row[x]
        return y, [(row[order[-1]], float(y))]
    return fold(df, keys, order, lambda: None, step, {order[-1]: T.LongType(), "ema": T.DoubleType()}, [order[-1], x])


def online_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], signed: str, price: str) -> DataFrame:
    from tickloom.operators.execution import position_step

    def step(s, row):
        s = position_step(s, row[signed], row[price])
        return s, [(row[order[-1]], float(s[0]), float(s[1]), float(s[2]))]
    return fold(df, keys, order, lambda: (0.0, 0.0, 0.0), step, {order[-1]: T.LongType(), "position": T.DoubleType(), "entry_price": T.DoubleType(), "realized": T.DoubleType()},
                [order[-1], signed, price])


def online_amm(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, R: str, kappa: str) -> DataFrame:
    from tickloom.operators.amm import AMM_OUT, AmmParams, amm_start, amm_step

    p = AmmParams()

    def step(s, row):
        o = amm_step(s, row[x], row[R], row[kappa], None, p)
        return s, [(row[order[-1]], *[o[n] for n in AMM_OUT])]
    return fold(df, keys, order, lambda: amm_start(p), step, {order[-1]: T.LongType(), **AMM_OUT}, [order[-1], x, R, kappa])


def hot_buffer(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, size: int) -> DataFrame:
    """Flush the values of a key each time ``size`` of them have arrived."""
    def step(buf, row):
        buf = [*buf, row[value]]
        return ([], [(buf,)]) if len(buf) >= size else (buf, [])
    return fold(df, keys, order, list, step, {"values": T.ArrayType(T.DoubleType())}, [value])


def rolling_buffer(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, size: int) -> DataFrame:
    """Mean of the last ``size`` values of a key after every row."""
    def step(buf, row):
        buf = [*buf, row[value]][-size:]
        return buf, [(row[order[-1]], sum(buf) / len(buf))]
    return fold(df, keys, order, list, step, {order[-1]: T.LongType(), "mean": T.DoubleType()}, [order[-1], value])


def ordered_release(df: DataFrame, keys: Sequence[str], order: Sequence[str], payload: str, lateness_us: int) -> DataFrame:
    """Hold events of a source group until the newest event is ``lateness_us`` ahead, then release them in time order."""
    import heapq

    def step(held, row):
        heap, top = held
        heapq.heappush(heap, (row["__us"], row[payload]))
        top, out = max(top, row["__us"]), []
        while heap and heap[0][0] <= top - lateness_us:
            out.append(heapq.heappop(heap))
        return (heap, top), out
    d = df.withColumn("__us", micros(order[0]))
    return fold(d, keys, order, lambda: ([], 0), step, {"event_us": T.LongType(), payload: T.LongType()}, ["__us", payload])


def online_arbitrage(df: DataFrame, keys: Sequence[str], order: Sequence[str], rule) -> DataFrame:
    """Trades of ``operators.arbitrage`` on a stream of quotes and balances (``arbitrage.messages``): latest quote and balance per venue in state, the same rule at every quote."""
    from tickloom.operators import arbitrage as A

    def walk(state, row):
        trade = A.step(rule, state, row["venue"], row["__us"], tuple(row[c] for c in A.QUOTE), tuple(row[c] for c in A.BALANCE)) if row["venue"] is not None else None
        return state, [(row[order[-1]], *trade)] if trade else []

    columns = {order[-1]: T.LongType()} | {f.name: f.dataType for f in T._parse_datatype_string(A.FOUND).fields}
    return fold(df.withColumn("__us", micros(order[0])), keys, order, lambda: ({}, {}), walk, columns, [order[-1], "__us", "venue", *A.QUOTE, *A.BALANCE])


def book_ingest(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, every: int = 1000) -> DataFrame:
    """Apply diffs in sequence; emits ``gap`` rows (a snapshot is needed), ``stale`` rows and a ``snapshot`` row every ``every`` diffs."""
    def step(s, row):
        last, n = s
        if last is not None and row["sequence_start"] > last + 1:
            return (row["sequence_end"], 0), [(row["sequence_start"], "gap")]
        if last is not None and row["sequence_end"] < last + 1:
            return (last, n), [(row["sequence_start"], "stale")]
        n += 1
        return (row["sequence_end"], 0 if n >= every else n), [(row["sequence_end"], "snapshot")] if n >= every else []
    return fold(df, keys, order, lambda: (None, 0), step, {"sequence": T.LongType(), "kind": T.StringType()}, ["sequence_start", "sequence_end"])


def materialise_features(df: DataFrame, keys: Sequence[str], seq: Sequence[str], table: str, checkpoint: str) -> None:
    """Per micro-batch: keep the last row per key, drop keys already stored, write under the batch id.

    A replayed batch overwrites its own folder, so a restart never doubles rows.
    """
    from tickloom.operators.bars import keep_last

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = keep_last(batch, list(keys), list(seq))
        if exists(batch.sparkSession, table):
            stored = batch.sparkSession.read.parquet(table).filter(F.col("batch") != batch_id).select(*keys)
            fresh = fresh.join(stored, list(keys), "left_anti")
        fresh.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def route(df: DataFrame, error: str, good: str, dead: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None) -> None:
    """Split each micro-batch into good rows and dead letters, both under the batch id."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.filter(F.col(error).isNull()).drop(error).write.mode("overwrite").parquet(f"{good}/batch={batch_id}")
        batch.filter(F.col(error).isNotNull()).write.mode("overwrite").parquet(f"{dead}/batch={batch_id}")
        if on_batch:
            on_batch(batch, batch_id)

    df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
