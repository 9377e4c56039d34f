"""A topic of four partitions with lost and replayed offsets, consumed in eight micro-batches; messages to publish; a callback for every batch."""

from pyspark.sql import functions as F

from tickloom.functions.exprs import micros
from tickloom.plans.registry import query
from tickloom.plans.streams import FILES, in_slots, ticks
from tickloom.plans.tables import SQL_TABLES
from tickloom.session import scratch_dir
from tickloom.sources.decode import decode_ticks
from tickloom.sources.kafka import envelope
from tickloom.streaming import core as S
from tickloom.streaming import offsets as O

SQL_TABLES["sent"] = "SELECT seq % 4 AS p, seq // 4 AS o, seq, price, seq % 20 = 3 AS bad, CASE WHEN seq % 3 > 0 THEN seq % 8 ELSE 0 END AS before FROM ticks WHERE seq // 4 % 50 <> 7"
ATTEMPTS = 3


def sent(t):
    """The messages; every 30th offset comes again a batch later."""
    seq = F.col("event_id")
    rows = t.raw("events").select("event_id", F.lit("ticks").alias("topic"), (seq % 4).cast("int").alias("partition"), F.floor(seq / 4).alias("offset"), F.col("user_id").cast("string").alias("key"),
                                  F.to_json(F.struct(F.col("user_id").cast("string").alias("symbol"), F.col("event_type").alias("venue"), (micros("ts") / 1e6).alias("timestamp"), F.when(seq % 20 != 3, F.col("value")).alias("price"))).alias("value"),
                                  F.when(seq % 3 == 1, F.create_map(F.lit("retry-attempt"), (seq % 8).cast("string"))).when(seq % 3 == 2, F.create_map(F.lit("x"), F.lit("y"), F.lit("retry-attempt"), (seq % 8).cast("string"))).alias("headers"))
    rows = rows.where(F.col("offset") % 50 != 7)
    end = rows.agg((F.max("offset") + 1).alias("end"))
    slot = F.floor(F.col("offset") * FILES / F.col("end"))
    rows = rows.crossJoin(F.broadcast(end)).withColumn("slot", F.explode(F.when(F.col("offset") % 30 == 3, F.array(slot, F.least(slot + 1, F.lit(FILES - 1)))).otherwise(F.array(slot))))
    return rows.drop("end").withColumn("slot", F.col("slot").cast("int"))


_runs: dict[str, str] = {}


def consumed(t) -> str:
    path, files = in_slots(t, "topic", sent(t), "slot")
    if path not in _runs:
        base = scratch_dir(t.spark, "topic")
        O.consume(S.stream_table(t.spark, path, files_per_batch=files).drop("slot"), base, decode_ticks, ATTEMPTS)
        _runs[path] = base
    return _runs[path]


@query("t11_offsets", """
WITH g AS (SELECT p, o, coalesce(lag(o) OVER (PARTITION BY p ORDER BY o) + 1, 0) AS e FROM sent)
SELECT 'ticks' AS topic, CAST(p AS INTEGER) AS "partition", max(o) + 1 AS expected, count(*) AS taken, count(*) FILTER (WHERE o % 30 = 3) AS replayed, count(*) FILTER (WHERE o > e) AS gaps, CAST(sum(o - e) AS BIGINT) AS missing FROM g GROUP BY p""")
def t11(t):
    return O.reached(t.spark, consumed(t))


@query("t11_backlog", """
SELECT 'ticks' AS topic, CAST(p AS INTEGER) AS "partition", max(o) + 1 AS expected, max(o) + 1 + p * 10 AS observed, p * 10 AS lag FROM sent GROUP BY p HAVING p * 10 >= 10
UNION ALL SELECT 'other', 0, 0, 5000, 5000""")
def t11b(t):
    ends = sent(t).groupBy("topic", "partition").agg((F.max("offset") + 1 + F.col("partition") * 10).alias("end_offset"))
    never = t.spark.createDataFrame([("other", 0, 5000)], "topic string, partition int, end_offset long")
    return O.backlog(t.spark, consumed(t), ends.unionByName(never), least=10)


@query("t13_retry_routes", f"""
SELECT seq, CASE WHEN NOT bad THEN 'good' WHEN before + 1 <= {ATTEMPTS} THEN 'retry' ELSE 'dead' END AS route,
  CASE WHEN bad AND before + 1 <= {ATTEMPTS} THEN CAST(before + 1 AS VARCHAR) WHEN seq % 3 > 0 THEN CAST(before AS VARCHAR) END AS attempt FROM sent""")
def t13b(t):
    rows = t.spark.read.parquet(f"{consumed(t)}/rows")
    return rows.select(F.col("event_id").alias("seq"), F.col("route").cast("string").alias("route"), F.try_element_at("headers", F.lit(O.ATTEMPT)).alias("attempt"))


@query("s17_envelopes", "SELECT symbol AS key, seq, venue AS event_type, CASE WHEN seq % 2 = 0 THEN CAST(seq AS VARCHAR) END AS trace, round(price, 6) AS price FROM ticks")
def s17(t):
    d = t.ticks.withColumn("trace", F.when(F.col("seq") % 2 == 0, F.col("seq")))
    e = envelope(d, headers=("venue", "trace"), payload=("symbol", "seq", "price"))
    head = lambda name: F.element_at(F.transform(F.filter("headers", lambda h: h["key"] == name), lambda h: F.decode(h["value"], "utf-8")), 1)
    body = F.from_json("value", "symbol string, seq long, price double")
    return e.select("key", body["seq"].alias("seq"), head("venue").alias("event_type"), F.when(F.size("headers") > 1, head("trace")).alias("trace"), F.round(body["price"], 6).alias("price"))


@query("s15_batch_callback", "SELECT venue, count(*) AS rows, CAST(sum(seq) AS BIGINT) AS total FROM ticks GROUP BY venue")
def s15(t):
    """Every micro-batch is handed to a callback, which keeps its own sums under the batch id."""
    base = scratch_dir(t.spark, "callback")

    def sums(batch, batch_id):
        batch.groupBy("venue").agg(F.count("*").alias("rows"), F.sum("seq").alias("total")).write.mode("overwrite").parquet(f"{base}/sums/batch={batch_id}")

    S.route(ticks(t).withColumn("error", F.lit(None).cast("string")), "error", f"{base}/good", f"{base}/dead", f"{base}/checkpoint", sums)
    return t.spark.read.parquet(f"{base}/sums").groupBy("venue").agg(F.sum("rows").alias("rows"), F.sum("total").alias("total"))
