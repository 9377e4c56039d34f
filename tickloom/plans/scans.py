"""Scans, decoders and sinks. What a source reads is first written by Spark from the given tables."""

from pyspark.sql import functions as F

from tickloom.functions.exprs import micros
from tickloom.plans.registry import query
from tickloom.session import scratch_dir
from tickloom.sources import decode as D
from tickloom.sources import files as S


def us(c, name=None):
    return micros(c).alias(name or c)


def csv_dir(t, ts="ts", price="price", volume="volume"):
    path = scratch_dir(t.spark, "csv")
    bad = F.col("seq") % 50 == 7
    t.ticks.select(
        "seq", "symbol", "venue", F.format_string("%.6f", micros("ts") / 1e6).alias(ts),
        F.when(bad, F.lit("n/a")).otherwise(F.col("price").cast("string")).alias(price),
        F.when(F.col("seq") % 3 == 0, F.lit("")).otherwise(F.col("volume").cast("string")).alias(volume)
    ).write.option("header", True).csv(path)
    return path


CSV_SQL = """SELECT seq, symbol, venue, epoch_us(ts) AS ts, price, CASE WHEN seq % 3 = 0 THEN 0 ELSE volume END AS volume
FROM ticks WHERE seq % 50 <> 7"""


@query("s1_csv_ticks", CSV_SQL)
def csv_ticks(t):
    rows = S.scan_csv_ticks(t.spark, csv_dir(t), keep=["seq"])
    return S.good_rows(rows).select(F.col("seq").cast("long").alias("seq"), "symbol", "venue", us("ts"), "price", "volume")


@query("s1_csv_dead_rows", "SELECT count(*) AS rows, min(seq) AS first_seq FROM ticks WHERE seq % 50 = 7")
def csv_dead(t):
    dead = S.dead_rows(S.scan_csv_ticks(t.spark, csv_dir(t)))
    return dead.agg(F.count(F.lit(1)).alias("rows"), F.min(F.get_json_object("raw", "$.seq").cast("long")).alias("first_seq"))


@query("s2_csv_chunked", "SELECT symbol, count(*) AS rows, round(sum(price), 4) AS total FROM ticks WHERE seq % 50 <> 7 GROUP BY symbol")
def csv_chunked(t):
    rows = S.good_rows(S.scan_csv_ticks(t.spark, csv_dir(t)))
    out = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("price"), 4).alias("total"))
    return out


@query("s3_csv_field_names", CSV_SQL)
def csv_names(t):
    path = csv_dir(t, "when", "last", "qty")
    rows = S.good_rows(S.scan_csv_ticks(t.spark, path, ts="when", price="last", volume="qty", keep=["seq"]))
    return rows.select(F.col("seq").cast("long").alias("seq"), "symbol", "venue", us("ts"), "price", "volume")


@query("s4_parquet_ticks", "SELECT event_id, epoch_us(ts) AS ts, value FROM events")
def parquet(t):
    return S.scan(t.spark, f"{t.dir}/events.parquet", columns=["event_id", "ts", "value"]).withColumn(
        "ts", micros(F.col("ts").cast("timestamp")))


@query("s5_lazy_scan_row_index", "SELECT event_id, value, event_id AS row_nr FROM events")
def lazy(t):
    return S.scan(t.spark, f"{t.dir}/events.parquet", columns=["event_id", "value"], row_count="row_nr")


@query("s6_pushdown_scan", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_partkey < 1000")
def pushdown(t):
    return S.scan(t.spark, f"{t.dir}/lineitem.parquet", columns=["l_orderkey", "l_partkey", "l_quantity"],
                  predicates=[F.col("l_quantity") >= 45, F.col("l_partkey") < 1000])


@query("s7_partition_pruning", "SELECT venue, seq, price FROM ticks WHERE venue IN ('click', 'view')")
def pruning(t):
    path = scratch_dir(t.spark, "parts")
    S.write_table(t.ticks, path, partition_by=["venue"], sort_by=["symbol", "ts"])
    return S.scan(t.spark, path, partitions={"venue": ["click", "view"]}, columns=["venue", "seq", "price"])


@query("s8_dataset_summary", "SELECT count(*) AS rows, true AS sized FROM lineitem")
def summary(t):
    out = S.dataset_summary(t.spark, f"{t.dir}/lineitem.parquet")
    return out.agg(F.sum("rows").alias("rows"), F.min(F.col("bytes") > 0).alias("sized"))


@query("s9_frame_round_trip", "SELECT symbol, seq, price FROM ticks UNION ALL SELECT symbol, seq, price FROM ticks")
def round_trip(t):
    a, b = scratch_dir(t.spark, "p"), scratch_dir(t.spark, "j")
    d = t.ticks.select("symbol", "seq", "price")
    S.write_table(d, a)
    S.write_table(d, b, fmt="json")
    return S.read_table(t.spark, a).unionByName(S.read_table(t.spark, b, fmt="json", schema=d.schema))


BOOK_SQL = """SELECT symbol AS instrument, CASE WHEN seq % 10 = 0 THEN 'snapshot' ELSE 'diff' END AS kind, {start} AS sequence_start,
  seq + 5 AS sequence_end, epoch_us(ts) // 1000 AS ts_event, CAST(CAST(price AS DECIMAL(28,10)) AS DOUBLE) AS bid,
  CAST(CAST(price + 1 AS DECIMAL(28,10)) AS DOUBLE) AS ask, volume AS bid_qty FROM ticks"""


def book_rows(d):
    return d.select("instrument", "kind", "sequence_start", "sequence_end", F.unix_millis("ts_event").alias("ts_event"),
                    F.col("bids")[0]["price"].cast("double").alias("bid"), F.col("asks")[0]["price"].cast("double").alias("ask"),
                    F.col("bids")[0]["quantity"].cast("double").alias("bid_qty"))


@query("s10_book_json_update_id", BOOK_SQL.format(start="CASE WHEN seq % 10 = 0 THEN seq + 5 ELSE seq END"))
def book_a(t):
    pair = lambda p, q: F.array(F.array(p.cast("string"), q.cast("string")))
    bid, ask = pair(F.col("price"), F.col("volume")), pair(F.col("price") + 1, F.col("volume"))
    ms = F.unix_millis("ts")
    snap = F.to_json(F.struct((F.col("seq") + 5).alias("lastUpdateId"), ms.alias("E"), F.col("symbol").alias("s"), bid.alias("bids"), ask.alias("asks")))
    diff = F.to_json(F.struct(F.col("seq").alias("U"), (F.col("seq") + 5).alias("u"), ms.alias("E"), F.col("symbol").alias("s"), bid.alias("b"), ask.alias("a")))
    raw = t.ticks.select(F.when(F.col("seq") % 10 == 0, snap).otherwise(diff).alias("body"), F.lit(None).cast("string").alias("instrument"),
                         F.col("ts").alias("ts_arrival"))
    return book_rows(D.decode_update_id_books(raw))


@query("s10_book_json_seq_id", BOOK_SQL.format(start="CASE WHEN seq % 10 = 0 THEN seq + 5 ELSE seq END"))
def book_b(t):
    level = lambda p: F.array(F.array(p.cast("string"), F.col("volume").cast("string"), F.lit("0"), F.lit("1")))
    snap = F.col("seq") % 10 == 0
    item = F.struct((F.col("seq") + 5).alias("seqId"), (F.col("seq") - 1).alias("prevSeqId"), F.unix_millis("ts").cast("string").alias("ts"),
                    level(F.col("price")).alias("bids"), level(F.col("price") + 1).alias("asks"))
    body = F.to_json(F.struct(F.when(snap, "snapshot").otherwise("update").alias("action"),
                              F.struct(F.col("symbol").alias("instId")).alias("arg"), F.array(item).alias("data")))
    return book_rows(D.decode_seq_id_books(t.ticks.select(body.alias("body"), F.col("ts").alias("ts_arrival"))))


def messages(t):
    seq = F.col("seq")
    body = F.to_json(F.struct(
        F.when(seq % 4 != 1, F.col("symbol")).alias("symbol"), F.when(seq % 4 != 2, F.col("venue")).alias("venue"),
        (micros("ts") / 1e6).alias("timestamp"), F.when(seq % 20 != 3, F.col("price")).alias("price"),
        F.when(seq % 5 != 0, F.col("volume")).alias("volume")))
    headers = F.create_map(F.lit("venue"), F.when(seq % 40 == 2, F.lit(None)).otherwise(F.lit("header")), F.lit("trade_id"), seq.cast("string"))
    return t.ticks.select("seq", F.col("symbol").alias("key"), F.when(seq % 100 == 99, F.lit("")).otherwise(body).alias("value"), headers.alias("headers"))


MSG_SQL = """SELECT seq, symbol, CASE WHEN seq % 4 = 2 THEN 'header' ELSE venue END AS venue, price,
  CASE WHEN seq % 5 = 0 THEN 0 ELSE volume END AS volume, CAST(seq AS VARCHAR) AS trade_id, epoch_us(ts) // 1000 AS ts
FROM ticks WHERE NOT (seq % 100 = 99 OR seq % 40 = 2 OR seq % 20 = 3)"""


@query("s11_tick_json_decode", MSG_SQL)
def tick_json(t):
    good = D.decode_ticks(messages(t)).filter(F.col("error").isNull())
    return good.select("seq", "symbol", "venue", "price", "volume", "trade_id", F.floor(micros("ts") / 1000).alias("ts"))


@query("s11_tick_json_errors", """
SELECT CASE WHEN seq % 100 = 99 THEN 'empty' WHEN seq % 40 = 2 THEN 'symbol_or_venue' ELSE 'price' END AS error, count(*) AS rows
FROM ticks WHERE seq % 100 = 99 OR seq % 40 = 2 OR seq % 20 = 3 GROUP BY 1""")
def tick_errors(t):
    return D.decode_ticks(messages(t)).filter(F.col("error").isNotNull()).groupBy("error").agg(F.count(F.lit(1)).alias("rows"))


@query("s12_tick_events", """
SELECT seq, epoch_us(ts) AS timestamp, price AS bid_price, price AS ask_price, price AS last_price, CAST(volume AS BIGINT) AS volume,
  CASE WHEN seq % 30 = 0 THEN 'schema_mismatch' END AS reason FROM (SELECT * REPLACE (CASE WHEN seq % 30 = 0 THEN NULL ELSE price END AS price) FROM ticks)""")
def tick_events(t):
    holes = t.ticks.withColumn("price", F.when(F.col("seq") % 30 != 0, F.col("price")))
    return D.to_tick_event(holes).select("seq", "timestamp", "bid_price", "ask_price", "last_price", F.col("volume_units").alias("volume"), "reason")


@query("s13_event_price", """
SELECT seq, coalesce(nullif(CASE WHEN seq % 3 = 0 THEN 0 ELSE price END, 0), nullif(CASE WHEN seq % 2 = 0 THEN 0 ELSE price - 1 END, 0),
  nullif(price + 1, 0)) AS price FROM ticks""")
def event_price(t):
    p, s = F.col("price"), F.col("seq")
    last, bid = F.when(s % 3 == 0, 0.0).otherwise(p), F.when(s % 2 == 0, 0.0).otherwise(p - 1)
    return t.ticks.select("seq", D.event_price(last, bid, p + 1).alias("price"))


@query("s18_bulk_insert", "SELECT venue, symbol, price FROM ticks")
def bulk(t):
    path = scratch_dir(t.spark, "insert")
    S.insert_rows(t.ticks, ["venue", "symbol", "price"], path=path)
    return S.read_table(t.spark, path)


@query("s19_offline_table", "SELECT symbol, venue, epoch_us(ts) AS ts, seq, price, volume FROM ticks")
def offline(t):
    path = scratch_dir(t.spark, "offline")
    S.write_table(t.ticks, path, sort_by=["symbol", "ts"])
    return S.read_table(t.spark, path).select("symbol", "venue", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "seq", "price", "volume")


@query("s20_feature_view_sync", "SELECT symbol, seq, price FROM ticks")
def sync(t):
    path = scratch_dir(t.spark, "view")
    d = t.ticks.select("symbol", "seq", "price", "venue")
    S.sync_view(d.filter("venue = 'click'").drop("venue"), path, mode="overwrite")
    S.sync_view(d.filter("venue <> 'click'").drop("venue"), path)
    return S.read_table(t.spark, path)


@query("s21_result_outputs", "SELECT fmt, symbol, seq, price FROM ticks, (VALUES ('csv'), ('json'), ('parquet')) f(fmt)")
def outputs(t):
    d = t.ticks.select("symbol", "seq", "price")
    parts = []
    for fmt in ("csv", "json", "parquet"):
        path = scratch_dir(t.spark, fmt)
        S.write_table(d, path, fmt=fmt)
        parts.append(S.read_table(t.spark, path, fmt=fmt, schema=d.schema).withColumn("fmt", F.lit(fmt)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
