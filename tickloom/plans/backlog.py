"""Events that arrive late, twice or not at all, in eight micro-batches, behind a watermark of several sources.

Delays, repetitions and a source that falls silent are derived from the events' own columns, so that SQL can tell the same arrivals.
"""

from pyspark.sql import functions as F

from tickloom.functions.exprs import micros
from tickloom.operators.axis import Axis, row_numbers
from tickloom.plans.aggregates import rnd
from tickloom.plans.registry import query
from tickloom.plans.streams import FILES, in_slots
from tickloom.plans.tables import SQL_TABLES
from tickloom.session import scratch_dir
from tickloom.streaming import backlog as B
from tickloom.streaming import book as K
from tickloom.streaming import core as S

LATENESS, EXPIRATION = 6 * 3600, 5 * 86400
SPEC = B.Backlog(ids=("event_id",), source="event_type", event="ts", arrival="arrival", lateness=LATENESS, expiration=EXPIRATION)
SQL_TABLES["arrived"] = """SELECT venue, seq, epoch_us(ts) AS event, epoch_us(ts) + CAST((CASE WHEN seq % 17 = 0 THEN volume * 7200 ELSE volume END + r * 129600) * 1000000 AS BIGINT) AS arrival
    FROM ticks, range(2) t(r) WHERE (r = 0 OR seq % 11 = 0) AND NOT (venue = 'signup' AND day(ts) BETWEEN 9 AND 21)"""
SQL_TABLES["slotted"] = f"""SELECT *, (arrival - min(arrival) OVER ()) * {FILES} // (max(arrival) OVER () - min(arrival) OVER () + 1) AS slot FROM arrived"""
SQL_TABLES["watermark"] = f"""SELECT slot, max(w) OVER (ORDER BY slot) AS wm FROM (
    SELECT slot, min(latest) - {LATENESS * 1_000_000} AS w FROM (SELECT *, max(latest) OVER (PARTITION BY slot) AS newest FROM (
        SELECT slot, venue, max(top) OVER (PARTITION BY venue ORDER BY slot) AS latest FROM (SELECT s.slot, v.venue, max(k.event) AS top FROM (SELECT DISTINCT slot FROM slotted) s CROSS JOIN (SELECT DISTINCT venue FROM slotted) v
            LEFT JOIN slotted k ON k.slot = s.slot AND k.venue = v.venue AND k.arrival - k.event <= {EXPIRATION * 1_000_000} GROUP BY 1, 2)))
    WHERE latest >= newest - {EXPIRATION * 1_000_000} GROUP BY slot)"""
SQL_TABLES["fates"] = f"""SELECT venue, seq, event, arrival, slot, in_time, in_time AND (k > 1 OR (first_slot < slot AND event >= first_wm - {EXPIRATION * 1_000_000} AND event >= before - {EXPIRATION * 1_000_000})) AS repeated,
    event < own - {EXPIRATION * 1_000_000} AS at_once_stale, (SELECT min(slot) FROM watermark w WHERE w.slot >= d.slot AND d.event <= w.wm) AS decided
    FROM (SELECT s.*, arrival - event <= {EXPIRATION * 1_000_000} AS in_time, row_number() OVER (PARTITION BY seq, s.slot, arrival - event <= {EXPIRATION * 1_000_000} ORDER BY arrival) AS k,
        min(s.slot) OVER (PARTITION BY seq, arrival - event <= {EXPIRATION * 1_000_000}) AS first_slot, w.wm AS own, b.wm AS before, first(w.wm) OVER (PARTITION BY seq ORDER BY s.slot, arrival) AS first_wm
        FROM slotted s JOIN watermark w USING (slot) LEFT JOIN watermark b ON b.slot = s.slot - 1) d"""


def arrivals(t):
    """The rows of ``arrived`` with their slot."""
    k, seq = F.get_json_object("props", "$.k").cast("double"), F.col("event_id")
    rows = t.raw("events").where((F.col("event_type") != "signup") | ~F.dayofmonth("ts").between(9, 21)).withColumn("r", F.explode(F.when(seq % 11 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    late = ((F.when(seq % 17 == 0, k * 7200).otherwise(k) + F.col("r") * 129600) * 1_000_000).cast("long")
    rows = rows.withColumn("arrival", F.timestamp_micros(micros("ts") + late))
    ends = rows.agg(F.min(micros("arrival")).alias("lo"), F.max(micros("arrival")).alias("hi"))
    slot = F.floor((micros("arrival") - F.col("lo")) * FILES / (F.col("hi") - F.col("lo") + 1))
    return rows.crossJoin(F.broadcast(ends)).withColumn("slot", slot.cast("int")).drop("r", "lo", "hi")


_runs: dict[str, str] = {}


def run(t) -> str:
    """The folder of the tables; the queries below read the same run."""
    path, files = in_slots(t, "arrivals", arrivals(t), "slot")
    if path not in _runs:
        base = scratch_dir(t.spark, "backlog")
        B.run(S.stream_table(t.spark, path, files_per_batch=files).drop("slot"), SPEC, base)
        _runs[path] = base
    return _runs[path]


@query("t2_source_watermark", "SELECT slot AS batch, wm AS watermark FROM watermark")
def t2b(t):
    return B.progress(t.spark, run(t)).select(F.col("batch").cast("long").alias("batch"), "watermark")


@query("t3_backlog_counts", f"""
SELECT venue, count(*) AS seen, count(*) FILTER (WHERE NOT in_time) AS expired, count(*) FILTER (WHERE repeated) AS repeated,
  count(*) FILTER (WHERE in_time AND NOT repeated AND event < wm - {EXPIRATION * 1_000_000}) AS stale, count(*) FILTER (WHERE in_time AND NOT repeated AND event >= wm - {EXPIRATION * 1_000_000}) AS released,
  count(*) FILTER (WHERE in_time AND NOT repeated AND decided IS NULL) AS held FROM fates LEFT JOIN watermark w ON w.slot = decided GROUP BY venue""")
def t3c(t):
    return B.summary(t.spark, run(t), SPEC).drop("invalid").withColumnRenamed("event_type", "venue")


@query("t5_backlog_release", f"SELECT seq, decided AS batch FROM fates JOIN watermark w ON w.slot = decided WHERE in_time AND NOT repeated AND event >= wm - {EXPIRATION * 1_000_000}")
def t5(t):
    return B.released(t.spark, run(t), SPEC).select(F.col("event_id").alias("seq"), F.col("batch").cast("long").alias("batch"))


@query("t6_lag_summary", """
WITH a AS (SELECT *, (arrival - event) / 1000000.0 AS lag, row_number() OVER (PARTITION BY venue ORDER BY arrival DESC, event DESC, seq DESC) AS k FROM fates WHERE in_time AND NOT repeated AND NOT at_once_stale)
SELECT venue, count(*) AS n, round(avg(lag) FILTER (WHERE k <= 512), 6) AS mean, round(max(lag), 6) AS worst, round(quantile_cont(lag, 0.95) FILTER (WHERE k <= 512), 6) AS p95 FROM a GROUP BY venue""")
def t6b(t):
    return rnd(B.lag_summary(t.spark, run(t), SPEC).withColumnRenamed("event_type", "venue"), "mean", "worst", "p95")


# Messages of one book for each symbol: a snapshot of two levels a side at every 40th, single-level diffs between, some lost, some sent again.
SQL_TABLES["messages"] = f"""SELECT symbol, CASE WHEN n % 40 = 7 THEN 'snapshot' ELSE 'diff' END AS kind, n, epoch_us(ts) AS us, price, volume, n % 97 = 60 AS lost, n % 13 = 0 AS twice
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS n FROM ticks)"""
IMAGES = {"interval": 2 * 86400.0, "diffs": 15}


def messages(t):
    """One row for each message of ``messages``: the lost ones missing, the repeated ones twice (the second a microsecond later)."""
    n, level = F.col("n"), F.floor(F.col("price") / 10) * 10
    levels = F.when(n % 40 == 7, F.array(*[F.struct(F.lit(side).alias("side"), (level + d).cast("double").alias("price"), (F.col("volume") + q).alias("quantity")) for side, d, q in
                                           (("bid", -10, 1), ("bid", -20, 2), ("ask", 10, 3), ("ask", 20, 4))])).otherwise(
        F.array(F.struct(F.when(n % 2 == 0, "bid").otherwise("ask").alias("side"), level.cast("double").alias("price"), F.when(F.col("volume") < 30, 0.0).otherwise(F.col("volume")).alias("quantity"))))
    rows = row_numbers(t.raw("events").select(F.col("user_id").cast("string").alias("symbol"), "ts", "event_id", F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("volume")),
                       Axis(("symbol",), "ts", ("event_id",)), "n").where(n % 97 != 60)
    copies = F.explode(F.when(n % 13 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.withColumn("copy", copies).select("symbol", "event_id", F.when(n % 40 == 7, "snapshot").otherwise("diff").alias("kind"), n.alias("sequence_start"), n.alias("sequence_end"),
                                                  F.timestamp_micros(micros("ts") + F.col("copy")).alias("ts"), levels.alias("levels"), F.least(F.floor(n / 10), F.lit(FILES - 1)).cast("int").alias("slot"))


_books: dict[str, object] = {}


def books(t):
    path, files = in_slots(t, "messages", messages(t), "slot")
    if path not in _books:
        _books[path] = S.drain(K.live_books(S.stream_table(t.spark, path, files_per_batch=files), ["symbol"], K.Images(**IMAGES)), "books")
    return _books[path]


APPLIED = """
sent AS (SELECT *, max(CASE WHEN kind = 'snapshot' THEN n END) OVER w AS base, max(CASE WHEN lost THEN n END) OVER w AS missing FROM messages WINDOW w AS (PARTITION BY symbol ORDER BY n)),
state AS (SELECT *, CASE WHEN base IS NULL THEN 'baseline' WHEN missing > base THEN 'gap' ELSE 'applied' END AS state FROM sent WHERE NOT lost)"""


@query("t14_book_events", f"""
WITH {APPLIED}
SELECT symbol, state AS kind, n AS sequence, CASE WHEN state = 'gap' THEN (SELECT min(m.n) FROM sent m WHERE m.lost AND m.symbol = s.symbol AND m.n > s.base) END AS expected, us + c AS event_us
FROM state s, range(2) r(c) WHERE state <> 'applied' AND (c = 0 OR twice)
UNION ALL SELECT symbol, 'stale', n, n + 1, us + 1 FROM state WHERE state = 'applied' AND twice AND kind = 'diff'""")
def t14b(t):
    return books(t).where("kind <> 'image'").select("symbol", "kind", "sequence", "expected", "event_us")


@query("t14_live_book", f"""
WITH RECURSIVE {APPLIED},
a AS (SELECT symbol, n, us, kind, row_number() OVER (PARTITION BY symbol ORDER BY n) AS k FROM state WHERE state = 'applied'),
f AS (SELECT symbol, k, us AS image, CAST(0 AS BIGINT) AS diffs, false AS due FROM a WHERE k = 1
  UNION ALL SELECT a.symbol, a.k, CASE WHEN a.kind = 'snapshot' OR a.us - f.image >= {int(IMAGES["interval"] * 1e6)} OR f.diffs + 1 >= {IMAGES["diffs"]} THEN a.us ELSE f.image END,
    CASE WHEN a.kind = 'snapshot' OR a.us - f.image >= {int(IMAGES["interval"] * 1e6)} OR f.diffs + 1 >= {IMAGES["diffs"]} THEN 0 ELSE f.diffs + 1 END,
    a.kind <> 'snapshot' AND (a.us - f.image >= {int(IMAGES["interval"] * 1e6)} OR f.diffs + 1 >= {IMAGES["diffs"]}) FROM f JOIN a ON a.symbol = f.symbol AND a.k = f.k + 1),
i AS (SELECT a.symbol, a.n, a.us, s.base FROM f JOIN a USING (symbol, k) JOIN state s ON s.symbol = a.symbol AND s.n = a.n WHERE f.due),
u AS (SELECT symbol, n, 0 AS o, CASE WHEN n % 2 = 0 THEN 'bid' ELSE 'ask' END AS side, floor(price / 10) * 10 AS price, CASE WHEN volume < 30 THEN 0 ELSE volume END AS quantity FROM state WHERE state = 'applied' AND kind = 'diff'
  UNION ALL SELECT symbol, n, 0, v.side, floor(price / 10) * 10 + v.d, volume + v.q FROM state, (VALUES ('bid', -10, 1), ('bid', -20, 2), ('ask', 10, 3), ('ask', 20, 4)) v(side, d, q) WHERE kind = 'snapshot'),
l AS (SELECT i.symbol, i.n, i.us, u.side, u.price, arg_max(u.quantity, u.n) AS quantity FROM i JOIN u ON u.symbol = i.symbol AND u.n BETWEEN i.base AND i.n GROUP BY ALL HAVING arg_max(u.quantity, u.n) > 0)
SELECT symbol, n AS sequence, us AS event_us, side, CAST(price AS DOUBLE) AS price, CAST(quantity AS DOUBLE) AS quantity,
  CAST(row_number() OVER (PARTITION BY symbol, n, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END) AS INTEGER) AS level FROM l
UNION ALL SELECT symbol, n, us, NULL, NULL, NULL, NULL FROM i WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.symbol = i.symbol AND l.n = i.n)""")
def t14c(t):
    return books(t).where("kind = 'image'").select("symbol", "sequence", "event_us", "side", "price", "quantity", "level")
