"""Joins, set operations, ordering."""

from pyspark.sql import functions as F

from tickloom.functions.exprs import micros
from tickloom.operators import joins as J
from tickloom.operators.bars import keep_last
from tickloom.operators.quality import duplicate_counts, first_copies
from tickloom.plans.registry import query

DAY = 86400.0


def us(c, name=None):
    return micros(c).alias(name or c)


@query("j1_asof_backward", """
SELECT c.symbol, c.seq, v.price AS last_view, CAST(epoch_us(v.ts) AS DOUBLE) AS matched FROM (SELECT * FROM ticks WHERE venue = 'click') c
ASOF LEFT JOIN (SELECT * FROM ticks WHERE venue = 'view') v ON c.symbol = v.symbol AND c.ts >= v.ts""")
def asof(t):
    c, v = (t.ticks.filter(F.col("venue") == n) for n in ("click", "view"))
    out = J.asof(c.select("symbol", "ts", "seq"), v.select("symbol", "ts", "seq", F.col("price").alias("last_view")),
                 keys=["symbol"], values=["last_view"], right_seq=["seq"])
    return out.select("symbol", "seq", "last_view", micros("matched_ts").cast("double").alias("matched"))


@query("j1_asof_forward_tolerance", """
SELECT c.symbol, c.seq, CASE WHEN epoch_us(v.ts) - epoch_us(c.ts) <= 86400000000 THEN v.price END AS next_view FROM (SELECT * FROM ticks WHERE venue = 'click') c
ASOF LEFT JOIN (SELECT * FROM ticks WHERE venue = 'view') v ON c.symbol = v.symbol AND c.ts <= v.ts""")
def asof_forward(t):
    c, v = (t.ticks.filter(F.col("venue") == n) for n in ("click", "view"))
    out = J.asof(c.select("symbol", "ts", "seq"), v.select("symbol", "ts", "seq", F.col("price").alias("next_view")),
                 keys=["symbol"], values=["next_view"], right_seq=["seq"], direction="forward", tolerance=DAY)
    return out.select("symbol", "seq", "next_view")


@query("j2_book_snapshot_at", """
SELECT o.order_id, s.price AS book_price, s.quantity AS book_quantity FROM (SELECT order_id, arg_min(part, (line, part, broker)) AS part, min(ts) AS ts FROM fills WHERE status = 'F' GROUP BY 1) o
ASOF LEFT JOIN (SELECT part, ts, max(price) AS price, sum(quantity) AS quantity FROM fills WHERE status = 'O' GROUP BY 1, 2) s ON o.part = s.part AND o.ts >= s.ts""")
def book_at(t):
    o = t.fills.filter("status = 'F'").groupBy("order_id").agg(F.min_by("part", F.struct("line", "part", "broker")).alias("part"), F.min("ts").alias("ts"))
    s = t.fills.filter("status = 'O'").groupBy("part", "ts").agg(F.max("price").alias("book_price"), F.sum("quantity").alias("book_quantity"))
    return J.asof(o, s, keys=["part"], values=["book_price", "book_quantity"], grain=DAY).select("order_id", "book_price", "book_quantity")


@query("j3_inner_join_suffixes", """
SELECT a.symbol, a.n AS n_click, b.n AS n_view FROM (SELECT symbol, count(*) AS n FROM ticks WHERE venue = 'click' GROUP BY 1) a
JOIN (SELECT symbol, count(*) AS n FROM ticks WHERE venue = 'view' GROUP BY 1) b USING (symbol)""")
def inner(t):
    a, b = (t.ticks.filter(F.col("venue") == v).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")) for v in ("click", "view"))
    return J.suffix_join(a, b, ["symbol"], ("_click", "_view"))


@query("j4_join_on_time", """
SELECT symbol, epoch_us(ts) AS ts, hi, vol FROM (SELECT symbol, time_bucket(INTERVAL '1 day', ts) AS ts, max(price) AS hi FROM ticks GROUP BY 1, 2)
JOIN (SELECT symbol, time_bucket(INTERVAL '1 day', ts) AS ts, sum(volume) AS vol FROM ticks WHERE venue <> 'view' GROUP BY 1, 2) USING (symbol, ts)""")
def on_time(t):
    day = F.window("ts", "1 day").start.alias("ts")
    a = t.ticks.groupBy("symbol", day).agg(F.max("price").alias("hi"))
    b = t.ticks.filter("venue <> 'view'").groupBy("symbol", day).agg(F.sum("volume").alias("vol"))
    return a.join(b, ["symbol", "ts"]).select("symbol", us("ts"), "hi", "vol")


@query("j5_outer_concat", """
SELECT epoch_us(h) AS ts, max(price) FILTER (WHERE venue = 'click') AS click_p, max(price) FILTER (WHERE venue = 'view') AS view_p,
  sum(volume) FILTER (WHERE venue = 'error') AS error_v, max(price) FILTER (WHERE venue NOT IN ('click', 'view', 'error')) AS other_p
FROM (SELECT *, time_bucket(INTERVAL '1 hour', ts) AS h FROM ticks) GROUP BY h""")
def concat(t):
    hour = F.window("ts", "1 hour").start.alias("ts")
    part = lambda v, e: t.ticks.filter(v if isinstance(v, F.Column) else F.col("venue") == v).groupBy(hour).agg(e)
    rest = ~F.col("venue").isin("click", "view", "error")
    out = J.concat_columns({"click": part("click", F.max("price").alias("p")), "view": part("view", F.max("price").alias("p")),
                            "error": part("error", F.sum("volume").alias("v")), "other": part(rest, F.max("price").alias("p"))}, ["ts"])
    return out.select(us("ts"), "click_p", "view_p", "error_v", "other_p")


@query("j6_index_intersection", """
SELECT epoch_us(h) AS ts FROM (SELECT DISTINCT venue, time_bucket(INTERVAL '1 hour', ts) AS h FROM ticks) GROUP BY h HAVING count(*) = 5""")
def intersection(t):
    names = ["click", "view", "error", "purchase", "signup"]
    hour = F.window("ts", "1 hour").start.alias("ts")
    return J.common_index([t.ticks.filter(F.col("venue") == n).select(hour) for n in names], ["ts"]).select(us("ts"))


@query("j7_anti_join", "SELECT o_orderkey FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey")
def anti(t):
    return J.keep_new(t.raw("orders").withColumnRenamed("o_orderkey", "order_id"), t.fills, ["order_id"]).select(F.col("order_id").alias("o_orderkey"))


@query("j8_semi_join", "SELECT o_orderkey FROM orders SEMI JOIN (SELECT * FROM lineitem WHERE l_quantity > 48) ON o_orderkey = l_orderkey")
def semi(t):
    return J.keep_known(t.raw("orders").withColumnRenamed("o_orderkey", "order_id"), t.fills.filter("quantity > 48"), ["order_id"]).select(
        F.col("order_id").alias("o_orderkey"))


@query("j9_bucket_join", """
WITH f AS (SELECT part, epoch_us(ts) // 604800000000 * 604800 AS bucket, sum(quantity) AS qty, round(sum(quantity * price), 2) AS notional FROM fills WHERE status = 'F' GROUP BY 1, 2),
m AS (SELECT part, epoch_us(ts) // 604800000000 * 604800 AS bucket, sum(quantity) AS market FROM fills GROUP BY 1, 2),
b AS (SELECT part, epoch_us(ts) // 604800000000 * 604800 AS bucket, round(avg(price), 6) AS bench FROM fills WHERE status = 'O' GROUP BY 1, 2)
SELECT part, bucket, qty, notional, market, bench FROM f LEFT JOIN m USING (part, bucket) LEFT JOIN b USING (part, bucket)""")
def buckets(t):
    f = t.fills
    return J.bucket_join({
        "fills": (f.filter("status = 'F'"), {"qty": F.sum("quantity"), "notional": F.round(F.sum(F.col("quantity") * F.col("price")), 2)}),
        "market": (f, {"market": F.sum("quantity")}),
        "bench": (f.filter("status = 'O'"), {"bench": F.round(F.avg("price"), 6)})}, ["part"], "ts", 604800.0, "fills")


CAT = """cat AS (SELECT c_custkey AS asset_id, 'N' || CAST(c_nationkey AS VARCHAR) || CASE WHEN c_custkey % 50 > 1 THEN '_' || CAST(c_custkey % 400 AS VARCHAR) ELSE '' END AS symbol,
  c_mktsegment AS venue, c_custkey % 7 <> 0 AS active FROM customer),
req AS (SELECT o_orderkey, symbol, CASE WHEN o_orderkey % 3 = 0 THEN 'ELSEWHERE' ELSE venue END AS venue FROM orders JOIN cat ON o_custkey = asset_id),
h AS (SELECT q.symbol, q.venue, c.asset_id, CASE WHEN NOT active THEN 3 WHEN c.venue = q.venue THEN 1 ELSE 2 END AS tier
  FROM (SELECT DISTINCT symbol, venue FROM req) q JOIN cat c USING (symbol)),
b AS (SELECT symbol, venue, tier, min(asset_id) AS a, count(DISTINCT asset_id) AS n, row_number() OVER (PARTITION BY symbol, venue ORDER BY tier) AS k FROM h GROUP BY 1, 2, 3)"""


@query("j10_symbol_resolution", f"""WITH {CAT} SELECT o_orderkey, CAST(CASE WHEN n = 1 THEN a ELSE -1 END AS BIGINT) AS asset_id, tier, n > 1 AS ambiguous
FROM req JOIN b USING (symbol, venue) WHERE k = 1""")
def resolve(t):
    k = F.col("c_custkey")
    cat = t.raw("customer").select(k.alias("asset_id"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string"), F.when(
        k % 50 > 1, F.concat(F.lit("_"), (k % 400).cast("string"))).otherwise("")).alias("symbol"), F.col("c_mktsegment").alias("venue"), (k % 7 != 0).alias("active"))
    req = t.raw("orders").join(cat, F.col("o_custkey") == F.col("asset_id")).select(
        "o_orderkey", "symbol", F.when(F.col("o_orderkey") % 3 == 0, "ELSEWHERE").otherwise(F.col("venue")).alias("venue"))
    return J.resolve_symbols(req, cat).select("o_orderkey", F.coalesce("asset_id", F.lit(-1)).cast("long").alias("asset_id"), "tier", "ambiguous")


@query("j11_pairwise_compare", """
WITH m AS (SELECT symbol, venue, round(avg(price), 6) AS v FROM ticks GROUP BY 1, 2)
SELECT x.symbol, x.venue AS a, y.venue AS b, round(y.v - x.v, 6) AS diff FROM m x JOIN m y ON x.symbol = y.symbol
  AND CASE x.venue WHEN 'view' THEN '' ELSE x.venue END < CASE y.venue WHEN 'view' THEN '' ELSE y.venue END""")
def pairs(t):
    m = t.ticks.groupBy("symbol", "venue").agg(F.round(F.avg("price"), 6).alias("v"))
    return J.compare_pairs(m, on=["symbol"], side="venue", value="v", baseline="view").select("symbol", "a", "b", F.round("diff", 6).alias("diff"))


@query("j12_interval_join", """
WITH s AS (SELECT CAST(o_orderkey AS BIGINT) AS sid, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (o_orderkey % 43000) AS a, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (o_orderkey % 43000 + 30 + o_orderkey % 90) AS b
  FROM orders)
SELECT seq, sid FROM ticks JOIN s ON ts >= a AND ts < b""")
def interval(t):
    k = F.col("o_orderkey")
    at = lambda m: F.timestamp_seconds(F.lit(1704067200) + m * 60)
    s = t.raw("orders").select(k.alias("sid"), at(k % 43000).alias("a"), at(k % 43000 + 30 + k % 90).alias("b"))
    return J.in_intervals(t.ticks, s, ts="ts", start="a", end="b", cell=3600.0).select("seq", "sid")


@query("j13_parameter_cross", """
SELECT symbol, thr, count(*) FILTER (WHERE price > thr) AS hits FROM ticks, (VALUES (10.0), (50.0), (100.0)) p(thr) GROUP BY 1, 2""")
def cross(t):
    p = t.spark.createDataFrame([(10.0,), (50.0,), (100.0,)], "thr double")
    return J.cross_params(t.ticks, p).groupBy("symbol", "thr").agg(F.count_if(F.col("price") > F.col("thr")).alias("hits"))


@query("j14_order_fills", """
SELECT o_orderkey, o_orderpriority, count(*) AS fills, round(sum(quantity), 2) AS qty FROM orders JOIN fills ON o_orderkey = order_id GROUP BY 1, 2""")
def parent_child(t):
    return t.raw("orders").join(t.fills, F.col("o_orderkey") == F.col("order_id")).groupBy("o_orderkey", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("fills"), F.round(F.sum("quantity"), 2).alias("qty"))


@query("o1_stable_sort", "SELECT symbol, seq FROM ticks ORDER BY symbol, ts, seq")
def sort(t):
    return t.ticks.orderBy("symbol", "ts", "seq").select("symbol", "seq")


@query("o2_order_limit", "SELECT seq, price FROM ticks ORDER BY price DESC, seq LIMIT 100")
def limit(t):
    return t.ticks.orderBy(F.col("price").desc(), "seq").limit(100).select("seq", "price")


@query("o3_keyset_page", "SELECT seq, epoch_us(ts) AS ts FROM ticks WHERE ts < TIMESTAMP '2024-01-15' ORDER BY ts DESC, seq DESC LIMIT 50")
def page(t):
    from tickloom.operators.parity import lookup_page
    return lookup_page(t.ticks, "ts", cursor="2024-01-15", limit=50, tie=["seq"]).select("seq", us("ts"))


@query("u1_union_all", "SELECT symbol, price FROM ticks WHERE venue = 'click' UNION ALL SELECT symbol, price FROM ticks WHERE price > 20")
def union(t):
    return t.ticks.filter("venue = 'click'").select("symbol", "price").unionByName(t.ticks.filter("price > 20").select("symbol", "price"))


@query("u2_keep_first", "SELECT part, epoch_us(ts) AS ts, first(order_id ORDER BY order_id, line, broker) AS order_id FROM fills GROUP BY part, ts")
def first(t):
    return first_copies(t.fills.select("part", "ts", "order_id", "line", "broker"), ["part", "ts"], ["order_id", "line", "broker"]).select(
        "part", us("ts"), "order_id")


@query("u2_keep_last", "SELECT part, epoch_us(ts) AS ts, last(order_id ORDER BY order_id, line, broker) AS order_id FROM fills GROUP BY part, ts")
def last(t):
    return keep_last(t.fills.select("part", "ts", "order_id", "line", "broker"), ["part", "ts"], ["order_id", "line", "broker"]).select(
        "part", us("ts"), "order_id")


@query("u2_keep_none", "SELECT part, epoch_us(ts) AS ts, any_value(order_id) AS order_id FROM fills GROUP BY part, ts HAVING count(*) = 1")
def none(t):
    d = t.fills.select("part", "ts", "order_id")
    return d.join(duplicate_counts(d, ["part", "ts"]), ["part", "ts"], "left_anti").select("part", us("ts"), "order_id")


@query("u3_key_difference", "SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 49 EXCEPT SELECT p_partkey FROM part WHERE p_size > 25")
def difference(t):
    return t.raw("lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("k")).subtract(
        t.raw("part").filter("p_size > 25").select(F.col("p_partkey").alias("k")))


@query("u4_edge_set_change", """
WITH e AS (SELECT DISTINCT date_trunc('day', ts) AS d, symbol, venue FROM ticks),
p AS (SELECT d + INTERVAL 1 DAY AS d, symbol, venue FROM e)
SELECT epoch_us(d) AS d, count(*) FILTER (WHERE a AND b) AS common, count(*) FILTER (WHERE a OR b) AS total, count(*) FILTER (WHERE (a IS NULL) <> (b IS NULL)) AS changed
FROM (SELECT d, symbol, venue, e.a, p.b FROM (SELECT *, true AS a FROM e) e FULL JOIN (SELECT *, true AS b FROM p) p USING (d, symbol, venue)) GROUP BY d""")
def edges(t):
    e = t.ticks.select(F.date_trunc("day", "ts").alias("d"), "symbol", "venue").distinct()
    p = e.withColumn("d", F.col("d") + F.expr("interval 1 day")).withColumn("b", F.lit(True))
    m = e.withColumn("a", F.lit(True)).join(p, ["d", "symbol", "venue"], "full_outer")
    return m.groupBy("d").agg(F.count_if(F.col("a") & F.col("b")).alias("common"), F.count(F.lit(1)).alias("total"),
                              F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("changed")).withColumn("d", micros("d"))
