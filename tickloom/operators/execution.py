"""Execution analytics: cost analysis, book impact, schedules, order states, positions, venues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.exprs import any_of, clip, micros, ratio
from tickloom.operators.aggregates import newest, vwap
from tickloom.operators.axis import Axis, running, windowed
from tickloom.operators.quantiles import quantiles


def side_sign(side: Column) -> Column:
    return F.when(F.lower(side) == "buy", 1.0).otherwise(-1.0)


def order_costs(parents: DataFrame, fills: DataFrame, *, order_id: str = "order_id", seq: Sequence[str] = ("ts",),
                benchmarks: DataFrame | None = None, market: DataFrame | None = None) -> DataFrame:
    """Per parent order: shortfall, slippage, fill rate, participation, opportunity cost and the cost breakdown.

    ``benchmarks`` has order_id, ts, price, volume (NULL volume weighs 1, volume <= 0 is left out); ``market`` has order_id, volume.
    """
    q, p = F.col("quantity"), F.col("price")
    f = fills.groupBy(order_id).agg(
        F.coalesce(F.sum(F.when(q > 0, q)), F.lit(0.0)).alias("executed"), F.coalesce(F.sum(F.when(q > 0, q * p)), F.lit(0.0)).alias("__notional"),
        F.coalesce(F.sum(F.when(q > 0, F.col("fees"))), F.lit(0.0)).alias("__fees"), F.sum("fees").alias("fees"), vwap(q, p).alias("trade_vwap"),
        F.max_by(p, F.struct(*seq)).alias("__last"))
    d = parents.join(f, order_id, "left").fillna(0.0, ["executed", "__notional", "__fees", "fees", "trade_vwap"])
    if benchmarks is not None:
        w = F.when(F.col("volume").isNull(), 1.0).when(F.col("volume") > 0, F.col("volume"))
        b = benchmarks.groupBy(order_id).agg(F.coalesce(F.sum(F.col("price") * w) / F.nullif(F.sum(w), F.lit(0.0)), F.lit(0.0)).alias("__mv"),
                                             F.max_by("price", "ts").alias("__lastb"))
        d = d.join(b, order_id, "left")
    else:
        d = d.withColumns({"__mv": F.lit(None).cast("double"), "__lastb": F.lit(None).cast("double")})
    d = d.join(market.groupBy(order_id).agg(F.sum("volume").alias("__vol")), order_id, "left") if market is not None else d.withColumn("__vol", F.lit(0.0))
    s, arrival = side_sign(F.col("side")), F.col("arrival_price")
    d = d.withColumn("market_vwap", F.coalesce("__mv", arrival))
    done = F.col("executed") > 0
    short = F.when(done, s * (F.col("__notional") - arrival * F.col("executed")) + F.col("__fees")).otherwise(0.0)
    slip = F.when(F.col("trade_vwap") != 0, s * (F.col("trade_vwap") - F.col("market_vwap"))).otherwise(0.0)
    rest = F.greatest(F.lit(0.0), F.col("target_quantity") - F.col("executed"))
    lost = F.when(rest > 0, F.greatest(F.lit(0.0), s * (F.coalesce("__lastb", "__last", arrival) - arrival) * rest)).otherwise(0.0)
    d = d.withColumns({
        "shortfall": short, "per_share_shortfall": F.coalesce(ratio(short, F.col("executed")), F.lit(0.0)),
        "arrival_slippage": F.when(F.col("trade_vwap") != 0, s * (F.col("trade_vwap") - arrival)).otherwise(0.0), "vwap_slippage": slip,
        "fill_rate": F.when(F.col("target_quantity") > 0, clip(ratio(F.col("executed"), F.col("target_quantity"), 0.0), 0.0, 1.0)).otherwise(0.0),
        "participation": F.when(done & (F.col("__vol") > 0), F.least(F.lit(1.0), ratio(F.col("executed"), F.col("__vol")))).otherwise(0.0),
        "slippage_cost": slip * F.col("executed"), "opportunity_cost": lost})
    return d.withColumn("total_cost", F.col("fees") + F.col("slippage_cost") + F.col("opportunity_cost")).drop("__notional", "__fees", "__last", "__mv", "__lastb", "__vol")


def order_latency(orders: DataFrame, keys: Sequence[str], submitted: str, acked: str, completed: str) -> DataFrame:
    """Latency distribution of each leg; missing or negative legs do not count as faster than 0."""
    from tickloom.operators.aggregates import latency_report

    leg = lambda a, b: F.greatest(F.lit(0.0), (micros(b) - micros(a)) / 1e6)
    tall = orders.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("leg"), F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), leg(a, b)).alias("v")) for n, a, b in (
        ("submit_to_ack", submitted, acked), ("ack_to_complete", acked, completed), ("submit_to_complete", submitted, completed))])).alias("x")).select(*keys, "x.leg", "x.v")
    return latency_report(tall, [*keys, "leg"], "v")


def liquidity_report(samples: DataFrame, fills: DataFrame, keys: Sequence[str], width: float) -> DataFrame:
    """Average displayed volume, coverage, peak book pressure per bucket and median spread."""
    keys = list(keys)
    bucket = F.floor(micros("ts") / int(width * 1e6)).alias("__b")
    liq = samples.groupBy(*keys, bucket).agg(F.avg("displayed_volume").alias("__a"))
    ex = fills.groupBy(*keys, bucket).agg(F.sum("quantity").alias("__q"))
    press = ex.join(liq, [*keys, "__b"]).filter(F.col("__a") > 0).groupBy(*keys).agg(F.max(F.col("__q") / F.col("__a")).alias("book_pressure"))
    tot = samples.groupBy(*keys).agg(F.avg("displayed_volume").alias("average_displayed"), F.sum("displayed_volume").alias("__d"))
    done = fills.groupBy(*keys).agg(F.sum(F.when(F.col("quantity") > 0, F.col("quantity"))).alias("__e"))
    spread = quantiles(samples, keys, "spread_bps", {"median_spread": 0.5}).drop("n")
    out = tot.join(done, keys, "left").join(press, keys, "left").join(spread, keys, "left")
    return out.withColumn("coverage", F.coalesce(ratio(F.col("__e"), F.col("__d")), F.lit(0.0))).fillna(0.0, ["book_pressure", "median_spread"]).drop("__d", "__e")


def broker_comparison(fills: DataFrame, keys: Sequence[str], side: Column, market_vwap: Column) -> DataFrame:
    """Quantity, price, fees and cost per share of each broker and venue."""
    g = fills.groupBy(*keys).agg(F.sum("quantity").alias("quantity"), F.sum(F.col("quantity") * F.col("price")).alias("__n"), F.sum("fees").alias("fees"), F.count(F.lit(1)).alias("fill_count"))
    g = g.withColumn("average_price", F.when(F.col("quantity") > 0, ratio(F.col("__n"), F.col("quantity"))).otherwise(0.0))
    return g.withColumn("cost_per_share", side_sign(side) * (F.col("average_price") - market_vwap)).drop("__n")


def periodic_costs(fills: DataFrame, market: DataFrame, benchmarks: DataFrame, keys: Sequence[str], width: float, side: Column) -> DataFrame:
    """One record per bucket with fills."""
    from tickloom.operators.joins import bucket_join

    w = F.when(F.col("volume").isNull(), 1.0).when(F.col("volume") > 0, F.col("volume"))
    d = bucket_join({
        "f": (fills, {"executed": F.sum("quantity"), "__n": F.sum(F.col("quantity") * F.col("price"))}),
        "m": (market, {"__v": F.sum("volume")}),
        "b": (benchmarks, {"__b": F.coalesce(F.sum(F.col("price") * w) / F.nullif(F.sum(w), F.lit(0.0)), F.lit(0.0))})}, keys, "ts", width, "f")
    d = d.withColumn("vwap", F.when(F.col("executed") > 0, ratio(F.col("__n"), F.col("executed"))).otherwise(0.0))
    return d.withColumn("participation", F.when(F.col("__v") > 0, F.least(F.lit(1.0), ratio(F.col("executed"), F.col("__v")))).otherwise(0.0)).withColumn(
        "slippage", side_sign(side) * (F.col("vwap") - F.coalesce("__b", "vwap"))).drop("__n", "__v", "__b")


def recommendations(ack_p95: Column, pressure: Column, shortfall: Column, participation: Column, broker_spread: Column) -> Column:
    """Codes of the rules that hold."""
    # fixed values: the limits of the rules and their codes
    return any_of([(ack_p95 > 1.0, "routing_latency"), (pressure > 1.2, "reduce_participation"), (shortfall > 0.5, "tighten_limits"),
                   (participation > 0.25, "participation_high"), (broker_spread > 0.1, "shift_broker")])


def walk_book(orders: DataFrame, levels: DataFrame, *, book: Sequence[str], order: Sequence[str], penalty_bps: float = 15.0) -> DataFrame:
    """Average price, book fill and shortfall of market orders.

    ``orders``: book keys, order keys, side, quantity, mid; ``levels``: book keys, side (of the resting orders), price, quantity.
    Cumulative depth and value are taken once per book side. An order is then a point on that depth: the level before it is used up, the level after it gives the rest, so it meets two levels however many
    the book has. Without a positive quantity nothing is filled.
    """
    buy = F.lower("side") == "buy"
    lv = levels.withColumn("__rank", F.when(F.lower("side") == "ask", F.col("price")).otherwise(-F.col("price")))
    lv = lv.groupBy(*book, F.col("side").alias("__side"), "__rank").agg(F.sum("quantity").alias("__q"), F.first("price").alias("__p"))
    deep = running(lv, Axis([*book, "__side"], "__rank", (), 1e6, numeric=True), {"__to": ("sum", F.col("__q")), "__val": ("sum", F.col("__q") * F.col("__p"))})
    points = deep.select(*book, "__side", F.col("__to").alias("__at"), F.lit(0).alias("__kind"), F.struct("__to", "__val", "__p").alias("__level"))
    asked = orders.select(*orders.columns, F.when(buy, "ask").otherwise("bid").alias("__side"), F.col("quantity").cast("double").alias("__at"), F.lit(1).alias("__kind"))
    level = F.col("__level")
    placed = running(asked.unionByName(points, allowMissingColumns=True), Axis([*book, "__side"], "__at", ("__kind",), 1e6, numeric=True),
                     {"__before": ("last", level), "__after": ("last", level, True), "__end": ("first", level, True)}).where("__kind = 1")
    n, used = F.col("quantity"), F.coalesce(F.col("__before.__to"), F.lit(0.0))
    depth = F.coalesce(F.col("__end.__to"), F.col("__before.__to"), F.lit(0.0))
    filled = F.when(n > 0, F.least(n, depth)).otherwise(0.0)
    value = F.when(n > 0, F.coalesce(F.col("__before.__val"), F.lit(0.0)) + F.coalesce((filled - used) * F.col("__after.__p"), F.lit(0.0))).otherwise(0.0)
    last = F.when((n > 0) & (n > used), F.coalesce("__after.__p", "__before.__p")).when(n > 0, F.col("__before.__p"))
    g = placed.select(*order, "side", "quantity", "mid", filled.alias("filled"), value.alias("__val"), F.coalesce(last, F.col("mid")).alias("__last"), depth.alias("depth"))
    g = g.withColumn("shortfall", F.greatest(F.lit(0.0), n - F.col("filled")))
    last = F.col("__last")
    worse = F.when(F.lower("side") == "buy", last * (1 + penalty_bps * 1e-4)).otherwise(F.greatest(F.lit(0.0), last * (1 - penalty_bps * 1e-4)))
    return g.withColumn("average_price", ratio(F.col("__val") + F.col("shortfall") * worse, n)).withColumn("liquidity_score", ratio(F.col("depth"), n)).drop("__val", "__last")


def impact_forecast(walked: DataFrame, participation: Column, volatility: Column, *, sensitivity: float = 0.05, exponent: float = 0.6, vol_sensitivity: float = 0.04) -> DataFrame:
    mid, buy = F.col("mid"), F.lower("side") == "buy"
    base = F.greatest(F.lit(0.0), F.when(buy, F.col("average_price") - mid).otherwise(mid - F.col("average_price")))
    part = mid * sensitivity * F.pow(F.least(F.greatest(participation, F.lit(1e-6)), F.lit(1.0)), exponent)
    vol = mid * vol_sensitivity * F.greatest(volatility, F.lit(0.0))
    d = walked.withColumns({"base_impact": base, "participation_component": part, "volatility_component": vol}).withColumn(
        "expected_slippage", F.col("base_impact") + F.col("participation_component") + F.col("volatility_component"))
    return d.withColumns({
        "slippage_bps": ratio(F.col("expected_slippage"), mid, 0.0) * 1e4, "expected_cost": F.col("expected_slippage") * F.col("quantity"),
        "expected_price": F.when(buy, mid + F.col("expected_slippage")).otherwise(F.greatest(mid - F.col("expected_slippage"), F.lit(0.0))),
        "shortfall_ratio": ratio(F.col("shortfall"), F.col("quantity"))})


def adjust_parameters(d: DataFrame, *, upper: float = 20.0, lower: float = 8.0, score: float = 1.5, step: float = 1.0, bounds: tuple[float, float] = (0.01, 0.5),
                      offsets: tuple[float, float] = (0.0, 50.0), slices: tuple[float, float] = (0.5, 2.0)) -> DataFrame:
    """New participation, slice and limit offset from the current ones and the forecast."""
    p = lambda c: clip(c, *bounds)
    o = lambda c: clip(c, *offsets)
    tight = (F.col("slippage_bps") > upper) | (F.col("liquidity_score") < 1.0)
    loose = (F.col("slippage_bps") < lower) & (F.col("liquidity_score") > score)
    part, size, off = F.col("participation_rate"), F.col("slice_volume"), F.col("limit_offset_bps")
    d = d.withColumns({
        "new_participation": F.when(tight, p(part * 0.75)).when(loose, p(part * 1.15)).otherwise(part),
        "new_slice": F.when(tight, F.greatest(size * slices[0], size * 0.5)).when(loose, F.least(size * slices[1], size * 1.25)).otherwise(size),
        "new_offset": F.when(tight, o(off + step)).when(loose, o(F.greatest(off - step, F.lit(0.0)))).otherwise(off)})
    risky = F.col("volatility_component") > F.col("base_impact")
    return d.withColumns({"new_participation": F.when(risky, p(F.col("new_participation") * 0.9)).otherwise(F.col("new_participation")),
                          "new_offset": F.when(risky, o(F.col("new_offset") + step / 2)).otherwise(F.col("new_offset"))})


def schedule(orders: DataFrame, kind: str, *, duration: float, profile: Sequence[float] | int, participation: float = 0.1, quantity: str = "quantity", ts: str = "ts") -> DataFrame:
    """Child orders: ``twap`` (profile = slices), ``vwap`` (volume weights), ``pov`` (forecast volumes, each capped by the target)."""
    n = profile if isinstance(profile, int) else len(profile)
    q = F.col(quantity)
    if kind == "twap":
        sizes = [q / n] * n
    elif kind == "vwap":
        total = float(sum(profile))
        sizes = [q * (w / total) for w in profile]
    elif kind == "pov":
        sizes = [F.least(q, F.lit(participation * float(v))) for v in profile]
        spent = sum(sizes[1:], sizes[0])
        sizes[-1] = sizes[-1] + F.greatest(F.lit(0.0), q - spent)
    else:
        raise ValueError(f"unknown schedule {kind!r}")
    d = orders.select("*", F.posexplode(F.array(*sizes)).alias("slice", "child_quantity"))
    return d.withColumn("scheduled", F.timestamp_micros(micros(ts) + F.col("slice").cast("long") * int(duration / n * 1e6)))


# fixed values: legal order transitions
TRANSITIONS = {
    ("pending", "submit"): "pending", ("pending", "ack"): "open", ("pending", "cancel"): "cancelled", ("pending", "reject"): "rejected",
    ("open", "ack"): "open", ("open", "fill_partial"): "partially_filled", ("open", "fill_final"): "filled", ("open", "cancel"): "cancelled", ("open", "reject"): "rejected",
    ("partially_filled", "fill_partial"): "partially_filled", ("partially_filled", "fill_final"): "filled", ("partially_filled", "cancel"): "cancelled",
    ("filled", "fill_final"): "filled", ("cancelled", "cancel"): "cancelled", ("rejected", "reject"): "rejected"}
TERMINAL = ("filled", "cancelled", "rejected")


def order_states(events: DataFrame, axis: Axis, *, event: str = "event", correlation: str = "correlation_id") -> DataFrame:
    """Status before and after each event; repeated correlation ids are dropped, illegal events keep the status and are flagged."""
    from tickloom.operators.automata import run_machine

    rest = [c for c in events.columns if c not in (*axis.keys, correlation)]
    once = events.groupBy(*axis.keys, correlation).agg(F.min_by(F.struct(*rest), F.struct(*axis.order)).alias("r")).select(*axis.keys, correlation, "r.*")
    return run_machine(once, axis, event, TRANSITIONS, "pending")


def latest_states(states: DataFrame, axis: Axis, active_only: bool = False) -> DataFrame:
    d = states.filter("legal").groupBy(*axis.keys).agg(F.max_by("to_status", F.struct(*axis.order)).alias("status"), F.count(F.lit(1)).alias("transitions"))
    return d.filter(~F.col("status").isin(*TERMINAL)) if active_only else d


POSITION = {"position": T.DoubleType(), "entry_price": T.DoubleType(), "realized": T.DoubleType(), "unrealized": T.DoubleType()}


def position_step(state: tuple, signed: float, price: float) -> tuple:
    """(quantity, entry, realised) after a fill: same side blends the entry, the other side realises and may flip."""
    held, entry, real = state
    if held * signed >= 0:
        total = abs(held) + abs(signed)
        entry = (entry * abs(held) + price * abs(signed)) / total if held else price
    else:
        real += min(abs(held), abs(signed)) * (price - entry) * (1.0 if held > 0 else -1.0)
        left = held + signed
        entry = 0.0 if left == 0 else price if abs(signed) > abs(held) else entry
    return held + signed, entry, real


def positions(fills: DataFrame, axis: Axis, *, signed: str = "signed_quantity", price: str = "price") -> DataFrame:
    """Position, entry price, realised and unrealised profit after each fill."""
    from tickloom.operators.amm import keyed_scan

    def step(state, row):
        s = position_step(state, row[signed], row[price])
        return s, (s[0], s[1], s[2], s[0] * (row[price] - s[1]))
    return keyed_scan(fills, axis, lambda: (0.0, 0.0, 0.0), step, POSITION, [signed, price])


def cash_rows(ex: DataFrame, *, side: str = "side", gross: str = "gross", fee: str = "fee") -> DataFrame:
    """Trade row of every execution and a fee row where the fee is not 0."""
    keep = [c for c in ex.columns if c not in (side, gross, fee)]
    trade = F.struct(F.lit("trade").alias("kind"), (-side_sign(F.col(side)) * F.col(gross)).alias("amount"))
    charge = F.when(F.col(fee) != 0, F.struct(F.lit("fee").alias("kind"), (-F.col(fee)).alias("amount")))
    return ex.select(*keep, F.explode(F.array_compact(F.array(trade, charge))).alias("x")).select(*keep, "x.*")


def venue_latency(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, n: int = 2048) -> DataFrame:
    return quantiles(newest(df, keys, order, n), keys, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def inventory(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Normalised weights, capped target, surplus and deficit per venue of each asset.

    Columns: base, quote, weight, min_base, min_quote, max_weight (NULL = no cap).
    """
    tot = df.groupBy(*keys).agg(F.sum("base").alias("__b"), F.sum("weight").alias("__w"))
    d = df.join(tot, list(keys))
    want = ratio(F.col("__b") * F.col("weight"), F.col("__w"))
    d = d.withColumn("desired", F.least(want, F.coalesce(F.col("__b") * F.col("max_weight"), want)))
    have = F.col("base")
    surplus = F.when((have > F.col("desired")) & (F.col("quote") >= F.col("min_quote")), F.least(have - F.col("desired"), F.greatest(have - F.col("min_base"), F.lit(0.0)))).otherwise(0.0)
    deficit = F.when(have <= F.col("desired"), F.greatest(F.greatest(F.col("desired"), F.col("min_base")) - have, F.lit(0.0))).otherwise(0.0)
    return d.withColumn("surplus", surplus).withColumn("deficit", deficit).withColumn("balanced", (F.col("surplus") == 0) & (F.col("deficit") == 0)).drop("__b", "__w")


def book_rules(snapshot: bool = True) -> Column:
    """Broken rules of ``bids``/``asks`` level arrays and their times."""
    pairs = lambda c, bad: F.exists(F.sequence(F.lit(2), F.greatest(F.size(c), F.lit(2))), lambda i: (i <= F.size(c)) & bad(
        F.try_element_at(c, i - 1)["price"], F.try_element_at(c, i)["price"]))
    neg = F.exists("bids", lambda x: x["quantity"] < 0) | F.exists("asks", lambda x: x["quantity"] < 0)
    rules = [(neg, "negative_quantity"), (F.col("ts_arrival") < F.col("ts_event"), "arrival_before_event")]
    if snapshot:
        zero = F.exists("bids", lambda x: x["quantity"] == 0) | F.exists("asks", lambda x: x["quantity"] == 0)
        rules += [(zero, "zero_quantity"), (pairs("bids", lambda a, b: b >= a), "bids_not_descending"), (pairs("asks", lambda a, b: b <= a), "asks_not_ascending")]
    return any_of(rules)


def book_state(updates: DataFrame, keys: Sequence[str], *, seq: str = "seq", depth: int | None = None) -> DataFrame:
    """Levels of each book: the latest quantity per (side, price) since the last snapshot, empty ones removed.

    ``updates`` has side, price, quantity, kind (snapshot or diff). No fold: one combining aggregate.
    """
    from pyspark.sql import Window as W

    keys = list(keys)
    last = updates.groupBy(*keys).agg(F.max(F.when(F.col("kind") == "snapshot", F.col(seq))).alias("__s"))
    d = updates.join(last, keys).filter(F.col("__s").isNull() | (F.col(seq) >= F.col("__s")))
    lv = d.groupBy(*keys, "side", "price").agg(F.max_by("quantity", seq).alias("quantity")).filter("quantity > 0")
    rank = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    lv = lv.withColumn("__r", rank)
    if depth is None:
        return lv.drop("__r")
    return lv.withColumn("level", F.row_number().over(W.partitionBy(*keys, "side").orderBy("__r"))).filter(F.col("level") <= depth).drop("__r")


def quote_stats(quotes: DataFrame, axis: Axis, *, received: str = "received", n: int = 256) -> DataFrame:
    """Mid, spread, age and mean latency of the last ``n`` quotes."""
    d = quotes.withColumns({"mid": (F.col("bid") + F.col("ask")) / 2, "spread": F.col("ask") - F.col("bid"),
                            "latency": F.greatest((micros(received) - micros(axis.ts)) / 1e6, F.lit(0.0))})
    return windowed(d, axis, lambda x, w: x.withColumn("mean_latency", F.avg("latency").over(w.rowsBetween(-(n - 1), 0))), back=n - 1)
