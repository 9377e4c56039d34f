"""Cross-venue arbitrage over any number of venues, with balances; one rule for tables and streams.

The state of a symbol is the latest quote and the latest balance of each venue. Over a block of rows it changes by what the block's own last quotes and balances are, so the states that blocks start in follow from
one map for each block, merged in order, and the rows of all blocks are walked independently.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.exprs import join_back, micros
from tickloom.operators.axis import BLOCK, HOT, Axis, split

QUOTE, BALANCE = ("bid", "ask", "bid_size", "ask_size"), ("base_available", "quote_available")
FOUND = "buy_venue string, sell_venue string, buy_price double, sell_price double, size double, notional double, profit double"


@dataclass(frozen=True)
class Rule:
    """Ages and skews in seconds; ``fee``: share of the notional taken on either leg, ``fees``: by venue where it differs. A venue with no known balance is not limited by one."""

    max_age: float = 5.0
    max_skew: float = 1.0
    fee: float = 0.001
    fees: Mapping[str, float] = field(default_factory=dict)
    min_edge: float = 0.0
    min_profit: float = 0.0

    def find(self, quotes: dict, balances: dict, now: int) -> tuple | None:
        """The trade at ``now`` (microseconds) from quotes venue -> (time, bid, ask, bid_size, ask_size): highest bid against lowest ask (equal ones: first venue by name)."""
        live = sorted((v, q) for v, q in quotes.items() if now - q[0] <= self.max_age * 1e6)
        if len(live) < 2:
            return None
        sell, b = max(live, key=lambda x: x[1][1])  # the first of equal ones
        buy, a = min(live, key=lambda x: x[1][2])
        if sell == buy or b[1] <= a[2] or abs(b[0] - a[0]) > self.max_skew * 1e6:
            return None
        size = min(a[4], b[3])
        if buy in balances:
            size = min(size, balances[buy][1] / a[2])
        if sell in balances:
            size = min(size, balances[sell][0])
        if size <= 0:
            return None
        notional = size * a[2]
        profit = (b[1] - a[2]) * size - notional * self.fees.get(buy, self.fee) - size * b[1] * self.fees.get(sell, self.fee)
        if profit <= 0 or profit < self.min_profit or profit / notional < self.min_edge:
            return None
        return buy, sell, a[2], b[1], size, notional, profit


def step(rule: Rule, state: tuple[dict, dict], venue: str, now: int, quote: tuple, balance: tuple) -> tuple | None:
    """Take in one row (``quote`` or ``balance`` is all None); the trade, if a quote makes one. ``state`` is changed."""
    quotes, balances = state
    if balance[0] is not None:
        balances[venue] = balance
    if quote[0] is None:
        return None
    quotes[venue] = (now, *quote)
    return rule.find(quotes, balances, now)


def messages(quotes: DataFrame, balances: DataFrame | None, axis: Axis, venue: str) -> DataFrame:
    """Quotes and balances as one table; at equal places a balance comes first if its ``seq`` does."""
    double = lambda names, df: [F.col(c).cast("double").alias(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in names]
    own = [*axis.keys, *axis.order, F.col(venue).alias("venue")]
    out = quotes.select(*own, *double(QUOTE, quotes), *[F.lit(None).cast("double").alias(c) for c in BALANCE])
    return out if balances is None else out.unionByName(balances.select(*own, *[F.lit(None).cast("double").alias(c) for c in QUOTE], *double(BALANCE, balances)))


def arbitrage(quotes: DataFrame, axis: Axis, rule: Rule = Rule(), *, venue: str = "venue", balances: DataFrame | None = None) -> DataFrame:
    """(keys, order, buy_venue, sell_venue, buy_price, sell_price, size, notional, profit) at every quote that makes a trade.

    ``quotes``: bid, ask, bid_size, ask_size; ``balances``: base_available and quote_available of a venue from then on. Both have the columns of ``axis``.
    """
    keys = list(axis.keys)
    rows = split(messages(quotes, balances, axis, venue).withColumn("__us", micros(axis.ts)), axis)
    place, at = W.partitionBy(*keys, BLOCK).orderBy(*axis.order), F.struct(*axis.order)

    quote, balance = F.struct("__us", *QUOTE), F.struct(*BALANCE)
    last = rows.where(HOT).groupBy(*keys, BLOCK, "venue").agg(F.max_by(quote, F.when(F.col("bid").isNotNull(), at)).alias("quote"), F.max_by(balance, F.when(F.col("base_available").isNotNull(), at)).alias("balance"))
    maps = last.groupBy(*keys, BLOCK).agg(F.map_from_entries(F.collect_list(F.struct("venue", F.struct("quote", "balance")))).alias("m"))  # an entry for each venue
    blocks = maps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(BLOCK, F.map_entries("m").alias("m")))).alias("__b"))  # a row for each block
    kind = maps.schema["m"].dataType.simpleString()
    later = lambda a, b: F.map_zip_with(a, b, lambda k, x, y: F.struct(F.coalesce(y["quote"], x["quote"]).alias("quote"), F.coalesce(y["balance"], x["balance"]).alias("balance")))
    zero = F.struct(F.expr("map()").cast(kind).alias("s"), F.array().cast(f"array<{kind}>").alias("done"))
    states = F.aggregate("__b", zero, lambda s, b: F.struct(later(s["s"], F.map_from_entries(b["m"])).alias("s"), F.concat(s["done"], F.array(s["s"])).alias("done")), lambda s: s["done"])
    starts = blocks.select(*keys, F.explode(F.arrays_zip(F.transform("__b", lambda b: b[BLOCK]).alias(BLOCK), states.alias("start"))).alias("z")).select(*keys, f"z.{BLOCK}", F.map_entries("z.start").alias("__start"))

    placed = join_back(rows, starts, [*keys, BLOCK], "left").withColumn("__first", F.row_number().over(place) == 1)
    placed = placed.withColumn("__start", F.when(F.col("__first"), F.col("__start")))
    own = [*keys, *axis.order]
    out = T.StructType([*[placed.schema[c] for c in own], *T._parse_datatype_string(FOUND).fields])

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: tuple[dict, dict] = {}, {}
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()
            hits, found = [], []
            for i, (first, start, v, us, q, b) in enumerate(zip(get("__first"), get("__start"), get("venue"), get("__us"), zip(*map(get, QUOTE)), zip(*map(get, BALANCE)))):
                if first:
                    state = {}, {}
                    for e in start or ():
                        if e["value"]["quote"]:
                            state[0][e["key"]] = tuple(e["value"]["quote"].values())
                        if e["value"]["balance"]:
                            state[1][e["key"]] = tuple(e["value"]["balance"].values())
                if v is not None and (trade := step(rule, state, v, us, q, b)):
                    hits.append(i)
                    found.append(trade)
            head = batch.select(own).take(pa.array(hits, pa.int64()))
            trades = pa.Table.from_pylist([dict(zip(out.names[len(own):], f)) for f in found], pa.schema([(f.name, pa.string() if isinstance(f.dataType, T.StringType) else pa.float64()) for f in out.fields[len(own):]]))
            yield pa.RecordBatch.from_arrays([*head.columns, *[c.combine_chunks() for c in trades.columns]], out.names)

    return placed.select(*own, "__first", "__start", "venue", "__us", *QUOTE, *BALANCE).mapInArrow(walked, out)
