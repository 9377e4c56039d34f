"""As-of, interval, bucket and set joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.exprs import micros
from tickloom.operators.axis import Axis, running


def asof(left: DataFrame, right: DataFrame, *, keys: Sequence[str], ts: str = "ts", right_ts: str | None = None,
         values: Sequence[str], right_seq: Sequence[str] = (), direction: str = "backward",
         tolerance: float | None = None, grain: float = 3600.0, block_rows: int = 1_000_000,
         strict: bool = False, numeric: bool = False) -> DataFrame:
    """Every left row with the last right row at or before it (``forward``: first at or after it).

    Both sides go through one union and one running value, so the cost is linear and no range join is
    made; the running value works on blocks, so one hot key is spread over tasks. A matched row whose
    values are NULL stays matched. ``strict`` leaves out a right row at the very same time.
    """
    right_ts = right_ts or ts
    first_right = (direction == "backward") != strict
    r_side, l_side = (0, 1) if first_right else (1, 0)
    order = F.struct(*right_seq) if right_seq else F.lit(0)
    payload = F.struct(F.col(right_ts).alias("__at"), *[F.col(v) for v in values])
    r = right.select(*keys, F.col(right_ts).alias(ts), F.lit(r_side).alias("__side"), order.alias("__o"), payload.alias("__r"))
    rest = [c for c in left.columns if c not in (*keys, ts)]
    l = left.select(*keys, ts, F.lit(l_side).alias("__side"), F.struct(F.lit(1).alias("__l"), *rest).alias("__row"))
    both = r.unionByName(l, allowMissingColumns=True)
    axis = Axis(tuple(keys), ts, ("__side", "__o"), grain, block_rows, numeric)
    done = running(both, axis, {"__r": ("last", F.col("__r"), direction == "forward")})
    hit = F.col("__r")
    if tolerance is not None:
        gap = F.abs(F.col(ts) - hit["__at"]) if numeric else F.abs(micros(ts) - micros(hit["__at"])) / 1e6
        hit = F.when(gap <= tolerance, hit)
    named = [hit[v].alias(v if v not in left.columns else f"{v}_right") for v in values]
    matched = hit["__at"].alias("matched_ts")
    out = done.filter(F.col("__row").isNotNull())
    return out.select(*keys, ts, *[F.col("__row")[c].alias(c) for c in rest], matched, *named)


def suffix_join(a: DataFrame, b: DataFrame, keys: Sequence[str], suffixes: tuple[str, str], how: str = "inner") -> DataFrame:
    """Equi join; columns on both sides get the suffixes."""
    shared = (set(a.columns) & set(b.columns)) - set(keys)
    left = a.select(*[F.col(c).alias(c + suffixes[0]) if c in shared else F.col(c) for c in a.columns])
    right = b.select(*[F.col(c).alias(c + suffixes[1]) if c in shared else F.col(c) for c in b.columns])
    return left.join(right, list(keys), how)


def concat_columns(frames: Mapping[str, DataFrame], on: Sequence[str]) -> DataFrame:
    """Outer union of columns on an index, each frame's columns prefixed by its name.

    Stacking and one aggregate need one shuffle; a chain of outer joins would need one per frame.
    """
    stacked = None
    names = []
    for name, df in frames.items():
        cols = [c for c in df.columns if c not in on]
        part = df.select(*on, *[F.col(c).alias(f"{name}_{c}") for c in cols])
        names += [f"{name}_{c}" for c in cols]
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    return stacked.groupBy(*on).agg(*[F.max(c).alias(c) for c in names])


def common_index(frames: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Index values present in every frame."""
    keys = [f.select(*on).distinct() for f in frames]
    stacked = reduce(lambda a, b: a.unionByName(b), keys)
    return stacked.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") == len(frames)).drop("__n")


def keep_new(df: DataFrame, history: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(history.select(*keys), list(keys), "left_anti")


def keep_known(df: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(known.select(*keys), list(keys), "left_semi")


def bucket_join(sides: Mapping[str, tuple[DataFrame, Mapping[str, Column]]], keys: Sequence[str], ts: str, width: float,
                base: str) -> DataFrame:
    """Aggregate each side per (keys, time bucket), then left join the others to ``base``.

    Every side shrinks map side before its shuffle, and all share one partitioning.
    """
    bucket = (F.floor(micros(ts) / int(width * 1e6)) * int(width)).cast("long").alias("bucket")
    done = {n: df.groupBy(*keys, bucket).agg(*[c.alias(a) for a, c in aggs.items()]) for n, (df, aggs) in sides.items()}
    out = done[base]
    for name, df in done.items():
        if name != base:
            out = out.join(df, [*keys, "bucket"], "left")
    return out


def resolve_symbols(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Asset of (symbol, venue): exact venue, else any venue, else historical names; ambiguity is flagged.

    ``catalog`` has asset_id, symbol, venue and active (false for historical names).
    """
    asks = requests.select("symbol", "venue").distinct()
    hits = asks.alias("q").join(catalog.alias("c"), "symbol").select(
        F.col("symbol"), F.col("q.venue").alias("venue"), F.col("c.asset_id").alias("asset_id"),
        F.when(~F.col("c.active"), 3).when(F.col("c.venue") == F.col("q.venue"), 1).otherwise(2).alias("tier"))
    best = hits.groupBy("symbol", "venue").agg(*[
        e for t in (1, 2, 3) for e in (
            F.min(F.when(F.col("tier") == t, F.col("asset_id"))).alias(f"a{t}"),
            F.count_distinct(F.when(F.col("tier") == t, F.col("asset_id"))).alias(f"n{t}"))])
    tier = F.when(F.col("n1") > 0, 1).when(F.col("n2") > 0, 2).when(F.col("n3") > 0, 3)
    count = F.when(tier == 1, F.col("n1")).when(tier == 2, F.col("n2")).otherwise(F.col("n3"))
    asset = F.when(count == 1, F.coalesce(F.when(tier == 1, F.col("a1")), F.when(tier == 2, F.col("a2")), F.col("a3")))
    found = best.select("symbol", "venue", asset.alias("asset_id"), tier.alias("tier"), (count > 1).alias("ambiguous"))
    return requests.join(found, ["symbol", "venue"], "left")


def compare_pairs(df: DataFrame, *, on: Sequence[str], side: str, value: str, baseline: str | None = None) -> DataFrame:
    """Values of each pair of sides (environments) per key, baseline first when it takes part."""
    a = df.select(*on, F.col(side).alias("a"), F.col(value).alias("a_value"))
    b = df.select(*on, F.col(side).alias("b"), F.col(value).alias("b_value"))
    rank = lambda c: F.when(F.col(c) == F.lit(baseline), F.lit("")).otherwise(F.col(c)) if baseline else F.col(c)
    return a.join(b, list(on)).filter(rank("a") < rank("b")).withColumn("diff", F.col("b_value") - F.col("a_value"))


def in_intervals(df: DataFrame, intervals: DataFrame, *, ts: str, start: str, end: str, keys: Sequence[str] = (),
                 cell: float = 86400.0, closed_end: bool = False, how: str = "inner") -> DataFrame:
    """Rows inside ``[start, end)`` intervals, as an equi join on the time cell plus the range test.

    Each interval is listed under every cell it touches, so there is no nested loop.
    """
    width = int(cell * 1e6)
    lo, hi = F.floor(micros(start) / width), F.floor(micros(end) / width)
    spread = intervals.withColumn("__cell", F.explode(F.sequence(lo, hi)))
    d = df.withColumn("__cell", F.floor(micros(ts) / width))
    inside = (F.col(ts) >= F.col(start)) & ((F.col(ts) <= F.col(end)) if closed_end else (F.col(ts) < F.col(end)))
    if how == "inner":
        return d.join(spread, [*keys, "__cell"]).filter(inside).drop("__cell")
    cond = (d["__cell"] == spread["__cell"]) & inside
    for k in keys:
        cond = cond & (d[k] == spread[k])
    return d.join(spread, cond, how).drop("__cell")


def cross_params(df: DataFrame, params: DataFrame) -> DataFrame:
    """Every row under every parameter set; the sets are a short list given by the caller."""
    return df.crossJoin(F.broadcast(params))
