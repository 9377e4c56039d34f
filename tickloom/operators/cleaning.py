"""Projection, casting, scaling, rounding and rule checks on rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.exprs import any_of, finite, join_back, ratio
from tickloom.operators.axis import Axis, row_numbers, split, unsplit, windowed
from tickloom.operators.bars import interpolate

Predicate = Column | Callable[[], Column]


def where_all(df: DataFrame, predicates: Sequence[Predicate]) -> DataFrame:
    for p in predicates:
        df = df.filter(p() if callable(p) and not isinstance(p, Column) else p)
    return df


def with_expressions(df: DataFrame, named: Mapping[str, Predicate]) -> DataFrame:
    return df.withColumns({k: v() if callable(v) and not isinstance(v, Column) else v for k, v in named.items()})


def enforce_schema(df: DataFrame, dtypes: Mapping[str, str], strict: bool = True) -> DataFrame:
    """Cast columns; ``strict`` raises on a bad value at run time, otherwise it becomes NULL."""
    missing = [c for c in dtypes if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.withColumns({c: F.col(c).cast(t) if strict else F.col(c).try_cast(t) for c, t in dtypes.items()})


def time_slice(df: DataFrame, ts: str, start, end) -> DataFrame:
    """Rows between the two instants, both included."""
    return df.filter(F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def pick_features(df: DataFrame, base: Sequence[str], *, prefixes: Sequence[str] = (), names: Sequence[str] = ()) -> DataFrame:
    chosen = [c for c in df.columns if c in base or c in names or any(c.startswith(p) for p in prefixes)]
    return df.select(*chosen)


def parse_time(df: DataFrame, ts: str) -> DataFrame:
    """Epoch seconds or text to TIMESTAMP; what cannot be read becomes NULL."""
    kind = df.schema[ts].dataType
    if isinstance(kind, T.NumericType):
        value = F.timestamp_micros(F.round(F.col(ts) * 1e6).cast("long"))
    elif isinstance(kind, T.StringType):
        value = F.try_to_timestamp(F.col(ts))
    else:
        value = F.col(ts).cast("timestamp")
    return df.withColumn(ts, value)


def normalize_frame(df: DataFrame, axis: Axis, columns: Sequence[str]) -> DataFrame:
    """Parsed times, exact duplicates removed, gaps of numeric columns interpolated by row position."""
    unique = parse_time(df, axis.ts).dropDuplicates()
    placed = row_numbers(split(unique, axis), axis, "__pos")
    return unsplit(interpolate(placed, axis, columns, at=F.col("__pos"))).drop("__pos")


def scale(df: DataFrame, keys: Sequence[str], column: str, method: str = "zscore", out: str = "scaled") -> DataFrame:
    """z-score (population) or min-max per key; a constant series scales to 0.

    The statistics combine map side and are joined back, so a hot key is never gathered.
    """
    keys, x = list(keys), F.col(column)
    if method == "zscore":
        stats = df.groupBy(*keys).agg(F.avg(x).alias("__a"), F.stddev_pop(x).alias("__b"))
    elif method == "minmax":
        stats = df.groupBy(*keys).agg(F.min(x).alias("__a"), (F.max(x) - F.min(x)).alias("__b"))
    else:
        raise ValueError(f"unknown scaling method {method!r}")
    joined = join_back(df, stats, keys)
    return joined.withColumn(out, ratio(x - F.col("__a"), F.col("__b"), 0.0)).drop("__a", "__b")


def leakage_gate(df: DataFrame, axis: Axis, features: Sequence[str], *, lag: int = 1, dropna: bool = True) -> DataFrame:
    """Infinities to NULL, features lagged by ``lag`` rows, incomplete rows dropped."""
    clean = df.withColumns({c: finite(F.col(c)) for c in features})
    if lag > 0:
        clean = windowed(clean, axis, lambda d, w: d.withColumns({c: F.lag(c, lag).over(w) for c in features}), back=lag)
    return clean.na.drop(subset=list(features)) if dropna else clean


def first_values(df: DataFrame, keys: Sequence[str], fields: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First non-NULL value of each field per key."""
    rank = F.struct(*order)
    return df.groupBy(*keys).agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), rank)).alias(f) for f in fields])


def path_key(paths: Sequence[str]) -> Column:
    """Nested fields joined with ``|``; a missing one reads ``None``."""
    return F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("None")) for p in paths])


def round_to_step(value: Column, step: Column) -> Column:
    """Half-up to a multiple of ``step`` in decimal arithmetic; a step of 0 leaves the value alone."""
    v, s = value.cast("decimal(28,10)"), step.cast("decimal(28,10)")
    return F.when(step > 0, (F.round(v / F.nullif(s, F.lit(0).cast("decimal(28,10)")), 0) * s).cast("double")).otherwise(value)


def aligned(value: Column, step: Column, *, absolute: float = 1e-12, relative: float = 1e-9) -> Column:
    """Is ``value`` a multiple of ``step`` within tolerance."""
    v, s = value.cast("decimal(28,10)"), step.cast("decimal(28,10)")
    rest = F.abs(v % F.nullif(s, F.lit(0).cast("decimal(28,10)")))
    tol = F.least(s * F.lit(0.1).cast("decimal(4,2)"), F.greatest(F.lit(absolute).cast("decimal(28,15)"),
                                                                  s * F.lit(relative).cast("decimal(18,15)")))
    return (step <= 0) | (rest == 0) | (rest < tol) | ((s - rest) < tol)


def order_violations(quantity: Column, price: Column, spec: str = "") -> Column:
    """Rules broken against ``step_size, min_qty, tick_size, min_notional`` columns, as an array of codes."""
    c = lambda n: F.col(f"{spec}{n}")
    return any_of([
        (~aligned(quantity, c("step_size")), "quantity_step"),
        (quantity < c("min_qty"), "min_quantity"),
        (price.isNotNull() & ~aligned(price, c("tick_size")), "price_tick"),
        (price.isNotNull() & (c("min_notional") > 0) & (quantity * price < c("min_notional")), "min_notional"),
    ])


def check_orders(orders: DataFrame, specs: DataFrame, on: str, *, strict: bool = True, auto_round: bool = True) -> DataFrame:
    """Normalise quantity and price to the venue's steps, then list violations and block.

    As validation stops at the first broken rule, ``violation`` is that rule; ``violations`` has all of them. ``specs`` is a list given by the caller, so it is broadcast: joined by key, all orders of
    a venue would meet in one task.
    """
    d = orders.join(F.broadcast(specs), on, "left")
    q, p = F.col("quantity"), F.col("price")
    known = F.col("step_size").isNotNull()
    if auto_round:
        d = d.withColumn("normalized_quantity", F.when(known, round_to_step(q, F.col("step_size"))).otherwise(q))
        d = d.withColumn("normalized_price", F.when(known, round_to_step(p, F.col("tick_size"))).otherwise(p))
    else:
        d = d.withColumns({"normalized_quantity": q, "normalized_price": p})
    found = order_violations(F.col("normalized_quantity"), F.col("normalized_price"))
    d = d.withColumn("violations", F.when(known, found).otherwise(F.array().cast("array<string>")))
    d = d.withColumn("violation", F.try_element_at("violations", F.lit(1)))
    return d.withColumn("blocked", (F.size("violations") > 0) & F.lit(strict))


def licence_check(meta: DataFrame, *, as_of: Column, allowed: Sequence[str] = (), restricted: Sequence[str] = (),
                  usages: Sequence[str] = ("research", "backtesting", "internal"), regions: Sequence[str] = ()) -> DataFrame:
    """Issues ``severity:code`` and the compliant flag of each dataset's licence metadata.

    Columns read: license, usage, region (STRING) and expires_at (TIMESTAMP or NULL).
    """
    name = F.trim(F.coalesce("license", F.lit("")))
    usage = F.trim(F.coalesce("usage", F.lit("")))
    region = F.lower(F.trim(F.coalesce("region", F.lit(""))))
    low = F.lower(name)
    banned = low.isin([x.lower() for x in restricted]) if restricted else F.lit(False)
    unlisted = ~low.isin([x.lower() for x in allowed]) if allowed else F.lit(False)
    issues = any_of([
        (name == "", "error:license_missing"),
        ((name != "") & banned, "error:license_restricted"),
        ((name != "") & ~banned & unlisted, "warning:license_unlisted"),
        ((usage != "") & ~F.lower(usage).isin([u.lower() for u in usages]), "error:usage_not_permitted"),
        (usage == "", "warning:usage_unspecified"),
        (region.isin([r.lower() for r in regions]) if regions else F.lit(False), "error:region_restricted"),
        (F.col("expires_at") < as_of, "error:license_expired"),
    ])
    return meta.withColumn("issues", issues).withColumn(
        "compliant", ~F.exists("issues", lambda i: i.startswith("error")))


def fold_union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
