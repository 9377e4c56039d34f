"""Feature tables: retention, integrity, offline/online parity, lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.exprs import micros, time_bin
from tickloom.operators.bars import keep_last


def retain(df: DataFrame, entity: Sequence[str], ts: str, *, ttl: float | None = None, as_of=None, max_versions: int | None = None,
           seq: Sequence[str] = ()) -> DataFrame:
    """Rows younger than the TTL, then the newest versions of each entity.

    The rank filter is pushed below the shuffle by Spark, so a hot entity ships only its newest rows.
    """
    if ttl is not None:
        now = F.lit(as_of).cast("timestamp") if as_of is not None else F.current_timestamp()
        df = df.filter(micros(ts) >= micros(now) - int(ttl * 1e6))
    if max_versions is not None:
        w = W.partitionBy(*entity).orderBy(F.col(ts).desc(), *[F.col(s).desc() for s in seq])
        df = df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= max_versions).drop("__rn")
    return df


def integrity(df: DataFrame, name: str) -> DataFrame:
    """Row count and an order-free content hash (sum and xor of row hashes)."""
    text = F.to_json(F.struct(*sorted(df.columns)))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.select(h.alias("h"), F.xxhash64(text).alias("x")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("h").alias("hash_sum"), F.bit_xor("x").alias("hash_xor")).withColumn("table", F.lit(name))


def integrity_report(offline: DataFrame, online: DataFrame) -> DataFrame:
    a, b = integrity(offline, "offline"), integrity(online, "online")
    return a.select(F.col("rows").alias("offline_rows"), F.col("hash_sum").alias("__s"), F.col("hash_xor").alias("__x")).crossJoin(
        b.select(F.col("rows").alias("online_rows"), "hash_sum", "hash_xor")).select(
        "offline_rows", "online_rows", (F.col("offline_rows") - F.col("online_rows")).alias("row_diff"),
        (F.col("__s").eqNullSafe(F.col("hash_sum")) & F.col("__x").eqNullSafe(F.col("hash_xor"))).alias("hash_match"))


def prepare(df: DataFrame, entity: Sequence[str], ts: str, seq: Sequence[str], floor: float | None = None) -> DataFrame:
    """One row per (entity, time), the last one; times floored to ``floor`` seconds first."""
    if floor:
        df = df.withColumn(ts, time_bin(ts, floor))
    return keep_last(df, [*entity, ts], seq)


def parity_report(offline: DataFrame, online: DataFrame, entity: Sequence[str], ts: str, values: Sequence[str], *,
                  tolerance: float | None = None, max_skew: float | None = None, mode: str = "append",
                  allow_schema_evolution: bool = False) -> DataFrame:
    """One row: inserted, removed, updated keys, largest drift, clock skew, column changes and what blocks the write.

    A changed text value counts as drift 1. ``tolerance`` NULL means numeric changes never count as updates.
    """
    keys = [*entity, ts]
    added = sorted(set(offline.columns) - set(online.columns))
    removed = sorted(set(online.columns) - set(offline.columns))
    shared = [v for v in values if v in offline.columns and v in online.columns]
    a = offline.select(*keys, F.lit(True).alias("__a"), *[F.col(v).alias(f"__a_{v}") for v in shared])
    b = online.select(*keys, F.lit(True).alias("__b"), *[F.col(v).alias(f"__b_{v}") for v in shared])
    m = a.join(b, keys, "full_outer")
    both = F.col("__a") & F.col("__b")
    diffs, exceed = [], F.lit(False)
    for v in shared:
        x, y = F.col(f"__a_{v}"), F.col(f"__b_{v}")
        if isinstance(offline.schema[v].dataType, T.NumericType):
            d = F.coalesce(F.abs(x - y), F.lit(0)).cast("double")
            over = d > (float("inf") if tolerance is None else tolerance)
        else:
            over = ~x.eqNullSafe(y)
            d = F.when(over, 1.0).otherwise(0.0)
        diffs.append(F.when(both, d))
        exceed = exceed | over
    drift = F.greatest(*diffs) if len(diffs) > 1 else diffs[0] if diffs else F.lit(None).cast("double")
    rep = m.agg(
        F.count_if(F.col("__b").isNull()).alias("inserted"), F.count_if(F.col("__a").isNull()).alias("removed"),
        F.count_if(both & exceed).alias("updated"), F.max(drift).alias("max_drift"),
        ((micros(F.max(F.when(F.col("__a"), F.col(ts)))) - micros(F.max(F.when(F.col("__b"), F.col(ts))))) / 1e6).alias("clock_skew"),
        F.count_if(F.col("__b")).alias("__online"))
    changed = bool(added or removed) and not allow_schema_evolution
    block = F.when(F.lit(changed) & (F.col("__online") > 0), "schema")
    if max_skew is not None:
        block = block.when(F.abs("clock_skew") > max_skew, "clock_skew")
    if mode == "append":
        block = block.when(F.col("updated") > 0, "append_updates")
    if tolerance is not None:
        block = block.when(F.col("max_drift") > tolerance, "drift")
    return rep.withColumns({
        "columns_added": F.lit(",".join(added)), "columns_removed": F.lit(",".join(removed)), "blocked_by": block}).drop("__online")


def rows_to_write(offline: DataFrame, online: DataFrame, entity: Sequence[str], ts: str, mode: str = "append") -> DataFrame:
    return offline if mode == "overwrite" else offline.join(online.select(*entity, ts), [*entity, ts], "left_anti")


def lookup_page(df: DataFrame, ts: str, *, cursor=None, limit: int = 100, where=None, tie: Sequence[str] = ()) -> DataFrame:
    """Newest first, strictly before the cursor."""
    if where is not None:
        df = df.filter(where)
    if cursor is not None:
        df = df.filter(F.col(ts) < F.lit(cursor).cast("timestamp"))
    return df.orderBy(F.col(ts).desc(), *[F.col(c).desc() for c in tie]).limit(limit)
