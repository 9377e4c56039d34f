"""Price-level graphs and their curvature."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.exprs import clip, finite, ratio
from tickloom.operators.axis import Axis, row_numbers, settle, windowed
from tickloom.session import materialise


def price_edges(df: DataFrame, axis: Axis, price: str = "price", delta: float = 0.005) -> DataFrame:
    """Edge table (keys, src, dst, weight) between consecutive price levels; the last weight of an edge wins.

    A level is ``rint((p - p0) / (|p0| * delta))``. Distinct levels are bounded by the price range, not by the row count.
    """
    keys = list(axis.keys)
    d = df.select(*keys, *axis.order, finite(F.col(price).cast("double")).alias("__p")).filter(F.col("__p").isNotNull())
    order = F.struct(*axis.order)
    base = d.groupBy(*keys).agg(F.min_by("__p", order).alias("__p0"))
    d = d.join(base, keys)
    scale = F.when(F.col("__p0") == 0, 1.0).otherwise(F.abs("__p0"))
    d = d.withColumn("__lv", F.rint((F.col("__p") - F.col("__p0")) / (scale * delta)).cast("long"))

    def build(x, w):
        return x.withColumn("__pl", F.lag("__lv").over(w)).withColumn("__pp", F.lag("__p").over(w))

    steps = windowed(d, axis, build, back=1).filter(F.col("__pl").isNotNull())
    weight = F.abs(F.col("__p") - F.col("__pp")) + 1.0
    return steps.groupBy(*keys, F.least("__pl", "__lv").alias("src"), F.greatest("__pl", "__lv").alias("dst")).agg(
        F.max_by(weight, order).alias("weight"))


def curvature_of(edges: list[tuple[int, int, float]]) -> list[float]:
    """1 - W1/d per edge, W1 between the sorted, zero-padded neighbour weights, d the weighted distance."""
    near: dict[int, dict[int, float]] = {}
    for a, b, w in edges:
        near.setdefault(a, {})[b] = w
        near.setdefault(b, {})[a] = w
    mass = {}
    for node, nb in near.items():
        total = sum(nb.values())
        mass[node] = sorted(w / total for w in nb.values())

    def distance(a: int, b: int, direct: float) -> float:
        if direct <= 2.0:  # every edge weighs at least 1, so a detour costs 2 or more
            return direct
        best, queue = {a: 0.0}, [(0.0, a)]
        while queue:
            far, node = heapq.heappop(queue)
            if node == b:
                return far
            if far > best[node]:
                continue
            for nxt, w in near[node].items():
                step = far + w
                if step <= direct and step < best.get(nxt, float("inf")):
                    best[nxt] = step
                    heapq.heappush(queue, (step, nxt))
        return direct

    out = []
    for a, b, w in edges:
        if a == b:
            out.append(0.0)
            continue
        x, y = mass[a], mass[b]
        m = max(len(x), len(y))
        x, y = [0.0] * (m - len(x)) + x, [0.0] * (m - len(y)) + y
        out.append(1.0 - sum(abs(p - q) for p, q in zip(x, y)) / m / distance(a, b, w))
    return out


def edge_curvature(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Curvature of every edge. One graph per key goes to a task; its size is bounded by the number of price levels."""
    schema = T.StructType([*[edges.schema[k] for k in keys], *[edges.schema[c] for c in ("src", "dst", "weight")],
                           T.StructField("curvature", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["src", "dst"])
        rows = list(zip(pdf["src"].tolist(), pdf["dst"].tolist(), pdf["weight"].tolist()))
        return pdf.assign(curvature=curvature_of(rows))

    return edges.select(*keys, "src", "dst", "weight").groupBy(*keys).applyInPandas(run, schema)


def mean_curvature(edges: DataFrame, keys: Sequence[str], out: str = "mean_ricci") -> DataFrame:
    return edge_curvature(edges, keys).groupBy(*keys).agg(F.coalesce(F.avg("curvature"), F.lit(0.0)).alias(out))


def window_graphs(df: DataFrame, axis: Axis, price: str, volume: str | None = None, *, window: int = 100, snapshots: int = 10,
                  levels: int = 20, threshold: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Edges and one row of statistics per (key, window) for evenly spaced windows of each series.

    Rows are sent only to the windows they belong to; rows in no window are dropped before the shuffle.
    """
    keys = list(axis.keys)
    d = row_numbers(df.select(*keys, *axis.order, F.col(price).alias("__p"), (F.col(volume) if volume else F.lit(1.0)).alias("__v")), axis, "__n")
    size = d.groupBy(*keys).agg(F.max("__n").alias("__size"))
    d = d.join(size, keys).filter(F.col("__size") >= window).withColumn("__pos", F.col("__n") - 1)
    step = F.lit(window) if snapshots <= 1 else F.greatest(F.lit(1), F.floor((F.col("__size") - window) / (snapshots - 1)))
    last = F.floor((F.col("__size") - window) / step)
    low = F.greatest(F.lit(0), F.ceil((F.col("__pos") - window + 1) / step), last - snapshots + 1)
    high = F.least(last, F.floor(F.col("__pos") / step))
    d = d.withColumn("win", F.explode(F.when(high >= low, F.sequence(low.cast("long"), high.cast("long"))).otherwise(F.array().cast("array<bigint>"))))
    gk = [*keys, "win"]
    d = materialise(d, "windows")  # few rows per series; read several times below
    ends = d.groupBy(*gk).agg(F.min("__p").alias("__lo"), F.max("__p").alias("__hi"), F.avg("__p").alias("__mean"))
    d = d.join(ends, gk).withColumn("__p", F.coalesce(finite(F.col("__p").cast("double")), F.col("__mean")))
    width = (F.col("__hi") + 1e-6 - F.col("__lo")) / max(levels - 1, 1)
    level = clip(F.floor((F.col("__p") - F.col("__lo")) / width), 0, levels - 1)
    w = W.partitionBy(*gk).orderBy("__pos")  # a window has a fixed number of rows
    d = d.withColumn("__l", level).withColumn("__pl", F.lag("__l").over(w)).withColumn("__pv", F.lag("__v").over(w)).withColumn(
        "__dp", F.col("__p") - F.lag("__p").over(w))
    moves = d.filter(F.col("__pl") != F.col("__l")).groupBy(*gk, F.least("__l", "__pl").alias("src"), F.greatest("__l", "__pl").alias("dst")).agg(
        F.sum(F.greatest(F.coalesce(finite(F.col("__pv").cast("double")), F.lit(0.0)), F.lit(0.0))).alias("__w"))
    top = moves.groupBy(*gk).agg(F.max("__w").alias("__top"))
    edges = moves.join(top, gk).withColumn("weight", ratio(F.col("__w"), F.col("__top"))).filter(F.col("weight") > threshold).select(*gk, "src", "dst", "weight")
    stats = d.groupBy(*gk).agg(F.stddev_pop("__dp").alias("volatility"))
    return edges, stats


def lazy_walk_curvature(edges: DataFrame, keys: Sequence[str], alpha: float = 0.5) -> DataFrame:
    """1 - total variation between the lazy random walks at both ends of each edge.

    With degrees and the number of shared neighbours the sum over the support has a closed form.
    """
    keys, edges = list(keys), settle(edges)
    both = edges.select(*keys, F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(
        edges.select(*keys, F.col("dst").alias("a"), F.col("src").alias("b")))
    deg = both.groupBy(*keys, "a").agg(F.count(F.lit(1)).alias("deg"))
    e = edges.join(deg.select(*keys, F.col("a").alias("src"), F.col("deg").alias("dx")), [*keys, "src"]).join(
        deg.select(*keys, F.col("a").alias("dst"), F.col("deg").alias("dy")), [*keys, "dst"])
    shared = edges.join(both.select(*keys, F.col("a").alias("src"), F.col("b").alias("z")), [*keys, "src"]).join(
        both.select(*keys, F.col("a").alias("dst"), F.col("b").alias("z")), [*keys, "dst", "z"]).groupBy(*keys, "src", "dst").agg(
        F.count(F.lit(1)).alias("__c"))
    e = e.join(shared, [*keys, "src", "dst"], "left").withColumn("__c", F.coalesce("__c", F.lit(0)))
    px, py, c = (1 - alpha) / F.col("dx"), (1 - alpha) / F.col("dy"), F.col("__c")
    tv = 0.5 * (F.abs(alpha - py) + F.abs(px - alpha) + c * F.abs(px - py) + (F.col("dx") - 1 - c) * px + (F.col("dy") - 1 - c) * py)
    return e.select(*keys, "src", "dst", "weight", (1.0 - tv).alias("curvature"))


def temporal_summary(df: DataFrame, axis: Axis, price: str, volume: str | None = None, *, window: int = 100, snapshots: int = 10,
                     levels: int = 20, threshold: float = 0.1) -> DataFrame:
    """Temporal curvature, transition score, stability and persistence of each series' last snapshots.

    Edge sets of a window have at most levels² / 2 entries, so they are compared as arrays.
    """
    keys = list(axis.keys)
    gk = [*keys, "win"]
    edges, stats = window_graphs(df, axis, price, volume, window=window, snapshots=snapshots, levels=levels, threshold=threshold)
    curv = lazy_walk_curvature(edges, gk)
    per = curv.groupBy(*gk).agg(F.avg("curvature").alias("curv"), F.count(F.lit(1)).alias("n_edges"),
                                F.collect_set(F.col("src") * levels + F.col("dst")).alias("edges"),
                                F.size(F.collect_set("src")).alias("__x"),
                                F.size(F.array_union(F.collect_set("src"), F.collect_set("dst"))).alias("nodes"))
    none = F.array().cast("array<bigint>")
    s = stats.join(per, gk, "left").select(
        *gk, "volatility", F.coalesce("curv", F.lit(0.0)).alias("curv"), F.coalesce("n_edges", F.lit(0)).cast("double").alias("n_edges"),
        F.coalesce(F.col("edges").cast("array<bigint>"), none).alias("edges"), F.coalesce(2.0 * F.col("n_edges") / F.col("nodes"), F.lit(0.0)).alias("degree"))
    w = W.partitionBy(*keys).orderBy("win")  # at most ``snapshots`` rows per series
    old = F.lag("edges").over(w)
    union, common = F.size(F.array_union("edges", old)), F.size(F.array_intersect("edges", old))
    s = s.withColumns({
        "__new": old.isNotNull(),
        "__ged": ratio((union - common).cast("double"), union.cast("double"), 0.0),
        "__sim": F.when(union == 0, 1.0).otherwise(common / F.nullif(union.cast("double"), F.lit(0.0))),
        "__dc": F.col("curv") - F.lag("curv").over(w), "__de": F.abs(F.col("n_edges") - F.lag("n_edges").over(w)),
        "__dd": F.abs(F.col("degree") - F.lag("degree").over(w)), "__k": F.row_number().over(w), "__m": F.count(F.lit(1)).over(W.partitionBy(*keys))})
    n = F.count(F.lit(1))
    new = lambda c: F.when(F.col("__new"), c)
    scaled = lambda c: F.avg(F.abs(F.col(c))) / F.coalesce(F.nullif(F.max(F.abs(F.col(c))), F.lit(0.0)), F.lit(1.0))
    base = (scaled("__de") + scaled("__dd") + scaled("__dc")) / 3.0
    # the two newest windows against the earlier ones (or one against one)
    tail = F.when(F.col("__m") > 2, 2).otherwise(1)
    recent = F.avg(F.when(F.col("__k") > F.col("__m") - tail, F.col("volatility")))
    before = F.avg(F.when(F.col("__k") <= F.col("__m") - tail, F.col("volatility")))
    jump = clip(F.coalesce(recent - before, F.lit(0.0)), 0.0, 1.0)
    logistic = 1.0 / (1.0 + F.exp(-8.0 * (base - 0.15)))
    score = clip(logistic + 0.2 * clip(F.stddev_pop("__dc"), 0.0, 1.0) + 0.2 * jump, 0.0, 1.0)
    out = s.groupBy(*keys).agg(
        n.alias("snapshots"),
        F.coalesce(F.avg(new(-(F.col("__ged") + F.abs(F.col("__dc"))))), F.lit(0.0)).alias("temporal_curvature"),
        F.when(n < 3, 0.0).otherwise(score).alias("transition_score"),
        F.coalesce(F.avg(new(F.col("__sim"))), F.lit(1.0)).alias("stability"),
        F.collect_list("edges").alias("__all"))
    every = F.aggregate(F.slice("__all", F.lit(2), F.size("__all")), F.col("__all")[0], lambda a, e: F.array_union(a, e))
    always = F.aggregate(F.slice("__all", F.lit(2), F.size("__all")), F.col("__all")[0], lambda a, e: F.array_intersect(a, e))
    persist = F.when((F.col("snapshots") < 2) | (F.size(every) == 0), 1.0).otherwise(F.size(always) / F.nullif(F.size(every).cast("double"), F.lit(0.0)))
    return out.withColumn("persistence", persist).drop("__all")


def composite_signal(df: DataFrame, *, R: str, coherence: str, temporal: str, transition: str, static: str, strong: float = 0.8, proto: float = 0.4,
                     ricci_negative: float = -0.3, temporal_limit: float = -0.2, transition_limit: float = 0.7, min_confidence: float = 0.5) -> DataFrame:
    """Market phase with confidence, entry, exit and risk columns, added one upon the other."""
    # fixed values: the limits above, and the factors of the phases below
    r, coh, kt, tr, st = (F.col(c) for c in (R, coherence, temporal, transition, static))
    phase = F.col("phase")
    d = df.withColumn("phase", F.when((r > strong) & (st < ricci_negative) & (kt < temporal_limit) & (tr < 0.5), "strong_emergent")
                      .when(tr > transition_limit, "transition").when((r > proto) & (r <= strong) & (tr < 0.5) & (st < 0), "proto_emergent")
                      .when((r > proto) & ((st > 0) | (kt > 0)), "post_emergent").otherwise("chaotic"))
    factor = F.when(phase == "strong_emergent", 1.0 + r).when(phase == "chaotic", 0.5).when(phase == "transition", 0.5 + 0.5 * tr).otherwise(1.0)
    near = F.least(F.abs(r - strong), F.abs(r - proto)) < 0.1
    unit = lambda c: F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))
    d = d.withColumn("confidence", unit(coh * factor * F.when(near, 0.8).otherwise(1.0)))
    conf = F.col("confidence")
    lean = F.when(phase == "strong_emergent", unit(-kt)).when(phase == "proto_emergent", 0.5 * r).when(phase == "post_emergent", -0.3).otherwise(0.0)
    base = F.when(phase == "strong_emergent", 1.0 + 0.5 * conf).when(phase == "proto_emergent", 0.7 + 0.3 * conf).when(phase == "post_emergent", 0.2).otherwise(0.3)
    return d.withColumns({
        "entry_signal": F.when(conf < min_confidence, 0.0).otherwise(F.greatest(F.least(lean * conf, F.lit(1.0)), F.lit(-1.0))),
        "exit_signal": F.when(phase == "post_emergent", 0.7).when(phase == "transition", unit(tr)).when(phase == "chaotic", 0.5).when(
            phase == "strong_emergent", 0.1).otherwise(0.3),
        "risk_multiplier": F.greatest(F.least(base * coh, F.lit(2.0)), F.lit(0.1))})


def phase_flag(R: Column, dH: Column, kappa: Column, *, proto_max: float = 0.4, slope_min: float = 0.0, emergent_min: float = 0.75,
               slope_max: float = -1e-8, kappa_max: float = -1e-8, band: tuple[float, float] = (0.4, 0.7)) -> Column:
    low, high = band
    return (F.when((R < proto_max) & (dH > slope_min), "proto").when(R.between(low, high) & (dH <= 0), "precognitive")
            .when((R >= emergent_min) & (dH <= slope_max) & (kappa <= kappa_max), "emergent")
            .when((R <= high) & (dH > slope_min), "post-emergent").otherwise("neutral"))


def transition_blend(R: Column, dH: Column, kappa: Column) -> Column:
    return 0.4 * R - 0.3 * dH - 0.3 * kappa


def direction_index(skew: Column, curvature_change: Column, bias: Column, weights=(0.5, 0.3, 0.2)) -> Column:
    return weights[0] * skew + weights[1] * curvature_change + weights[2] * bias


def ism(entropy_rate: Column, energy: Column, eta: float = 1.0) -> Column:
    return ratio(eta * entropy_rate, energy, 0.0)
