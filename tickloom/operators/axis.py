"""The series axis, and ordered windows that stay bounded when one series is huge.

``Window.partitionBy(symbol).orderBy(ts)`` puts a whole symbol into one task. If one symbol holds a
third of the table that task never ends, and AQE cannot split it. So every ordered operator runs
on *blocks*: runs of consecutive time buckets of one series holding about ``block_rows`` rows.

* Frames over a fixed number of rows get the rows they need from neighbouring blocks as a halo.
* Unbounded frames run inside the block and add a carry folded from one row per earlier block.

The map from time bucket to block is built from a count per (series, bucket), which combines map
side. It holds rows only for series larger than one block, so for tables without hot series it is
empty and joins with it are pruned at run time; an operator then costs the combining count and the
shuffle into blocks. With hot series, rows are shuffled once more where Spark does not broadcast the map.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK, HALO, HOT, BUCKET = "__block", "__halo", "__hot", "__bucket"


@dataclass(frozen=True)
class Axis:
    """Which columns name a series and which order its rows.

    ``seq`` breaks ties of ``ts`` so that "last" is always well defined. ``grain`` is the width of the
    time bucket a series may be cut at: seconds for timestamps, plain units when ``numeric``.
    """

    keys: Sequence[str]
    ts: str = "ts"
    seq: Sequence[str] = ()
    grain: float = 3600.0
    block_rows: int = 1_000_000
    numeric: bool = False

    def __post_init__(self):
        if not self.keys:
            raise ValueError("an ordered operator needs at least one series key")

    @property
    def order(self) -> list[str]:
        return [self.ts, *self.seq]

    def bucket(self) -> Column:
        position = F.col(self.ts) if self.numeric else F.unix_micros(F.col(self.ts).cast("timestamp")) / 1e6
        return F.floor(position / F.lit(float(self.grain))).cast("long")

    def by(self, *keys: str) -> "Axis":
        return replace(self, keys=tuple(keys))


def block_map(df: DataFrame, axis: Axis, back: int = 0, fwd: int = 0) -> DataFrame:
    """(keys, bucket) -> own block and the range of blocks the bucket must be visible in.

    Only buckets of series that span several blocks are listed.
    """
    keys = list(axis.keys)
    counts = (df.select(*keys, axis.bucket().alias(BUCKET)).groupBy(*keys, BUCKET)
              .agg(F.count(F.lit(1)).alias("__n")))
    series = W.partitionBy(*keys)
    in_order = series.orderBy(BUCKET)
    m = counts.withColumn(
        "__start", F.coalesce(F.sum("__n").over(in_order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    m = m.withColumn("__total", F.sum("__n").over(series)).filter(F.col("__total") > axis.block_rows)
    m = m.withColumn("__cell", F.floor(F.col("__start") / axis.block_rows))
    m = m.withColumn(BLOCK, F.dense_rank().over(series.orderBy("__cell")) - 1)
    first = last = F.col(BLOCK)
    if back > 0:
        reach = F.max(BLOCK).over(series.orderBy("__start").rangeBetween(0, back - 1))
        m = m.withColumn("__reach", reach)
        last = F.greatest(F.col(BLOCK), F.coalesce(F.lead("__reach").over(in_order), F.col(BLOCK)))
    if fwd > 0:
        m = m.withColumn("__end", F.col("__start") + F.col("__n"))
        m = m.withColumn("__reach_back", F.min(BLOCK).over(series.orderBy("__end").rangeBetween(-(fwd - 1), 0)))
        first = F.least(F.col(BLOCK), F.coalesce(F.lag("__reach_back").over(in_order), F.col(BLOCK)))
    return m.select(*keys, BUCKET, F.col(BLOCK).alias("__own"), first.alias("__first"), last.alias("__last"))


MAX_LEAVES = 6


def settle(df: DataFrame) -> DataFrame:
    """Write out a deep plan before it is referenced again.

    Every ordered step reads its input for the rows and for the block map; chained steps would multiply the scans.
    Once a plan has more than ``MAX_LEAVES`` sources its rows are written to the shared scratch folder, which keeps
    the work linear and cuts the lineage.
    """
    if df.isStreaming or df._jdf.queryExecution().analyzed().collectLeaves().size() <= MAX_LEAVES:
        return df
    from tickloom.session import materialise
    return materialise(df, "series")


def split(df: DataFrame, axis: Axis, back: int = 0, fwd: int = 0) -> DataFrame:
    """Add the block column and, for frames of ``back``/``fwd`` rows, the halo copies.

    A frame that is already split and needs no halo is returned as it is, so several running values can share a split.
    """
    keys = list(axis.keys)
    df = settle(df)
    if BLOCK in df.columns:
        if not (back or fwd):
            return df
        df = unsplit(df)
    cut = (df.withColumn(BUCKET, axis.bucket())
           .join(block_map(df, axis, back, fwd), [*keys, BUCKET], "left"))
    hot = F.col("__own").isNotNull()
    own = F.coalesce(F.col("__own"), F.lit(0)).cast("long")
    if back or fwd:
        spread = F.when(~hot, F.array(F.lit(0).cast("long"))).otherwise(
            F.sequence(F.col("__first").cast("long"), F.col("__last").cast("long")))
        cut = cut.withColumn(BLOCK, F.explode(spread)).withColumn(HALO, F.col(BLOCK) != own)
    else:
        cut = cut.withColumn(BLOCK, own).withColumn(HALO, F.lit(False))
    return cut.select(*df.columns, BLOCK, HALO, hot.alias(HOT))


def unsplit(df: DataFrame) -> DataFrame:
    return df.drop(BLOCK, HALO, HOT)


def block_window(axis: Axis, desc: bool = False) -> WindowSpec:
    order = [F.col(c).desc() if desc else F.col(c).asc() for c in axis.order]
    return W.partitionBy(*axis.keys, BLOCK).orderBy(*order)


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def windowed(df: DataFrame, axis: Axis, build: Callable[[DataFrame, WindowSpec], DataFrame],
             *, back: int = 0, fwd: int = 0) -> DataFrame:
    """Run ``build`` over block windows; it may look ``back`` rows behind and ``fwd`` ahead."""
    out = build(split(df, axis, back, fwd), block_window(axis))
    return unsplit(out.filter(~F.col(HALO)))


def _combine(kind: str, before: Column, here: Column) -> Column:
    if kind in ("sum", "count"):
        return F.when(before.isNull(), here).when(here.isNull(), before).otherwise(before + here)
    if kind == "max":
        return F.greatest(before, here)
    if kind == "min":
        return F.least(before, here)
    if kind == "last":
        return F.coalesce(here, before)
    return F.coalesce(before, here)


def running(df: DataFrame, axis: Axis, aggs: Mapping[str, tuple], *, exclusive: bool = False) -> DataFrame:
    """Cumulative values per series: ``{name: (kind, value)}`` or ``(kind, value, True)`` to run from the end.

    Kinds are ``sum|count|max|min|first|last``; first and last skip NULL. ``exclusive`` leaves out the current row.
    Given a split frame the result stays split.
    """
    keys, shared = list(axis.keys), BLOCK in df.columns
    specs = {n: (a[0], a[1], len(a) > 2 and bool(a[2])) for n, a in aggs.items()}
    rows = split(df, axis)
    plain = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}
    skip_null = {"last": lambda c: F.last(c, ignorenulls=True), "first": lambda c: F.first(c, ignorenulls=True)}
    inside_fold, carry_fold = {**plain, **skip_null}, {**plain, **skip_null, "count": F.sum}
    totals, carries, local = [], [], []
    for name, (kind, value, reverse) in specs.items():
        if kind in plain:
            totals.append(plain[kind](value).alias(f"__tot_{name}"))
        else:
            at = F.when(value.isNotNull(), F.struct(*axis.order))
            chooser = F.max_by if (kind == "last") != reverse else F.min_by
            totals.append(chooser(value, at).alias(f"__tot_{name}"))
        over = W.partitionBy(*keys).orderBy(F.col(BLOCK).desc() if reverse else F.col(BLOCK).asc())
        carries.append(carry_fold[kind](F.col(f"__tot_{name}")).over(
            over.rowsBetween(W.unboundedPreceding, -1)).alias(f"__pre_{name}"))
        frame = block_window(axis, desc=reverse).rowsBetween(W.unboundedPreceding, -1 if exclusive else 0)
        local.append(inside_fold[kind](value).over(frame).alias(f"__loc_{name}"))
    blocks = rows.filter(HOT).groupBy(*keys, BLOCK).agg(*totals)
    carry = blocks.select(*keys, BLOCK, *carries)
    out = rows.select("*", *local).join(carry, [*keys, BLOCK], "left")
    keep = [c for c in rows.columns if c not in aggs]
    out = out.select(*keep, *[
        _combine(kind, F.col(f"__pre_{name}"), F.col(f"__loc_{name}")).alias(name) for name, (kind, _, _) in specs.items()])
    return out if shared else unsplit(out)


def row_numbers(df: DataFrame, axis: Axis, name: str = "rn") -> DataFrame:
    """1-based position of each row in its series (split frames stay split)."""
    return running(df, axis, {name: ("count", F.lit(1))})


def ewm(df: DataFrame, axis: Axis, columns: Mapping[str, tuple[str, float]], *,
        min_periods: Mapping[str, int] | None = None) -> DataFrame:
    """Exponentially weighted means ``{out: (column, alpha)}`` of the recursive kind.

    ``y = (decay*y' + alpha*x) / (decay + alpha)`` over non-NULL x, where ``decay`` is ``(1-alpha)`` to the number of
    rows since the last non-NULL one; y' seeds with the first value and NULL rows repeat y'. The recurrence is
    linear, so inside a cell whose total decay stays representable it is a running sum of ``b*x/A`` with A the
    running product of the decays; a cell needs only the end value of the cell in front of it, since older weight is below 1e-60.

    Given a split frame the result stays split, so means of means share one. A block runs as if its first value were the series' first. What that gets wrong is a shift of its start, which
    fades with A; the shifts follow from one row of each block (``_shifts``), as does the number of values before the block.
    """
    need = min_periods or {}
    keys = list(axis.keys)
    d, w = split(df, axis), block_window(axis)
    before, upto = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("__rn", F.row_number().over(w))
    stats = [F.count("*").alias("rows")]
    for out, (column, alpha) in columns.items():
        x, keep, p = F.col(column), 1.0 - alpha, f"__{out}_"
        if keep <= 0:
            d = d.withColumn(p + "s", F.lit(0.0)).withColumn(p + "y", F.last(x, ignorenulls=True).over(upto))
        else:
            prev = F.last(F.when(x.isNotNull(), F.col("__rn")), ignorenulls=True).over(before)
            d = d.withColumn(p + "gap", F.when(x.isNotNull(), F.col("__rn") - prev))
            decay = F.pow(F.lit(keep), F.col(p + "gap"))
            d = d.withColumn(p + "la", F.when(F.col(p + "gap").isNotNull(),
                                              F.log(decay / (decay + F.lit(alpha)))).otherwise(F.lit(0.0)))
            d = d.withColumn(p + "la", F.greatest(F.col(p + "la"), F.lit(-700.0)))  # a gap whose decay is 0 starts anew
            d = d.withColumn(p + "s", F.sum(p + "la").over(upto))
            d = d.withColumn(p + "cell", F.floor(-F.col(p + "s") / F.lit(140.0)))
            cell = W.partitionBy(*keys, BLOCK, p + "cell").orderBy(*axis.order)
            base = F.col(p + "cell") * F.lit(140.0)
            weight = F.when(F.col(p + "gap").isNull(), F.lit(1.0)).otherwise(
                F.lit(alpha) / (F.pow(F.lit(keep), F.col(p + "gap")) + F.lit(alpha)))
            term = F.when(x.isNotNull(), weight * x * F.exp(-(F.col(p + "s") + base)))
            d = d.withColumn(p + "c", F.sum(term).over(cell.rowsBetween(W.unboundedPreceding, 0)))
            d = d.withColumn(p + "c", F.col(p + "c") * F.exp(F.col(p + "s") + base))
            d = d.withColumn(p + "end", F.when(
                F.lead(p + "cell").over(w) != F.col(p + "cell"), F.struct(
                    F.col(p + "c").alias("y"), F.col(p + "s").alias("s"))))
            d = d.withColumn(p + "in", F.last(p + "end", ignorenulls=True).over(before))
            d = d.withColumn(p + "y", F.when(F.col(p + "in").isNull() | F.col(p + "in.y").isNull(), F.col(p + "c")).otherwise(
                F.coalesce(F.col(p + "c"), F.lit(0.0)) + F.col(p + "in.y") * F.exp(F.col(p + "s") - F.col(p + "in.s"))))
        d = d.withColumn(p + "n", F.count(x).over(upto))
        held = F.when(x.isNotNull(), F.col("__rn"))
        stats.append(F.struct(F.min(held).alias("first"), F.max(held).alias("last"), F.count(x).alias("n"), F.min_by(x, held).alias("x"),
                              F.max_by(p + "y", "__rn").alias("y"), F.max_by(p + "s", "__rn").alias("s")).alias(out))
    blocks = d.filter(HOT).groupBy(*keys, BLOCK).agg(*stats)
    d = d.join(_shifts(blocks, keys, {out: alpha for out, (_, alpha) in columns.items()}), [*keys, BLOCK], "left")
    values = {}
    for out in columns:
        p = f"__{out}_"
        y = F.coalesce(F.col(p + "y") + F.exp(F.col(p + "s")) * F.coalesce(F.col(f"__before.{out}.shift"), F.lit(0.0)), F.col(f"__before.{out}.y"))
        enough = F.col(p + "n") + F.coalesce(F.col(f"__before.{out}.n"), F.lit(0)) >= need.get(out, 1)
        values[out] = F.when(enough, y)
    return d.select(*[c for c in df.columns if c not in values], *[v.alias(out) for out, v in values.items()])


def _shifts(blocks: DataFrame, keys: Sequence[str], alphas: Mapping[str, float]) -> DataFrame:
    """(keys, block, __before): for each mean, how far a block's first value is from the true mean there, and value and count before the block.

    Folds the blocks of a series in order; there is one row for each ``block_rows`` rows of it.
    """
    ordered = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(BLOCK, "rows", *alphas))).alias("__b"))

    def fold(out: str, alpha: float) -> Column:
        entry = "array<struct<shift:double,y:double,n:bigint>>"
        zero = F.struct(F.lit(None).cast("double").alias("y"), F.lit(0).cast("bigint").alias("gap"), F.lit(0).cast("bigint").alias("n"), F.array().cast(entry).alias("done"))

        def step(s: Column, b: Column) -> Column:
            own = b[out]
            decay = F.pow(F.lit(1.0 - alpha), s["gap"] + own["first"])
            shift = F.when(s["y"].isNull() | (own["n"] == 0), F.lit(0.0)).otherwise(decay / (decay + F.lit(alpha)) * (s["y"] - own["x"]))
            here = F.struct(shift.alias("shift"), s["y"].alias("y"), s["n"].alias("n"))
            return F.struct(
                F.when(own["n"] == 0, s["y"]).otherwise(own["y"] + F.exp(own["s"]) * shift).alias("y"),
                F.when(own["n"] == 0, s["gap"] + b["rows"]).otherwise(b["rows"] - own["last"]).cast("bigint").alias("gap"),
                (s["n"] + own["n"]).alias("n"), F.concat(s["done"], F.array(here)).alias("done"))

        return F.aggregate("__b", zero, step, lambda s: s["done"]).alias(out)

    folded = ordered.select(*keys, F.transform("__b", lambda b: b[BLOCK]).alias(BLOCK), *[fold(o, a) for o, a in alphas.items()])
    each = folded.select(*keys, F.explode(F.arrays_zip(BLOCK, *alphas)).alias("__before"))
    return each.select(*keys, F.col(f"__before.{BLOCK}").alias(BLOCK), "__before")
