"""User functions: feature registry, wrapped functions, signal functions, rollup specs, gap loaders."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.axis import Axis

_FEATURES: dict[str, Callable[[str], Column]] = {}


def feature(name: str):
    """Register ``column name -> aggregate Column`` under a feature name."""
    def add(fn: Callable[[str], Column]):
        _FEATURES[name] = fn
        return fn
    return add


def feature_block(df: DataFrame, keys: Sequence[str], column: str, names: Sequence[str], metadata: Mapping[str, str] | None = None) -> DataFrame:
    """(keys, name, value, metadata) rows of several registered features, from a single aggregate."""
    wide = df.groupBy(*keys).agg(*[_FEATURES[n](column).cast("double").alias(n) for n in names])
    meta = F.create_map(*[F.lit(x) for kv in (metadata or {"column": column}).items() for x in kv])
    return wide.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])).alias("f")).select(
        *keys, "f.name", "f.value", meta.alias("metadata"))


def wrap_function(fn: Callable[[pd.Series], float]):
    """A plain ``series -> number`` function as a grouped aggregate; a group must fit one task."""
    def run(x: pd.Series) -> float:
        return float(fn(x))
    return F.pandas_udf(run, "double", F.PandasUDFType.GROUPED_AGG)


def user_signals(df: DataFrame, axis: Axis, price: str, fn: Callable, out: str = "signal") -> DataFrame:
    """``prices -> signals`` of equal length per key; the function sees a whole series, so a series must fit one task."""
    slim = df.select(*axis.keys, *axis.order, price)
    schema = T.StructType([*slim.schema.fields, T.StructField(out, T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(axis.order, kind="stable")
        got = fn(pdf[price].to_numpy())
        if len(got) != len(pdf):
            raise ValueError("a signal function must return one signal per price")
        return pdf.assign(**{out: [float(v) for v in got]})
    return slim.groupBy(*axis.keys).applyInPandas(run, schema)


@dataclass(frozen=True)
class RollupColumn:
    alias: str
    expression: str
    type: str


def rollup(df: DataFrame, keys: Sequence[Column | str], spec: Sequence[RollupColumn]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.expr(c.expression).cast(c.type).alias(c.alias) for c in spec])


def load_gaps(gaps: DataFrame, fetch: Callable[[dict], pd.DataFrame], schema: str) -> DataFrame:
    """Call ``fetch(gap)`` for every gap row in parallel tasks and return what it loads."""
    def run(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                yield fetch(row)
    return gaps.repartition(*gaps.columns).mapInPandas(run, schema)
