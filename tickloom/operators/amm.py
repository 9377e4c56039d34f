"""Adaptive prediction-error recurrence and the strategy on top of it.

The state is non-linear in its own past, so a series is walked in time order. Partitions are sorted by
series and time and streamed through in Arrow batches: a task keeps only the state of the series it is in, never the series.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.axis import Axis

f32 = np.float32


@dataclass(frozen=True)
class AmmParams:
    # fixed values: the published defaults
    ema_span: int = 32
    vol_lambda: float = 0.94
    alpha: float = 1.2
    beta: float = 0.6
    lambda_sync: float = 0.7
    eta_ricci: float = 0.5
    k_gain0: float = 2.0
    theta0: float = 0.0
    rho: float = 0.04
    lam_S: float = 0.92
    eta_k: float = 0.01
    eta_theta: float = 0.001
    pi_min: float = 1e-2
    pi_max: float = 1e3
    eps: float = 1e-8
    ent_bins: int = 32
    ent_xmin: float = -0.05
    ent_xmax: float = 0.05
    ent_decay: float = 0.975
    r_bar: float = 0.5


def keyed_scan(df: DataFrame, axis: Axis, start: Callable[[], object], step: Callable[[object, dict], tuple], columns: Mapping[str, T.DataType],
               inputs: list[str]) -> DataFrame:
    """Fold each series in order with the state that ``step`` keeps; emits one row per row with the extra ``columns``."""
    keys = list(axis.keys)
    kept = list(dict.fromkeys([*keys, *axis.order, *inputs]))
    slim = df.select(*kept)
    schema = T.StructType([slim.schema[c] for c in kept] + [T.StructField(n, t) for n, t in columns.items()])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            out = []
            ids = list(zip(*[pdf[k].tolist() for k in keys]))
            rows = zip(*[pdf[c].tolist() for c in inputs])
            for key, values in zip(ids, rows):
                if key != current:
                    current, state = key, start()
                state, emitted = step(state, dict(zip(inputs, values)))
                out.append(emitted)
            extra = pd.DataFrame(out, columns=list(columns), index=pdf.index)
            yield pd.concat([pdf, extra], axis=1)

    placed = slim.repartition(*keys).sortWithinPartitions(*keys, *axis.order)
    return placed.mapInPandas(run, schema)


def amm_start(p: AmmParams) -> dict:
    counts = np.full(p.ent_bins, f32(1e-6), dtype=f32)
    return {"ema": None, "var": f32(1e-6), "S": f32(0), "k": f32(p.k_gain0), "theta": f32(p.theta0), "counts": counts}


def amm_step(s: dict, x: float, R: float, kappa: float, H: float | None, p: AmmParams) -> dict:
    """Advance the state by one observation and report pulse, precision, valence, prediction, error and entropy."""
    x, R, kappa = f32(x), f32(R), f32(kappa)
    a = f32(2.0 / (1.0 + p.ema_span))
    s["ema"] = f32((1.0 - a) * (x if s["ema"] is None else s["ema"]) + a * x)
    pe = f32(x - s["ema"])
    lam = f32(p.vol_lambda)
    s["var"] = f32(lam * s["var"] + (1.0 - lam) * (pe * pe) + f32(p.eps))
    if H is None:
        s["counts"] *= f32(p.ent_decay)
        at = math.floor(float((x - p.ent_xmin) / (p.ent_xmax - p.ent_xmin + 1e-12)) * p.ent_bins)
        s["counts"][max(0, min(p.ent_bins - 1, at))] += f32(1.0)
        q = s["counts"] / f32(np.sum(s["counts"])) + f32(1e-12)
        H = float(f32(-np.sum(q * np.log(q))))
    base = f32(p.alpha / (float(s["var"]) + p.eps)) * f32(math.exp(-p.beta * H))
    pi = float(base * f32(1.0 + p.lambda_sync * (R - f32(p.r_bar))) * f32(math.exp(p.eta_ricci * float(kappa))))
    pi = min(max(pi, p.pi_min), p.pi_max)
    act = float(f32(math.tanh(float(s["k"]) * float(f32(pi) * pe))))
    burst = f32(max(0.0, act - float(s["theta"])))
    s["S"] = f32(p.lam_S) * s["S"] + f32(1.0 - p.lam_S) * burst
    drift = float(s["S"]) - p.rho
    s["k"] = f32(float(s["k"]) * math.exp(p.eta_k * drift))
    s["theta"] = f32(float(s["theta"]) + p.eta_theta * drift)
    sign = 0.0 if abs(act) < 1e-7 else math.copysign(1.0, act)
    return {"pulse": float(s["S"]), "precision": pi, "valence": sign, "pred": float(s["ema"]), "pe": float(pe), "entropy": H}


AMM_OUT = {n: T.DoubleType() for n in ("pulse", "precision", "valence", "pred", "pe", "entropy")}


def amm(df: DataFrame, axis: Axis, x: str, R: str, kappa: str, H: str | None = None, params: AmmParams = AmmParams()) -> DataFrame:
    """The recurrence per series; without ``H`` a decayed histogram entropy is kept in the state."""
    names = [x, R, kappa] + ([H] if H else [])

    def step(state, row):
        o = amm_step(state, row[x], row[R], row[kappa], row[H] if H else None, params)
        return state, tuple(o[n] for n in AMM_OUT)

    return keyed_scan(df, axis, lambda: amm_start(params), step, AMM_OUT, names)


@dataclass(frozen=True)
class ComboParams:
    # fixed values: the published defaults
    q_lo: float = 0.2
    q_hi: float = 0.8
    R_min: float = 0.45
    target_vol: float = 0.02
    max_leverage: float = 3.0
    min_pulse: float = 0.0
    max_pulse: float = 0.25


def _interpolated(values: list[float], q: float) -> float:
    at = (len(values) - 1) * q
    lo = math.floor(at)
    hi = min(lo + 1, len(values) - 1)
    return values[lo] + (values[hi] - values[lo]) * (at - lo)


def running_quantile(df: DataFrame, axis: Axis, column: str, q: float, out: str = "quantile") -> DataFrame:
    """Exact quantile of all values of the series so far. The sorted values of one series stay in its task's memory."""
    def step(state, row):
        bisect.insort(state, float(row[column]))
        return state, (_interpolated(state, q),)

    return keyed_scan(df, axis, list, step, {out: T.DoubleType()}, [column])


def combo(df: DataFrame, axis: Axis, x: str, R: str, kappa: str, params: AmmParams = AmmParams(), rules: ComboParams = ComboParams()) -> DataFrame:
    """Enter on a high pulse with synchrony, exit on a low one; size by pulse, precision and the running error."""
    out = {"action": T.StringType(), "direction": T.LongType(), "est_sigma": T.DoubleType(), "q_lo": T.DoubleType(), "q_hi": T.DoubleType(),
           "pulse": T.DoubleType(), "precision": T.DoubleType()}

    def step(state, row):
        s, seen, sigma = state
        o = amm_step(s, row[x], row[R], row[kappa], None, params)
        bisect.insort(seen, o["pulse"])
        lo, hi = _interpolated(seen, rules.q_lo), _interpolated(seen, rules.q_hi)
        action, side = "HOLD", 0
        if o["pulse"] <= lo:
            action = "EXIT_ALL"
        elif row[R] >= rules.R_min and o["pulse"] >= hi:
            side = 1 if o["valence"] > 0 else -1
            action = "ENTER_LONG" if side > 0 else "ENTER_SHORT"
        sigma = f32(0.98) * sigma + f32(0.02) * f32(abs(o["pe"]))
        return (s, seen, sigma), (action, side, float(sigma), lo, hi, o["pulse"], o["precision"])

    d = keyed_scan(df, axis, lambda: (amm_start(params), [], f32(1e-4)), step, out, [x, R, kappa])
    weight = F.least(F.greatest((F.col("pulse") - rules.min_pulse) / max(1e-8, rules.max_pulse - rules.min_pulse), F.lit(0.0)), F.lit(1.0))
    trust = F.greatest("precision", F.lit(1e-8))
    size = weight * trust / (1.0 + trust) * rules.target_vol / F.nullif(F.col("est_sigma"), F.lit(0.0)) * F.col("direction")
    size = F.when((F.col("direction") == 0) | (F.col("est_sigma") <= 1e-12), 0.0).otherwise(
        F.least(F.greatest(size, F.lit(-rules.max_leverage)), F.lit(rules.max_leverage)))
    return d.withColumn("size", size)


