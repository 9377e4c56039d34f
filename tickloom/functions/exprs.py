"""Column expressions shared by the operators. All of them stay inside generated code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit_if(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def clip(x: Column, low=None, high=None) -> Column:
    """``x`` limited to [low, high]; NULL stays NULL."""
    out = x
    if low is not None:
        out = F.when(out < low, lit_if(low)).otherwise(out)
    if high is not None:
        out = F.when(out > high, lit_if(high)).otherwise(out)
    return out


def ratio(a: Column, b: Column, empty=None) -> Column:
    """``a / b``; ``empty`` (default NULL) where b is 0 or NULL."""
    out = a / F.nullif(b, F.lit(0.0))
    return out if empty is None else F.coalesce(out, lit_if(empty))


def quotient(a: Column, b: Column) -> Column:
    """``a / b`` as floating point has it: a zero divisor gives an infinity, or NaN for 0 / 0; NULL stays NULL."""
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(a / F.nullif(b, F.lit(0.0)))


def natural_log(x: Column) -> Column:
    """``ln(x)`` as floating point has it: minus infinity at 0, NaN below."""
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.log(x))


def round_scaled(x: Column, digits: int) -> Column:
    """``x`` rounded half away from zero as ``round(x * 10^digits) / 10^digits``.

    Spark rounds the shortest decimal that names the float, so a float just below a half goes up; here its own value decides.
    """
    scale = float(10 ** digits)
    y = F.abs(x) * scale
    whole = F.floor(y)
    near = F.when(y - whole >= 0.5, whole + 1).otherwise(whole) / scale
    return F.when(y < 1e15, F.when(x < 0, -near).otherwise(near)).otherwise(x)


def finite(x: Column) -> Column:
    """NULL for NaN and infinities, which pandas and numpy treat as missing."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def micros(ts) -> Column:
    return F.unix_micros(ts if isinstance(ts, Column) else F.col(ts))


def seconds(ts) -> Column:
    """Epoch seconds as DOUBLE."""
    return micros(ts) / F.lit(1e6)


def time_bin(ts, width: float) -> Column:
    """Start of the epoch-anchored bin of ``width`` seconds that ``ts`` falls in."""
    step = int(round(width * 1e6))
    at = micros(ts)
    return F.timestamp_micros(at - F.pmod(at, F.lit(step)))


def any_of(pairs: Sequence[tuple[Column, str]]) -> Column:
    """Array of the labels whose condition holds, in the given order."""
    marks = [F.when(cond, F.lit(label)) for cond, label in pairs]
    return F.array_compact(F.array(*marks))


def ladder(steps: Sequence[tuple[Column, object]], otherwise) -> Column:
    """First matching step wins."""
    out = reduce(lambda acc, s: acc.when(s[0], lit_if(s[1])), steps[1:], F.when(steps[0][0], lit_if(steps[0][1])))
    return out.otherwise(lit_if(otherwise))


def lookup(x: Column, table: Mapping[str, str]) -> Column:
    """``table[x]`` or NULL, as a literal map (fixed small tables only)."""
    flat = [F.lit(v) for kv in table.items() for v in kv]
    return F.try_element_at(F.create_map(*flat), x)


def join_back(df, stats, keys: Sequence[str], how: str = "inner"):
    """``df`` with the columns of per-key ``stats``; a NULL key meets the NULL key, so no row is lost. Without keys ``stats`` is one row."""
    if not keys:
        return df.crossJoin(F.broadcast(stats))
    right = stats.withColumnsRenamed({k: f"__key_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys])
    return df.join(right, same, how).drop(*[f"__key_{k}" for k in keys])


def population_skew(n: Column, mean: Column, m2: Column, m3: Column) -> Column:
    return ratio(m3 / n, F.pow(m2 / n, 1.5), 0.0)
