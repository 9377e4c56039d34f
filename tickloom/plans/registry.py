"""Named queries over the given tables, each with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.plans.tables import SQL_TABLES, Tables

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def with_tables(sql: str) -> str:
    """Put the definitions of the domain tables ``sql`` names in front of it as CTEs."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name, body in SQL_TABLES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                need(body)
                needed.append(name)

    need(sql)
    heads = ", ".join(f"{n} AS ({SQL_TABLES[n].strip()})" for n in needed)
    body = sql.strip()
    if not heads:
        return body
    for opening in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(opening):
            return f"{opening}{heads}, {body[len(opening):]}"
    return f"WITH {heads} {body}"


def rounded_twice(sql: str) -> str:
    """Make every ``round(x, n)`` round ``x`` as a decimal of n + 3 digits.

    Averages of cents often end exactly on a rounding boundary, where the last bit of a float sum decides. As a decimal the boundary is met
    exactly and goes up in every engine.
    """
    out, i = "", 0
    while (at := sql.find("round(", i)) >= 0:
        depth, j, comma = 1, at + 6, -1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            comma = j if sql[j] == "," and depth == 1 else comma
            j += 1
        digits = int(sql[comma + 1:j - 1])
        out += sql[i:at] + f"CAST(round(CAST(({rounded_twice(sql[at + 6:comma])}) AS DECIMAL(38, {digits + 3})), {digits}) AS DOUBLE)"
        i = j
    return out + sql[i:]


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            _SQL[name] = with_tables(sql)
        return fn
    return register


def _load() -> None:
    import importlib
    import pkgutil

    import tickloom.plans as plans
    for module in pkgutil.iter_modules(plans.__path__):
        importlib.import_module(f"tickloom.plans.{module.name}")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
