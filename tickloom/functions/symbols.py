"""Canonical venue and symbol spelling as native string expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.exprs import lookup

# Canonical venue -> accepted spellings.
VENUE_SPELLINGS = {
    "BINANCE": ("BINANCE", "BINANCE-SPOT", "BINANCE GLOBAL"),
    "BINANCE_FUTURES": ("BINANCE_FUTURES", "BINANCE-FUTURES", "BINANCE PERP", "BINANCEUSDM"),
    "COINBASE": ("COINBASE", "COINBASE-PRO", "GDAX"),
    "KRAKEN": ("KRAKEN",),
    "BITFINEX": ("BITFINEX",),
    "POLYGON": ("POLYGON", "POLYGON.IO"),
    "ALPACA": ("ALPACA", "ALPACA-MARKETS"),
    "CSV": ("CSV",),
}
# Quote currencies in matching order, contract markers, separators.
QUOTES = ("USDT", "USDC", "USD", "EUR", "GBP", "JPY", "AUD", "CAD", "CHF", "BTC", "ETH", "BNB", "BUSD", "TRY", "BRL")
DERIVATIVE_MARKS = ("PERP", "PERPETUAL", "SWAP", "FUT", "FUTURE", "FUTURES", "QUARTER", "THISWEEK", "NEXTWEEK")
SEPARATORS = "/-_:"


def venue_code(venue: Column) -> Column:
    """Trimmed upper-case venue, known spellings folded to the canonical code."""
    clean = F.upper(F.trim(venue))
    spelling = {s.upper(): code for code, all_ in VENUE_SPELLINGS.items() for s in all_}
    return F.coalesce(lookup(clean, spelling), clean)


def _legs(part: Column) -> Column:
    """One symbol part as an array of one or two legs."""
    by_quote = None
    for quote in QUOTES:
        base = F.regexp_extract(part, f"^(.+){quote}$", 1)
        pair = F.array(base, F.lit(quote))
        cond = part.endswith(quote) & (F.length(part) > len(quote))
        by_quote = F.when(cond, pair) if by_quote is None else by_quote.when(cond, pair)
    return F.coalesce(by_quote, F.array(part))


def symbol_code(symbol: Column, kind: Column | None = None) -> Column:
    """``BASE/QUOTE`` for spot, ``BASE-QUOTE-...`` for contracts, the plain code for one leg.

    Where separators are mixed, the first of ``SEPARATORS`` that occurs is the one that splits.
    """
    clean = F.upper(F.trim(symbol))
    splitter = None
    for sep in SEPARATORS:
        parts = F.filter(F.split(clean, f"[{sep}]"), lambda p: F.length(p) > 0)
        hit = F.contains(clean, F.lit(sep)) & (F.size(parts) > 0)
        splitter = F.when(hit, parts) if splitter is None else splitter.when(hit, parts)
    legs = F.coalesce(F.flatten(F.transform(splitter, _legs)), _legs(clean))
    marked = F.lit(False)
    for mark in DERIVATIVE_MARKS:
        marked = marked | F.contains(clean, F.lit(mark))
    hint = F.lower(F.trim(F.coalesce(kind, F.lit("")))) if kind is not None else F.lit("")
    contract = F.when(hint == "", marked).otherwise(
        hint.isin("future", "futures", "derivative", "derivatives", "perp"))
    return F.when(F.size(legs) == 1, legs[0]).when(contract, F.array_join(legs, "-")).otherwise(
        F.array_join(F.slice(legs, 1, 2), "/"))
