"""Null-safe predicates as Columns.

In a filter a null result drops the row, as false does, so plain comparisons stay bare and reach the scan; every
negation (not_, ne, not_in, falsy) first turns null into false.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def eq(c: Column, v) -> Column:
    return c.eqNullSafe(F.lit(v))


def ne(c: Column, v) -> Column:
    return ~c.eqNullSafe(F.lit(v))


def gt(c: Column, v) -> Column:
    return c > F.lit(v)


def gte(c: Column, v) -> Column:
    return c >= F.lit(v)


def lt(c: Column, v) -> Column:
    return c < F.lit(v)


def lte(c: Column, v) -> Column:
    return c <= F.lit(v)


def isin(c: Column, values) -> Column:
    known = [v for v in values if v is not None]
    out = c.isin(known) if known else F.lit(False)
    return out | c.isNull() if None in list(values) else out


def not_in(c: Column, values) -> Column:
    return ~_sure(isin(c, values))


def between(c: Column, low, high) -> Column:
    return c.between(F.lit(low), F.lit(high))


def _text(c: Column, v: str, kind: T.DataType | None, how: str, insensitive: bool) -> Column:
    if kind is not None and not isinstance(kind, T.StringType):
        return F.lit(False)
    c, v = (F.lower(c), v.lower()) if insensitive else (c, v)
    return getattr(c, how)(v)


def contains(c: Column, v: str, kind=None, insensitive: bool = False) -> Column:
    return _text(c, v, kind, "contains", insensitive)


def starts_with(c: Column, v: str, kind=None, insensitive: bool = False) -> Column:
    return _text(c, v, kind, "startswith", insensitive)


def ends_with(c: Column, v: str, kind=None, insensitive: bool = False) -> Column:
    return _text(c, v, kind, "endswith", insensitive)


def is_null(c: Column) -> Column:
    return c.isNull()


def is_not_null(c: Column) -> Column:
    return c.isNotNull()


def truthy(c: Column, kind: T.DataType) -> Column:
    """False for null, false, 0, NaN and the empty string."""
    if isinstance(kind, T.BooleanType):
        return c
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (c != 0) & ~F.isnan(c)
    if isinstance(kind, T.NumericType):
        return c != 0
    if isinstance(kind, T.StringType):
        return c != ""
    return c.isNotNull()


def falsy(c: Column, kind: T.DataType) -> Column:
    return ~_sure(truthy(c, kind))


def and_(*parts: Column) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def or_(*parts: Column) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def not_(part: Column) -> Column:
    return ~_sure(part)


# -- selectors for Select ------------------------------------------------------------------------------------
def pluck(path: str) -> Callable:
    return lambda row: row[path]


def select_keys(*names: str) -> Callable:
    return lambda row: {n: row[n] for n in names}


def omit_keys(*names: str) -> Callable:
    return lambda row: {n: row[n] for n in row._schema.names if n not in names}
