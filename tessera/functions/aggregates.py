"""Aggregates as columns, shared by whole-frame reductions and groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.types import is_integer

NUMERIC = {"sum", "mean", "std", "var", "median", "quantile"}


def number(c: Column, kind: T.DataType) -> Column:
    """Booleans and integers as bigint, decimals as they are, floats as double."""
    if isinstance(kind, T.BooleanType) or is_integer(kind):
        return c.cast("bigint")
    return c if isinstance(kind, T.DecimalType) else c.cast("double")


def truth(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        return c
    if isinstance(kind, T.StringType):
        return F.length(c) > 0
    if isinstance(kind, T.NumericType):
        return c.cast("boolean")
    return F.when(c.isNotNull(), F.lit(True))  # dates, times and the like are true


def _unless_missing(c: Column, value: Column, skipna: bool) -> Column:
    return value if skipna else F.when(F.count(c) < F.count(F.lit(1)), F.lit(None)).otherwise(value)


def aggregate(name: str, c: Column, kind: T.DataType, *, skipna: bool = True, min_count: int = 0, ddof: int = 1, q: float = 0.5) -> Column:
    if name == "size":
        return F.count(F.lit(1))
    if name == "count":
        return F.count(c)
    if name == "nunique":
        return F.countDistinct(c)
    if name in ("any", "all"):
        t = truth(c, kind)
        found = F.coalesce(F.bool_or(t), F.lit(False)) if name == "any" else F.coalesce(F.bool_and(t), F.lit(True))
        if not skipna:
            missing = F.count(c) < F.count(F.lit(1))
            floating = isinstance(kind, (T.FloatType, T.DoubleType))
            if name == "any" and floating:  # a missing float is NaN, which is true
                found = F.when(missing, F.lit(True)).otherwise(found)
            elif name == "all" and not floating:
                found = F.when(missing, F.lit(False)).otherwise(found)
        return found
    if name in ("min", "max"):
        return _unless_missing(c, (F.min if name == "min" else F.max)(c), skipna)
    x = number(c, kind)
    if name == "sum":
        value = F.coalesce(F.sum(x), F.lit(0).cast("double") if isinstance(kind, (T.FloatType, T.DoubleType)) else F.lit(0))
        if min_count:
            value = F.when(F.count(c) < min_count, F.lit(None)).otherwise(value)
        return _unless_missing(c, value, skipna)
    x = x.cast("double")
    if name == "mean":
        return _unless_missing(c, F.avg(x), skipna)
    if name == "std":
        return _unless_missing(c, F.stddev_samp(x) if ddof else F.stddev_pop(x), skipna)
    if name == "var":
        return _unless_missing(c, F.var_samp(x) if ddof else F.var_pop(x), skipna)
    if name == "median":
        return _unless_missing(c, F.median(x), skipna)
    if name == "quantile":
        return F.percentile(x, F.lit(q))
    raise KeyError(name)
