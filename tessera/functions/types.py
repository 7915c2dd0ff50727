"""Types: names of cast targets, literals, and which columns count as numeric."""

from __future__ import annotations

import datetime as dt
import decimal
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cast targets by their pandas or SQL names. Unsigned types become the next wider signed one.
TARGETS = {
    **dict.fromkeys(("int8", "tinyint"), "tinyint"), **dict.fromkeys(("int16", "smallint"), "smallint"), **dict.fromkeys(("int32", "integer"), "int"),
    **dict.fromkeys(("int", "int64", "bigint"), "bigint"), **dict.fromkeys(("uint8", "utinyint"), "smallint"), **dict.fromkeys(("uint16", "usmallint"), "int"),
    **dict.fromkeys(("uint32", "uinteger"), "bigint"), **dict.fromkeys(("uint64", "ubigint"), "decimal(20,0)"), **dict.fromkeys(("hugeint", "uhugeint"), "decimal(38,0)"),
    **dict.fromkeys(("float32",), "float"), **dict.fromkeys(("float", "float64", "double"), "double"), **dict.fromkeys(("bool", "boolean"), "boolean"),
    **dict.fromkeys(("str", "string", "object", "varchar"), "string"), "date": "date", "time": "time",
    **dict.fromkeys(("timestamp", "datetime64[ns]", "datetime64[us]", "datetime64[ms]", "datetime64[s]"), "timestamp_ntz"), "interval": "interval day to second",
}

SCALARS = (int, float, bytes, bytearray, memoryview, str, bool, dt.date, dt.datetime, dt.time, dt.timedelta, uuid.UUID, decimal.Decimal, type(None))


def target(dtype: object) -> str | None:
    """The Spark type of a dtype (name, Python type or numpy dtype), None if it is not supported."""
    if isinstance(dtype, type):
        dtype = {int: "int64", float: "float64", bool: "bool", str: "str", dt.date: "date", dt.datetime: "timestamp"}.get(dtype, getattr(dtype, "__name__", ""))
    name = str(getattr(dtype, "name", dtype)).strip().lower()
    if name.startswith("decimal(") and name.endswith(")"):
        return name
    return TARGETS.get(name)


def is_scalar(value: object) -> bool:
    return isinstance(value, SCALARS) or (type(value).__module__ == "numpy" and getattr(value, "ndim", 1) == 0)


def literal(value: object) -> Column:
    """A typed literal; naive timestamps do not depend on any time zone."""
    if type(value).__module__ == "numpy":
        value = value.item()
    if isinstance(value, dt.datetime):
        return F.lit(value.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")
    if isinstance(value, dt.time):
        return F.lit(value.isoformat()).cast("time")
    if isinstance(value, uuid.UUID):
        return F.lit(str(value))
    if isinstance(value, (bytearray, memoryview)):
        value = bytes(value)
    return F.lit(value)


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.BooleanType))


def is_integer(kind: T.DataType) -> bool:
    return isinstance(kind, T.IntegralType)


def common(kinds: list[T.DataType]) -> T.DataType:
    """The type that a union gives to columns of these types."""
    kinds = [k for k in dict.fromkeys(kinds) if not isinstance(k, T.NullType)]
    if not kinds:
        return T.NullType()
    if len(kinds) == 1:
        return kinds[0]
    if all(is_integer(k) for k in kinds):
        return T.LongType()
    if all(isinstance(k, T.NumericType) for k in kinds):
        return T.DoubleType()
    return T.StringType()
