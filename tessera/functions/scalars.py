"""Element-wise expressions with pandas results where Spark's differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _number(c: Column, kind: T.DataType) -> Column:
    return c.cast("bigint") if isinstance(kind, T.BooleanType) else c


def add(a: Column, b: Column, ka: T.DataType, kb: T.DataType) -> Column:
    if isinstance(ka, T.StringType) or isinstance(kb, T.StringType):
        return F.concat(a, b)
    return _number(a, ka) + _number(b, kb)


def subtract(a: Column, b: Column, ka: T.DataType, kb: T.DataType) -> Column:
    return _number(a, ka) - _number(b, kb)


def multiply(a: Column, b: Column, ka: T.DataType, kb: T.DataType) -> Column:
    return _number(a, ka) * _number(b, kb)


def divide(a: Column, b: Column, *_: T.DataType) -> Column:
    """True division; by zero it gives signed infinity or NaN instead of an error."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(a / b)


def modulo(a: Column, b: Column, ka: T.DataType, kb: T.DataType) -> Column:
    """Remainder with the dividend's sign; by zero NaN for floats, null for integers."""
    a, b = _number(a, ka), _number(b, kb)
    floating = isinstance(ka, T.FractionalType) or isinstance(kb, T.FractionalType)
    return F.when(b == 0, F.lit(float("nan")) if floating else F.lit(None)).otherwise(a % b)


#: Directives of strftime and the patterns that Spark formats the same way.
STRFTIME = {
    "Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "y": "yy", "I": "hh", "p": "a", "f": "SSSSSS",
    "F": "yyyy-MM-dd", "T": "HH:mm:ss", "D": "MM/dd/yy", "R": "HH:mm",
}


def date_pattern(text: str) -> str:
    """Spark's pattern for a strftime format; raises ValueError for a directive that has none."""
    out, plain, i = [], "", 0

    def quoted() -> None:
        nonlocal plain
        if plain:
            out.append("'" + plain.replace("'", "''") + "'" if any(c.isalpha() or c in "'[]{}#" for c in plain) else plain)
            plain = ""

    while i < len(text):
        if text[i] != "%":
            plain += text[i]
            i += 1
            continue
        code = text[i + 1 : i + 2]
        i += 2
        if code == "%":
            plain += "%"
        elif code in STRFTIME:
            quoted()
            out.append(STRFTIME[code])
        else:
            raise ValueError(f"no pattern for %{code}")
    quoted()
    return "".join(out)
