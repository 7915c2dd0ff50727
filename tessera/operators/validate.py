"""Checks of arguments that pandas knows and this library takes only in part."""

from __future__ import annotations

from tessera.errors import UnsupportedOperationError


def axis0(axis: object, series: bool = False) -> None:
    if axis not in (0, "index") and not (series and axis is None) and not (not series and axis is None):
        raise UnsupportedOperationError(f"axis={axis!r} is not supported, only axis=0")


def refuse(**given: object) -> None:
    """Raise for the first argument that is not its default (False or None)."""
    for name, value in given.items():
        if value is not None and value is not False:
            raise UnsupportedOperationError(f"{name}={value!r} is not supported")


def whole_number(name: str, value: object, least: int = 0, most: int | None = None, kind: type[Exception] = TypeError) -> int:
    """``value`` if it is an integer within its bounds; ``kind`` is raised for what is no integer."""
    if type(value) is bool or not isinstance(value, int):
        raise kind(f"{name} takes an integer, not {value!r}")
    if value < least:
        raise ValueError(f"{name} has to be {'positive' if least == 1 else 'non-negative'}, not {value}")
    if most is not None and value > most:
        raise ValueError(f"{name} of {value} would exceed {most}")
    return value


def one_of(name: str, value: object, known: tuple) -> object:
    if value not in known:
        raise ValueError(f"{name} is one of {', '.join(map(repr, known))}, not {value!r}")
    return value


def ddof_of(ddof: object) -> int:
    if whole_number("ddof", ddof, least=-(2**62)) not in (0, 1):
        raise UnsupportedOperationError(f"ddof={ddof} is not supported, only 0 and 1")
    return ddof  # type: ignore[return-value]


def min_count_of(value: object) -> int:
    return whole_number("min_count", value)


def quantile_of(q: object, interpolation: str = "linear") -> float:
    if isinstance(q, bool) or not isinstance(q, (int, float)):
        raise UnsupportedOperationError("quantile takes one scalar")
    if q < 0 or q > 1:
        raise ValueError(f"a quantile lies between 0 and 1, not at {q}")
    if interpolation != "linear":
        raise UnsupportedOperationError(f"interpolation={interpolation!r} is not supported, only 'linear'")
    return float(q)


def count_of(n: object, name: str = "n") -> int:
    return whole_number(name, n)
