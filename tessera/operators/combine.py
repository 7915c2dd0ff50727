"""Joins and unions of frames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import AlignmentError, UnsupportedOperationError
from tessera.functions.types import common
from tessera.plans.state import Key, State, fresh

if TYPE_CHECKING:
    from tessera.operators.frame import DataFrame
    from tessera.operators.series import Series

HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "cross": "cross"}


def _labels(value: object) -> list[str]:
    return [] if value is None else [value] if isinstance(value, str) else list(value)  # type: ignore[call-overload]


def merge(left: DataFrame, right: DataFrame, how: str, on: object, left_on: object, right_on: object, left_index: bool, right_index: bool, sort: bool, suffixes: tuple[str | None, str | None]) -> DataFrame:
    """Equi-join in which missing keys match each other; shared key labels come once."""
    if left._state.session is not right._state.session:
        raise AlignmentError("Cannot merge frames from different sessions")
    if how not in HOW:
        raise ValueError(f"Invalid how: {how!r}")
    if not isinstance(suffixes, (tuple, list)) or len(suffixes) != 2 or any(s is not None and not isinstance(s, str) for s in suffixes):
        raise ValueError("suffixes must be two strings or None")
    ls, rs = left._state, right._state
    # The right side gets names of its own, so that a frame can be joined with itself.
    made = {p: fresh() for p in dict.fromkeys([*rs.labels.values(), *(p for _, p in rs.index)])}
    rdf = rs.df.select(*(F.col(p).alias(q) for p, q in made.items()))
    rlabels = {n: made[p] for n, p in rs.labels.items()}
    shared: list[str] = []
    if how == "cross":
        if on is not None or left_on is not None or right_on is not None or left_index or right_index:
            raise ValueError("Can not pass on, left_on, right_on, left_index or right_index with how='cross'")
        lk = rk = []
    else:
        if on is not None and (left_on is not None or right_on is not None or left_index or right_index):
            raise ValueError("Cannot pass on with left_on, right_on, left_index or right_index")
        if left_index and left_on is not None or right_index and right_on is not None:
            raise ValueError("Cannot pass both an index flag and keys for one side")
        if left_index and not ls.index:
            raise ValueError("left_index=True requires left frame to have an explicit index")
        if right_index and not rs.index:
            raise ValueError("right_index=True requires right frame to have an explicit index")
        if on is None and left_on is None and right_on is None and not (left_index or right_index):
            on = [n for n in ls.labels if n in rs.labels]
            if not on:
                raise ValueError("No common columns to merge on")
        lnames = _labels(on if on is not None else left_on)
        rnames = _labels(on if on is not None else right_on)
        lall, rall = left._all_labels(), {n: made[p] for n, p in right._all_labels().items()}
        for n, known in ((*((n, lall) for n in lnames), *((n, rall) for n in rnames))):
            if n not in known:
                raise KeyError(n)
        lk = [p for _, p in ls.index] if left_index else [lall[n] for n in lnames]
        rk = [made[p] for _, p in rs.index] if right_index else [rall[n] for n in rnames]
        if not lk or len(lk) != len(rk):
            raise ValueError("left and right keys must have the same number of columns")
        if not left_index and not right_index:
            shared = [a for a, b in zip(lnames, rnames, strict=True) if a == b and a in ls.labels and a in rs.labels]
    overlap = [n for n in ls.labels if n in rs.labels and n not in shared]
    a, b = (s or "" for s in suffixes)
    if overlap and not a and not b:
        raise ValueError(f"Columns overlap but no suffix was given: {overlap}")
    names = [(n + a if n in overlap else n, "l", n) for n in ls.labels] + [(n + b if n in overlap else n, "r", n) for n in rs.labels if n not in shared]
    if len({n for n, _, _ in names}) != len(names):
        raise ValueError("Merge would create duplicate columns")
    kept = list(dict.fromkeys([*ls.labels.values(), *(p for _, p in ls.index), *lk]))
    ldf = ls.df.select(*kept)
    if how == "cross":
        df = ldf.crossJoin(rdf)
    else:
        df = ldf.join(rdf, reduce(lambda x, y: x & y, (F.col(x).eqNullSafe(F.col(y)) for x, y in zip(lk, rk, strict=True))), HOW[how])
    labels = {n: (ls.labels if side == "l" else rlabels)[old] for n, side, old in names}
    order: tuple[Key, ...] = ()
    index: tuple[tuple[str, str], ...] = ()
    joined = list(zip(lk, rk, strict=True))
    merged: dict[str, str] = {}
    if how in ("right", "outer"):
        both = left_index and right_index
        for x, y in joined:
            if both or any(ls.labels.get(n) == x for n in shared):
                merged[x] = fresh()
                df = df.withColumn(merged[x], F.coalesce(x, y))
        labels = {n: merged.get(p, p) if (n in shared or (both and p in merged)) else p for n, p in labels.items()}
    if left_index and right_index:
        index = tuple((n, merged.get(p, p)) for n, p in ls.index)
    if sort and joined:
        order = tuple(Key(merged.get(x, x), next((n for n, p in left._all_labels().items() if p == x), None)) for x, _ in joined)
    nullable = (ls.nullable | {merged.get(p, p) for p in ls.nullable} | {made[p] for p in rs.nullable if p in made}) & set(df.columns)
    return left._at(df=df, labels=labels, index=index, order=order, row_id=None, nullable=frozenset(nullable))


def concat(objs: Sequence[DataFrame | Series], *, axis: object = 0, join: str = "outer", ignore_index: bool = False) -> DataFrame:
    """Rows of all frames, matched by label. Rows keep their order where every input is a snapshot."""
    from tessera.operators.frame import DataFrame
    from tessera.operators.series import Series

    if axis not in (0, "index"):
        raise UnsupportedOperationError("Only axis=0 is supported")
    if join != "outer":
        raise UnsupportedOperationError("Only join='outer' is supported")
    items = list(objs)
    if not items:
        raise ValueError("No objects to concatenate")
    if any(not isinstance(o, (DataFrame, Series)) for o in items):
        raise TypeError("Objects to concatenate must be DataFrame or Series")
    frames = [o.to_frame() if isinstance(o, Series) else o for o in items]
    states: list[State] = [f._state for f in frames]
    if any(s.session is not states[0].session for s in states):
        raise AlignmentError("Cannot concatenate frames from different sessions")
    labels = list(dict.fromkeys(n for s in states for n in s.labels))
    names = [tuple(n for n, _ in s.index) for s in states]
    index = names[0] if not ignore_index and names[0] and all(n == names[0] for n in names) else ()
    made = {("c", n): fresh() for n in labels} | {("i", n): fresh() for n in index}
    placed = all(s.row_id is not None and len(s.order) == 1 for s in states)
    source, row = fresh(), fresh()
    kinds: dict[tuple[str, str], T.DataType] = {}
    for kind, name in made:
        found = []
        for s in states:
            p = s.labels.get(name) if kind == "c" else dict(s.index)[name]
            if p is not None:
                found.append(s.df.schema[p].dataType)
        kinds[kind, name] = common(found)
    parts = []
    for i, s in enumerate(states):
        columns = []
        for (kind, name), q in made.items():
            p = s.labels.get(name) if kind == "c" else dict(s.index)[name]
            columns.append((F.lit(None) if p is None else F.col(p)).cast(kinds[kind, name]).alias(q))
        if placed:
            columns += [F.lit(i).alias(source), F.col(s.row_id).alias(row)]
        parts.append(s.df.select(*columns))
    df = reduce(lambda x, y: x.unionAll(y), parts)
    nullable = frozenset(made["c", n] for n in labels if any(s.labels.get(n) in s.nullable for s in states))
    first = states[0]
    order = (Key(source, None), Key(row, None)) if placed else ()
    return DataFrame(replace(first, df=df, labels={n: made["c", n] for n in labels}, index=tuple((n, made["i", n]) for n in index), order=order, row_id=None, nullable=nullable, drop_index=True))
