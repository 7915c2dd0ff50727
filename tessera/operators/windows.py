"""Row-ordered expressions: shifts, running and moving aggregates, ranks.

Windows span the whole frame, in its guaranteed order. Spark evaluates such a window in one task, which is the
fastest plan for frames that a task can sort. Beyond ``ONE_TASK_BYTES`` (Catalyst's estimate; nothing runs) and if the
first order key is a number, a time or text, the same values come from blocks of that key:

* running aggregates: a window in each block, plus what all blocks before it add up to (one row for each block);
  means and variances are merged from counts, means and squared deviations, never from sums of squares;
* shifts and moving aggregates: a row number from block counts, then runs of ``RUN_ROWS`` rows, each of which
  also gets the few rows before (and after) it that its frames reach.

Ranks come from the distinct values with their counts, in blocks of the value, at every size.

Blocks are equal spans between the key's least and greatest value, so both branches of a plan agree on them; rows
with equal keys share a block. Text counts by its first six bytes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING
from weakref import WeakKeyDictionary

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column
from pyspark.sql import DataFrame as SparkFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from tessera.errors import UnorderedOperationError, UnsupportedOperationError
from tessera.functions.aggregates import number
from tessera.functions.scalars import divide
from tessera.functions.types import is_integer, is_numeric
from tessera.operators.validate import ddof_of, refuse, whole_number
from tessera.plans.state import Key, State, fresh

if TYPE_CHECKING:
    from tessera.operators.frame import DataFrame
    from tessera.operators.series import Series


def in_order(state: State) -> WindowSpec:
    if not state.order:
        raise UnorderedOperationError("Operation requires a guaranteed row order; sort the frame or declare order_by")
    return Window.orderBy(*(k.spark() for k in state.order))


#: Estimated size up to which one task evaluates a window over the whole frame.
ONE_TASK_BYTES = 1 << 30
#: Rows of a frame up to which its variance is folded row by row; longer frames take Spark's own aggregate.
FOLD_ROWS = 16
#: Blocks of the order key, and rows of a run for frames of bounded reach.
BLOCKS, RUN_ROWS = 4096, 1 << 20


@dataclass(frozen=True)
class Prep:
    """Columns that an expression needs besides those of its state, and how they are added; rows stay the same."""

    column: str
    apply: Callable[[SparkFrame], SparkFrame]


def ready(state: State, preps: tuple[Prep, ...]) -> State:
    """The state with these columns added, each once."""
    df = state.df
    for p in preps:
        if p.column not in df.columns:
            df = p.apply(df)
    return state if df is state.df else replace(state, df=df)


def _in_blocks(state: State) -> bool:
    in_order(state)
    kind = state.df.schema[state.order[0].column].dataType
    if not _has_blocks(kind):
        return False
    estimate = state.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(estimate)) > ONE_TASK_BYTES


def _has_blocks(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.BooleanType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType))


def _with_block(df: SparkFrame, key: Key, block: str) -> SparkFrame:
    """Adds the block of each row by a key, numbered in the key's order."""
    kind = df.schema[key.column].dataType
    c = F.col(key.column)
    if isinstance(kind, T.TimestampType):
        x = F.unix_micros(c).cast("double")
    elif isinstance(kind, T.TimestampNTZType):  # in whole seconds, without passing through a time zone
        x = F.unix_date(c.cast("date")).cast("double") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    elif isinstance(kind, T.StringType):  # strings are ordered by their bytes
        x = F.conv(F.rpad(F.substring(F.hex(c.cast("binary")), 1, 12), 12, "0"), 16, 10).cast("double")
    else:
        x = F.unix_date(c).cast("double") if isinstance(kind, T.DateType) else c.cast("double")
    x = F.when(~F.isnan(x), x)
    low, high = fresh(), fresh()
    ends = df.agg(F.min(x).alias(low), F.max(x).alias(high))  # one row
    place = F.least(F.floor((x - F.col(low)) / (F.col(high) - F.col(low)) * BLOCKS), F.lit(BLOCKS - 1))
    place = F.when(F.col(high) > F.col(low), place).otherwise(F.lit(0))
    if not key.ascending:
        place = BLOCKS - 1 - place
    isnan = F.isnan(c) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.lit(False)
    missing = F.lit(BLOCKS + 1 if key.nulls_last else -2)
    nan = F.lit(BLOCKS if key.ascending else -1)  # NaN is the greatest value
    place = F.when(c.isNull(), missing).when(isnan, nan).otherwise(place)
    return df.crossJoin(F.broadcast(ends)).withColumn(block, place.cast("int")).drop(low, high)


def _row_number(state: State) -> tuple[str, Prep]:
    block, local, before, number = (fresh() for _ in range(4))

    def apply(df: SparkFrame) -> SparkFrame:
        df = _with_block(df, state.order[0], block)
        counts = df.groupBy(block).agg(F.count(F.lit(1)).alias(before))
        counts = counts.withColumn(before, F.coalesce(F.sum(before).over(Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        df = df.withColumn(local, F.row_number().over(Window.partitionBy(block).orderBy(*(k.spark() for k in state.order))))
        return df.join(F.broadcast(counts), block).withColumn(number, F.col(local) + F.col(before) - 1).drop(block, local, before)

    return number, Prep(number, apply)


def _in_runs(state: State, values: dict[str, Callable[[WindowSpec], Column]], back: int, ahead: int) -> tuple[Prep, ...]:
    """Columns of window expressions that reach at most ``back`` rows before and ``ahead`` rows after each row."""
    number, numbered = _row_number(state)
    run, own = fresh(), fresh()
    size = max(RUN_ROWS, 4 * (back + ahead))

    def apply(df: SparkFrame) -> SparkFrame:
        at, place = F.floor(F.col(number) / size).cast("bigint"), F.col(number) % size
        copies = F.array_compact(F.array(at, F.when(place >= size - back, at + 1), F.when(place < ahead, at - 1)))
        df = df.withColumn(own, at).withColumn(run, F.explode(copies))
        w = Window.partitionBy(run).orderBy(number)
        df = df.withColumns({name: build(w) for name, build in values.items()})
        return df.filter(F.col(run) == F.col(own)).drop(run, own)

    return numbered, Prep(next(iter(values)), apply)


def cumulative(state: State, c: Column, kind: T.DataType, name: str, skipna: bool = True) -> tuple[Column, tuple[Prep, ...]]:
    """Running sum, min, max or product. Missing values give missing results, with ``skipna=False`` from there on."""
    if not is_numeric(kind):
        raise UnsupportedOperationError(f"cum{name} requires numeric or boolean data")
    x = number(c, kind) if name in ("sum", "prod") or isinstance(kind, T.BooleanType) else c
    fold = {"sum": F.sum, "min": F.min, "max": F.max, "prod": F.product}[name]
    value, gone, preps = running(state, {"value": (fold, x, name), "gone": (F.bool_or, c.isNull(), "or")})
    if name == "prod" and (is_integer(kind) or isinstance(kind, T.BooleanType)):
        value = value.cast("bigint")
    return F.when(c.isNull() if skipna else gone, F.lit(None)).otherwise(value), preps


_MERGE: dict[str, Callable[[Column, Column], Column]] = {
    "sum": lambda a, b: F.when(a.isNull() | b.isNull(), F.coalesce(a, b)).otherwise(a + b),
    "prod": lambda a, b: F.when(a.isNull() | b.isNull(), F.coalesce(a, b)).otherwise(a * b),
    "min": lambda a, b: F.least(a, b),
    "max": lambda a, b: F.greatest(a, b),
    "or": lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)),
}


#: What adds up the blocks before a block.
_FOLD = {"sum": F.sum, "prod": F.product, "min": F.min, "max": F.max, "or": F.bool_or}


def running(state: State, wanted: dict[str, tuple[Callable[[Column], Column], Column, str]]) -> tuple:
    """Aggregates over all rows up to each row: their columns, and the preparations these need."""
    folds = list(wanted.values())
    if not _in_blocks(state):
        w = in_order(state).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return (*(fold(x).over(w) for fold, x, _ in folds), ())
    block = fresh()
    made = [fresh() for _ in folds]

    def apply(df: SparkFrame) -> SparkFrame:
        df = _with_block(df, state.order[0], block)
        sums = [fresh() for _ in folds]
        totals = df.groupBy(block).agg(*(fold(x).alias(s) for (fold, x, _), s in zip(folds, sums, strict=True)))
        earlier = Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.select(block, *(_FOLD[how](F.col(s)).over(earlier).alias(s) for (_, _, how), s in zip(folds, sums, strict=True)))
        local = Window.partitionBy(block).orderBy(*(k.spark() for k in state.order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        df = df.withColumns({m: fold(x).over(local) for (fold, x, _), m in zip(folds, made, strict=True)}).join(F.broadcast(totals), block)
        df = df.withColumns({m: _MERGE[how](F.col(s), F.col(m)) for (_, _, how), m, s in zip(folds, made, sums, strict=True)})
        return df.drop(block, *sums)

    return (*(F.col(m) for m in made), (Prep(made[0], apply),))


def shift(state: State, c: Column, periods: int, fill: Column | None = None) -> tuple[Column, tuple[Prep, ...]]:
    """The value ``periods`` rows before (after, if negative); ``fill`` stands in only beyond the edge."""
    in_order(state)
    if periods == 0:
        return c, ()
    move = lambda x: (lambda w: F.lag(x, periods).over(w)) if periods > 0 else (lambda w: F.lead(x, -periods).over(w))
    # lag's own default takes only constants, so the edge is told by whether there is a row.
    builds = {"value": move(c)} | ({} if fill is None else {"there": move(F.lit(True))})
    if _in_blocks(state):
        names = {k: fresh() for k in builds}
        preps = _in_runs(state, {names[k]: b for k, b in builds.items()}, max(periods, 0), max(-periods, 0))
        found = {k: F.col(n) for k, n in names.items()}
    else:
        preps, found = (), {k: b(in_order(state)) for k, b in builds.items()}
    return found["value"] if fill is None else F.when(found["there"].isNull(), fill).otherwise(found["value"]), preps


def difference(state: State, c: Column, periods: int) -> tuple[Column, tuple[Prep, ...]]:
    before, preps = shift(state, c, periods)
    return c - before, preps


def pct_change(state: State, c: Column, periods: int) -> tuple[Column, tuple[Prep, ...]]:
    before, preps = shift(state, c, periods)
    return divide(c.cast("double") - before.cast("double"), before), preps


def moments(state: State, c: Column, x: Column) -> tuple[Column, Column, Column, tuple[Prep, ...]]:
    """Count, mean and sum of squared deviations of all rows up to each row, from blocks that are merged pairwise."""
    block, n, m, q, n0, m0, q0 = (fresh() for _ in range(7))

    def before(totals: pd.DataFrame) -> pd.DataFrame:
        out, n_, m_, q_ = [], 0, 0.0, 0.0
        for b, n1, m1, q1 in totals.sort_values(block)[[block, n, m, q]].itertuples(index=False):
            out.append((b, n_, m_, q_))
            if n1:
                gap, both = m1 - m_, n_ + n1
                m_, q_, n_ = m_ + gap * n1 / both, q_ + q1 + gap * gap * n_ * n1 / both, both
        return pd.DataFrame(out, columns=[block, n0, m0, q0])

    def apply(df: SparkFrame) -> SparkFrame:
        df = _with_block(df, state.order[0], block)
        parts = lambda over: (over(F.count(c)), over(F.avg(x)), over(F.var_pop(x)))
        count, mean, spread = parts(lambda f: f)
        # At most BLOCKS + 3 rows, one for each block.
        totals = df.groupBy(block).agg(count.alias(n), F.coalesce(mean, F.lit(0.0)).alias(m), F.coalesce(spread * count, F.lit(0.0)).alias(q))
        earlier = totals.groupBy().applyInPandas(before, f"`{block}` int, `{n0}` long, `{m0}` double, `{q0}` double")
        w = Window.partitionBy(block).orderBy(*(k.spark() for k in state.order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        count, mean, spread = parts(lambda f: f.over(w))
        df = df.withColumns({n: count, m: F.coalesce(mean, F.lit(0.0)), q: F.coalesce(spread * count, F.lit(0.0))}).join(F.broadcast(earlier), block)
        both, gap = F.col(n) + F.col(n0), F.col(m) - F.col(m0)
        some = F.when(both > 0, both)
        merged = {
            n: both,
            m: F.when(F.col(n0) == 0, F.col(m)).when(F.col(n) == 0, F.col(m0)).otherwise(F.col(m0) + gap * F.col(n) / some),
            q: F.col(q) + F.col(q0) + F.when((F.col(n) > 0) & (F.col(n0) > 0), gap * gap * F.col(n) * F.col(n0) / some).otherwise(0.0),
        }
        return df.withColumns(merged).drop(block, n0, m0, q0)

    return F.col(n), F.col(m), F.col(q), (Prep(n, apply),)


def rank(state: State, c: Column, kind: T.DataType, method: str, na_option: str, ascending: bool, pct: bool) -> tuple[Column, tuple[Prep, ...]]:
    """Ranks of values, from the distinct values with their counts: no task sees more than a block of them."""
    if method not in ("average", "min", "max", "first", "dense"):
        raise ValueError(f"unknown way to rank ties: {method!r}")
    if na_option not in ("keep", "top", "bottom"):
        raise ValueError(f"na_option is 'keep', 'top' or 'bottom', not {na_option!r}")
    if method == "first" and not state.order:
        raise UnorderedOperationError("ties ranked by first appearance need a guaranteed row order")
    if not _has_blocks(kind):
        raise UnsupportedOperationError(f"values of type {kind.simpleString()} cannot be ranked")
    nulls_last = na_option != "top"
    known = _places.setdefault(state, {})
    asked = (c._jc.toString(), ascending, nulls_last)
    if asked not in known:  # the methods of one series share one look at its values
        known[asked] = _place_of_values(state, c, ascending, nulls_last)
    value, ties, before, dense, preps = known[asked]
    number_ = {"min": before + 1, "max": before + ties, "average": before + (ties + 1) / F.lit(2.0), "dense": dense, "first": before}[method]
    if method == "first":
        place = fresh()
        order = [k.spark() for k in state.order]
        preps = (*preps, Prep(place, lambda df: df.withColumn(place, F.row_number().over(Window.partitionBy(value).orderBy(*order)))))
        number_ = before + F.col(place)
    number_ = number_.cast("double")
    if pct:
        whole = fresh()
        counted = F.countDistinct(c) if method == "dense" else F.count(c)
        if na_option != "keep":
            counted = counted + F.max(c.isNull()).cast("int") if method == "dense" else F.count(F.lit(1))
        preps = (*preps, Prep(whole, lambda df: df.crossJoin(F.broadcast(_base(state, c, df).agg(counted.alias(whole))))))  # one row
        number_ = number_ / F.col(whole)
    return F.when(value.isNull(), F.lit(None)).otherwise(number_) if na_option == "keep" else number_, preps


#: What ranks of a state's series share, by series and direction.
_places: WeakKeyDictionary[State, dict[tuple, tuple]] = WeakKeyDictionary()


def _base(state: State, c: Column, df: SparkFrame) -> SparkFrame:
    """The state's own rows if they have what ``c`` needs: they are not grown by the joins of other preparations."""
    try:
        state.df.select(c)
    except AnalysisException:
        return df
    return state.df


def _place_of_values(state: State, c: Column, ascending: bool, nulls_last: bool) -> tuple[Column, Column, Column, Column, tuple[Prep, ...]]:
    """For each row its value, how many rows have it, how many come before them, and its place among the values."""
    value, place, block, ties, dense, before, earlier, local = (fresh() for _ in range(8))
    key = Key(value, None, ascending, nulls_last)

    def apply(df: SparkFrame) -> SparkFrame:
        counts = _base(state, c, df).select(c.alias(value)).groupBy(value).agg(F.count(F.lit(1)).alias(ties))
        counts = _with_block(counts, key, block)
        totals = counts.groupBy(block).agg(F.sum(ties).alias(before), F.count(F.lit(1)).alias(earlier))
        ahead = Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.select(block, *(F.coalesce(F.sum(x).over(ahead), F.lit(0)).alias(x) for x in (before, earlier)))
        w = Window.partitionBy(block).orderBy(key.spark()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = counts.withColumns({local: F.sum(ties).over(w), dense: F.row_number().over(w)}).join(F.broadcast(totals), block)
        ranked = ranked.select(F.col(value).alias(place), ties, (F.col(before) + F.col(local) - F.col(ties)).alias(before), (F.col(earlier) + F.col(dense)).alias(dense))
        return df.withColumn(value, c).join(ranked, F.col(value).eqNullSafe(F.col(place))).drop(place)

    return F.col(value), F.col(ties), F.col(before), F.col(dense), (Prep(value, apply),)


def folded_var(x: Column, w: WindowSpec, ddof: int) -> Column:
    """Variance of a short frame's values, folded in row order by Welford's steps as SQL engines take them.

    Spark's aggregate takes the product of each step from other roundings, which shows where results lie on the border
    between two rounded values.
    """

    def step(s: Column, v: Column) -> Column:
        n = s["n"] + 1
        mean = s["mean"] + (v - s["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (s["squares"] + (v - mean) * (v - s["mean"])).alias("squares"))

    none = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))
    end = lambda s: F.when(s["n"] > ddof, s["squares"] / F.when(s["n"] > ddof, s["n"] - ddof))
    return F.aggregate(F.collect_list(x).over(w), none, step, end)


class _Moving:
    """Aggregates over a frame of rows around each row, of a frame's numeric columns or of one series."""

    def __init__(self, owner: DataFrame | Series, rows: int | None, min_periods: int):
        in_order(owner._state)
        self._owner, self._rows, self._min = owner, rows, min_periods

    def _apply(self, name: str, ddof: int = 1, numeric_only: bool = False) -> DataFrame | Series:
        from tessera.operators.series import Series

        owner = self._owner
        if isinstance(owner, Series):
            return owner._with(*self._value(owner._column, owner._kind(), name, ddof))
        kinds = owner._kinds()
        chosen = [c for c, k in kinds.items() if is_numeric(k)] if numeric_only else list(kinds)
        built = {c: self._value(F.col(owner._state.labels[c]), kinds[c], name, ddof) for c in chosen}
        return owner._only({c: v for c, (v, _) in built.items()}, tuple(p for _, ps in built.values() for p in ps))

    def _value(self, c: Column, kind: T.DataType, name: str, ddof: int) -> tuple[Column, tuple[Prep, ...]]:
        least, state = self._min, self._owner._state
        if name != "count" and not is_numeric(kind):
            raise UnsupportedOperationError(f"Window {name} requires numeric or boolean data")
        x = c if name == "count" else number(c, kind).cast("double")
        if name in ("std", "var"):
            least = max(least, 2 if ddof else 1)
        fold = {"count": F.count, "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp if ddof else F.stddev_pop, "var": F.var_samp if ddof else F.var_pop}[name]
        value_of = lambda w: fold(x).over(w)
        if name in ("std", "var") and self._rows is not None and self._rows <= FOLD_ROWS:
            value_of = lambda w: folded_var(x, w, ddof) if name == "var" else F.sqrt(folded_var(x, w, ddof))
        builds = {"value": value_of, "seen": lambda w: (F.count(F.lit(1)) if name == "count" else F.count(c)).over(w)}
        if self._rows is not None:
            bounded = lambda w: w.rowsBetween(1 - self._rows, Window.currentRow)
            if name == "count":  # min_periods counts rows from the start, which a full frame has had
                least = min(least, self._rows)
            if _in_blocks(state):
                names = {k: fresh() for k in builds}
                preps = _in_runs(state, {names[k]: (lambda w, b=b: b(bounded(w))) for k, b in builds.items()}, self._rows - 1, 0)
                value, seen = F.col(names["value"]), F.col(names["seen"])
            else:
                w = bounded(in_order(state))
                value, seen, preps = builds["value"](w), builds["seen"](w), ()
        elif name in ("count", "sum", "min", "max"):
            value, seen, preps = running(state, {"value": (fold, x, "sum" if name == "count" else name), "seen": (F.count, F.lit(1) if name == "count" else c, "sum")})
        else:
            if _in_blocks(state):
                seen, mean, squares, preps = moments(state, c, x)
                degrees = seen - ddof
                spread = F.when(degrees > 0, squares / F.when(degrees > 0, degrees))
                value = {"mean": F.when(seen > 0, mean), "var": spread, "std": F.sqrt(spread)}[name]
            else:
                w = in_order(state).rowsBetween(Window.unboundedPreceding, Window.currentRow)
                value, seen, preps = builds["value"](w), builds["seen"](w), ()
        if name == "count":
            return F.when(seen >= least, value.cast("double")), preps
        if name == "sum" and least == 0:
            value = F.coalesce(value, F.lit(0.0))
        return F.when(seen >= least, value), preps

    def count(self, numeric_only: bool = False) -> DataFrame | Series:
        return self._apply("count", numeric_only=numeric_only)

    def sum(self, numeric_only: bool = False) -> DataFrame | Series:
        return self._apply("sum", numeric_only=numeric_only)

    def mean(self, numeric_only: bool = False) -> DataFrame | Series:
        return self._apply("mean", numeric_only=numeric_only)

    def min(self, numeric_only: bool = False) -> DataFrame | Series:
        return self._apply("min", numeric_only=numeric_only)

    def max(self, numeric_only: bool = False) -> DataFrame | Series:
        return self._apply("max", numeric_only=numeric_only)

    def std(self, ddof: int = 1, numeric_only: bool = False) -> DataFrame | Series:
        return self._apply("std", ddof_of(ddof), numeric_only)

    def var(self, ddof: int = 1, numeric_only: bool = False) -> DataFrame | Series:
        return self._apply("var", ddof_of(ddof), numeric_only)


class Rolling(_Moving):
    """The last ``window`` rows."""

    def __init__(self, owner: DataFrame | Series, window: object, min_periods: object = None, center: bool = False):
        refuse(center=center)
        rows = whole_number("window", window, least=1, kind=ValueError)
        super().__init__(owner, rows, rows if min_periods is None else whole_number("min_periods", min_periods, most=rows, kind=ValueError))


class Expanding(_Moving):
    """All rows up to each row."""

    def __init__(self, owner: DataFrame | Series, min_periods: object = 1):
        super().__init__(owner, None, whole_number("min_periods", min_periods, kind=ValueError))
