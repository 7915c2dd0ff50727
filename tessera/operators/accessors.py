"""String and date members of a series."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import UnsupportedOperationError
from tessera.functions.scalars import date_pattern

if TYPE_CHECKING:
    from tessera.operators.series import Series


class Strings:
    def __init__(self, series: Series):
        self._s, self._c = series, series._column

    def upper(self) -> Series:
        return self._s._with(F.upper(self._c))

    def lower(self) -> Series:
        return self._s._with(F.lower(self._c))

    def strip(self) -> Series:
        """Without white space of any kind at either end."""
        return self._s._with(F.regexp_replace(self._c, r"^\s+|\s+$", ""))

    def len(self) -> Series:
        return self._s._with(F.char_length(self._c).cast("bigint"))

    def _flag(self, c: Column, na: object) -> Series:
        return self._s._with(c if na is None else F.coalesce(c, F.lit(bool(na))))

    def startswith(self, pat: str, na: object = False) -> Series:
        return self._flag(self._c.startswith(pat), na)

    def endswith(self, pat: str, na: object = False) -> Series:
        return self._flag(self._c.endswith(pat), na)

    def contains(self, pat: str, case: bool = True, flags: int = 0, na: object = False, regex: bool = True) -> Series:
        if flags:
            raise UnsupportedOperationError("regex flags are not supported")
        if regex:
            return self._flag(self._c.rlike(pat if case else f"(?iu){pat}"), na)
        return self._flag(self._c.contains(pat) if case else F.lower(self._c).contains(pat.lower()), na)

    def replace(self, pat: str, repl: str) -> Series:
        """Replaces a literal text."""
        return self._s._with(F.replace(self._c, F.lit(pat), F.lit(repl)))


class Dates:
    def __init__(self, series: Series):
        self._s, self._c = series, series._column

    def _part(self, c: Column) -> Series:
        return self._s._with(c.cast("bigint"))

    @property
    def year(self) -> Series:
        return self._part(F.year(self._c))

    @property
    def month(self) -> Series:
        return self._part(F.month(self._c))

    @property
    def day(self) -> Series:
        return self._part(F.dayofmonth(self._c))

    @property
    def hour(self) -> Series:
        return self._part(F.hour(self._c))

    @property
    def minute(self) -> Series:
        return self._part(F.minute(self._c))

    @property
    def second(self) -> Series:
        return self._part(F.second(self._c))

    @property
    def date(self) -> Series:
        return self._s._with(self._c.cast("date"))

    def strftime(self, date_format: str) -> Series:
        try:
            pattern = date_pattern(date_format)
        except ValueError as e:
            raise UnsupportedOperationError(f"strftime format {date_format!r} is not supported: {e}") from e
        return self._s._with(F.date_format(self._c, pattern) if pattern else F.when(self._c.isNotNull(), F.lit("")))

    def to_period(self, freq: str = "M") -> Series:
        """The period as text: a year, month or day."""
        patterns = {"Y": "yyyy", "M": "yyyy-MM", "D": "yyyy-MM-dd"}
        if freq not in patterns:
            raise UnsupportedOperationError("to_period currently supports 'Y', 'M', 'D'")
        return self._s._with(F.date_format(self._c, patterns[freq]))
