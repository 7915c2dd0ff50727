"""The immutable state behind a frame handle: a Spark plan and the metadata pandas semantics need.

Physical column names are generated and never used twice, so a plan can keep every column it ever had: labels,
index and order are only pointers to physical columns, and Catalyst prunes what nothing points to.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import DataFrame as SparkFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from tessera.sources.session import Session

_numbers = itertools.count()


def fresh() -> str:
    """A physical column name that no plan has yet."""
    return f"_c{next(_numbers)}"


@dataclass(frozen=True)
class Key:
    """One column of a guaranteed order; a row identity has no label."""

    column: str
    label: str | None
    ascending: bool = True
    nulls_last: bool = True

    def spark(self) -> Column:
        c = F.col(self.column)
        if self.ascending:
            return c.asc_nulls_last() if self.nulls_last else c.asc_nulls_first()
        return c.desc_nulls_last() if self.nulls_last else c.desc_nulls_first()

    def reversed(self) -> Key:
        return replace(self, ascending=not self.ascending, nulls_last=not self.nulls_last)


@dataclass(frozen=True, eq=False)
class State:
    session: Session
    df: SparkFrame
    labels: dict[str, str]
    index: tuple[tuple[str, str], ...] = ()
    order: tuple[Key, ...] = ()
    row_id: str | None = None
    drop_index: bool = True
    #: Physical columns that came from nullable pandas integers.
    nullable: frozenset[str] = field(default_factory=frozenset)

    def with_columns(self, columns: dict[str, Column], **changes: object) -> tuple[State, dict[str, str]]:
        """Add computed columns by label; the labels point to them from now on."""
        made = {label: fresh() for label in columns}
        df = self.df.withColumns({made[label]: c for label, c in columns.items()})
        return replace(self, df=df, labels=self.labels | made, **changes), made

    def visible(self) -> list[Column]:
        return [F.col(c).alias(label) for label, c in self.labels.items()]

    def sorted(self) -> SparkFrame:
        return self.df.orderBy(*(k.spark() for k in self.order)) if self.order else self.df

    def protected(self) -> set[str]:
        """Labels of index and order columns, which may not be replaced."""
        return {label for label, _ in self.index} | {k.label for k in self.order if k.label is not None}
