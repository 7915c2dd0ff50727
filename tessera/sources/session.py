"""Sessions: where frames come from."""

from __future__ import annotations

import os
import weakref
from collections.abc import Sequence
from contextvars import ContextVar
from typing import TYPE_CHECKING

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame as SparkFrame
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from tessera.errors import SessionClosedError, UnsupportedOperationError
from tessera.plans.state import Key, State, fresh

if TYPE_CHECKING:
    from tessera.operators.frame import DataFrame

Labels = str | Sequence[str] | None


def as_labels(value: Labels) -> tuple[str, ...]:
    return () if value is None else (value,) if isinstance(value, str) else tuple(value)


def _paths(path: object, kind: str) -> list[str]:
    found = [os.fspath(path)] if isinstance(path, (str, os.PathLike)) else [os.fspath(p) for p in path]  # type: ignore[union-attr]
    if not found:
        raise ValueError(f"At least one {kind} path is required")
    return found


class Session:
    """Reads sources over a Spark session, which is borrowed if there is an active one."""

    def __init__(self, database: str = ":memory:", *, read_only: bool = False, memory_limit: str | None = None, temp_directory: str | None = None, max_temp_directory_size: str | None = None, threads: int | None = None, spark: SparkSession | None = None) -> None:
        if max_temp_directory_size is not None:
            raise UnsupportedOperationError("max_temp_directory_size has no counterpart in Spark")
        if threads is not None and threads < 1:
            raise ValueError("threads must be positive")
        active = spark or SparkSession.getActiveSession()
        if active is None:
            builder = SparkSession.builder.master(f"local[{threads or '*'}]").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
            if memory_limit:
                builder = builder.config("spark.driver.memory", memory_limit.lower().removesuffix("b").replace(" ", ""))
            if temp_directory:
                builder = builder.config("spark.local.dir", temp_directory)
            active = builder.getOrCreate()
        self.spark = active if spark is not None else active.newSession()
        if database not in (":memory:", ""):
            self.spark.sql(f"USE `{database.replace('`', '``')}`")
        self.read_only = read_only
        self._closed = False
        self._executions = 0
        self._views: list[str] = []

    @property
    def closed(self) -> bool:
        return self._closed

    @property
    def execution_count(self) -> int:
        """How often a boundary has run a plan."""
        return self._executions

    def check(self) -> None:
        if self._closed:
            raise SessionClosedError("The session is closed")

    def begin(self) -> None:
        """Count one execution."""
        self.check()
        self._executions += 1

    def close(self) -> None:
        """Drop this session's views; the Spark session goes on. Later use raises."""
        if not self._closed:
            self._closed = True
            for view in self._views:
                self.spark.catalog.dropTempView(view)

    def __enter__(self) -> Session:
        self.check()
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    # --- sources ------------------------------------------------------------------------------------------

    def source(self, df: SparkFrame, index: Labels, order_by: Labels, row_id: str | None = None, nullable: Sequence[str] = ()) -> DataFrame:
        """A frame over a Spark plan; ``row_id`` names its ordinal, which is hidden and breaks ties."""
        from tessera.operators.frame import DataFrame

        names = df.columns
        if len(set(names)) != len(names):
            raise ValueError("Sources with duplicate column labels are not supported")
        index_labels, order_labels = as_labels(index), as_labels(order_by)
        for kind, labels in (("index", index_labels), ("order_by", order_labels)):
            if len(set(labels)) != len(labels):
                raise ValueError(f"{kind} labels must be unique")
            for label in labels:
                if label not in names or label == row_id:
                    raise KeyError(label)
        made = {name: fresh() for name in names}
        df = df.select(*(F.col(f"`{n.replace('`', '``')}`").alias(p) for n, p in made.items()))
        order = [Key(made[label], label) for label in order_labels]
        if row_id is not None:
            order.append(Key(made[row_id], None))
        labels = {n: p for n, p in made.items() if n != row_id and n not in index_labels}
        state = State(self, df, labels, tuple((label, made[label]) for label in index_labels), tuple(order), made.get(row_id or ""), True, frozenset(made[n] for n in nullable))
        return DataFrame(state)

    def from_pandas(self, value: pd.DataFrame, *, index: Labels = None, order_by: Labels = None) -> DataFrame:
        """A snapshot of a pandas frame in its row order. NaN is missing."""
        self.check()
        if any(not isinstance(c, str) for c in value.columns):
            raise TypeError("Only string column labels are supported")
        if not value.columns.is_unique:
            raise ValueError("Sources with duplicate column labels are not supported")
        nullable = [c for c in value.columns if str(value[c].dtype).startswith(("Int", "UInt"))]
        return self._arrow(pa.Table.from_pandas(value, preserve_index=False), index, order_by, nullable)

    def from_arrow(self, value: pa.Table | pa.RecordBatch, *, index: Labels = None, order_by: Labels = None) -> DataFrame:
        """A snapshot of an Arrow table in its row order."""
        self.check()
        table = pa.Table.from_batches([value]) if isinstance(value, pa.RecordBatch) else value
        if len(set(table.column_names)) != table.num_columns:
            raise ValueError("Sources with duplicate column labels are not supported")
        return self._arrow(table, index, order_by, ())

    def _arrow(self, table: pa.Table, index: Labels, order_by: Labels, nullable: Sequence[str]) -> DataFrame:
        wider = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0), pa.float16(): pa.float32(), pa.null(): pa.string()}
        for i, f in enumerate(table.schema):
            kind, column = f.type, table.column(i)
            if pa.types.is_dictionary(kind):
                kind, column = kind.value_type, column.cast(kind.value_type)
            if pa.types.is_timestamp(kind):
                column = column.cast(pa.timestamp("us", kind.tz), safe=False)
            elif pa.types.is_uint64(kind):
                import decimal

                column = pa.chunked_array([pa.array([None if v is None else decimal.Decimal(v) for v in column.to_pylist()], pa.decimal128(20, 0))])
            elif kind in wider:
                column = column.cast(wider[kind])
            table = table.set_column(i, f.name, column)
        row_id = fresh()
        table = table.append_column(row_id, pa.array(range(table.num_rows), pa.int64()))
        schema = from_arrow_schema(table.schema, prefer_timestamp_ntz=True)
        return self.source(self.spark.createDataFrame(table, schema), index, order_by, row_id, nullable)

    def read_parquet(self, path: object, *, hive_partitioning: bool = False, union_by_name: bool = False, index: Labels = None, order_by: Labels = None) -> DataFrame:
        """Files, folders or globs. Partition folders become columns only with ``hive_partitioning``."""
        self.check()
        reader = self.spark.read.option("mergeSchema", str(union_by_name).lower())
        paths = _paths(path, "Parquet")
        if not hive_partitioning:
            reader = reader.option("recursiveFileLookup", "true")
        return self.source(reader.parquet(*paths), index, order_by)

    def read_csv(self, path: object, *, header: bool = True, delimiter: str = ",", auto_detect: bool = True, index: Labels = None, order_by: Labels = None) -> DataFrame:
        """CSV files; with ``auto_detect`` integers become bigint and times timestamps without a zone."""
        self.check()
        df = self.spark.read.csv(_paths(path, "CSV"), header=header, sep=delimiter, inferSchema=auto_detect)
        kinds = {T.IntegerType(): "bigint", T.TimestampType(): "timestamp_ntz"}
        df = df.select(*(F.col(f"`{f.name}`").cast(kinds[f.dataType]).alias(f.name) if f.dataType in kinds else F.col(f"`{f.name}`") for f in df.schema))
        return self.source(df, index, order_by)

    def table(self, name: str, *, index: Labels = None, order_by: Labels = None) -> DataFrame:
        """A table or view of the session."""
        self.check()
        return self.source(self.spark.table(name), index, order_by)

    def sql(self, query: str, *, index: Labels = None, order_by: Labels = None) -> DataFrame:
        """One SELECT statement; anything that would act at once is refused without running."""
        self.check()
        text = query.strip().rstrip(";").rstrip()
        if not text:
            raise UnsupportedOperationError("sql() takes exactly one SELECT statement")
        try:
            self.spark.sql(f"SELECT * FROM (\n{text}\n) AS q")
        except ParseException as e:
            raise UnsupportedOperationError("sql() takes exactly one SELECT statement; only read-only SELECT is supported") from e
        except AnalysisException as e:
            if text.split(None, 1)[0].lower() not in ("select", "with", "values", "from", "table", "("):
                raise UnsupportedOperationError("sql() supports only read-only SELECT statements") from e
            raise
        return self.source(self.spark.sql(text), index, order_by)


def connect(database: str = ":memory:", **options: object) -> Session:
    """A new session with its own views and settings."""
    return Session(database, **options)  # type: ignore[arg-type]


_implicit: ContextVar[weakref.ref[Session] | None] = ContextVar("session", default=None)
_kept: list[Session] = []


def implicit() -> Session:
    """The session of the module-level readers; it is made anew once closed."""
    held = _implicit.get()
    session = held() if held else None
    if session is None or session.closed:
        session = Session()
        _kept[:] = [session]
        _implicit.set(weakref.ref(session))
    return session


def from_pandas(value: pd.DataFrame, *, index: Labels = None, order_by: Labels = None) -> DataFrame:
    return implicit().from_pandas(value, index=index, order_by=order_by)


def from_arrow(value: pa.Table | pa.RecordBatch, *, index: Labels = None, order_by: Labels = None) -> DataFrame:
    return implicit().from_arrow(value, index=index, order_by=order_by)


def read_parquet(path: object, **options: object) -> DataFrame:
    return implicit().read_parquet(path, **options)  # type: ignore[arg-type]


def read_csv(path: object, **options: object) -> DataFrame:
    return implicit().read_csv(path, **options)  # type: ignore[arg-type]
