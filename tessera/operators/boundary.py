"""Where plans run: collecting, streaming, writing, explaining."""

from __future__ import annotations

import contextlib
import io
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import MaterializationError
from tessera.plans.state import State

CODECS = ("snappy", "gzip", "zstd", "lz4", "brotli", "uncompressed", "lz4_raw")


def to_pandas(table: pa.Table, nullable: set[str]) -> pd.DataFrame:
    """Arrow to pandas: integers with nulls become floats unless they came as nullable integers."""
    out = table.to_pandas(timestamp_as_object=False)
    for i, f in enumerate(table.schema):
        if f.name in nullable and (pa.types.is_integer(f.type) or pa.types.is_decimal(f.type)):
            values = table.column(i).to_pylist()
            big = pa.types.is_decimal(f.type)
            out[f.name] = pd.array([None if v is None else int(v) for v in values], dtype="UInt64" if big else "Int64")
        elif pa.types.is_timestamp(f.type):
            out[f.name] = out[f.name].astype("datetime64[ns]") if f.type.tz is None else out[f.name]
    return out


def collect(state: State) -> pd.DataFrame:
    state.session.begin()
    physical = list(dict.fromkeys([*(p for _, p in state.index), *state.labels.values()]))
    table = state.sorted().select(*physical).toArrow()
    frame = to_pandas(table, {p for p in physical if p in state.nullable})
    out = frame[list(state.labels.values())].copy()
    out.columns = list(state.labels)
    if state.index:
        keys = [frame[p] for _, p in state.index]
        names = [n for n, _ in state.index]
        out.index = pd.Index(keys[0], name=names[0]) if len(keys) == 1 else pd.MultiIndex.from_arrays(keys, names=names)
    return out


def one_row(state: State, columns: dict[str, Column]) -> dict[str, object]:
    """The values of aggregates over the whole frame, in one job."""
    state.session.begin()
    names = {f"a{i}": label for i, label in enumerate(columns)}
    table = state.df.agg(*(columns[label].alias(n) for n, label in names.items())).toArrow()
    if table.num_rows != 1 or table.num_columns != len(columns):
        raise MaterializationError(f"Expected one row of {len(columns)} values, got {table.num_rows} x {table.num_columns}")
    return {label: table.column(n)[0].as_py() for n, label in names.items()}


def to_arrow(state: State) -> pa.Table:
    state.session.begin()
    return state.df.select(*state.visible()).toArrow()


def to_batches(state: State, size: int) -> pa.RecordBatchReader:
    """Batches of at most ``size`` rows; partitions come to the driver one after another."""
    if size <= 0:
        raise ValueError("batch_size must be positive")
    state.session.begin()
    df = state.df.select(*state.visible())
    schema = df.limit(0).toArrow().schema

    def packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema) as out:
                out.write_batch(part)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["b"])

    def batches() -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for row in df.mapInArrow(packed, "b binary").toLocalIterator(prefetchPartitions=True):
            for part in pa.ipc.open_stream(row.b):
                held.append(pa.Table.from_batches([part]).cast(schema).combine_chunks().to_batches()[0] if part.schema != schema and part.num_rows else part)
                rows += part.num_rows
            while rows >= size:
                whole = pa.Table.from_batches(held, schema).combine_chunks()
                yield from whole.slice(0, size).to_batches()
                held, rows = whole.slice(size).to_batches(), rows - size
        if rows:
            yield from pa.Table.from_batches(held, schema).combine_chunks().to_batches()

    return pa.RecordBatchReader.from_batches(schema, batches())


def write_parquet(state: State, path: str, compression: str, overwrite: bool) -> None:
    if compression not in CODECS:
        raise ValueError(f"Unsupported Parquet compression: {compression!r}")
    state.session.begin()
    state.sorted().select(*state.visible()).write.mode("overwrite" if overwrite else "errorifexists").option("compression", compression).parquet(path)


def write_csv(state: State, path: str, sep: str, header: bool) -> None:
    state.session.begin()
    state.sorted().select(*state.visible()).write.mode("overwrite").csv(path, sep=sep, header=header)


def explain(state: State, mode: str) -> str:
    modes = {"all": "extended", "logical": "extended", "sql": "extended", "physical": "formatted"}
    if mode not in modes:
        raise ValueError(f"Unknown explain mode: {mode!r}")
    state.session.begin()
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        state.df.select(*state.visible()).explain(modes[mode])
    text = said.getvalue()
    if mode in ("logical", "sql"):
        text = text.split("== Physical Plan ==")[0]
    return text


def persist(state: State, name: str | None) -> tuple[State, str]:
    """The frame as a table of its own, in the checkpoint folder if one is set; index and order are kept."""
    from dataclasses import replace
    from uuid import uuid4

    state.session.begin()
    name = name or f"_persist_{uuid4().hex}"
    kept = list(dict.fromkeys([*(p for _, p in state.index), *(k.column for k in state.order), *state.labels.values()]))
    df = state.df.select(*kept)
    spark = state.session.spark
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        path = f"{folder.rstrip('/')}/persist-{uuid4().hex}"
        df.write.parquet(path)
        df = spark.read.schema(df.schema).parquet(path)
    else:
        df = df.persist()
        df.count()
    df.select(*(F.col(p).alias(label) for label, p in state.labels.items())).createTempView(name)
    state.session._views.append(name)
    return replace(state, df=df), name
