"""Every registered query of the frame library against its SQL, on the smallest tables."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from tessera.plans import registered

FOLDER = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def value(x: object) -> object:
    if isinstance(x, float) and math.isnan(x):
        return "nan"
    if isinstance(x, bool) or x is None or isinstance(x, (str, datetime.date)):
        return x
    return float(f"{float(x):.9g}")  # type: ignore[arg-type]


def rows(columns: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(value(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(registered.QUERIES))
def test_matches_sql(spark, duck, name):
    got = registered.QUERIES[name](spark, str(FOLDER))
    want = duck.execute(registered.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def test_pushdown_and_pruning(spark):
    """Filters and the needed columns reach the scan, through the frame's renamed columns."""
    plan = registered.QUERIES["flagship_pricing"](spark, str(FOLDER))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThanOrEqual(l_shipdate" in plan
    assert "l_orderkey" not in plan and "l_suppkey" not in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
