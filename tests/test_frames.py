"""The frame library against pandas."""

from __future__ import annotations

import datetime as dt

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pandas.testing import assert_frame_equal, assert_series_equal

import tessera as ts
from tessera.errors import AlignmentError, SessionClosedError, UnorderedOperationError, UnsupportedOperationError
from tessera.operators import windows

BASE = pd.DataFrame(
    {
        "g": ["a", "b", None, "a", "b", "Z"],
        "x": [1, 2, 3, 4, 5, 4],
        "y": [1.0, np.nan, 2.5, 0.0, 4.0, 1.0],
        "b": [True, False, True, True, False, False],
        "s": ["  Ab", "b\t", None, "a.c", "", "zé"],
        "t": pd.to_datetime(["2024-01-02 03:04:05", "2023-12-31 23:59:59", None, "2024-02-29", "2020-01-01", "2024-06-01 12:00"], format="ISO8601"),
    }
)


@pytest.fixture
def session(spark):
    return ts.Session(spark=spark)


@pytest.fixture
def f(session):
    return session.from_pandas(BASE)


def same(got: pd.DataFrame, want: pd.DataFrame, **options) -> None:
    assert_frame_equal(got, want, check_dtype=False, check_index_type=False, **options)


def test_round_trip_and_laziness(session, f):
    assert f.columns == tuple(BASE.columns) and session.execution_count == 0
    g = f[f["x"] > 1].assign(z=lambda d: d["x"] + 1).sort_values("y")
    assert session.execution_count == 0
    assert g.collect()["z"].tolist() == [5, 5, 4, 6, 3]
    assert session.execution_count == 1
    same(f.collect(), BASE)


def test_arithmetic(f):
    p = BASE
    for got, want in (
        (f["x"] + 2, p.x + 2), (10 - f["x"], 10 - p.x), (f["x"] * f["y"], p.x * p.y), (f["x"] / 2, p.x / 2), (f["y"] / 0, p.y / 0), (7 % f["x"], 7 % p.x), (-f["x"], -p.x),
        (f["g"] + "!", p.g + "!"), (f["b"] + 1, p.b + 1),
    ):
        np.testing.assert_array_equal(pd.array(got.collect()).astype(object)[~want.isna()], pd.array(want).astype(object)[~want.isna()])
        assert got.collect().isna().tolist() == want.isna().tolist()
    with pytest.raises(ValueError, match=r"truth value.*ambiguous"):
        bool(f["x"])
    with pytest.raises(TypeError, match="scalar or Series"):
        f["x"] + [1]


def test_reductions(f):
    n = f[["x", "y", "b"]]
    for name in ("sum", "mean", "min", "max", "std", "var", "median", "count", "nunique", "any", "all"):
        want = getattr(BASE[["x", "y", "b"]], name)()
        np.testing.assert_allclose(getattr(n, name)().astype(float), want.astype(float))
    for options in ({"skipna": False}, {"min_count": 6}):
        np.testing.assert_allclose(n.sum(**options).astype(float), BASE[["x", "y", "b"]].sum(**options).astype(float))
    assert f["y"].quantile(0.3) == pytest.approx(BASE.y.quantile(0.3))
    assert f["y"].std(ddof=0) == pytest.approx(BASE.y.std(ddof=0))
    assert f.size == BASE.size and f["x"].size == 6
    assert_series_equal(f["x"].value_counts(), BASE.x.value_counts().sort_index().sort_values(ascending=False, kind="stable"), check_names=False)
    assert set(f["g"].unique()) == {"a", "b", "Z", None}
    empty = f[f["x"] > 99]
    assert empty["y"].sum() == 0 and np.isnan(empty["y"].mean()) and empty["b"].any() is False and empty["b"].all() is True
    for bad, match in ((lambda: f.sum(), "numeric or boolean"), (lambda: n.sum(axis=1), "axis=0"), (lambda: n.std(ddof=2), "ddof"), (lambda: n.quantile([0.1]), "scalar")):
        with pytest.raises(UnsupportedOperationError, match=match):
            bad()


def test_groupby(f):
    p = BASE
    got = f.groupby("g").agg(s=("x", "sum"), m=("y", "mean"), n=("y", "count"), z=("y", "size"), lo=("s", "min"))
    same(got.collect(), p.groupby("g").agg(s=("x", "sum"), m=("y", "mean"), n=("y", "count"), z=("y", "size"), lo=("s", "min")))
    same(f.groupby("g", dropna=False, as_index=False)[["x"]].sum().collect(), p.groupby("g", dropna=False, as_index=False)[["x"]].sum())
    same(f.groupby("g", sort=False).max(numeric_only=True)[["x", "y"]].collect(), p.groupby("g", sort=False)[["x", "y"]].max())
    same((f["x"] * 2).groupby(f["b"]).sum().collect(), (p.x * 2).groupby(p.b).sum().to_frame())
    assert f.groupby(["g", "b"]).size().collect()["size"].tolist() == p.groupby(["g", "b"]).size().tolist()
    for bad, error, match in (
        (lambda: f.groupby([]), ValueError, "different keys"), (lambda: f.groupby(["g", "g"]), ValueError, "different keys"), (lambda: f.groupby("g").agg(len), UnsupportedOperationError, "names of functions"),
        (lambda: f.groupby("g").agg(a=("s", "sum")), UnsupportedOperationError, "numbers and booleans"), (lambda: f.groupby("g").agg("x", a=("x", "sum")), ValueError, "either one request"),
        (lambda: f.groupby("g").agg(a=("x", "nope")), UnsupportedOperationError, "no known aggregate"), (lambda: f.groupby("g").agg(), ValueError, "either one request"),
    ):
        with pytest.raises(error, match=match):
            bad()


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_joins(session, how):
    a = pd.DataFrame({"k": [1.0, 2.0, np.nan, 2.0], "v": list("abcd")})
    b = pd.DataFrame({"k": [2.0, np.nan, 9.0], "v": list("xyz"), "w": [1, 2, 3]})
    got = session.from_pandas(a).merge(session.from_pandas(b), on="k", how=how).collect()
    want = a.merge(b, on="k", how=how)
    key = ["k", "v_x", "v_y"]
    same(got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True))
    c = b.rename(columns={"k": "q"})
    got = session.from_pandas(a).merge(session.from_pandas(c), left_on="k", right_on="q", how=how).collect()
    want = a.merge(c, left_on="k", right_on="q", how=how)
    same(got.sort_values(["k", "q", "v_x"]).reset_index(drop=True), want.sort_values(["k", "q", "v_x"]).reset_index(drop=True))


def test_join_by_index_self_and_errors(spark, session, f):
    a, b = f.set_index("x")[["g"]], session.from_pandas(pd.DataFrame({"x": [1, 4], "w": [7, 8]})).set_index("x")
    same(a.join(b).collect().sort_index(kind="stable"), BASE.set_index("x")[["g"]].join(pd.DataFrame({"x": [1, 4], "w": [7, 8]}).set_index("x")).sort_index(kind="stable"))
    assert len(f.merge(f, on="x", suffixes=("_1", "_2")).collect()) == len(BASE.merge(BASE, on="x"))
    with pytest.raises(AlignmentError, match="different sessions"):
        f.merge(ts.Session(spark=spark).from_pandas(BASE))
    with pytest.raises(ValueError, match="no suffix"):
        f.merge(f, on="x", suffixes=("", ""))
    with pytest.raises(ValueError, match="Invalid how"):
        f.merge(f, how="semi")
    with pytest.raises(ValueError, match="Can not pass on"):
        f.merge(f, on="x", how="cross")


@pytest.fixture(params=["one task", "blocks"])
def plan(request, monkeypatch):
    """Both plans of windows over the whole frame; the second is otherwise taken by large frames only."""
    if request.param == "blocks":
        monkeypatch.setattr(windows, "ONE_TASK_BYTES", -1)
        monkeypatch.setattr(windows, "BLOCKS", 3)
        monkeypatch.setattr(windows, "RUN_ROWS", 2)
    return request.param


def test_windows_by_declared_order(session, plan):
    r = np.random.default_rng(1)
    p = pd.DataFrame({"k": r.permutation(40), "t": pd.Timestamp("2024-03-31") + pd.to_timedelta(r.permutation(40), "h"), "v": np.where(r.random(40) < 0.2, np.nan, r.integers(-9, 9, 40))})
    p.loc[3, "t"] = pd.NaT
    for key, up, nulls in (("k", True, "last"), ("k", False, "last"), ("t", True, "last"), ("t", True, "first"), ("t", False, "first")):
        f = session.from_pandas(p).sort_values(key, ascending=up, na_position=nulls)
        q = p.sort_values(key, ascending=up, na_position=nulls)
        s = f["v"]
        assert (f.collect()["k"].to_numpy() == q.k.to_numpy()).all()
        for got, want in (
            (s.cumsum(), q.v.cumsum()), (s.cummax(skipna=False), q.v.cummax(skipna=False)), (s.shift(3), q.v.shift(3)), (s.shift(-2), q.v.shift(-2)), (s.diff(), q.v.diff()), (s.rolling(4, 2).mean(), q.v.rolling(4, 2).mean()),
            (s.rolling(3).count() , q.v.rolling(3, 3).count().where(np.arange(40) >= 2)), (s.expanding(2).std(), q.v.expanding(2).std()), (s.expanding(1).max(), q.v.expanding(1).max()), (s.expanding(3).count(), q.v.expanding(1).count().where(np.arange(40) >= 2)),
            (s.cumsum().shift(1) + s, q.v.cumsum().shift(1) + q.v), (s.expanding(1).mean(), q.v.expanding(1).mean()),
        ):
            np.testing.assert_allclose(got.collect().astype(float), want, atol=1e-9)
        g = f.assign(a=s.cumsum(), b=s.rolling(2, 1).sum())
        assert g[g["a"] > 0].collect()["b"].tolist() == pytest.approx(q.v.rolling(2, 1).sum()[q.v.cumsum() > 0].tolist(), nan_ok=True)
        assert f[s.cumsum().isna()].collect().shape[0] == q.v.isna().sum()
        assert s.cumsum().max() == q.v.cumsum().max()


def test_windows(f, plan):
    p = BASE
    for name in ("cumsum", "cummin", "cummax", "cumprod"):
        for skipna in (True, False):
            np.testing.assert_allclose(getattr(f["y"], name)(skipna=skipna).collect().astype(float), getattr(p.y, name)(skipna=skipna))
    for n in (1, -2):
        np.testing.assert_allclose(f["x"].shift(n).collect().astype(float), p.x.shift(n))
        np.testing.assert_allclose(f["y"].diff(n).collect().astype(float), p.y.diff(n))
        np.testing.assert_allclose(f["x"].pct_change(n).collect().astype(float), p.x.pct_change(n))
    np.testing.assert_allclose(f["y"].shift(1, fill_value=-1).collect().astype(float), p.y.shift(1, fill_value=-1))
    for method in ("average", "min", "max", "first", "dense"):
        for options in ({}, {"pct": True}, {"ascending": False}, {"na_option": "top"}, {"na_option": "bottom", "pct": True}):
            np.testing.assert_allclose(f["y"].rank(method=method, **options).collect().astype(float), p.y.rank(method=method, **options), err_msg=f"{method} {options}")
    for w, m in ((3, None), (2, 1), (3, 0)):
        for name in ("sum", "mean", "min", "max", "std", "var"):
            np.testing.assert_allclose(getattr(f["y"].rolling(w, m), name)().collect().astype(float), getattr(p.y.rolling(w, m), name)(), atol=1e-12)
    np.testing.assert_allclose(f[["x", "y"]].expanding(2).sum().collect().astype(float), p[["x", "y"]].expanding(2).sum())
    for bad, match in ((lambda: f["x"].rolling(0), "positive"), (lambda: f["x"].rolling(2, 3), "exceed"), (lambda: f["x"].rolling(2, -1), "non-negative"), (lambda: f["x"].rolling(2.5), "integer")):
        with pytest.raises(ValueError, match=match):
            bad()


def test_order_contract(session, tmp_path):
    BASE.to_parquet(tmp_path / "p.parquet", coerce_timestamps="us")
    g = session.read_parquet(tmp_path / "p.parquet")
    assert g.ordering == ()
    for bad in (lambda: g["x"].cumsum(), lambda: g.iloc[0:1], lambda: g.drop_duplicates("x", keep="last"), lambda: g["x"].rank(method="first")):
        with pytest.raises(UnorderedOperationError):
            bad()
    h = session.read_parquet(tmp_path / "p.parquet", order_by=["y", "x"], index="x")
    assert h.ordering == ("y", "x") and h.index_names == ("x",)
    assert h.collect().index.tolist() == [4, 1, 4, 3, 5, 2]
    assert h[["g"]].fillna({"g": "?"}).ordering == ("y", "x")


def test_selection(f):
    p = BASE
    same(f.sort_values(["y", "x"], ascending=[False, True], na_position="first").limit(3, offset=1).collect().reset_index(drop=True), p.sort_values(["y", "x"], ascending=[False, True], na_position="first").iloc[1:4].reset_index(drop=True))
    for keep in ("first", "last"):
        assert f.nlargest(3, "x", keep=keep).collect()["s"].tolist()[:1] == p.nlargest(3, "x", keep=keep)["s"].tolist()[:1]
        assert f.nlargest(2, "x", keep=keep).collect()["y"].tolist() == p.nlargest(2, "x", keep=keep)["y"].tolist()
        assert f.drop_duplicates("x", keep=keep).collect()["y"].tolist()[-1] == p.drop_duplicates("x", keep=keep)["y"].tolist()[-1]
    assert f.drop_duplicates("x", keep=False).collect()["x"].tolist() == p.drop_duplicates("x", keep=False)["x"].tolist()
    same(f.iloc[1:4, [0, 2]].collect().reset_index(drop=True), p.iloc[1:4, [0, 2]].reset_index(drop=True))
    h = f.set_index(["g", "x"])
    assert len(h.loc["a"].collect()) == 2 and len(h.loc[("a", 4)].collect()) == 1 and len(h.loc[(None,), :].collect()) == 1
    h.loc[h["y"] > 1, ["y", "b"]] = None
    assert h.collect()["y"].isna().sum() == 3
    with pytest.raises(UnsupportedOperationError, match="slicing"):
        h.loc["a":"b"]


def test_missing_values(f):
    p = BASE
    same(f.dropna(subset=["y", "g"]).collect().reset_index(drop=True), p.dropna(subset=["y", "g"]).reset_index(drop=True))
    same(f.dropna(thresh=6).collect().reset_index(drop=True), p.dropna(thresh=6).reset_index(drop=True))
    same(f.fillna({"y": 9, "g": "?"}).collect(), p.fillna({"y": 9, "g": "?"}))
    same(f.isna().collect(), p.isna())
    n = f[["x", "y"]]
    same(n.where(n["x"] > 2, -1).collect(), p[["x", "y"]].where(p.x > 2, -1))
    same(f.mask(f["x"] > 2, {"x": 0})[["x"]].collect(), p[["x"]].mask(p.x > 2, 0))
    with pytest.raises(TypeError, match="both how and thresh"):
        f.dropna(how="any", thresh=1)


def test_strings_and_dates(f):
    p = BASE
    for got, want in (
        (f["s"].str.upper(), p.s.str.upper()), (f["s"].str.strip(), p.s.str.strip()), (f["s"].str.len(), p.s.str.len()), (f["s"].str.replace("a", "."), p.s.str.replace("a", ".", regex=False)),
        (f["t"].dt.year, p.t.dt.year), (f["t"].dt.second, p.t.dt.second), (f["t"].dt.strftime("%d/%m/%y it's %j %%"), p.t.dt.strftime("%d/%m/%y it's %j %%")), (f["t"].dt.to_period("D"), p.t.dt.to_period("D").astype(str).where(p.t.notna())),
    ):
        assert [None if pd.isna(a) else a for a in got.collect()] == [None if pd.isna(a) else a for a in want]
    assert f["s"].str.contains("a.c").collect().tolist() == [False, False, False, True, False, False]
    assert f["s"].str.contains("AB", case=False, regex=False).collect().tolist()[0] is True
    assert f["s"].str.startswith("z").sum() == 1
    assert f["t"].dt.date.collect().tolist()[0] == dt.date(2024, 1, 2)
    for bad, match in ((lambda: f["t"].dt.strftime("%Q"), "not supported"), (lambda: f["t"].dt.to_period("W"), "'Y', 'M', 'D'"), (lambda: f["s"].str.contains("a", flags=2), "regex flags")):
        with pytest.raises(UnsupportedOperationError, match=match):
            bad()


def test_concat(session, f):
    a, b = f[["g", "x"]], f[["x", "y"]]
    same(ts.concat([a, b]).collect(), pd.concat([BASE[["g", "x"]], BASE[["x", "y"]]], ignore_index=True))
    c = session.from_pandas(pd.DataFrame({"v": [1, 2]})), session.from_pandas(pd.DataFrame({"v": [1.5]}))
    assert ts.concat(c).collect()["v"].tolist() == [1.0, 2.0, 1.5]
    d = session.from_pandas(pd.DataFrame({"v": ["q"]}))
    assert ts.concat([c[0], d]).collect()["v"].tolist() == ["1", "2", "q"]
    same(ts.concat([a.set_index("g"), a.set_index("g")]).collect(), pd.concat([BASE[["g", "x"]].set_index("g")] * 2))
    with pytest.raises(ValueError, match="No objects"):
        ts.concat([])


def test_assignment_and_alignment(f):
    f["c"] = 1
    f[["d", "e"]] = (f["x"] * 10, "k")
    assert f.collect()[["c", "d", "e"]].iloc[1].tolist() == [1, 20, "k"]
    g = f.assign(x=f["x"] * 2, w=f["x"] + 1)
    assert g.collect()["w"].tolist() == (BASE.x + 1).tolist()
    with pytest.raises(AlignmentError, match="different frame"):
        f[g["x"] > 1]
    with pytest.raises(ValueError, match="index or ordering column"):
        f.set_index("x").assign(x=1)
    assert (f["x"] * -1).nlargest(1).collect().tolist() == [-1]


def test_metadata(f):
    h = f.rename(columns={"x": "q"}).set_index("q")
    assert h.index_names == ("q",) and "q" not in h.columns
    same(h.reset_index().collect()[["q", "g"]], BASE.rename(columns={"x": "q"})[["q", "g"]])
    with pytest.raises(ValueError, match="already exists"):
        f.set_index("x", drop=False).reset_index()
    with pytest.raises(ValueError, match="no explicit index"):
        f.reset_index()
    with pytest.raises(ValueError, match="empty projections"):
        f[[]]
    with pytest.raises(UnsupportedOperationError, match="renaming index"):
        f.rename({"x": "y"})
    with pytest.raises(TypeError, match="Unsupported dtype"):
        f.astype("list")
    assert f.astype({"x": "float64", "b": "str"}).collect()["x"].dtype == float


def test_sources_and_sinks(session, f, tmp_path):
    f[["x", "g"]].write_parquet(tmp_path / "o")
    same(session.read_parquet(tmp_path / "o").collect().sort_values("x", kind="stable").reset_index(drop=True)[["x"]], BASE[["x"]].sort_values("x").reset_index(drop=True))
    with pytest.raises(Exception, match="exist"):
        f.write_parquet(tmp_path / "o")
    f[["x"]].write_parquet(tmp_path / "o", overwrite=True, compression="zstd")
    f[["x", "g"]].to_csv(tmp_path / "c", sep=";")
    assert len(session.read_csv(tmp_path / "c", delimiter=";").collect()) == 6
    assert f.to_arrow().column_names == list(BASE.columns)
    batches = list(f.to_arrow_batches(4))
    assert [b.num_rows for b in batches] == [4, 2]
    odd = session.from_pandas(pd.DataFrame({'odd "name`': ["y'q"], "a.b": [1]}))
    assert odd[odd['odd "name`'] == "y'q"].collect().shape == (1, 2)
    big = pd.DataFrame({"v": pd.array([2**63 + 1, None], dtype="UInt64")})
    assert session.from_pandas(big).collect()["v"].tolist()[0] == 2**63 + 1
    assert session.from_arrow(pa.table({"v": pa.array([1, None], pa.uint32())})).collect()["v"].isna().tolist() == [False, True]
    with pytest.raises(ValueError, match="At least one Parquet path"):
        session.read_parquet([])
    with pytest.raises(TypeError, match="string column labels"):
        session.from_pandas(pd.DataFrame({1: [1]}))


def test_sql_guard_persist_explain_close(session, f):
    p = f.persist("kept_table")
    same(p.collect(), f.collect())
    assert session.sql("SELECT count(*) AS n FROM kept_table").collect()["n"].tolist() == [6]
    for bad in ("CREATE TABLE q AS SELECT 1", "SELECT 1; SELECT 2", "SHOW TABLES", "1) ; DROP TABLE x --", ""):
        with pytest.raises(UnsupportedOperationError, match="SELECT"):
            session.sql(bad)
    assert "Physical" in f.explain() and "Physical" not in f.explain("logical")
    assert "Write Parquet" in f.explain_write("/tmp/none")
    with pytest.raises(ValueError, match="Unknown explain mode"):
        f.explain("nope")
    with pytest.raises(ValueError, match="batch_size must be positive"):
        f.to_arrow_batches(0)
    session.close()
    session.close()
    with pytest.raises(SessionClosedError, match="session is closed"):
        f.collect()


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-5, 5))), min_size=1, max_size=12))
def test_random_groups_and_windows(session, data):
    p = pd.DataFrame({"k": pd.Series([k for k, _ in data], dtype=object), "v": pd.Series([v for _, v in data], dtype=float)})
    f = session.from_pandas(p)
    same(f.groupby("k", dropna=False).agg(s=("v", "sum"), c=("v", "count")).collect().reset_index(drop=True), p.groupby("k", dropna=False).agg(s=("v", "sum"), c=("v", "count")).reset_index(drop=True))
    np.testing.assert_allclose(f["v"].cumsum().collect().astype(float), p.v.cumsum())
    np.testing.assert_allclose(f["v"].rank().collect().astype(float), p.v.rank())


def test_module_level_readers(spark, tmp_path):
    a = ts.from_pandas(pd.DataFrame({"x": [1, 2]}))
    b = ts.from_arrow(pa.table({"x": [3]}))
    assert a._state.session is b._state.session
    assert ts.concat([a, b]).collect()["x"].tolist() == [1, 2, 3]
    a.write_csv(tmp_path / "c")
    a.write_parquet(tmp_path / "p")
    assert ts.read_csv(tmp_path / "c").collect()["x"].sum() == 3 and ts.read_parquet(tmp_path / "p").collect()["x"].sum() == 3
    a._state.session.close()
    assert ts.from_pandas(pd.DataFrame({"x": [1]}))._state.session is not a._state.session


def test_sessions_are_apart(spark):
    with ts.connect() as one, ts.connect() as two:
        one.from_pandas(pd.DataFrame({"x": [1]})).persist("only_here")
        assert one.table("only_here").collect()["x"].tolist() == [1]
        with pytest.raises(Exception, match="only_here"):
            two.table("only_here")
    assert one.closed
    with pytest.raises(SessionClosedError):
        one.sql("SELECT 1")
    assert spark.range(1).count() == 1
    with pytest.raises(UnsupportedOperationError):
        ts.connect(max_temp_directory_size="1GB")


def test_partition_folders_and_merged_schemas(session, tmp_path):
    pd.DataFrame({"x": [1]}).to_parquet(tmp_path / "a.parquet")
    pd.DataFrame({"x": [2], "y": ["q"]}).to_parquet(tmp_path / "b.parquet")
    got = session.read_parquet([tmp_path / "a.parquet", tmp_path / "b.parquet"], union_by_name=True).sort_values("x").collect()
    assert got["y"].tolist() == [None, "q"]
    (tmp_path / "h" / "day=3").mkdir(parents=True)
    pd.DataFrame({"x": [1]}).to_parquet(tmp_path / "h" / "day=3" / "a.parquet")
    assert session.read_parquet(tmp_path / "h", hive_partitioning=True).columns == ("x", "day")
    assert session.read_parquet(tmp_path / "h").columns == ("x",)
    with pytest.raises(KeyError):
        session.read_parquet(tmp_path / "h", index="nope")
    with pytest.raises(ValueError, match="must be unique"):
        session.from_pandas(pd.DataFrame({"x": [1]}), order_by=["x", "x"])


def test_where_with_frames_and_casts(session):
    p = pd.DataFrame({"a": [True, False, True], "b": [False, False, True]})
    f = session.from_pandas(p)
    same(f.where(f, False).collect(), p.where(p, False))
    same(f.mask(f, None).isna().collect(), p.mask(p, None).isna())
    with pytest.raises(AlignmentError):
        f.where(f.isna())
    with pytest.raises(TypeError, match="cond must be"):
        f.where([True])
    with pytest.raises(TypeError, match="other must be"):
        f.where(True, [1])
    n = session.from_pandas(pd.DataFrame({"x": [2.7, -2.7, None]}))
    assert n.astype({"x": "int64"}).collect()["x"].tolist()[:2] == [2, -2]
    assert n.astype({"x": "nope"}, errors="ignore").collect()["x"].tolist()[:2] == [2.7, -2.7]


def test_nullable_integers_keep_their_type(session):
    p = pd.DataFrame({"v": pd.array([1, None, 3], dtype="Int64"), "k": [1, 1, 2]})
    f = session.from_pandas(p)
    assert str(f.collect()["v"].dtype) == "Int64" and str(f[f["k"] > 0].collect()["v"].dtype) == "Int64"
    assert str(f.assign(w=f["v"] + 1).collect()["w"].dtype) == "float64"
    assert str(f.head(1)["v"].dtype) == "Int64"


def test_moments_far_from_zero(session, monkeypatch):
    """Both plans of expanding means and variances agree on values whose squares lose all digits."""
    from tessera.operators import windows

    r = np.random.default_rng(0)
    p = pd.DataFrame({"k": np.arange(400) % 397, "x": 1e9 + np.tile([0.0, 1.0, 2.0, np.nan], 100) + r.integers(0, 3, 400), "s": [f"{i % 90:03}{'ab'[i % 2]}" for i in range(400)]})
    for by in (["k", "x"], ["s", "k"]):
        q = p.sort_values(by, kind="stable").reset_index(drop=True)
        near = (q.x - 1e9).expanding()  # exact where all values are small
        want = {"mean": near.mean() + 1e9, "std": near.std(), "var": near.var()}
        for size in (1 << 30, -1):
            monkeypatch.setattr(windows, "ONE_TASK_BYTES", size)
            f = session.from_pandas(p).sort_values(by)
            e = f["x"].expanding()
            got = f.assign(mean=e.mean(), std=e.std(), var=e.var()).collect()
            for n, w in want.items():
                np.testing.assert_allclose(got[n].astype(float), w, rtol=1e-6)


def test_rank_has_no_single_task(session):
    f = session.from_pandas(pd.DataFrame({"a": [3.0, 1.0, np.nan, 3.0], "s": ["b", "a", None, "b"]}))
    g = f.assign(r=f["a"].rank(), d=f["s"].rank(method="dense", pct=True))
    assert g.collect()[["r", "d"]].fillna(-1).to_numpy().tolist() == [[2.5, 1.0], [1.0, 0.5], [-1.0, -1.0], [2.5, 1.0]]
    # What is in one task are the sums of blocks, not rows or values.
    plan = f.assign(r=f["a"].rank())._state.df._jdf.queryExecution().optimizedPlan().toString()
    import re as _re

    unparted = [w for w in _re.findall(r"Window \[.*", plan) if _re.search(r"\], \[\w+#\d+ ASC", w) and "[], [" in w]
    assert all("unboundedpreceding" in w and "-1" in w for w in unparted)


def test_loc_lists_are_one_lookup(session):
    p = pd.DataFrame({"g": ["a", "a", None, "b"], "i": [1, 2, 1, 2], "v": [1, 2, 3, 4]})
    f = session.from_pandas(p)
    one = f.set_index("i")
    assert sorted(one.loc[list(range(2, 300))].collect()["v"]) == [2, 4]
    assert " OR " not in one.loc[list(range(2, 300))]._state.df._jdf.queryExecution().optimizedPlan().toString()
    both = f.set_index(["g", "i"])
    assert sorted(both.loc[[("a", 1), ("b", 2), (None, 1), ("b",)]].collect()["v"]) == [1, 3, 4]
    assert both.loc["a", 2].collect()["v"].tolist() == [2] and both.loc[("a",), "v"].collect().tolist() == [1, 2]


@pytest.mark.parametrize("plan", ["one task", "blocks"])
def test_moving_variance_is_that_of_sql_to_the_last_bit(session, monkeypatch, plan):
    """Results on the border between two rounded values fall on the same side."""
    if plan == "blocks":
        monkeypatch.setattr(windows, "ONE_TASK_BYTES", -1)
    p = pd.DataFrame({"i": range(400), "v": np.random.default_rng(5).integers(100, 20000, 400).astype(float)})
    p.loc[4:7, "v"] = [2435, 2131, 1954, 2863]
    p.loc[::31, "v"] = np.nan
    f = session.from_pandas(p).sort_values("i")
    got = f.assign(r=f["v"].rolling(4).var())[["i", "r"]].collect()["r"]
    sql = "SELECT CASE WHEN count(x) OVER w >= 4 THEN var_samp(x) OVER w END AS r FROM (SELECT i, CASE WHEN NOT isnan(v) THEN v END AS x FROM p) WINDOW w AS (ORDER BY i ROWS 3 PRECEDING) ORDER BY i"
    want = duckdb.sql(sql).df()["r"]
    np.testing.assert_array_equal(got.astype(float), want)
    alone = f["v"].rolling(1, 1)
    assert alone.var(ddof=0).collect().dropna().eq(0).all() and alone.var().collect().isna().all()
