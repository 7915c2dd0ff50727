"""Registered queries of the frame library: each over whole tables, with the SQL that says the same."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame as SparkFrame
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import tessera
from tessera.operators.frame import DataFrame
from tessera.operators.series import Series

Tables = Callable[[str], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], SparkFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register ``f(tables)`` under its name with its SQL. ``tables(name, **options)`` reads a table."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> SparkFrame:
            session = tessera.Session(spark=spark)

            def tables(name: str, **options: object) -> DataFrame:
                return session.read_parquet(f"{sf_dir}/{name}.parquet", **options)

            tables.session = session  # type: ignore[attr-defined]
            found = f(tables)  # type: ignore[arg-type]
            return found if isinstance(found, SparkFrame) else plain(found)

        QUERIES[f.__name__] = run
        SQL[f.__name__] = sql
        return f

    return register


def plain(frame: DataFrame | Series) -> SparkFrame:
    """The Spark frame of visible columns, with the index before them."""
    frame = frame.to_frame() if isinstance(frame, Series) else frame
    s = frame._state
    hidden = [F.col(p).alias(n) for n, p in s.index if n not in s.labels]
    return s.df.select(*hidden, *s.visible())


def cents(frame: DataFrame, column: str) -> Series:
    """Money as whole cents: sums are exact in any order."""
    return (frame[column] * 100 + 0.5).astype("int64")


CENTS = "CAST(floor({0} * 100 + 0.5) AS BIGINT)"


# --- projection, filter, assignment -----------------------------------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_qty,
CAST(sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS BIGINT) AS sum_cents, round(avg(l_discount), 6) AS avg_disc,
max(l_tax) AS max_tax, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def flagship_pricing(t: Tables) -> DataFrame:
    f = t("lineitem")
    f = f[f["l_shipdate"] <= __import__("datetime").datetime(1998, 9, 2)]
    f = f.assign(qty=lambda d: d["l_quantity"].astype("int64"), cents=lambda d: cents(d, "l_extendedprice"))
    g = f.groupby(["l_returnflag", "l_linestatus"], as_index=False).agg(sum_qty=("qty", "sum"), sum_cents=("cents", "sum"), avg_disc=("l_discount", "mean"), max_tax=("l_tax", "max"), n=("qty", "size"))
    return rounded(g, "avg_disc")


def rounded(frame: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Columns rounded as SQL's round() does it for doubles: scaled first, which decides values on the border."""
    state = frame._state
    return DataFrame(state.with_columns({c: F.round(F.col(state.labels[c]) * 10.0**digits) / 10.0**digits for c in columns})[0])


@query("SELECT l_orderkey, l_quantity FROM lineitem")
def project_columns(t: Tables) -> DataFrame:
    return t("lineitem")[["l_orderkey", "l_quantity"]]


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice > 100000 AND o_orderstatus = 'O') OR NOT (o_orderpriority <> '1-URGENT')")
def filter_and_or_not(t: Tables) -> DataFrame:
    f = t("orders")
    return f[((f["o_totalprice"] > 100000) & (f["o_orderstatus"] == "O")) | ~(f["o_orderpriority"] != "1-URGENT")][["o_orderkey", "o_totalprice"]]


@query("""SELECT p_partkey, p_size * 2 + 1 AS a, (p_size * 2 + 1) % 7 AS b, p_size - 10 AS c, -p_size AS d, p_size / 4.0 AS e,
p_name || '-' || p_brand AS label FROM part""")
def arithmetic_chain(t: Tables) -> DataFrame:
    return t("part").assign(a=lambda d: d["p_size"] * 2 + 1, b=lambda d: d["a"] % 7, c=lambda d: d["p_size"] - 10, d=lambda d: -d["p_size"], e=lambda d: d["p_size"] / 4, label=lambda d: d["p_name"] + "-" + d["p_brand"])[["p_partkey", "a", "b", "c", "d", "e", "label"]]


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN CASE WHEN p_size = 0 THEN 'NaN'::DOUBLE ELSE 'inf'::DOUBLE END
ELSE p_size / CAST(p_size % 5 AS DOUBLE) END AS ratio FROM part""")
def division_by_zero(t: Tables) -> DataFrame:
    return t("part").assign(ratio=lambda d: d["p_size"] / (d["p_size"] % 5))[["p_partkey", "ratio"]]


@query("SELECT c_custkey AS id, c_acctbal AS balance FROM customer")
def rename_drop(t: Tables) -> DataFrame:
    return t("customer").rename(columns={"c_custkey": "id", "c_acctbal": "balance"}).drop(columns=["c_name", "c_nationkey", "c_mktsegment"])


@query("""SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS whole, CAST(o_custkey AS VARCHAR) AS cust, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders""")
def astype_columns(t: Tables) -> DataFrame:
    return t("orders").assign(whole=lambda d: d["o_totalprice"].astype("int64"), cust=lambda d: d["o_custkey"].astype("str"), day=lambda d: d["o_orderdate"].astype("date").astype("str"))[["o_orderkey", "whole", "cust", "day"]]


_HOLES = "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END AS size, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_brand END AS brand, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_retailprice END AS price FROM part"


def holes(t: Tables) -> DataFrame:
    f = t("part")
    return f.assign(size=f["p_size"].mask(f["p_size"] % 3 == 0), brand=f["p_brand"].mask(f["p_size"] % 4 == 0), price=f["p_retailprice"].mask(f["p_size"] % 5 == 0))[["p_partkey", "size", "brand", "price"]]


@query(f"SELECT p_partkey, coalesce(size, -1) AS size, coalesce(brand, 'none') AS brand, price FROM ({_HOLES})")
def fillna_dict(t: Tables) -> DataFrame:
    return holes(t).fillna({"size": -1, "brand": "none"})


@query(f"SELECT * FROM ({_HOLES}) WHERE size IS NOT NULL AND brand IS NOT NULL AND price IS NOT NULL")
def dropna_any(t: Tables) -> DataFrame:
    return holes(t).dropna()


@query(f"SELECT * FROM ({_HOLES}) WHERE size IS NOT NULL OR brand IS NOT NULL")
def dropna_all(t: Tables) -> DataFrame:
    return holes(t).dropna(how="all", subset=["size", "brand"])


@query(f"SELECT * FROM ({_HOLES}) WHERE (size IS NOT NULL)::INT + (brand IS NOT NULL)::INT + (price IS NOT NULL)::INT >= 2")
def dropna_thresh(t: Tables) -> DataFrame:
    return holes(t).dropna(thresh=2, subset=["size", "brand", "price"])


@query(f"SELECT p_partkey IS NULL AS p_partkey, size IS NULL AS size, brand IS NULL AS brand, price IS NULL AS price FROM ({_HOLES})")
def isna_frame(t: Tables) -> DataFrame:
    return holes(t).isna()


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 50000 THEN o_totalprice END AS kept, CASE WHEN o_totalprice > 50000 THEN 0.0 ELSE o_totalprice END AS masked FROM orders")
def where_mask(t: Tables) -> DataFrame:
    f = t("orders")
    big = f["o_totalprice"] > 50000
    return f.assign(kept=f["o_totalprice"].where(big), masked=f["o_totalprice"].mask(big, 0.0))[["o_orderkey", "kept", "masked"]]


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders")
def loc_masked_assignment(t: Tables) -> DataFrame:
    f = t("orders")
    f.loc[f["o_orderstatus"] == "F", "o_totalprice"] = 0.0
    return f[["o_orderkey", "o_totalprice"]]


# --- strings and dates ------------------------------------------------------------------------------------


@query("""SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, trim('  ' || p_name || ' ') AS s, CAST(length(p_name) AS BIGINT) AS n,
starts_with(p_name, 'b') AS sw, ends_with(p_brand, '3') AS ew, regexp_matches(p_name, '[aeiou]{2}') AS rx, contains(p_name, 'ee') AS lit,
regexp_matches(p_brand, '(?i)BRAND') AS ci, replace(p_name, 'e', '_') AS r FROM part""")
def string_accessor(t: Tables) -> DataFrame:
    f = t("part")
    name, brand = f["p_name"], f["p_brand"]
    return f.assign(u=name.str.upper(), l=brand.str.lower(), s=("  " + name + " ").str.strip(), n=name.str.len(), sw=name.str.startswith("b"), ew=brand.str.endswith("3"), rx=name.str.contains("[aeiou]{2}"), lit=name.str.contains("ee", regex=False), ci=brand.str.contains("BRAND", case=False), r=name.str.replace("e", "_"))[["p_partkey", "u", "l", "s", "n", "sw", "ew", "rx", "lit", "ci", "r"]]


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, contains(text, 'license') AS licensed FROM documents")
def document_lengths(t: Tables) -> DataFrame:
    f = t("documents")
    return f.assign(chars=f["text"].str.len(), licensed=f["text"].str.contains("license", regex=False))[["doc_id", "chars", "licensed"]]


@query("""SELECT event_id, year(ts) AS y, month(ts) AS mo, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, CAST(floor(second(ts)) AS BIGINT) AS s, CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
strftime(ts, '%Y-%m-%d %H:%M:%S day %j') AS f, strftime(ts, '%Y-%m') AS period FROM events""")
def datetime_accessor(t: Tables) -> DataFrame:
    f = t("events")
    dt = f["ts"].dt
    return f.assign(y=dt.year, mo=dt.month, d=dt.day, h=dt.hour, mi=dt.minute, s=dt.second, day=dt.date.astype("str"), f=dt.strftime("%Y-%m-%d %H:%M:%S day %j"), period=dt.to_period("M"))[["event_id", "y", "mo", "d", "h", "mi", "s", "day", "f", "period"]]


# --- joins and unions -------------------------------------------------------------------------------------


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def inner_join(t: Tables) -> DataFrame:
    c = t("customer")
    return t("orders").merge(c[c["c_mktsegment"] == "BUILDING"], left_on="o_custkey", right_on="c_custkey")[["o_orderkey", "c_name", "o_totalprice"]]


_LINES = "(SELECT l_orderkey AS o_orderkey, count(*) AS lines FROM lineitem GROUP BY 1)"


def lines(t: Tables) -> DataFrame:
    return t("lineitem").groupby("l_orderkey", as_index=False).agg(lines=("l_linenumber", "size")).rename(columns={"l_orderkey": "o_orderkey"})


@query(f"SELECT o_orderkey, o_orderstatus, lines FROM orders LEFT JOIN {_LINES} USING (o_orderkey)")
def left_join(t: Tables) -> DataFrame:
    return t("orders").merge(lines(t), on="o_orderkey", how="left")[["o_orderkey", "o_orderstatus", "lines"]]


@query(f"SELECT o_orderkey, o_orderstatus, lines FROM {_LINES} RIGHT JOIN orders USING (o_orderkey)")
def right_join(t: Tables) -> DataFrame:
    return lines(t).merge(t("orders"), on="o_orderkey", how="right")[["o_orderkey", "o_orderstatus", "lines"]]


@query(f"SELECT o_orderkey, o_custkey, lines FROM orders FULL JOIN (SELECT o_orderkey + 100 AS o_orderkey, lines FROM {_LINES}) USING (o_orderkey)")
def outer_join(t: Tables) -> DataFrame:
    f = t("lineitem")
    shifted = f.assign(o_orderkey=f["l_orderkey"] + 100).groupby("o_orderkey", as_index=False).agg(lines=("l_linenumber", "size"))
    return t("orders").merge(shifted, on="o_orderkey", how="outer")[["o_orderkey", "o_custkey", "lines"]]


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def cross_join(t: Tables) -> DataFrame:
    return t("region").merge(t("nation"), how="cross")[["r_name", "n_name"]]


_NK = "SELECT n_nationkey, n_name, CASE WHEN n_regionkey = 0 THEN NULL ELSE n_regionkey END AS k FROM nation"


@query(f"SELECT a.n_name AS a, b.n_name AS b FROM ({_NK}) a JOIN ({_NK}) b ON a.k IS NOT DISTINCT FROM b.k")
def null_key_self_join(t: Tables) -> DataFrame:
    f = t("nation")
    f = f.assign(k=f["n_regionkey"].mask(f["n_regionkey"] == 0))[["n_name", "k"]]
    return f.merge(f, on="k", suffixes=("_a", "_b")).rename(columns={"n_name_a": "a", "n_name_b": "b"})[["a", "b"]]


@query("""SELECT s.s_suppkey, c.c_custkey FROM supplier s JOIN customer c ON s.s_nationkey = c.c_nationkey AND CAST(floor(s.s_acctbal / 1000) AS BIGINT) = CAST(floor(c.c_acctbal / 1000) AS BIGINT)""")
def multi_key_join(t: Tables) -> DataFrame:
    s, c = t("supplier"), t("customer")
    floor = lambda f, x: (f[x] / 1000 + 1000).astype("int64")
    s, c = s.assign(nation=s["s_nationkey"], band=floor(s, "s_acctbal")), c.assign(nation=c["c_nationkey"], band=floor(c, "c_acctbal"))
    return s.merge(c, on=["nation", "band"])[["s_suppkey", "c_custkey"]]


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def index_join(t: Tables) -> DataFrame:
    return t("nation").set_index("n_regionkey").join(t("region").set_index("r_regionkey"), how="inner").reset_index(drop=True)[["n_name", "r_name"]]


@query("SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer")
def concat_same_schema(t: Tables) -> DataFrame:
    a = t("supplier").rename(columns={"s_suppkey": "id", "s_name": "name", "s_acctbal": "balance"})[["id", "name", "balance"]]
    b = t("customer").rename(columns={"c_custkey": "id", "c_name": "name", "c_acctbal": "balance"})[["id", "name", "balance"]]
    return tessera.concat([a, b])


@query("""SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS key, CAST(NULL AS VARCHAR) AS brand FROM nation UNION ALL SELECT NULL, p_partkey, p_brand FROM part
UNION ALL SELECT r_name, NULL, NULL FROM region""")
def concat_disjoint(t: Tables) -> DataFrame:
    a = t("nation").rename(columns={"n_name": "name", "n_nationkey": "key"})[["name", "key"]]
    b = t("part").rename(columns={"p_partkey": "key", "p_brand": "brand"})[["key", "brand"]]
    return tessera.concat([a, b, t("region").rename(columns={"r_name": "name"})[["name"]]])[["name", "key", "brand"]]


@query("SELECT CAST(p_size AS DOUBLE) AS v FROM part UNION ALL SELECT s_acctbal FROM supplier")
def concat_promotion(t: Tables) -> DataFrame:
    return tessera.concat([t("part").rename(columns={"p_size": "v"})[["v"]], t("supplier").rename(columns={"s_acctbal": "v"})[["v"]]])


# --- aggregates -------------------------------------------------------------------------------------------


def eager(t: Tables, result: pd.DataFrame, kinds: str) -> SparkFrame:
    """What an eager call returned, as rows: whole numbers, floats and text by ``kinds``."""
    return t.session.spark.createDataFrame([tuple(None if pd.isna(x) else x for x in row) for row in result.itertuples(index=False)], kinds)


def _number(x: object, digits: int | None = None) -> object:
    x = x.item() if hasattr(x, "item") else x
    if isinstance(x, bool) or x is None or pd.isna(x):
        return x if isinstance(x, bool) else None
    return round(x, digits) if digits is not None else x


def _reduction(name: str, sql: str, kind: str, digits: int | None = None, series: bool = False, **options: object) -> None:
    """A whole-frame reduction of part's columns with holes, or one of each of its series, as one row."""

    @query(f"SELECT {sql} FROM ({_HOLES})")
    def run(t: Tables) -> SparkFrame:
        f = holes(t)[["size", "price"]]
        if series:
            found = [getattr(f[c], name)(**options) if name != "size" else f[c].size for c in f.columns]
        else:
            found = list(getattr(f, name)(**options)[["size", "price"]])
        cast = {"long": int, "double": float, "boolean": bool}
        row = tuple(None if (x := _number(v, digits)) is None else cast[k](x) for v, k in zip(found, kind.split(), strict=True))
        return t.session.spark.createDataFrame([row], ", ".join(f"{c} {k}" for c, k in zip(("size", "price"), kind.split(), strict=True)))

    label = ("series" if series else "reduce") + f"_{name}" + ("_strict" if options.get("skipna") is False else "") + ("_pop" if options.get("ddof") == 0 else "") + ("_min_count" if options.get("min_count") else "")
    QUERIES[label], SQL[label] = QUERIES.pop("run"), SQL.pop("run")


_WHOLE, _MIXED, _REAL, _TRUTH = "long long", "long double", "double double", "boolean boolean"
for _s in (False, True):
    _reduction("sum", "CAST(sum(size) AS BIGINT) AS size, round(sum(price), 4) AS price", _MIXED, 4, _s)
    _reduction("sum", "CASE WHEN count(*) = count(size) THEN CAST(sum(size) AS BIGINT) END AS size, CASE WHEN count(*) = count(price) THEN sum(price) END AS price", _MIXED, None, _s, skipna=False)
    _reduction("sum", "CASE WHEN count(size) >= 1000000 THEN CAST(sum(size) AS BIGINT) END AS size, CASE WHEN count(price) >= 1000000 THEN sum(price) END AS price", _MIXED, None, _s, min_count=1000000)
    _reduction("count", "count(size) AS size, count(price) AS price", _WHOLE, None, _s)
    _reduction("mean", "round(avg(size), 6) AS size, round(avg(price), 6) AS price", _REAL, 6, _s)
    _reduction("min", "min(size) AS size, min(price) AS price", _MIXED, None, _s)
    _reduction("max", "max(size) AS size, max(price) AS price", _MIXED, None, _s)
    _reduction("std", "round(stddev_samp(size), 6) AS size, round(stddev_samp(price), 6) AS price", _REAL, 6, _s)
    _reduction("std", "round(stddev_pop(size), 6) AS size, round(stddev_pop(price), 6) AS price", _REAL, 6, _s, ddof=0)
    _reduction("var", "round(var_samp(size), 4) AS size, round(var_samp(price), 4) AS price", _REAL, 4, _s)
    _reduction("median", "round(median(size), 6) AS size, round(median(price), 6) AS price", _REAL, 6, _s)
    _reduction("quantile", "round(quantile_cont(size, 0.3), 6) AS size, round(quantile_cont(price, 0.3), 6) AS price", _REAL, 6, _s, q=0.3)
    _reduction("any", "coalesce(bool_or(size <> 0), false) AS size, coalesce(bool_or(price <> 0), false) AS price", _TRUTH, None, _s)
    _reduction("all", "coalesce(bool_and(size <> 0), true) AS size, coalesce(bool_and(price <> 0), true) AS price", _TRUTH, None, _s)
    _reduction("nunique", "count(DISTINCT size) AS size, count(DISTINCT price) AS price", _WHOLE, None, _s)
_reduction("size", "count(*) AS size, count(*) AS price", _WHOLE, None, True)


@query("SELECT 4 * count(*) AS n FROM part")
def frame_size(t: Tables) -> SparkFrame:
    return t.session.spark.createDataFrame([(int(holes(t).size),)], "n long")


@query("""SELECT o_orderpriority, CAST(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS BIGINT) AS s, round(avg(o_totalprice), 4) AS m, min(o_totalprice) AS lo, max(o_totalprice) AS hi,
count(o_custkey) AS c, count(*) AS n, round(stddev_samp(o_totalprice), 4) AS sd, round(var_samp(o_totalprice / 1000), 4) AS v, round(median(o_totalprice), 4) AS md FROM orders GROUP BY 1""")
def groupby_all_functions(t: Tables) -> DataFrame:
    f = t("orders").assign(cents=lambda d: cents(d, "o_totalprice"), k=lambda d: d["o_totalprice"] / 1000)
    g = f.groupby("o_orderpriority").agg(s=("cents", "sum"), m=("o_totalprice", "mean"), lo=("o_totalprice", "min"), hi=("o_totalprice", "max"), c=("o_custkey", "count"), n=("o_custkey", "size"), sd=("o_totalprice", "std"), v=("k", "var"), md=("o_totalprice", "median"))
    return rounded(g, "m", "sd", "v", "md", digits=4)


@query(f"SELECT brand, count(*) AS n, coalesce(CAST(sum(size) AS BIGINT), 0) AS s FROM ({_HOLES}) WHERE brand IS NOT NULL GROUP BY 1")
def groupby_dropna(t: Tables) -> DataFrame:
    return holes(t).assign(s=lambda d: d["size"]).groupby("brand", as_index=False).agg(n=("p_partkey", "size"), s=("s", "sum"))


@query(f"SELECT brand, count(*) AS n, coalesce(CAST(sum(size) AS BIGINT), 0) AS s FROM ({_HOLES}) GROUP BY 1")
def groupby_keep_null_keys(t: Tables) -> DataFrame:
    return holes(t).groupby("brand", as_index=False, dropna=False).agg(n=("p_partkey", "size"), s=("size", "sum"))


@query("SELECT p_brand, p_type, count(*) AS size FROM part GROUP BY ALL")
def groupby_size(t: Tables) -> DataFrame:
    return t("part").groupby(["p_brand", "p_type"], sort=False).size()


@query("SELECT event_type, round(max(value * 2), 6) AS value FROM events GROUP BY 1")
def series_groupby(t: Tables) -> DataFrame:
    f = t("events")
    return rounded((f["value"] * 2).groupby("event_type").max(), "value")


@query("SELECT p_type, count(*) AS n FROM part GROUP BY 1")
def value_counts(t: Tables) -> SparkFrame:
    found = t("part")["p_type"].value_counts()
    assert list(found) == sorted(found, reverse=True)
    return eager(t, pd.DataFrame({"p_type": found.index, "n": [int(x) for x in found]}), "p_type string, n long")


@query(f"SELECT DISTINCT brand FROM ({_HOLES})")
def unique(t: Tables) -> SparkFrame:
    return eager(t, pd.DataFrame({"brand": list(holes(t)["brand"].unique())}), "brand string")


@query(f"SELECT brand, coalesce(CAST(sum(size) AS BIGINT), 0) AS size, coalesce(round(sum(price), 4), 0) AS price FROM ({_HOLES}) WHERE brand IS NOT NULL GROUP BY 1")
def groupby_selected_columns(t: Tables) -> DataFrame:
    g = holes(t).groupby("brand", as_index=False)
    return rounded(g[["size", "price"]].sum(), "price", digits=4)


@query(f"SELECT brand, max(size) AS size FROM ({_HOLES}) WHERE brand IS NOT NULL GROUP BY 1")
def groupby_selected_column(t: Tables) -> DataFrame:
    return holes(t).groupby("brand")["size"].max().reset_index()


@query(f"SELECT brand, count(size) AS size, round(avg(price), 6) AS price FROM ({_HOLES}) WHERE brand IS NOT NULL GROUP BY 1")
def groupby_agg_dict(t: Tables) -> DataFrame:
    return rounded(holes(t).groupby("brand", as_index=False).agg({"size": "count", "price": "mean"}), "price")


@query(f"SELECT brand, round(median(p_partkey), 6) AS p_partkey, round(median(size), 6) AS size, round(median(price), 6) AS price FROM ({_HOLES}) WHERE brand IS NOT NULL GROUP BY 1")
def groupby_agg_string(t: Tables) -> DataFrame:
    return rounded(rounded(rounded(holes(t).groupby("brand", as_index=False).agg("median"), "p_partkey"), "size"), "price")


def _convenience(name: str, sql: str) -> None:
    @query(f"SELECT brand, {', '.join(sql.format(c) + ' AS ' + c for c in ('size', 'price'))} FROM ({_HOLES}) WHERE brand IS NOT NULL GROUP BY 1")
    def run(t: Tables) -> DataFrame:
        out = getattr(holes(t)[["brand", "size", "price"]].groupby("brand", as_index=False), name)()
        return rounded(rounded(out, "size", digits=4), "price", digits=4) if name == "mean" else out

    QUERIES[f"groupby_{name}"], SQL[f"groupby_{name}"] = QUERIES.pop("run"), SQL.pop("run")


for _n, _q in (("mean", "round(avg({0}), 4)"), ("min", "min({0})"), ("max", "max({0})"), ("count", "count({0})")):
    _convenience(_n, _q)


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS m, min(value) AS lo, round(stddev_samp(value), 6) AS sd, round(var_samp(value), 4) AS v, round(median(value), 6) AS md, count(*) AS rows FROM events GROUP BY 1")
def series_groupby_functions(t: Tables) -> DataFrame:
    f = t("events")
    g = f["value"].groupby("event_type", as_index=False)
    out = g.count().rename(columns={"value": "n"})
    for label, found in (("m", g.mean()), ("lo", g.min()), ("sd", g.std()), ("v", g.var()), ("md", g.median()), ("rows", g.size())):
        out = out.merge(found.rename(columns={"value": label}), on="event_type")
    return rounded(rounded(rounded(rounded(out, "m"), "sd"), "md"), "v", digits=4)


@query("""SELECT l_shipmode_ AS flag, round(avg(share), 9) AS mean_share, round(avg(net), 4) AS mean_net, max(l_extendedprice) AS hi, min(l_extendedprice) AS lo, count(*) AS n
FROM (SELECT l_returnflag AS l_shipmode_, l_extendedprice, l_tax / (l_discount + 1) AS share, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_linestatus = 'O') GROUP BY 1""")
def filter_derive_group(t: Tables) -> DataFrame:
    """Filter, derived columns, then grouped mean, mean, max, min and count over a wide scan."""
    f = t("lineitem")
    f = f[f["l_linestatus"] == "O"]
    f = f.assign(share=f["l_tax"] / (f["l_discount"] + 1), net=f["l_extendedprice"] * (1 - f["l_discount"]))
    g = f.groupby("l_returnflag", as_index=False).agg(mean_share=("share", "mean"), mean_net=("net", "mean"), hi=("l_extendedprice", "max"), lo=("l_extendedprice", "min"), n=("l_extendedprice", "count"))
    return rounded(rounded(g, "mean_share", digits=9), "mean_net", digits=4).rename(columns={"l_returnflag": "flag"})


# --- boundaries and sources -------------------------------------------------------------------------------

_PART = "SELECT p_partkey, p_name, p_size, p_retailprice FROM part"
_PART_COLUMNS = ["p_partkey", "p_name", "p_size", "p_retailprice"]


def _place(t: Tables) -> str:
    """A new path in the folder that the cluster shares."""
    spark = t.session.spark
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="frames-")
    return f"{folder.rstrip('/')}/frames-{uuid.uuid4().hex}"


@query(_PART)
def collect_from_pandas(t: Tables) -> DataFrame:
    return t.session.from_pandas(t("part")[_PART_COLUMNS].collect())


@query(_PART)
def to_arrow_from_arrow(t: Tables) -> DataFrame:
    return t.session.from_arrow(t("part")[_PART_COLUMNS].to_arrow())


@query(_PART)
def to_arrow_batches(t: Tables) -> DataFrame:
    return t.session.from_arrow(t("part")[_PART_COLUMNS].to_arrow_batches(300).read_all())


@query(_PART + " ORDER BY p_partkey LIMIT 7")
def head(t: Tables) -> DataFrame:
    return t.session.from_pandas(t("part", order_by="p_partkey")[_PART_COLUMNS].head(7))


@query(_PART)
def write_parquet(t: Tables) -> DataFrame:
    path = _place(t)
    t("part")[_PART_COLUMNS].write_parquet(path, compression="zstd")
    return t.session.read_parquet(path)


@query(_PART)
def write_csv_read_csv(t: Tables) -> DataFrame:
    path = _place(t)
    t("part")[_PART_COLUMNS].write_csv(path, sep="|")
    return t.session.read_csv(path, delimiter="|").astype({"p_size": "int32"})


@query("SELECT p_partkey, p_size FROM part WHERE p_size > 25")
def persist_table(t: Tables) -> DataFrame:
    f = t("part")
    name = f"frames_{uuid.uuid4().hex}"
    f[f["p_size"] > 25][["p_partkey", "p_size"]].persist(name)
    return t.session.table(name)


@query("SELECT p_brand, p_size FROM part")
def series_collect(t: Tables) -> DataFrame:
    f = t("part", order_by="p_partkey")
    return t.session.from_pandas(pd.DataFrame({"p_brand": f["p_brand"].collect().to_list(), "p_size": f["p_size"].collect().astype("int32").to_list()}))


# --- windows ----------------------------------------------------------------------------------------------

_EV = "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(floor(value * 100) AS BIGINT) END AS v FROM events"


def ordered_events(t: Tables) -> DataFrame:
    f = t("events", order_by="event_id")
    f = f.assign(v=(f["value"] * 100).astype("int64"))
    return f.assign(v=f["v"].mask(f["event_id"] % 7 == 0))[["event_id", "v"]]


@query(f"SELECT event_id, CASE WHEN v IS NOT NULL THEN CAST(sum(v) OVER w AS BIGINT) END AS s, CASE WHEN v IS NOT NULL THEN min(v) OVER w END AS lo, CASE WHEN v IS NOT NULL THEN max(v) OVER w END AS hi FROM ({_EV}) WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def cumulative(t: Tables) -> DataFrame:
    f = ordered_events(t)
    return f.assign(s=f["v"].cumsum(), lo=f["v"].cummin(), hi=f["v"].cummax())[["event_id", "s", "lo", "hi"]]


@query(f"""SELECT event_id, CASE WHEN NOT bool_or(event_id % 5000 = 4999) OVER w THEN CAST(sum(coalesce(v, 1)) OVER w AS BIGINT) END AS s, round(product((event_id + 2) / (event_id + 1)::DOUBLE) OVER w, 4) AS p
FROM ({_EV}) WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def cumulative_strict_and_product(t: Tables) -> DataFrame:
    f = ordered_events(t)
    strict = f["v"].fillna(1).mask(f["event_id"] % 5000 == 4999)
    return rounded(f.assign(s=strict.cumsum(skipna=False), p=((f["event_id"] + 2) / (f["event_id"] + 1)).cumprod())[["event_id", "s", "p"]], "p", digits=4)


@query(f"SELECT event_id, lag(v, 2) OVER w AS a, lead(v, 1, -1) OVER w AS b, v - lag(v) OVER w AS d FROM ({_EV}) WINDOW w AS (ORDER BY event_id)")
def shift_diff(t: Tables) -> DataFrame:
    f = ordered_events(t)
    return f.assign(a=f["v"].shift(2), b=f["v"].shift(-1, fill_value=-1), d=f["v"].diff())[["event_id", "a", "b", "d"]]


@query("SELECT o_orderkey, round((o_totalprice - lag(o_totalprice) OVER w) / lag(o_totalprice) OVER w, 8) AS p FROM orders WINDOW w AS (ORDER BY o_orderkey)")
def pct_change(t: Tables) -> DataFrame:
    f = t("orders", order_by="o_orderkey")
    return rounded(f.assign(p=f["o_totalprice"].pct_change())[["o_orderkey", "p"]], "p", digits=8)


_RANKED = "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END AS size FROM part"


@query(f"""SELECT p_partkey, CASE WHEN size IS NOT NULL THEN rank() OVER w + (count(*) OVER g - 1) / 2.0 END AS average, CASE WHEN size IS NOT NULL THEN CAST(rank() OVER w AS DOUBLE) END AS least,
CASE WHEN size IS NOT NULL THEN CAST(rank() OVER w + count(*) OVER g - 1 AS DOUBLE) END AS most, CASE WHEN size IS NOT NULL THEN CAST(dense_rank() OVER w AS DOUBLE) END AS dense,
CASE WHEN size IS NOT NULL THEN CAST(row_number() OVER (ORDER BY size NULLS LAST, p_partkey) AS DOUBLE) END AS first FROM ({_RANKED}) WINDOW w AS (ORDER BY size NULLS LAST), g AS (PARTITION BY size)""")
def rank_methods(t: Tables) -> DataFrame:
    f = t("part", order_by="p_partkey")
    s = f["p_size"].mask(f["p_size"] % 3 == 0)
    return f.assign(average=s.rank(), least=s.rank(method="min"), most=s.rank(method="max"), dense=s.rank(method="dense"), first=s.rank(method="first"))[["p_partkey", "average", "least", "most", "dense", "first"]]


@query(f"""SELECT p_partkey, CAST(rank() OVER (ORDER BY size DESC NULLS FIRST) AS DOUBLE) AS top, CAST(rank() OVER (ORDER BY size NULLS LAST) AS DOUBLE) AS bottom,
CASE WHEN size IS NOT NULL THEN round(rank() OVER (ORDER BY size NULLS LAST) / CAST(count(size) OVER () AS DOUBLE), 9) END AS share FROM ({_RANKED})""")
def rank_options(t: Tables) -> DataFrame:
    f = t("part", order_by="p_partkey")
    s = f["p_size"].mask(f["p_size"] % 3 == 0)
    g = f.assign(top=s.rank(method="min", na_option="top", ascending=False), bottom=s.rank(method="min", na_option="bottom"), share=s.rank(method="min", pct=True))
    return rounded(g[["p_partkey", "top", "bottom", "share"]], "share", digits=9)


@query(f"""SELECT event_id, CASE WHEN count(v) OVER w >= 3 THEN CAST(sum(v) OVER w AS DOUBLE) END AS s, CASE WHEN count(v) OVER w >= 3 THEN round(avg(v) OVER w, 6) END AS m,
CASE WHEN count(v) OVER w >= 3 THEN CAST(min(v) OVER w AS DOUBLE) END AS lo, CASE WHEN count(v) OVER w >= 3 THEN CAST(max(v) OVER w AS DOUBLE) END AS hi,
CASE WHEN row_number() OVER (ORDER BY event_id) >= 3 THEN CAST(count(v) OVER w AS DOUBLE) END AS c, CASE WHEN count(v) OVER w >= 3 THEN round(stddev_samp(v) OVER w, 4) END AS sd
FROM ({_EV}) WINDOW w AS (ORDER BY event_id ROWS 4 PRECEDING)""")
def rolling(t: Tables) -> DataFrame:
    f = ordered_events(t)
    r = f["v"].rolling(5, 3)
    return rounded(rounded(f.assign(s=r.sum(), m=r.mean(), lo=r.min(), hi=r.max(), c=r.count(), sd=r.std())[["event_id", "s", "m", "lo", "hi", "c", "sd"]], "m"), "sd", digits=4)


@query(f"SELECT event_id, CASE WHEN count(v) OVER w >= 2 THEN CAST(sum(v) OVER w AS DOUBLE) END AS s, CAST(count(v) OVER w AS DOUBLE) AS c, CASE WHEN count(v) OVER w >= 2 THEN CAST(max(v) OVER w AS DOUBLE) END AS hi FROM ({_EV}) WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def expanding(t: Tables) -> DataFrame:
    f = ordered_events(t)
    e = f["v"].expanding(2)
    return f.assign(s=e.sum(), c=f["v"].expanding(1).count(), hi=e.max())[["event_id", "s", "c", "hi"]]


@query(f"SELECT CAST(sum(event_id) OVER w AS BIGINT) AS event_id, CASE WHEN v IS NOT NULL THEN CAST(sum(v) OVER w AS BIGINT) END AS v FROM ({_EV}) WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def frame_cumulative(t: Tables) -> DataFrame:
    return ordered_events(t).cumsum()


@query(f"SELECT lag(event_id, 3) OVER w AS event_id, lag(v, 3) OVER w AS v FROM ({_EV}) WINDOW w AS (ORDER BY event_id)")
def frame_shift(t: Tables) -> DataFrame:
    return ordered_events(t).shift(3)


@query(f"SELECT CAST(row_number() OVER (ORDER BY event_id) AS DOUBLE) AS event_id, CASE WHEN v IS NOT NULL THEN rank() OVER (ORDER BY v NULLS LAST) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 END AS v FROM ({_EV})")
def frame_rank(t: Tables) -> DataFrame:
    return ordered_events(t).rank()


@query(f"SELECT CASE WHEN row_number() OVER (ORDER BY event_id) >= 3 THEN CAST(sum(event_id) OVER w AS DOUBLE) END AS event_id, CASE WHEN count(v) OVER w >= 3 THEN CAST(sum(v) OVER w AS DOUBLE) END AS v FROM ({_EV}) WINDOW w AS (ORDER BY event_id ROWS 3 PRECEDING)")
def frame_rolling(t: Tables) -> DataFrame:
    return ordered_events(t).rolling(4, 3).sum()


@query(f"""SELECT event_id, CASE WHEN count(v) OVER w >= 1 THEN round(avg(v) OVER w, 6) END AS m, CASE WHEN count(v) OVER w >= 1 THEN CAST(min(v) OVER w AS DOUBLE) END AS lo,
CASE WHEN count(v) OVER w >= 2 THEN round(stddev_samp(v) OVER w, 4) END AS sd, CASE WHEN count(v) OVER w >= 2 THEN round(var_samp(v) OVER w / 700, 3) END AS va FROM ({_EV}) WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def expanding_moments(t: Tables) -> DataFrame:
    f = ordered_events(t)
    e = f["v"].expanding()
    g = f.assign(m=e.mean(), lo=e.min(), sd=e.std(), va=e.var() / 700)[["event_id", "m", "lo", "sd", "va"]]
    return rounded(rounded(rounded(g, "m"), "sd", digits=4), "va", digits=3)


@query(f"SELECT event_id, CASE WHEN count(v) OVER w >= 4 THEN round(var_samp(v) OVER w / 700, 3) END AS va FROM ({_EV}) WINDOW w AS (ORDER BY event_id ROWS 3 PRECEDING)")
def rolling_var(t: Tables) -> DataFrame:
    f = ordered_events(t)
    return rounded(f.assign(va=f["v"].rolling(4).var() / 700)[["event_id", "va"]], "va", digits=3)


# --- more joins and assignments ---------------------------------------------------------------------------


@query("SELECT n_nationkey, n_name, c_custkey FROM nation JOIN customer ON n_nationkey = c_nationkey")
def merge_common_keys(t: Tables) -> DataFrame:
    c = t("customer").rename(columns={"c_nationkey": "n_nationkey"})
    return t("nation")[["n_nationkey", "n_name"]].merge(c[["n_nationkey", "c_custkey"]])


@query("SELECT o_custkey AS k, o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY k, o_orderkey LIMIT 50")
def merge_sorted(t: Tables) -> DataFrame:
    a, b = t("orders").rename(columns={"o_custkey": "k"}), t("customer").rename(columns={"c_custkey": "k"})
    joined = a[["k", "o_orderkey"]].merge(b[["k", "c_name"]], on="k", sort=True)
    assert joined.ordering[0] == "k"
    return joined.sort_values(["k", "o_orderkey"]).limit(50)


@query("SELECT p_partkey, p_size * 2 AS p_size, 'x' AS tag FROM part")
def set_item(t: Tables) -> DataFrame:
    f = t("part")[["p_partkey", "p_size"]]
    f["p_size"] = f["p_size"] * 2
    f["tag"] = "x"
    return f


@query("SELECT o_totalprice FROM orders ORDER BY o_totalprice DESC LIMIT 12")
def series_nlargest(t: Tables) -> DataFrame:
    return t("orders", order_by="o_orderkey")["o_totalprice"].nlargest(12).to_frame()


@query("SELECT s_acctbal FROM supplier ORDER BY s_acctbal LIMIT 9")
def series_nsmallest(t: Tables) -> DataFrame:
    return t("supplier", order_by="s_suppkey")["s_acctbal"].nsmallest(9).to_frame()


# --- distinct rows, top rows, positions -------------------------------------------------------------------


@query("SELECT DISTINCT p_brand, p_type FROM part")
def drop_duplicates_all(t: Tables) -> DataFrame:
    return t("part")[["p_brand", "p_type"]].drop_duplicates()


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def drop_duplicates_first(t: Tables) -> DataFrame:
    return t("events", order_by="event_id").drop_duplicates("user_id")[["event_id", "user_id", "event_type"]]


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def drop_duplicates_last(t: Tables) -> DataFrame:
    return t("events", order_by="event_id").drop_duplicates("user_id", keep="last")[["event_id", "user_id"]]


@query("SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1")
def drop_duplicates_none(t: Tables) -> DataFrame:
    return t("lineitem").drop_duplicates(["l_orderkey", "l_linenumber"], keep=False)[["l_orderkey", "l_linenumber"]]


@query("SELECT DISTINCT o_orderpriority FROM orders")
def series_drop_duplicates(t: Tables) -> DataFrame:
    return t("orders")["o_orderpriority"].drop_duplicates().to_frame()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def nlargest(t: Tables) -> DataFrame:
    return t("orders", order_by="o_orderkey").nlargest(25, "o_totalprice")[["o_orderkey", "o_totalprice"]]


@query("SELECT p_partkey, p_size FROM part ORDER BY p_size, p_partkey DESC LIMIT 40")
def nsmallest_last(t: Tables) -> DataFrame:
    return t("part", order_by="p_partkey").nsmallest(40, "p_size", keep="last")[["p_partkey", "p_size"]]


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 30 OFFSET 10")
def sort_limit_offset(t: Tables) -> DataFrame:
    return t("customer").sort_values(["c_acctbal", "c_custkey"], ascending=[False, True]).limit(30, offset=10)[["c_custkey", "c_acctbal"]]


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 100")
def iloc_slice(t: Tables) -> DataFrame:
    return t("orders", order_by="o_orderkey").iloc[100:120, :2]


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (1, 7, 42)")
def loc_labels(t: Tables) -> DataFrame:
    return t("orders").set_index("o_custkey").loc[[1, 7, 42], ["o_orderkey", "o_totalprice"]]


# --- SQL --------------------------------------------------------------------------------------------------

_TPCH = """SELECT n.n_name AS nation, count(*) AS orders, CAST(sum(CAST(floor(o.o_totalprice * 100 + 0.5) AS BIGINT)) AS BIGINT) AS cents
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
WHERE r.r_name = 'ASIA' GROUP BY n.n_name"""


def sql_passthrough(spark: SparkSession, sf_dir: str) -> SparkFrame:
    session = tessera.Session(spark=spark.newSession())  # its views are its own
    for name in ("orders", "customer", "nation", "region"):
        session.spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return plain(session.sql(_TPCH))


QUERIES["sql_passthrough"], SQL["sql_passthrough"] = sql_passthrough, _TPCH

__all__ = ["QUERIES", "SQL"]
