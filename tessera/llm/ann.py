"""Nearest neighbours by learned partitions.

The neighbour graph of a bounded sample is cut into balanced parts, a small network learns to tell a vector's part,
and it then assigns every row to its most probable part. The number of parts grows with the square root of the table. A
query is sent to its most probable parts, as many as hold a certain share of the probability, and reranked there by exact
inner products. That share is set from measured recall: the true neighbours of some queries, found by brute force over
all rows, say how much of the probability stands before the parts they lie in. So clear queries visit few parts, and
vectors without any neighbourhood structure, which no partition can sort, visit many.

Parts are searched in blocks of bounded size, so a part that holds a third of all rows is split like any other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import written

#: Rows that the graph and the network are fitted on at most, those with the least hash of the id, and wanted for each part.
SAMPLE_ROWS, SAMPLE_PER_PART = 32768, 128
#: Parts: the square root of the number of rows divided by this, between these bounds.
ROOT_PER_PART, LEAST_PARTS, MOST_PARTS = 4, 4, 2048
#: Queries whose true neighbours set the share of probability to visit, and the recall aimed at.
CALIBRATION_QUERIES, RECALL = 1024, 0.94
#: Rows of one block of candidates and of queries.
BLOCK_ROWS, QUERY_ROWS = 8192, 4096


def neighbour_graph(x: np.ndarray, k: int = 12) -> np.ndarray:
    """The k rows of largest inner product with each row, block by block."""
    out = np.empty((len(x), min(k, len(x) - 1)), np.int64)
    for a in range(0, len(x), 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + len(s)] = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 25) -> np.ndarray:
    """Label of each row: parts of equal size (to 5 %) with few graph edges between them.

    Starts from halving along main directions, then rows move to the part that most of their neighbours are in,
    the most determined first, as far as there is room.
    """
    label = np.zeros(len(x), np.int64)

    def halve(rows: np.ndarray, low: int, count: int) -> None:
        if count == 1:
            label[rows] = low
            return
        centred = x[rows] - x[rows].mean(0)
        axis = np.linalg.svd(centred.T @ centred)[0][:, 0]
        order = rows[np.argsort(centred @ axis, kind="stable")]
        cut = len(rows) * (count // 2) // count
        halve(order[:cut], low, count // 2)
        halve(order[cut:], low + count // 2, count - count // 2)

    halve(np.arange(len(x)), 0, parts)
    room = int(np.ceil(1.05 * len(x) / parts))
    ends = np.concatenate([np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()])
    other = np.concatenate([graph.ravel(), np.repeat(np.arange(len(x)), graph.shape[1])])
    for _ in range(rounds):
        votes = np.bincount(ends * parts + label[other], minlength=len(x) * parts).reshape(-1, parts)
        gain = votes.max(1) - votes[np.arange(len(x)), label]
        size = np.bincount(label, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            to = votes[i].argmax()
            if size[to] < room:
                size[label[i]] -= 1
                size[to] += 1
                label[i] = to
                moved += 1
        if not moved:
            break
    return label


@dataclass(frozen=True)
class Router:
    """One hidden layer; the scores rank a vector's parts."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x.astype(np.float32) @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def train_router(x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 60, seed: int = 5) -> Router:
    """Fit to the shares of each row's neighbours in the parts, by Adam on cross-entropy."""
    r = np.random.default_rng(seed)
    d, k = x.shape[1], target.shape[1]
    p = [r.normal(0, d**-0.5 * 2, (d, hidden)), np.zeros(hidden), r.normal(0, hidden**-0.5, (hidden, k)), np.zeros(k)]
    p = [a.astype(np.float32) for a in p]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = r.permutation(len(x))
        for a in range(0, len(x), 256):
            rows = order[a : a + 256]
            h = np.maximum(x[rows] @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            z = np.exp(z - z.max(1, keepdims=True))
            dz = (z / z.sum(1, keepdims=True) - target[rows]) / len(rows)
            dh = (dz @ p[2].T) * (h > 0)
            t += 1
            for i, g in enumerate((x[rows].T @ dh, dh.sum(0), h.T @ dz, dz.sum(0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] -= 0.003 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Router(*p)


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def shares(router: Router, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts of each row, the most probable first, and the probability that stands before each."""
    z = router.scores(x).astype(np.float64)
    z = np.exp(z - z.max(1, keepdims=True))
    z /= z.sum(1, keepdims=True)
    order = np.argsort(-z, axis=1, kind="stable")
    z = np.take_along_axis(z, order, 1)
    return order, np.cumsum(z, axis=1) - z


def route(rows: DataFrame, router: Router, share: float) -> DataFrame:
    """Each row (id, vec) with its most probable part, and those after it before which less than ``share`` stands: a row for each."""
    dim = router.w1.shape[0]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 4096):
                batch = whole.slice(a, 4096)
                order, before = shares(router, _matrix(batch.column(1), dim))
                before[:, 0] = -1
                row, col = np.nonzero(before < share)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(order[row, col].astype(np.int32))], ["id", "vec", "part"])

    kind = rows.schema["vec"].dataType.simpleString()
    return rows.select("id", "vec").mapInArrow(run, f"id long, vec {kind}, part int")


def best_of(queries: np.ndarray, query_ids: np.ndarray, base: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query id, candidate id and inner product of each query's k best ids; ties go to the smaller id, an id counts once, with its best row."""
    order = np.argsort(ids, kind="stable")
    new = np.append(True, ids[order[1:]] != ids[order[:-1]]) if len(order) else np.zeros(0, bool)
    if new.all():
        return _best_rows(queries, query_ids, base, ids, k)
    # Rows of the same id are parted into layers without repeats; the best of all layers are merged.
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    layer = np.arange(len(order)) - first
    found = [_best_rows(queries, query_ids, base[order[layer == n]], ids[order[layer == n]], k) for n in range(int(layer.max()) + 1)]
    q, c, s = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((-s, c, q))
    q, c, s = q[order], c[order], s[order]
    once = np.append(True, (q[1:] != q[:-1]) | (c[1:] != c[:-1])) if len(q) else np.zeros(0, bool)
    q, c, s = q[once], c[once], s[once]
    order = np.lexsort((c, -s, q))
    q, c, s = q[order], c[order], s[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], c[keep], s[keep]


def _best_rows(queries: np.ndarray, query_ids: np.ndarray, base: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    base = base.astype(np.float64)
    for a in range(0, len(queries), 256):
        q, own = queries[a : a + 256].astype(np.float64), query_ids[a : a + 256]
        s = q @ base.T
        s[own[:, None] == ids[None, :]] = -np.inf
        if s.shape[1] > k:
            bar = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            slack = 1e-12 * np.abs(q).sum(1) * np.abs(base).max()  # more than the product's rounding can be
            row, col = np.nonzero((s >= (bar - slack)[:, None]) & (s > -np.inf))
        else:
            row, col = np.nonzero(s > -np.inf)
        exact = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", q[row[b : b + 65536]], base[col[b : b + 65536]]) for b in range(0, len(row), 65536))])
        order = np.lexsort((ids[col], -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        first = np.searchsorted(row, np.arange(len(q)))
        keep = np.arange(len(row)) - first[row] < k
        found.append((own[row[keep]], ids[col[keep]], exact[keep]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (query_ids[:0], ids[:0], np.zeros(0))


def top(found: DataFrame, k: int) -> DataFrame:
    """The k best candidates of each query over all blocks."""
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return one.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(rows: DataFrame, queries: np.ndarray, query_ids: np.ndarray, dim: int, k: int) -> DataFrame:
    """True neighbours of a bounded set of queries among all rows (id, vec, and part, which is carried on)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            q, c, s = best_of(queries, query_ids, _matrix(batch.column(1), dim), ids, k)
            at = np.argsort(ids, kind="stable")
            part = batch.column(2).to_numpy()[at[np.searchsorted(ids[at], c)]]
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(c), pa.array(s), pa.array(part)], ["query_id", "vec_id", "score", "part"])

    found = rows.select("id", "vec", "part").mapInArrow(run, "query_id long, vec_id long, score double, part int")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def fit(x: np.ndarray, parts: int) -> Router:
    """Cuts the neighbour graph of the sample into parts and learns where neighbours lie."""
    graph = neighbour_graph(x)
    label = balanced_parts(x, graph, parts)
    near = np.concatenate([np.arange(len(x))[:, None], graph], 1)
    target = np.zeros((len(x), parts), np.float32)
    np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), label[near.ravel()]), 1)
    return train_router(x, target / target.sum(1, keepdims=True))


def nearest(spark: SparkSession, table: DataFrame, every: int = 20, k: int = 20, recall: float = RECALL, report: dict | None = None) -> DataFrame:
    """The k rows of largest inner product for each row whose vec_id is divisible by ``every``.

    Returns query_id, ``rank`` from 1, vec_id and ``score`` (in double precision on the stored vectors). Vectors that are
    null, zero, of another length than most, or hold null or non-finite components take no part, nor do rows without an
    id; a row is never its own neighbour, and rows with the query's id are its own. Repeated rows count once, and an id
    with several vectors counts once, with the best of them. Fewer candidates than k give all of them; an empty table
    gives no rows; other columns are not read. ``report`` is filled with the number of parts and the share of probability.
    """
    sound = "vec is not null and id is not null and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vec, x -> x <> 0)"
    stored = table.schema["embedding"].dataType
    kind = "array<float>" if stored.simpleString() == "array<float>" else "array<double>"
    rows = table.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast(kind).alias("vec")).filter(sound)
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return nothing
    dim, total = sizes[0]["d"], sizes[0]["count"]
    rows = rows.filter(F.size("vec") == dim)
    parts = int(min(MOST_PARTS, max(LEAST_PARTS, total**0.5 // ROOT_PER_PART)))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(min(SAMPLE_ROWS, parts * SAMPLE_PER_PART)).toArrow()
    x = np.unique(_matrix(sample.column("vec"), dim).astype(np.float32), axis=0)
    parts = min(parts, len(x))
    router = fit(x, parts)

    once = rows.dropDuplicates(["id", "vec"])
    base = written(spark, route(once, router, 0))
    wanted = once.filter(F.col("id") % every == 0)
    probe = wanted.orderBy(F.xxhash64("id"), "id").limit(CALIBRATION_QUERIES).toArrow()
    share = 1.0
    if probe.num_rows:
        q, ids = _matrix(probe.column("vec"), dim), probe.column("id").to_numpy()
        true = brute_force(base, q, ids, dim, k).select("query_id", "part").toArrow()
        order, before = shares(router, q)
        before_part = np.zeros_like(before)
        np.put_along_axis(before_part, order, before, 1)
        at = np.argsort(ids, kind="stable")
        needed = before_part[at[np.searchsorted(ids[at], true.column("query_id").to_numpy())], true.column("part").to_numpy()]
        if len(needed):
            share = float(np.quantile(needed, recall, method="higher")) + 1e-9
    if report is not None:
        report.update(parts=parts, share=share)
    asked = written(spark, route(wanted, router, share))
    # Blocks: the counts by part (at most MOST_PARTS rows) say into how many a part's rows and queries are dealt.
    size = lambda df, rows_a_block, name: df.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / rows_a_block).cast("int").alias(name))
    blocks = F.broadcast(size(base, BLOCK_ROWS, "bs").join(size(asked, QUERY_ROWS, "qs"), "part"))
    pick = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = base.join(blocks, "part").withColumn("b", pick("bs")).withColumn("a", each("qs")).drop("bs", "qs")
    right = asked.join(blocks, "part").withColumn("b", each("bs")).withColumn("a", pick("qs")).drop("bs", "qs")

    def search(one: pa.Table, two: pa.Table) -> pa.Table:
        q, c, s = best_of(_matrix(two.column("vec"), dim), two.column("id").to_numpy(), _matrix(one.column("vec"), dim), one.column("id").to_numpy(), k)
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(c, pa.int64()), "score": pa.array(s, pa.float64())})

    found = left.groupBy("part", "b", "a").cogroup(right.groupBy("part", "b", "a")).applyInArrow(search, "query_id long, vec_id long, score double")
    return top(found, k)
