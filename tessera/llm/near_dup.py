"""Near-duplicates by b-bit MinHash.

Texts of the same words in the same order are one *class* from then on, by a cryptographic digest of their words, so
exact copies cost one row; classes with equal sets are links like any others. A class is its set of word shingles, each
a 64-bit hash.
A class has ``BANDS * ROWS`` minima; whole minima make the band keys, and only their low eight bits are kept as the
packed signature. Classes that share a band key are candidates; the number of agreeing bytes, corrected for chance
collisions, drops pairs that are far below the threshold; the rest is confirmed on the full sets.

No bucket is paired out. First every class of a bucket is compared with the bucket's centre alone, the class whose band
keys are the most common: among edited copies of a text that is the text itself, which the copies resemble more than
each other. A centre's pairs are dealt to several tasks. A bucket in which the centre is not linked with all others, of which there are several, stays open. Open buckets
that share classes make a group, groups are dealt into blocks of bounded size, and each pair of blocks is compared at once
by a product of 0/1 matrices, which gives all intersections exactly; only links leave the task, and no more of them
than join its classes. So every candidate pair is either compared or already connected, whatever a group's size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import NARROW_BYTES, chunks, lower_ascii, mix, range_hashes, sequence_digests, sliding_hashes, text_buffers, word_hashes, words
from .components import components
from .shared import written

BANDS, ROWS = 28, 4
MINIMA = BANDS * ROWS
#: Classes, and shingles of their sets, that one block of an open group holds.
BLOCK_CLASSES, BLOCK_SHINGLES = 768, 1 << 20
#: Pairs of one class that meet one copy of its text.
PAIRS_A_COPY = 64
#: Standard deviations by which a signature's estimate may fall short before a pair is dropped unseen.
SLACK = 6
#: Texts handled at once.
_ROWS = 2048

_rng = np.random.default_rng(7077)
_A = _rng.integers(0, 2**32, MINIMA, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, MINIMA, dtype=np.uint32)
_BAND = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def _in_rows(keys: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and rows sorted by row, then key."""
    order = np.argsort(keys)
    order = order[np.argsort(row[order].astype(np.uint16), kind="stable")]
    return keys[order], row[order]


def shingle_sets(column: pa.Array, size: int, digests: bool = False) -> tuple:
    """Hashes of each row's distinct shingles in order, each row's first place among them, and digests of the rows' words.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a text of fewer than ``size`` words is one shingle. At
    most ``_ROWS`` rows. A long text takes about 15 bytes of memory a byte.
    """
    body, off = text_buffers(column)
    body = lower_ascii(body)
    starts, ends, first = words(body, off)
    hashes = word_hashes(body, starts, ends)
    count = np.diff(first)
    long = np.flatnonzero(count >= size)
    number = count[long] - size + 1
    row = np.repeat(long, number)
    begin = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
    wide = sliding_hashes(hashes, size) if len(long) else hashes[:0]
    short = np.flatnonzero((count > 0) & (count < size))
    keys = np.concatenate([wide[begin], range_hashes(hashes, first[short], first[short + 1])])
    keys, row = _in_rows(keys, np.concatenate([row, short]))
    if len(keys):
        new = np.append(True, (keys[1:] != keys[:-1]) | (row[1:] != row[:-1]))
        keys, row = keys[new], row[new]
    edge = np.searchsorted(row, np.arange(len(count) + 1))
    return (keys, edge, sequence_digests(body, starts, ends, first[:-1], first[1:])) if digests else (keys, edge)


def _pieces(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, text, NARROW_BYTES):
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n (set size), digest (of the words), sig (bytes of the minima as longs), bands (their keys)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, "text"):
            keys, edge, digests = shingle_sets(batch.column(1), size, digests=True)
            n = np.diff(edge)
            some = np.flatnonzero(n)
            minima = np.zeros((MINIMA, batch.num_rows), np.uint32)
            if len(some):
                x = mix(keys).astype(np.uint32)
                for k in range(MINIMA):
                    minima[k, some] = np.minimum.reduceat(x * _A[k] + _B[k], edge[some])
            sig = np.ascontiguousarray((minima & np.uint32(255)).astype(np.uint8).T).view(np.int64).ravel()
            wide = minima.astype(np.uint64).reshape(BANDS, ROWS, -1)
            key = np.broadcast_to(_BAND[:, None], wide[:, 0].shape).copy()
            for r in range(ROWS):
                key = mix(key + wide[:, r])
            bands = key.T.reshape(-1).view(np.int64)
            m, offset = batch.num_rows, lambda w: pa.array(np.arange(m + 1, dtype=np.int32) * w)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n),
                    pa.array(digests, pa.binary()),
                    pa.ListArray.from_arrays(offset(MINIMA // 8), pa.array(sig)),
                    pa.ListArray.from_arrays(offset(BANDS), pa.array(np.ascontiguousarray(bands))),
                ],
                ["doc_id", "n", "digest", "sig", "bands"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, digest binary, sig array<long>, bands array<long>")


def agreeing(a: str, b: str) -> Column:
    """Number of equal bytes of two signatures: each byte of the difference is folded onto its lowest bit."""
    ones = 0x0101010101010101
    different = []
    for i in range(MINIMA // 8):
        d = f"({a}[{i}] ^ {b}[{i}])"
        folded = " | ".join([d, *(f"shiftrightunsigned({d}, {k})" for k in range(1, 8))])
        different.append(f"bit_count(({folded}) & {ones}L)")
    return F.expr(f"{MINIMA} - (" + " + ".join(different) + ")")


def least_agreeing(percent: int) -> int:
    """Agreeing bytes below which the corrected estimate lies ``SLACK`` deviations under the threshold."""
    j = percent / 100
    p = j + (1 - j) / 256  # chance that a byte agrees: the minima are the same, or differ alike in the low bits
    return max(0, int(MINIMA * p - SLACK * (MINIMA * p * (1 - p)) ** 0.5))


def confirm(pairs: DataFrame, percent: int, size: int) -> DataFrame:
    """The links (a, b) among pairs with their texts (a, b, ta, tb), by exact similarity of the full sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, "ta"):
            a, b, ta, tb = batch.columns
            (ka, ea), (kb, eb) = shingle_sets(ta, size), shingle_sets(tb, size)
            rows = np.arange(batch.num_rows)
            both, row = _in_rows(np.concatenate([ka, kb]), np.concatenate([np.repeat(rows, np.diff(ea)), np.repeat(rows, np.diff(eb))]))
            inter = np.bincount(row[1:][(both[1:] == both[:-1]) & (row[1:] == row[:-1])], minlength=batch.num_rows)
            union = np.diff(ea) + np.diff(eb) - inter
            good = pa.array((union > 0) & (100 * inter >= percent * union))
            yield pa.RecordBatch.from_arrays([a.filter(good), b.filter(good)], ["a", "b"])

    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def block_links(keys_a: np.ndarray, edge_a: np.ndarray, keys_b: np.ndarray, edge_b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and of b that are links, as far as needed to connect all that links connect.

    Keys are shingle hashes of consecutive rows. The product runs over the shingles that both sides have, some
    columns at a time.
    """
    na, nb = np.diff(edge_a), np.diff(edge_b)
    inter = np.zeros((len(na), len(nb)), np.float32)
    row_a, row_b = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
    both = np.intersect1d(keys_a, keys_b)
    in_a, in_b = np.searchsorted(both, keys_a), np.searchsorted(both, keys_b)
    hit_a, hit_b = (np.append(both, 0)[i] == k if len(both) else np.zeros(len(k), bool) for i, k in ((in_a, keys_a), (in_b, keys_b)))
    hit_a &= in_a < len(both)
    hit_b &= in_b < len(both)
    row_a, in_a, row_b, in_b = row_a[hit_a], in_a[hit_a], row_b[hit_b], in_b[hit_b]
    order_a, order_b = np.argsort(in_a, kind="stable"), np.argsort(in_b, kind="stable")
    row_a, in_a, row_b, in_b = row_a[order_a], in_a[order_a], row_b[order_b], in_b[order_b]
    width = 2048
    for low in range(0, len(both), width):
        (a0, a1), (b0, b1) = np.searchsorted(in_a, (low, low + width)), np.searchsorted(in_b, (low, low + width))
        x, y = np.zeros((len(na), width), np.float32), np.zeros((len(nb), width), np.float32)
        x[row_a[a0:a1], in_a[a0:a1] - low] = 1
        y[row_b[b0:b1], in_b[b0:b1] - low] = 1
        inter += x @ y.T
    union = na[:, None] + nb[None, :] - inter.astype(np.int64)
    return np.nonzero((union > 0) & (100 * inter.astype(np.int64) >= percent * union))


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mask of links that are enough to connect what all of them connect."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    keep = np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            keep[i] = True
    return keep


def compare_groups(members: DataFrame, percent: int, size: int) -> DataFrame:
    """Links (a, b) within groups; ``members`` has grp, node, n and text. Every pair of a group meets in one task."""
    shape = members.groupBy("grp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = members.join(shape, "grp").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = dealt.select("grp", "node", "text", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = other.select("grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "text")

    def run(table: pa.Table) -> pa.Table:
        node, own = table.column("node").to_numpy(), table.column("own").to_numpy()
        sets: list[np.ndarray] = []
        for batch in _pieces(table.select(["text"]).combine_chunks().to_batches(), "text"):
            keys, edge = shingle_sets(batch.column(0), size)
            sets += [keys[edge[i] : edge[i + 1]] for i in range(batch.num_rows)]
        i = int(own.min())
        left, right = np.flatnonzero(own == i), np.flatnonzero(own != i)
        if not len(right):
            right = left
        flat = lambda rows: (np.concatenate([sets[r] for r in rows]), np.concatenate([[0], np.cumsum([len(sets[r]) for r in rows])]))
        x, y = block_links(*flat(left), *flat(right), percent)
        a, b = node[left[x]], node[right[y]]
        keep = a != b
        a, b = a[keep], b[keep]
        keep = _forest(a, b)
        return pa.table({"a": pa.array(a[keep]), "b": pa.array(b[keep])})

    return placed.groupBy("grp", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(spark: SparkSession, docs: DataFrame, size: int = 3, percent: int = 85) -> DataFrame:
    """Components of texts of which ``100 * intersection >= percent * union`` holds for sets of ``size``-word shingles.

    Returns for each row doc_id, ``n_shingles``, ``component_id`` (least doc_id that can be reached) and ``kept``
    (it is the row's own). A text without words has an empty set, is linked with nothing and is kept. Repeated rows
    fall in one class: rows with the same id are all kept if that id is the least. A null id is passed over as
    component_id; a row that only such rows are linked with has a null component_id and is kept if it is alone.
    An empty table gives no rows; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(spark, signatures(docs, size))
    classes = rows.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("did"), F.first(F.struct("n", "sig", "bands")).alias("v"))
    classes = written(spark, classes.select(F.monotonically_increasing_id().alias("node"), "digest", "did", "v.*"))
    keys = classes.select("node", F.explode("bands").alias("key"))
    common = written(spark, keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"))
    members = written(spark, keys.join(common, "key"))
    popular = written(spark, members.groupBy("node").agg(F.sum("c").alias("pop")))
    texts = written(spark, _texts(popular.join(classes.select("node", "did", "digest"), "node"), docs))
    placed = members.join(popular, "node").select("key", "node", "pop")
    centre = written(spark, placed.groupBy("key").agg(F.max(F.struct("pop", "node")).alias("m")).select("key", F.col("m.node").alias("centre")))
    met = written(spark, members.join(centre, "key").filter("node <> centre").select("key", "node", "centre"))

    side = lambda x: classes.select(F.col("node").alias(x), F.struct("n", "sig").alias(f"v{x}"))
    pairs = met.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").filter(f"100 * least(va.n, vb.n) >= {percent} * greatest(va.n, vb.n)")
    pairs = written(spark, pairs.filter(agreeing("va.sig", "vb.sig") >= least_agreeing(percent)).select("a", "b"))
    links = written(spark, confirm(_with_text(_with_text(pairs, "a", "b", texts), "b", "a", texts), percent, size))

    # A bucket is open if it holds more classes than its centre and one, and its centre is not linked with them all.
    ends = links.select("a", "b", F.lit(1).alias("linked"))
    now = met.select("key", "node", F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).join(ends, ["a", "b"], "left")
    count = now.groupBy("key").agg(F.count(F.lit(1)).alias("all"), F.count("linked").alias("linked"), F.min("node").alias("least"))
    apart = written(spark, count.filter("all > 1 and linked < all").select("key", "least"))
    left = written(spark, met.join(apart, "key").select("node", "least").distinct())
    if not left.isEmpty():
        groups = components(spark, left.select(F.col("node").alias("a"), F.col("least").alias("b")))
        open_ = groups.select("node", F.col("root").alias("grp")).join(classes.select("node", "n"), "node").join(texts, "node")
        links = links.unionByName(written(spark, compare_groups(open_, percent, size)))
    roots = components(spark, links)

    joined = classes.select("node", "digest", "did").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    low = joined.groupBy("root").agg(F.min("did").alias("component_id"))
    reps = written(spark, joined.join(low, "root").select("digest", "component_id"))
    out = rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest")).join(reps, "digest", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _with_text(pairs: DataFrame, x: str, other: str, texts: DataFrame) -> DataFrame:
    """Adds the text of class ``x`` as ``t<x>``; a class with many pairs has several copies of it, each for some of the pairs."""
    copies = pairs.groupBy(x).agg(F.ceil(F.count(F.lit(1)) / PAIRS_A_COPY).cast("int").alias("copies"))
    left = pairs.join(copies, x).withColumn("copy", F.pmod(F.xxhash64(other), F.col("copies")).cast("int")).drop("copies")
    right = texts.withColumnRenamed("node", x).join(copies, x).select(x, F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.col("text").alias(f"t{x}"))
    return left.join(right, [x, "copy"]).drop("copy")


def _texts(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """node and text of the classes ``wanted`` (node, did, digest): of the texts with a class's least id, the one with its digest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", NARROW_BYTES):
            body, off = text_buffers(batch.column(2))
            body = lower_ascii(body)
            starts, ends, first = words(body, off)
            have = pa.array(sequence_digests(body, starts, ends, first[:-1], first[1:]), pa.binary())
            right = pa.array([x == y for x, y in zip(have, batch.column(1), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(right), batch.column(2).filter(right)], ["node", "text"])

    found = wanted.join(docs, wanted.did.eqNullSafe(docs.doc_id)).select("node", "digest", "text").mapInArrow(run, "node long, text string")
    return found.dropDuplicates(["node"])
