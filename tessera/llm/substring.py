"""Long repeated word spans, found by compacting the de Bruijn graph of the corpus.

A node is a run of ``width - 1`` words; a window of ``width`` words is the edge from its first node to its last. The
graph is built of the edges that occur at least twice:

1. Every window is dealt by its *anchor*, the k-mer inside it with the least hash; consecutive windows with the same
   anchor form a path. Equal windows have equal anchors, so an anchor that occurs once has no repeated edge, and one
   aggregation drops most of the corpus.
2. One source of each different path is read again at its coordinates. Where all occurrences of an anchor lie in the
   same path, that path is a chain without branches and stays one row; otherwise it is expanded to its edges. Rows carry
   both end nodes and a cryptographic digest of the words read there; edges are counted by digest, weighted with the
   path's occurrences.
3. An aggregation over the ends of repeated edges and chains gives each node's in- and outdegree. A node with one of
   each does not branch: the rows that meet there are joined, first along each source text, then, by a join on nodes and
   connected components, across texts. What comes out are the compacted paths, maximal repeated spans without a branch.
4. Joins bring the verdict, a bit mask over a path's edges, and the length of its compacted path back to all source
   coordinates, where each occurrence is verified: the digest of its own words must be that of the path's source.

Copies meet as one row for each path, never as pairs, and a hot passage is summed before it is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .arrays import NARROW_BYTES, chunks, mix, range_hashes, sequence_digests, sliding_hashes, text_buffers, word_hashes, words
from .components import components
from .shared import discard, written

#: Words scanned at once; a longer text is scanned in stretches, which cuts paths but loses no window.
STRETCH_WORDS = 1 << 19

_NO_ID = -(2**63)


def _key() -> list[Column]:
    """What tells rows apart: the id and the text's hash. Rows alike in both have the same result."""
    return [F.coalesce("doc_id", F.lit(_NO_ID)).alias("kid"), F.xxhash64("text").alias("kh")]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` consecutive ones, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def paths(word_hash: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Text, anchor, path hash, first window and number of windows of each path; ``first`` are the texts' first words."""
    k = max(1, width // 3)
    span = width - k + 1
    n = len(word_hash)
    if n < width:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    gram = sliding_hashes(word_hash, k)
    least = sliding_min(gram, span)
    start = np.arange(len(least))
    # Place of the leftmost least k-mer: the first place, from the window's start, that holds the least value.
    place = np.full(len(least), -1)
    for d in range(span - 1, -1, -1):
        place[gram[d : d + len(least)] == least] = d
    place += start
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = first[text[start] + 1] - start >= width
    start, place = start[inside], place[inside]
    if not len(start):
        return paths(word_hash[:0], first, width)
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(start)))
    begin = start[head]
    owner = text[begin]
    whole = mix(range_hashes(word_hash, begin, begin + count - 1 + width) + (place[head] - begin).astype(np.uint64))
    return owner, gram[place[head]], whole, begin - first[owner], count


def _stretches(word_hash: np.ndarray, first: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The same, of a bounded number of words at a time."""
    for a in range(0, len(word_hash), STRETCH_WORDS):
        part = word_hash[a : a + STRETCH_WORDS + width - 1]
        owner, anchor, path, start, count = paths(part, np.clip(first - a, 0, len(part)), width)
        yield owner, anchor, path, start + np.maximum(a - first[owner], 0), count


def scan_paths(docs: DataFrame, width: int) -> DataFrame:
    """All paths of all texts with their source coordinates; ``docs`` has kid, kh and text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", NARROW_BYTES):
            body, off = text_buffers(batch.column(2))
            starts, ends, first = words(body, off)
            for owner, anchor, path, start, count in _stretches(word_hashes(body, starts, ends), first, width):
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(anchor.view(np.int64)), pa.array(path.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))],
                    ["kid", "kh", "anchor", "path", "start", "edges"],
                )

    return docs.mapInArrow(run, "kid long, kh long, anchor long, path long, start int, edges int")


_PIECES = "kid long, kh long, anchor long, path long, start int, number int, edges int, weight long, branching boolean, left long, right long, digest binary"


def read_sources(sources: DataFrame, width: int) -> DataFrame:
    """Reads paths at their source coordinates; ``sources`` has kid, kh, text and an array of what is asked there.

    A path that does not branch, or occurs more than once, gives a row for itself (``number`` -1); one that branches gives
    a row for each edge. ``left`` and ``right`` are the end nodes, ``digest`` is that of the words.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", NARROW_BYTES):
            body, off = text_buffers(batch.column(2))
            starts, ends, first = words(body, off)
            word_hash = word_hashes(body, starts, ends)
            node = sliding_hashes(word_hash, width - 1).view(np.int64)
            asked = batch.column(3)
            items = asked.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(asked.offsets.to_numpy()))
            anchor, path, start, edges, weight = (items.field(i).to_numpy() for i in range(5))
            branching = items.field(5).to_numpy(zero_copy_only=False)
            whole, split = np.flatnonzero(~branching | (weight > 1)), np.flatnonzero(branching)
            item = np.concatenate([whole, np.repeat(split, edges[split])])
            inner = np.arange(len(item) - len(whole)) - np.repeat(np.cumsum(edges[split]) - edges[split], edges[split])
            number = np.concatenate([np.full(len(whole), -1), inner])
            size = np.where(number < 0, edges[item], 1)
            begin = first[row[item]] + start[item] + np.maximum(number, 0)
            for a in range(0, len(item), 1 << 16):
                some = slice(a, a + (1 << 16))
                i, b, n = item[some], begin[some], size[some]
                take = pa.array(row[i])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(take), batch.column(1).take(take), pa.array(anchor[i]), pa.array(path[i]),
                        pa.array((b - first[row[i]]).astype(np.int32)), pa.array(number[some].astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(weight[i]), pa.array(branching[i]),
                        pa.array(node[b]), pa.array(node[b + n]), pa.array(sequence_digests(body, starts, ends, b, b + n + width - 1), pa.binary()),
                    ],
                    [c.split()[0] for c in _PIECES.split(", ")],
                )

    return sources.select("kid", "kh", "text", "asked").mapInArrow(run, _PIECES)


def compact(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """``digest``, ``path_id`` and ``path_words`` less the node's: the compacted path of each repeated edge or chain.

    ``rows`` has digest, left, right, edges and the coordinates (kid, kh, start) of one source, each digest once.
    """
    ends = rows.select(F.col("left").alias("node"), F.lit(1).alias("outdegree"), F.lit(0).alias("indegree")).unionByName(rows.select(F.col("right").alias("node"), F.lit(0).alias("outdegree"), F.lit(1).alias("indegree")))
    degrees = ends.groupBy("node").agg(F.sum("outdegree").alias("outdegree"), F.sum("indegree").alias("indegree"))
    through = degrees.filter("indegree = 1 and outdegree = 1").select(F.col("node").alias("left"), F.lit(True).alias("joins"))
    along = Window.partitionBy("kid", "kh").orderBy("start")
    met = rows.join(through, "left", "left").withColumn("joins", F.coalesce("joins", F.lit(False)))
    follows = F.col("joins") & F.coalesce(F.lag(F.col("right")).over(along) == F.col("left"), F.lit(False))
    met = met.withColumn("new", (~follows).cast("int")).withColumn("run", F.sum("new").over(along)).withColumn("part", F.xxhash64("kid", "kh", "run"))
    met = written(spark, met.select("digest", "left", "right", "edges", "start", "joins", "part"))
    parts = met.groupBy("part").agg(F.sum("edges").alias("edges"), F.min(F.struct("start", "left", "joins")).alias("head"), F.max(F.struct("start", "right")).alias("tail"))
    parts = written(spark, parts.select("part", "edges", "head.left", "head.joins", "tail.right"))
    seams = parts.filter("joins").select(F.col("part").alias("a"), F.col("left").alias("node")).join(parts.select(F.col("part").alias("b"), F.col("right").alias("node")), "node")
    roots = components(spark, seams.select("a", "b"))
    named = parts.join(roots.withColumnRenamed("node", "part"), "part", "left").select("part", F.coalesce("root", "part").alias("path_id"), "edges")
    total = named.groupBy("path_id").agg(F.sum("edges").alias("path_edges"))
    out = written(spark, met.select("digest", "part").join(named.select("part", "path_id").join(total, "path_id"), "part").select("digest", "path_id", "path_edges"))
    for table in (met, parts):
        discard(spark, table)
    return out


def repeated_windows(spark: SparkSession, docs: DataFrame, width: int) -> DataFrame:
    """For each row key, ``marks``: its paths with masks of those edges that occur elsewhere too, what verifies them, and the edges of the compacted paths."""
    keyed = docs.select(*_key(), "text")
    found = written(spark, scan_paths(keyed, width))
    # Verdicts are written before they are joined, so that both sides of a join are plain shuffles that can be split.
    anchors = written(spark, found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"))
    some = written(spark, found.join(anchors, "anchor"))
    for table in (found, anchors):
        discard(spark, table)
    source = F.min(F.struct("kid", "kh", "start", "edges")).alias("source")
    variants = written(spark, some.groupBy("anchor", "path").agg(F.count(F.lit(1)).alias("weight"), source))
    branching = written(spark, variants.groupBy("anchor").agg((F.count(F.lit(1)) > 1).alias("branching")))
    asked = (
        variants.join(branching, "anchor")
        .groupBy(F.col("source.kid").alias("kid"), F.col("source.kh").alias("kh"))
        .agg(F.collect_list(F.struct("anchor", "path", "source.start", "source.edges", "weight", "branching")).alias("asked"))
    )
    pieces = written(spark, read_sources(asked.join(keyed, ["kid", "kh"]).dropDuplicates(["kid", "kh"]), width))
    for table in (variants, branching):
        discard(spark, table)
    edges, whole = pieces.filter("number >= 0"), pieces.filter("number < 0")
    one = F.min(F.struct("kid", "kh", "start", "left", "right", "edges")).alias("one")
    twice = edges.groupBy("digest").agg(F.sum("weight").alias("n"), one).filter("n > 1").select("digest", "one.*")
    graph = written(spark, twice.unionByName(whole.filter("not branching").select("digest", "kid", "kh", "start", "left", "right", "edges")))
    spans = compact(spark, graph)
    full = F.expr("shiftleft(1L, edges) - 1").alias("mask")
    bits = edges.join(spans, "digest").select("anchor", "path", F.expr("shiftleft(1L, number)").alias("mask"), F.lit(None).cast("binary").alias("digest"), "path_edges")
    chains = whole.join(spans, "digest", "left").select("anchor", "path", full, "digest", "path_edges")
    verdict = bits.unionByName(chains).groupBy("anchor", "path").agg(F.expr("bit_or(mask)").alias("mask"), F.max("digest").alias("digest"), F.max("path_edges").alias("path_edges"))
    masks = written(spark, verdict)
    for table in (pieces, graph, spans):
        discard(spark, table)
    marks = written(spark, some.join(masks, ["anchor", "path"]).groupBy("kid", "kh").agg(F.collect_list(F.struct("start", "mask", "edges", "digest", "path_edges")).alias("marks")))
    for table in (some, masks):
        discard(spark, table)
    return marks


def drop_repeats(spark: SparkSession, docs: DataFrame, width: int, keep_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove every word that a repeated window of ``width`` words covers.

    A window is repeated if its words also start anywhere else, in the same text or another, judged on the input.
    ``docs`` has doc_id and text; the result has doc_id, ``n_words``, ``n_removed``, ``kept_sha256`` (of the kept
    words joined by one space), ``longest_repeat`` and, with ``keep_text``, ``text`` (unchanged where nothing was removed; null stays null), and the columns ``carry`` as they are.
    ``longest_repeat`` is the number of words of the longest compacted path that the text goes through (0 for none).
    All copies of a passage go, the first too: its words leave the corpus, as the windows are judged on the input.
    A null or empty text has no words; repeated rows repeat each other; a null id is kept; an empty table gives no
    rows; other columns are not read. A text is held whole by one task, at about 30 bytes of memory a byte where it is
    longer than a batch.
    """
    if not 2 <= width <= 63:
        raise ValueError("width must be between 2 and 63 words")
    own = [f"c{i}" for i in range(len(carry))]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).alias(n) for c, n in zip(carry, own, strict=True)))
    marks = repeated_windows(spark, docs, width)
    both = docs.select("doc_id", "text", *own, *_key()).join(marks, ["kid", "kh"], "left").select("doc_id", "text", "marks", *own)
    schema = T.StructType([T.StructField(n, t()) for n, t in (("doc_id", T.LongType), ("n_words", T.LongType), ("n_removed", T.LongType), ("kept_sha256", T.StringType), ("longest_repeat", T.LongType), ("text", T.StringType))][: 5 + keep_text] + [both.schema[n] for n in own])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", NARROW_BYTES):
            body, off = text_buffers(batch.column(1))
            starts, ends, first = words(body, off)
            n = batch.num_rows
            cover = np.zeros(len(starts) + 1, np.int64)
            asked = batch.column(2)
            per = np.diff(asked.offsets.to_numpy()) if asked.null_count == 0 else np.array([0 if x is None else x for x in asked.value_lengths().to_pylist()], np.int64)
            items = asked.flatten()
            row = np.repeat(np.arange(n), per)
            longest = np.zeros(n, np.int64)
            if len(row):
                begin, mask, edges, ahead = first[row] + items.field(0).to_numpy(), items.field(1).to_numpy(), items.field(2).to_numpy(), items.field(4).to_numpy()
                right = items.field(3)
                check = np.flatnonzero(right.is_valid().to_numpy(zero_copy_only=False))
                good = np.ones(len(row), bool)
                for a in range(0, len(check), 1 << 16):
                    at = check[a : a + (1 << 16)]
                    have = sequence_digests(body, starts, ends, begin[at], begin[at] + edges[at] + width - 1)
                    good[at] = [x == y for x, y in zip(have, right.take(pa.array(at)).to_pylist(), strict=True)]
                begin, mask = begin[good], mask[good]
                np.maximum.at(longest, row[good], ahead[good] + width - 1)
                for d in range(64):
                    hit = begin[(mask >> d) & 1 == 1] + d
                    cover += np.bincount(hit, minlength=len(cover)) - np.bincount(hit + width, minlength=len(cover)) if len(hit) else 0
            kept = np.cumsum(cover)[:-1] == 0
            total = np.zeros(len(starts) + 1, np.int64)
            np.cumsum(kept, out=total[1:])
            left = np.diff(total[first])
            # Kept words, each with one space after it; a text's last space is left out of its slice.
            size = (ends - starts)[kept] + 1
            ahead = np.zeros(len(size) + 1, np.int64)
            np.cumsum(size, out=ahead[1:])
            at = np.repeat(starts[kept] - ahead[:-1], size)
            at += np.arange(ahead[-1])
            joined = np.append(body, np.uint8(32))[at]
            joined[ahead[1:] - 1] = 32
            low = ahead[total[first[:-1]]]
            high = np.where(left > 0, ahead[total[first[1:]]] - 1, low)
            view = memoryview(joined)
            low, high = low.tolist(), high.tolist()
            out = [
                batch.column(0),
                pa.array(np.diff(first)),
                pa.array(np.diff(first) - left),
                pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(low, high, strict=True)]),
                pa.array(longest),
            ]
            if keep_text:
                gone = (np.diff(first) - left).tolist()
                old = batch.column(1)
                out.append(pa.array([bytes(view[low[i] : high[i]]).decode() if gone[i] else old[i].as_py() for i in range(n)], pa.string()))
            out += batch.columns[3:]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_words", "n_removed", "kept_sha256", "longest_repeat"] + ["text"] * keep_text + own)

    return both.mapInArrow(run, schema).withColumnsRenamed(dict(zip(own, carry, strict=True)))
