"""Fixity audit of web archives by Merkle trees.

Records are hashed where they are read. Ordered offset ranges of an archive are the nodes of its tree: a node of the
lowest level hashes the records of one range, a node above hashes the nodes of ``FANOUT`` ranges. As ranges are fixed by
offset, a record lost from one replica leaves every other range as it was. Two replicas are compared from the roots
down, and only children of differing nodes are looked at, so that the last step touches only the records of damaged
ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import written

#: Bytes of the ranges of the lowest level, and nodes that one node above covers.
RANGE_BYTES, FANOUT = 1 << 16, 16
#: Pages that one archive file holds.
ARCHIVE_PAGES = 1000


def record_text(url: Column, body: Column) -> Column:
    """A WARC resource record as text."""
    body = F.coalesce(body, F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def archive(pages: DataFrame, body: Column | None = None) -> DataFrame:
    """Records of archive files of ``ARCHIVE_PAGES`` pages: archive, offset, length, digest, and page_id.

    ``offset`` is the record's place as the pages have it; ``body`` is what the replica holds there.
    """
    kept = record_text(F.col("url"), F.col("html"))
    held = record_text(F.col("url"), F.col("html") if body is None else body)
    hashed = pages.filter("page_id is not null").select(
        F.expr(f"page_id div {ARCHIVE_PAGES}").alias("archive"), "page_id", F.octet_length(kept).cast("long").alias("place"), F.octet_length(held).cast("long").alias("length"), F.sha2(held, 256).alias("digest")
    )
    order = Window.partitionBy("archive").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return hashed.select("archive", "page_id", F.coalesce(F.sum("place").over(order), F.lit(0)).alias("offset"), "length", "digest")


def leaves(records: DataFrame) -> DataFrame:
    """One row for each archive and offset; records that repeat at an offset are folded into one digest, in any order."""
    many = F.sha2(F.concat_ws(",", F.min("digest"), F.max("digest"), F.sum(F.xxhash64("digest").cast("decimal(20,0)")).cast("string"), F.count(F.lit(1)).cast("string")), 256)
    return (
        records.filter("archive is not null and offset is not null")
        .groupBy("archive", "offset")
        .agg(F.max("length").alias("length"), F.when(F.count(F.lit(1)) == 1, F.min("digest")).otherwise(many).alias("digest"))
    )


def _fold(nodes: DataFrame, node: str) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("at", "digest")))
    text = F.concat_ws("\n", F.transform(listed, lambda x: F.concat_ws(" ", x["at"].cast("string"), x["digest"])))
    return nodes.withColumn("node", F.expr(node)).groupBy("archive", "node").agg(F.sha2(text, 256).alias("digest"))


def tree(spark: SparkSession, leaf: DataFrame, levels: int) -> list[DataFrame]:
    """The levels of the trees of all archives, lowest first: archive, node, digest."""
    out = [written(spark, _fold(leaf.withColumnRenamed("offset", "at"), f"at div {RANGE_BYTES}"))]
    for _ in range(levels - 1):
        out.append(written(spark, _fold(out[-1].withColumnRenamed("node", "at"), f"at div {FANOUT}")))
    return out


def differing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys at which the two sides have different digests, or only one has any."""
    both = left.select(*keys, F.col("digest").alias("l")).join(right.select(*keys, F.col("digest").alias("r")), keys, "full")
    return both.filter("not (l <=> r)").select(*keys)


def audit(spark: SparkSession, primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Records in which two replicas differ, found by descending their trees.

    Both sides have archive, offset, length and digest. Returns archive, offset, ``fault`` (changed, missing or extra
    in the replica) and the lengths and digests of both sides (null where a side has no record). Rows without
    archive or offset take no part; records repeated at one offset count together; an empty side makes every record
    of the other a fault; two empty sides give no rows; other columns are not read.
    """
    left, right = written(spark, leaves(primary)), written(spark, leaves(replica))
    end = left.agg(F.max("offset")).unionByName(right.agg(F.max("offset"))).agg(F.max("max(offset)")).first()[0] or 0
    levels, span = 1, RANGE_BYTES
    while span <= end:  # until one node covers an archive
        levels, span = levels + 1, span * FANOUT
    a, b = tree(spark, left, levels), tree(spark, right, levels)
    bad = written(spark, differing(a[-1], b[-1], ["archive", "node"]))
    for level in range(levels - 2, -1, -1):
        under = bad.withColumnRenamed("node", "above")
        some = [side.withColumn("above", F.expr(f"node div {FANOUT}")).join(under, ["archive", "above"], "left_semi") for side in (a[level], b[level])]
        bad = written(spark, differing(*some, ["archive", "node"]))
    last = [side.withColumn("node", F.expr(f"offset div {RANGE_BYTES}")).join(bad, ["archive", "node"], "left_semi") for side in (left, right)]
    l, r = (side.select("archive", "offset", F.col("length").alias(f"length_{n}"), F.col("digest").alias(f"digest_{n}")) for side, n in zip(last, ("primary", "replica"), strict=True))
    both = l.join(r, ["archive", "offset"], "full").filter("not (digest_primary <=> digest_replica)")
    fault = F.when(F.col("digest_replica").isNull(), "missing").when(F.col("digest_primary").isNull(), "extra").otherwise("changed")
    return both.select("archive", "offset", fault.alias("fault"), "length_primary", "length_replica", "digest_primary", "digest_replica")


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with known damage, for the registered query: some records changed, some missing."""
    return archive(pages, F.when(F.expr("page_id % 97 = 13"), F.concat(F.lit("#"), F.expr("substr(html, 2)"))).otherwise(F.col("html"))).filter("page_id % 193 <> 7")


SQL = f"""
with base as (
  select page_id, page_id // {ARCHIVE_PAGES} as archive, coalesce(url, '') as url, coalesce(html, '') as good,
    coalesce(case when page_id % 97 = 13 then '#' || substr(html, 2) else html end, '') as held
  from pages where page_id is not null
), texts as (
  select page_id, archive,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
      || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' as head,
    chr(13) || chr(10) || chr(13) || chr(10) as gap, good, held
  from base
), records as (
  select page_id, archive, head || strlen(good)::varchar || gap || good || gap as a, head || strlen(held)::varchar || gap || held || gap as b from texts
), placed as (
  select *, coalesce(sum(strlen(a)) over (partition by archive order by page_id rows between unbounded preceding and 1 preceding), 0)::bigint as "offset" from records
)
select archive, "offset", case when page_id % 193 = 7 then 'missing' else 'changed' end as fault, strlen(a)::bigint as length_primary,
  case when page_id % 193 <> 7 then strlen(b)::bigint end as length_replica, sha256(a) as digest_primary,
  case when page_id % 193 <> 7 then sha256(b) end as digest_replica
from placed where page_id % 193 = 7 or a <> b
"""
