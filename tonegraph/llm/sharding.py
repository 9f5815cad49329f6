"""Contiguous shards of near equal size from global byte-size prefix sums.

Order: the smallest doc_id among documents of equal text, then doc_id; copies thus stand side by side
and mostly share a shard.  The rows are range-partitioned in that order; each partition reports one
total; the running sum over those totals plus the running sum inside a partition is a row's global
byte position, and the cuts lie at equal multiples of total / shards.  A row goes to the shard that
holds its middle byte, so a shard is off its target by at most one document.  Where a cut would part a
group of equal texts that is small (1 / GROUP_SHARE of a target at most), the whole group goes by its middle
byte; a larger group is parted, for sizes stay near equal.

Only (doc_id, size, hashes) rows move; texts are read once and stay where they are.  What is
broadcast is one row per range partition, one per shard and one per cut that falls into a group.

Defined edge cases: null text has size 8 and the CRC of the empty text; a null doc_id sorts first;
repeated rows are placed one by one; a document larger than a target fills a shard alone and may
leave its neighbours empty; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

SHARDS = 24
#: Added to the bytes of each text, for its length prefix.
RECORD_BYTES = 8
#: Groups of equal texts of up to this fraction of a shard's target are never parted.
GROUP_SHARE = 50


def prefix_positions(rows: DataFrame, order: list[str], size: str) -> DataFrame:
    """rows with global_start (sum of size over all rows before), global_row and global_total."""
    placed = materialize(
        rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "ranges"
    )
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = (
        placed.groupBy("part")
        .agg(F.sum(size).alias("part_size"), F.count(F.lit(1)).alias("part_rows"))
        .select(
            "part",
            F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("part_start"),
            F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("part_row"),
            F.sum("part_size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("global_total"),
        )
    )
    inside = W.partitionBy("part").orderBy(*order)
    return (
        placed.withColumn("__row", F.row_number().over(inside) - 1)
        .withColumn("__start", F.sum(size).over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col(size))
        .join(F.broadcast(totals), "part")
        .withColumn("global_start", F.col("part_start") + F.col("__start"))
        .withColumn("global_row", F.col("part_row") + F.col("__row"))
        .drop("part", "part_start", "part_row", "__row", "__start")
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = text_or_empty()
    rows = materialize(
        docs.select(
            "doc_id",
            (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("copy"),
        ),
        "sizes",
    )
    group = ["copy", "text_crc32"]
    groups = rows.groupBy(*group).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("group_size"))
    copies = materialize(groups.where("n > 1").select(*group, "first_id", "group_size"), "groups")
    ordered = rows.join(copies, group, "left").withColumn("first_id", F.coalesce("first_id", "doc_id"))
    placed = prefix_positions(ordered, ["first_id", "copy", "doc_id", "text_crc32", "size"], "size")
    middle = F.expr(f"((2 * global_start + size) * {shards}) div (2 * global_total)")
    placed = materialize(placed.withColumn("shard", F.least(middle, F.lit(shards - 1)).cast("int")), "placed")
    small = placed.where(F.expr(f"group_size * {GROUP_SHARE * shards} <= global_total"))
    parted = small.groupBy(*group, "group_size", "global_total").agg(F.min("global_start").alias("at"), F.min("shard").alias("low"), F.max("shard").alias("high"))
    whole = F.expr(f"((2 * at + group_size) * {shards}) div (2 * global_total)").cast("int")
    moved = parted.where("low < high").select(*group, whole.alias("whole"))  # a cut parts one group at most
    placed = placed.join(F.broadcast(moved), group, "left").withColumn("shard", F.coalesce("whole", "shard"))
    first = placed.groupBy("shard").agg(F.min("global_row").alias("first_row"))  # one row per shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("global_row") - F.col("first_row")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, '')))::BIGINT + {RECORD_BYTES} AS size FROM documents),
o AS (SELECT *, min(doc_id) OVER g AS first_id, count(*) OVER g AS n, (sum(size) OVER g)::BIGINT AS group_size FROM d WINDOW g AS (PARTITION BY t)),
p AS (
  SELECT *, (sum(size) OVER w - size)::BIGINT AS start_at, (sum(size) OVER ())::BIGINT AS total
  FROM o WINDOW w AS (ORDER BY first_id, doc_id ROWS UNBOUNDED PRECEDING)),
q AS (SELECT *, min(start_at) OVER (PARTITION BY t) AS group_at, n > 1 AND group_size * {GROUP_SHARE * SHARDS} <= total AS whole FROM p),
s AS (
  SELECT *, least((CASE WHEN whole THEN (2 * group_at + group_size) * {SHARDS} ELSE (2 * start_at + size) * {SHARDS} END) // (2 * total), {SHARDS} - 1)::INT AS shard
  FROM q),
k AS (SELECT list_reduce(range(0, 8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b::BIGINT) AS c, b
      FROM range(0, 256) r(b)),
crc AS (SELECT list(c ORDER BY b) AS tab FROM k)
SELECT doc_id, size, 'bytes' AS law, shard,
       xor(list_reduce(list_transform(range(1, size - 7), lambda i: ('0x' || substr(hex(encode(t)), 2 * i - 1, 2))::BIGINT),
                       lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295)::BIGINT AS text_crc32,
       row_number() OVER (PARTITION BY shard ORDER BY first_id, doc_id) - 1 AS slot, NULL::INT AS grown_shard
FROM s, crc"""
