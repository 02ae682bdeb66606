"""Contiguous, byte-balanced shards of a table (DataFrame functions only).

Rows are dealt into ranges of the order key, each range sums its bytes and rows, the totals of the ranges are turned
into prefix sums, and a running sum inside each range gives every row its place in the whole. Cuts at equal targets of
the total then make shards whose rows follow each other in doc_id order.

Defined results: a null text has no bytes and counts 1 (its row end); an empty table gives an empty result; repeated
rows and equal doc_ids are kept, ordered by checksum and size; null doc_ids come first; a text larger than a shard's
target leaves the shards that it spans empty. Other columns of the input are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import partitions, read, stored

ROW_END = 1


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size in UTF-8 bytes plus the row end, and the text's unsigned CRC-32."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", (F.octet_length(text) + F.lit(ROW_END)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))


def shard_at(before: Column, size: Column, total: Column, shards: int) -> Column:
    """The shard in whose share of the bytes the row's middle lies."""
    middle = F.lit(2) * before + size
    return F.least(F.lit(shards - 1), F.floor(middle / (F.lit(2) * total) * F.lit(shards))).cast("int")


def balanced_shards(rows: DataFrame, shards: int) -> DataFrame:
    """rows(doc_id, size, text_crc32) with shard and slot (the place inside the shard, gapless from 0)."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    order = ["doc_id", "text_crc32", "size"]
    ranged = stored(rows.repartitionByRange(partitions(rows.sparkSession), *order).withColumn("_range", F.spark_partition_id()), "shards")
    # One row for each range: as many as there are partitions, however large the table is.
    totals = ranged.groupBy("_range").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy("_range")
    bases = totals.select(
        "_range",
        F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(whole).alias("_total"),
    )
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        ranged.withColumn("_sum", F.sum("size").over(inside))
        .withColumn("_count", F.count(F.lit(1)).over(inside))
        .join(F.broadcast(bases), "_range")
        .select(
            *order,
            shard_at(F.col("_bytes_before") + F.col("_sum") - F.col("size"), F.col("size"), F.col("_total"), shards).alias("shard"),
            (F.col("_rows_before") + F.col("_count") - 1).alias("_place"),
        )
    )
    firsts = placed.groupBy("shard").agg(F.min("_place").alias("_first"))  # one row a shard
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("_place") - F.col("_first")).alias("slot"))


def op4_sharding(spark: SparkSession, sf_dir: str, shards: int = 8) -> DataFrame:
    out = balanced_shards(sized(read(spark, sf_dir, "documents")), shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The checksum is written out bit by bit over the text's bytes, as DuckDB has no CRC-32.
OP4_SQL = """
WITH RECURSIVE t(n, k, c) AS (
  SELECT n, 0, n::BIGINT FROM range(256) r(n)
  UNION ALL
  SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM t WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY n) AS entries FROM t WHERE k = 8),
hexed AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
bytes AS (
  SELECT doc_id, len(h) // 2 AS n,
    list_transform(range(0, len(h) // 2), lambda i: (('0x' || substr(h, 2 * i + 1, 2))::BIGINT)) AS b
  FROM hexed
), summed AS (
  SELECT doc_id, n + 1 AS size,
    CASE WHEN n = 0 THEN 0 ELSE xor(4294967295, list_reduce(b, lambda a, x: xor(a >> 8, entries[(xor(a, x) & 255) + 1]), 4294967295::BIGINT)) END AS text_crc32
  FROM bytes, crc_table
), placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS before,
    (sum(size) OVER ())::BIGINT AS total,
    row_number() OVER (ORDER BY doc_id, text_crc32, size) AS place
  FROM summed
), cut AS (
  SELECT *, least(7, floor((2 * before + size)::DOUBLE / (2 * total)::DOUBLE * 8))::INTEGER AS shard FROM placed
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY place) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM cut
"""
