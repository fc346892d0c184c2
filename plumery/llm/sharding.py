"""Contiguous shards of near-equal byte size, cut from global prefix sums.

Rows are put in order of doc_id by range partitioning; each partition's total gives the offset at which the next one
starts, so no task and no group sees more than its own range. Only one total per partition is gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumery.llm.common import table
from plumery.operators.graph import cut


def shard_by_bytes(docs: DataFrame, n_shards: int = 40, per_row: int = 16, n_parts: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row of docs.

    A row's size is the UTF-8 length of its text (null: 0) plus per_row. In order of doc_id (nulls first, then the text's
    checksum and size, then input order) a row goes to the shard in whose equal part of all bytes its middle lies. Slots
    count from 0 in each shard. Repeated rows each get a slot. Other columns of docs play no part. Of a very long text only size
    and checksum are carried on; it is in one shard whole, however large that makes it.
    """
    spark = docs.sparkSession
    n_parts = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "text_crc32", "size", "seq"]
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = docs.select(
        "doc_id", (F.octet_length(text) + F.lit(per_row)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("seq")
    ).transform(cut)
    ranged = slim.repartitionByRange(n_parts, *order).withColumn("part", F.spark_partition_id()).transform(cut)
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = (
        ranged.groupBy("part")
        .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        .select("part", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("rows_before"))
    )
    total = ranged.agg(F.coalesce(F.sum("size"), F.lit(1))).first()[0]
    inside = Window.partitionBy("part").orderBy(*order[:-1], "seq")
    placed = (
        ranged.join(F.broadcast(offsets), "part")
        .withColumn("at", F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("row", F.col("rows_before") + F.row_number().over(inside) - 1)
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"cast((2 * at + size) * {n_shards} div {2 * total} as int)")))
    )
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))  # at most n_shards rows
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 40 and slot by the law ``bytes``."""
    return shard_by_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


SQL = {
    "op4_sharding": r"""
WITH crc_table AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
    FROM (SELECT range AS n FROM range(256)))),
sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
             lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM documents, crc_table),
placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - size AS start, row_number() OVER (ORDER BY doc_id) AS n, sum(size) OVER () AS total FROM sized),
cut AS (
  SELECT *, least(39, ((2 * start + size) * 40) // (2 * total))::INTEGER AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
       (n - min(n) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM cut"""
}
