"""Contiguous shards of near-equal bytes, by global prefix sums (DataFrame functions only).

Rows are ranged by id into parts; each part's byte total gives, by a running sum over
the (few) parts, where it starts; a running sum inside the part gives every row its
offset in the whole. Cutting the offsets at equal targets makes contiguous shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def row_bytes(text: Column, overhead: int = 16) -> Column:
    """UTF-8 bytes of the text (null: none) and a fixed overhead for each row."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(overhead)).cast("bigint")


def shard_by_bytes(rows: DataFrame, shards: int, order: list[str], size: str = "size", parts: int | None = None) -> DataFrame:
    """Adds ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    A row goes to the shard in which its first byte falls when [0, total) is cut into
    ``shards`` equal spans, so a shard exceeds its target by less than one row. Rows are
    ordered by ``order``, nulls first; rows that tie in all of ``order`` and in size are
    interchangeable. Sizes must be positive. No rows: no rows. All columns are kept;
    ``shard`` and ``slot`` replace columns of these names, and names that begin with
    ``_shard_`` are reserved.
    """
    spark = rows.sparkSession
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    keys = [*order, size]
    # The ranges come from a sample, so the parts are written: both uses below must see the same ones.
    ranged = materialize(rows.select(*kept).repartitionByRange(parts, *keys).withColumn("_shard_part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("_shard_part").agg(F.sum(size).alias("_shard_bytes"))
    before = Window.orderBy("_shard_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    everything = Window.partitionBy()
    starts = totals.select(
        "_shard_part",
        F.coalesce(F.sum("_shard_bytes").over(before), F.lit(0)).alias("_shard_start"),
        F.sum("_shard_bytes").over(everything).alias("_shard_total"),
    )
    inside = Window.partitionBy("_shard_part").orderBy(*[F.col(k).asc_nulls_first() for k in keys])
    placed = (
        ranged.join(F.broadcast(starts), "_shard_part")  # as many rows as parts
        .withColumn("_shard_offset", F.col("_shard_start") + F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size))
        .withColumn("shard", F.least(F.expr(f"(_shard_offset * {shards}) div _shard_total"), F.lit(shards - 1)).cast("int"))
        .withColumn("_shard_row", F.row_number().over(Window.partitionBy("_shard_part", "shard").orderBy("_shard_offset")))
    )
    placed = materialize(placed.drop("_shard_start", "_shard_total", "_shard_offset"), "placed")
    counts = placed.groupBy("_shard_part", "shard").agg(F.count(F.lit(1)).alias("_shard_rows"))  # at most parts + shards rows
    earlier = Window.partitionBy("shard").orderBy("_shard_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("_shard_part", "shard", F.coalesce(F.sum("_shard_rows").over(earlier), F.lit(0)).alias("_shard_first"))
    return placed.join(F.broadcast(firsts), ["_shard_part", "shard"]).select(*kept, "shard", (F.col("_shard_first") + F.col("_shard_row") - 1).cast("bigint").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Every document's place: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A null text has size 16 and the checksum of no bytes; repeated rows each get a slot.
    """
    rows = docs.select("doc_id", row_bytes(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    return shard_by_bytes(rows, shards, ["doc_id", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
