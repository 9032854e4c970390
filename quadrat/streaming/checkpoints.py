"""Lineage cuts for iterative queries, and incremental totals of a stream of counts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, prefix: str = "cut") -> str:
    """A path of its own in the folder that the session's ``spark.checkpoint.dir`` names.

    A single-JVM session without that setting gets a temporary folder, a cluster one in the warehouse.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        local = master.startswith("local") and not master.startswith("local-cluster")
        folder = "file://" + tempfile.mkdtemp(prefix="quadrat-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{prefix}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once, in a folder of scratch(), and read back: lineage ends there. An RDD checkpoint would compute the rows twice."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def windowed_totals(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) by event-time window, for batch or streaming input; an extension of the study's operators."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
