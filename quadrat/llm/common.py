"""What the corpus operators share: tables, the shared folder, written intermediates, files in it."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it.

    Where ``spark.checkpoint.dir`` is unset, a single-JVM session (tests) gets a
    temporary folder and a cluster a folder in the warehouse.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        found = "file://" + tempfile.mkdtemp(prefix="quadrat-")
    else:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_quadrat"
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there.

    A lost executor costs the tasks that read the files, not the work behind them.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quadrat_path = path
    return out


def discard(*written: DataFrame) -> None:
    """Deletes what ``materialize`` wrote, once nothing reads it any more."""
    for df in written:
        spark, path = df.sparkSession, df._quadrat_path
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Spark's setting that deletes the shuffle files of an action when it ends; by default they stay until the driver collects its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it the shuffle files of each action go when it ends. The session's own setting comes back after."""
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after a limit on the rows that a Python worker gets at once: texts are long, and a worker holds several copies of a batch.

    A setting that the session has made itself stays.
    """
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # Spark's own default
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return df


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than it must to tell."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint where the row count is checked to be small; else the planner's own join."""
    return F.broadcast(df) if is_small(df, rows) else df


def text_key(col: str = "text"):
    """Tells apart rows of one id with different texts (null and empty differ)."""
    return F.xxhash64(F.col(col).isNull(), F.col(col))


class SharedFiles:
    """Whole files in a shared folder, from inside tasks: local paths, or what pyarrow can open.

    ``write`` is atomic: a retried or speculative task replaces the file with the same bytes.
    """

    def __init__(self, folder: str):
        self.folder = folder

    def _local(self) -> str | None:
        if self.folder.startswith("file:"):
            return "/" + self.folder[5:].lstrip("/")
        return self.folder if "://" not in self.folder else None

    def _remote(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder)

    def write(self, name: str, chunks) -> None:
        temporary = f".{name}.{uuid.uuid4().hex}"
        if local := self._local():
            os.makedirs(local, exist_ok=True)
            with open(f"{local}/{temporary}", "wb") as out:
                for chunk in chunks:
                    out.write(chunk)
            os.replace(f"{local}/{temporary}", f"{local}/{name}")
            return
        store, folder = self._remote()
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{temporary}") as out:
            for chunk in chunks:
                out.write(chunk)
        store.move(f"{folder}/{temporary}", f"{folder}/{name}")

    def open(self, name: str):
        if local := self._local():
            return open(f"{local}/{name}", "rb")
        store, folder = self._remote()
        return store.open_input_file(f"{folder}/{name}")

    def remove_all(self) -> None:
        if local := self._local():
            shutil.rmtree(local, ignore_errors=True)
