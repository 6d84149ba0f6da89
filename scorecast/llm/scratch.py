"""Lineage cuts in the folder that all executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from scorecast.session import _hadoop_path, scratch_dir


#: Rows of an Arrow batch between Spark and a Python worker, at most.
ROWS_PER_BATCH = 2000


def shared_dir(spark: SparkSession) -> str:
    """The configured shared folder; a private one only where a local session has none."""
    fallback = scratch_dir(spark)
    return (spark.conf.get("spark.checkpoint.dir", None) or fallback).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own for a table in this application's part of the shared folder."""
    return f"{shared_dir(spark)}/run-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written once as Parquet to the shared folder (to a new path there, or to ``path``)
    and read again."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def forgotten(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    fs, p = _hadoop_path(spark, path)
    fs.delete(p, True)


#: Spark's setting that removes a query's shuffle files when the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released_shuffles(spark: SparkSession):
    """Queries run inside give back their shuffle files at their end. For tables that are
    written: what is read again is the table, so nothing needs the shuffle any more."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int):
    """Queries run inside send Python workers so many rows at once, at most: for rows that are large each."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship_package(spark: SparkSession) -> None:
    """Give this package to the executors, once per Spark context (a zip that Spark serves)."""
    import os
    import tempfile
    import zipfile

    import scorecast

    # Texts may be long: a batch of the default 10,000 rows is tens of MB in each worker.
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ROWS_PER_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    sc = spark.sparkContext
    if getattr(sc, "_scorecast_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(scorecast.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="scorecast-zip-"), "scorecast.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._scorecast_shipped = True
