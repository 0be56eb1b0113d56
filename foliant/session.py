"""A session with the settings that the operators expect."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's place where driver and executors both see it: below spark.checkpoint.dir. Where that is unset a local session takes a
    temporary one; on a cluster, whose machines don't share it, that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.conf.get("spark.master", "local") or "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "foliant-shared")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, which cuts its lineage."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def removed(table: DataFrame) -> None:
    """Deletes a written table that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        deleted(table.sparkSession, folder)


def swept(spark: SparkSession, hours: float) -> int:
    """Deletes the tables and stream folders of this library in the shared folder that nothing has been put into for so many hours; how many they were."""
    base = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark, "x")).getParent()
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    before, gone = (time.time() - hours * 3_600) * 1_000, 0
    for status in fs.listStatus(base) if fs.exists(base) else []:
        if re.fullmatch(r"[a-z0-9_-]+-[0-9a-f]{32}", status.getPath().getName()) and status.getModificationTime() < before:
            gone += fs.delete(status.getPath(), True)
    return gone


def session(master: str = "local[*]", partitions: int | None = None, **settings: str) -> SparkSession:
    """UTC, adaptive execution, and shuffle partitions only where they are given; other settings stay the cluster's."""
    builder = SparkSession.builder.master(master).appName("foliant")
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.enabled": "false"}
    if partitions:
        base["spark.sql.shuffle.partitions"] = str(partitions)
    found = builder.config(map=base | settings).getOrCreate()
    if not master.startswith("local"):
        shipped(found)
    return found


def shipped(spark: SparkSession) -> None:
    """Gives the executors' Python this package, where they don't have it installed."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "foliant"), "zip", root, "foliant"))
