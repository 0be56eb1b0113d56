"""Change detection between snapshots, liveness and attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.rules import fingerprint_current, skip_by_hash, skip_by_metadata


def plan(sources: DataFrame, current: DataFrame, forced: Column | None = None) -> DataFrame:
    """Sources with action and layout_current. current: file_id, new_time, new_version, new_layout_hash, new_hash.

    skip_metadata where time, version and layout are as recorded; skip_content where the content's hash is; else sync; missing where
    the current snapshot has no such file. An empty recorded hash never skips.
    """
    force = F.lit(False) if forced is None else forced
    rows = sources.join(current, "file_id", "left")
    rows = rows.withColumn("layout_current", fingerprint_current(F.coalesce("new_layout_hash", F.lit("")), F.col("last_layout_hash"), F.col("layout_preset")))
    by_meta = skip_by_metadata(force, F.col("last_hash"), F.col("modified_time") == F.col("new_time"), F.col("version") == F.col("new_version"), F.col("layout_current"))
    by_hash = skip_by_hash(force, F.col("new_hash"), F.col("last_hash"))
    return rows.withColumn("action", F.when(F.col("new_time").isNull(), "missing").when(by_meta, "skip_metadata").when(by_hash, "skip_content").otherwise("sync"))


def attempts(events: DataFrame, key: str = "post_id", busy: str = "syncing") -> DataFrame:
    """Adds attempt (numbered from 1; 0 before the first) and started_at: a new attempt begins where the status becomes busy."""
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    begins = (F.col("status") == busy) & (F.coalesce(F.lag("status").over(order), F.lit("")) != busy)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("_begins", begins).withColumn("attempt", F.sum(F.col("_begins").cast("long")).over(so_far)).withColumn("started_at", F.last(F.when(F.col("_begins"), F.col("ts")), ignorenulls=True).over(so_far)).drop("_begins")


def progress(events: DataFrame, key: str = "post_id") -> DataFrame:
    """Progress that an error doesn't lower: at an error the highest so far, else the reported one within 0 and 100."""
    held = F.greatest(F.lit(0), F.least(F.lit(100), F.col("progress")))
    so_far = Window.partitionBy(key).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("progress", F.when(F.col("status") == "error", F.max(held).over(so_far)).otherwise(held))


def still_current(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """Runs (post_id, file_id) with error: source_changed where the source is gone or links another file by now, so that nothing old is written."""
    now = sources.select("post_id", F.col("file_id").alias("_now"))
    rows = runs.join(now, "post_id", "left")
    same = F.coalesce(F.col("_now") == F.col("file_id"), F.lit(False))
    return rows.withColumn("error", F.when(~same, "source_changed")).drop("_now")


def live_locks(locks: DataFrame, now: int, seconds: int = 1_800) -> DataFrame:
    """Keys whose lock, refreshed at several times (key, at), hasn't run out."""
    return locks.groupBy("key").agg((F.max("at") + seconds).alias("expires")).filter(F.col("expires") > now)
