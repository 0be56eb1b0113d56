"""Scans along the rows of a key that don't make a key one task's work: ordered chunks, values carried across them, chains by doubling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.session import removed, written


def dealt(rows: DataFrame) -> DataFrame:
    """Rows for a join that shuffles both sides: what grows with the keys or rows isn't sent through the driver, however small its files are."""
    return rows.hint("merge")


def ordered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows as a written table with place (long, rising by keys and order) and chunk (int): a chunk is a stretch of the rows in order, of about one size, so that a
    key with most of the rows has many."""
    stretches = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    return written(stretches.withColumn("place", F.monotonically_increasing_id()).withColumn("chunk", F.spark_partition_id()), "ordered")


def _carried(rows: DataFrame, keys: list[str], value: Column, out: str, forth: bool) -> DataFrame:
    """Adds out: the nearest value that isn't null of the rows before (forth) or after a row, itself left out, within keys.

    Only the rows of a chunk meet in a task; what a chunk hands on is one value, and those of a key are carried over its chunks, of which there are as many as partitions.
    """
    sign = (lambda c: F.asc(c)) if forth else (lambda c: F.desc(c))
    before = Window.partitionBy(*keys, "chunk").orderBy(sign("place")).rowsBetween(Window.unboundedPreceding, -1)
    given = rows.withColumn("_given", value)
    nearest = (F.max_by if forth else F.min_by)("_given", "place")
    handed = given.filter(F.col("_given").isNotNull()).groupBy(*keys, "chunk").agg(nearest.alias("_handed"))
    there = given.select(*keys, "chunk").distinct().join(dealt(handed), [*keys, "chunk"], "left")
    earlier = Window.partitionBy(*keys).orderBy(sign("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    carried = there.withColumn("_carried", F.last("_handed", ignorenulls=True).over(earlier)).drop("_handed")
    found = given.withColumn("_own", F.last("_given", ignorenulls=True).over(before)).join(dealt(carried), [*keys, "chunk"])
    return found.withColumn(out, F.coalesce("_own", "_carried")).select(*rows.columns, out)


def last_before(rows: DataFrame, keys: list[str], value: Column, out: str) -> DataFrame:
    """Adds out to rows of ordered: the last value that isn't null before each, within keys (which aren't null)."""
    return _carried(rows, keys, value, out, True)


def next_after(rows: DataFrame, keys: list[str], value: Column, out: str) -> DataFrame:
    """Adds out to rows of ordered: the first value that isn't null after each, within keys (which aren't null)."""
    return _carried(rows, keys, value, out, False)


def counted(rows: DataFrame, keys: list[str], value: Column, out: str) -> DataFrame:
    """Adds out to rows of ordered: the sum of value over the rows up to each, itself included, within keys (which aren't null)."""
    upto = Window.partitionBy(*keys, "chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    given = rows.withColumn("_given", value.cast("long"))
    sums = given.groupBy(*keys, "chunk").agg(F.sum("_given").alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    return given.withColumn("_own", F.sum("_given").over(upto)).join(dealt(sums), [*keys, "chunk"]).withColumn(out, F.col("_own") + F.col("_before")).select(*rows.columns, out)


def reached(starts: DataFrame, jumps: DataFrame) -> DataFrame:
    """The ids (id) that are reached from starts (id) by jumps (id, next), each id having one at most.

    In each round what is reached jumps on, and jumps double their length, so that a chain of n takes about log2(n) rounds of joins.
    """
    found = written(starts.select("id").distinct(), "reached")
    jumps = written(jumps.filter("next IS NOT NULL").select("id", "next"), "jumps")
    size = found.count()
    while True:
        before, far = found, jumps
        found = written(before.union(before.join(dealt(far), "id").select("next")).distinct(), "reached")
        removed(before)
        grown = found.count()
        if grown == size:
            removed(far)
            return found
        size = grown
        jumps = written(far.join(dealt(far.select(F.col("id").alias("next"), F.col("next").alias("far"))), "next").select("id", F.col("far").alias("next")), "jumps")
        removed(far)
