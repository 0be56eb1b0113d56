"""What the operators of this subpackage share: words, row keys, shared tables, prefix sums, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.session import deleted, removed, shared_folder

#: White space between words.
GAP = r"[\x20\x09-\x0D]+"


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def framed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as one struct, row, beside the columns that are worked on and row_key (hash of the text), so that no name of theirs clashes."""
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    return docs.select(F.struct(*quoted).alias("row"), *columns, F.xxhash64(text_of()).alias("row_key"))


def words_of(text: Column) -> Column:
    """Array of the words of a text that isn't null."""
    return F.array_remove(F.split(text, GAP), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row, for use inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: The folders of the tables made within scratch in this thread, the innermost last.
_made: ContextVar[tuple[list[str], ...]] = ContextVar("made", default=())


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a query go when it ends; else they stay until the driver happens to collect its garbage. No DataFrame may run twice within."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again, which cuts its lineage and leaves no shuffle files. It outlives scratch only if it is to be kept."""
    path = shared_folder(df.sparkSession, name)
    with released(df.sparkSession):
        df.write.parquet(path)
    if (made := _made.get()) and not keep:
        made[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that are made within by this thread, once what was computed from them is written."""
    own: list[str] = []
    before = _made.set((*_made.get(), own))
    try:
        yield
    finally:
        _made.reset(before)
        for path in own:
            deleted(spark, path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """Within, Python gets at most so many rows at a time, so that batches of long texts stay small. Plans must run within."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def prefix_sums(df: DataFrame, keys: list[str], chunk: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds out: the sum of value over the rows before a row, within keys, by (chunk, order).

    Only the rows of one chunk meet in a task; the totals of the chunks are summed apart, so that a key
    with most of the rows is dealt out. Rows that tie in order get their sums in any order.
    """
    inner = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, chunk).agg(F.sum(value).alias("_total"))
    starts = totals.withColumn("_start", F.coalesce(F.sum("_total").over(outer), F.lit(0))).drop("_total")
    on = [*keys, chunk]
    right = starts.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(on)], "_start")
    within = df.withColumn("_within", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    condition = [F.col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(on)]
    joined = within.join(right, condition, "left")
    return joined.withColumn(out, F.col("_within") + F.col("_start")).select(*df.columns, out)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long): one row (node, root) for each node, root the smallest node.

    Large-star and small-star rounds (Kiveris et al. 2014) until the edges are stars. Minima come from
    aggregates and joins, so that a node with very many edges isn't one task's work. Each round is
    a written table, and the one before is deleted then.
    """
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    stars = materialize(edges.filter("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), "edges")
    before = mark(stars)
    while True:
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        upper = stars.select(F.col("b").alias("a"), F.col("a").alias("v"))
        large = materialize(upper.join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        old = stars
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = materialize(low.select("a", F.col("m").alias("b")).union(small).distinct(), "edges")
        after = mark(stars)
        removed(old)
        removed(large)
        if after == before:
            break
        before = after
    roots = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select("root", "root").distinct())


def running(widths: Column) -> Column:
    """The sums of an array of lengths up to each element, itself included.

    Summed in blocks, so that appending to an array doesn't make long arrays cost the square of their length.
    """
    block = 256

    def sums(xs: Column, start: Column) -> Column:
        zero = F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("all"))
        add = lambda acc, x: F.struct((acc.at + x).alias("at"), F.array_append(acc.all, acc.at + x).alias("all"))
        return F.aggregate(xs, zero, add, lambda acc: acc.all)

    def of(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int")), lambda i: F.slice(xs, i * block + 1, block))
        return let(
            blocks,
            lambda bs: let(
                sums(F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda t, x: t + x)), F.lit(0)),
                lambda ends: F.flatten(F.transform(bs, lambda b, i: sums(b, F.when(i == 0, 0).otherwise(F.try_element_at(ends, i))))),
            ),
        )

    return let(widths, lambda xs: F.when(F.size(xs) > 0, of(xs)).otherwise(F.array().cast("array<int>")))
