"""The model tables, made of the driver's tables. Each is a list of expressions that Spark and DuckDB share, but for the hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A fixed present, in epoch seconds.
NOW = 1_700_000_000

SOURCE_COLUMNS = {
    "post_id": "doc_id",
    "post_type": "lang",
    "post_author": "doc_id % 50",
    "post_title": "substring(text, 1, 40)",
    "post_modified": "1600000000 + (doc_id * 7919) % 500000",
    "file_id": "CASE WHEN doc_id % 97 = 0 THEN '' ELSE concat('doc-', CAST(doc_id AS STRING)) END",
    "doc_url": "concat('https://docs.google.com/document/d/document-', CAST(doc_id AS STRING), '/edit')",
    "title": "substring(text, 5, 30)",
    "folder_watch_id": "CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END",
    "status": "CASE WHEN doc_id % 13 = 0 THEN 'syncing' WHEN quality IS NULL THEN 'linked' WHEN toxic = 1 THEN 'error' WHEN quality = 1 THEN 'synced' ELSE 'skipped' END",
    "last_synced_at": "CASE WHEN quality IS NULL OR doc_id % 11 = 0 THEN '' ELSE concat('2024-01-', substring(CAST(100 + doc_id % 28 AS STRING), 2, 2)) END",
    "last_method": "CASE WHEN quality IS NULL THEN '' ELSE 'html_zip' END",
    "modified_time": "concat('m', CAST(n_chars % 5 AS STRING))",
    "version": "CAST(n_chars % 7 AS STRING)",
    "last_hash": "CASE WHEN doc_id % 3 = 0 THEN '' ELSE {sha} END",
    "layout_preset": "CASE doc_id % 3 WHEN 0 THEN 'plain_blocks' WHEN 1 THEN 'clean_article' ELSE 'documentation' END",
    "last_layout_hash": "CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN 'old' ELSE 'now' END",
    "updated_at": "CASE WHEN doc_id % 9 = 0 THEN NULL ELSE 1700000000 - (doc_id * 31) % 1200 END",
}
EVENT_COLUMNS = {
    "event_id": "event_id",
    "ts": "ts",
    "post_id": "user_id",
    "post_title": "CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('Post ', CAST(user_id AS STRING)) END",
    "level": "CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'warning' ELSE 'info' END",
    "status": "CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'synced' ELSE 'syncing' END",
    "step": "event_type",
    "progress": "CAST(floor(value) AS INT)",
    "message": "concat('step ', event_type, ' Bearer abc', CAST(event_id AS STRING), ' client_secret=', CAST(user_id AS STRING), ' done')",
    "error_code": "CASE WHEN event_type <> 'error' THEN '' WHEN event_id % 2 = 0 THEN 'sync_stalled' ELSE 'access_denied' END",
    "props": "props",
}
#: Users of the catalog: user 7 edits all en posts and its own de ones.
GRANTS = [(7, "en", "all"), (7, "de", "own"), (7, "fr", "own"), (8, "es", "all")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.select(*[F.expr(e.format(sha="sha2(text, 256)")).alias(c) for c, e in SOURCE_COLUMNS.items()])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(*[F.expr(e).alias(c) for c, e in EVENT_COLUMNS.items()])


def grants(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GRANTS, "user_id long, post_type string, scope string")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders: each region holds nations, a nation customers (folders), a customer orders (documents)."""
    kind = lambda k: F.lit(k).alias("item_type")
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    nation = table(spark, sf_dir, "nation").select(key("r", "n_regionkey").alias("parent_id"), key("n", "n_nationkey").alias("file_id"), F.col("n_name").alias("name"), kind("folder"), F.lit(True).alias("selectable"))
    customer = table(spark, sf_dir, "customer").select(key("n", "c_nationkey").alias("parent_id"), key("c", "c_custkey").alias("file_id"), F.col("c_name").alias("name"), kind("folder"), F.lit(True).alias("selectable"))
    orders = table(spark, sf_dir, "orders").select(key("c", "o_custkey").alias("parent_id"), key("o", "o_orderkey").alias("file_id"), key("Order ", "o_orderkey").alias("name"), kind("document"), (F.col("o_orderstatus") != "P").alias("selectable"))
    return nation.union(customer).union(orders)


SOURCES_SQL = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in SOURCE_COLUMNS.items()).replace("{sha}", "sha256(text)") + " FROM documents LEFT JOIN labels USING (doc_id)"
EVENTS_SQL = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in EVENT_COLUMNS.items()) + " FROM events"
GRANTS_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({u}, '{t}', '{s}')" for u, t, s in GRANTS) + ") AS g(user_id, post_type, scope)"
TREE_SQL = """
SELECT concat('r', n_regionkey) AS parent_id, concat('n', n_nationkey) AS file_id, n_name AS name, 'folder' AS item_type, TRUE AS selectable FROM nation
UNION ALL SELECT concat('n', c_nationkey), concat('c', c_custkey), c_name, 'folder', TRUE FROM customer
UNION ALL SELECT concat('c', o_custkey), concat('o', o_orderkey), concat('Order ', o_orderkey), 'document', o_orderstatus <> 'P' FROM orders"""
