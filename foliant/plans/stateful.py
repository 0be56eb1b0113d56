"""Queries whose answer depends on all that came before: progress of syncs, locks, limits, written tables. Their SQL goes row by row, by recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.operators import locks
from foliant.plans.models import table
from foliant.plans.queries import query
from foliant.operators.watches import HARD
from foliant.session import shared_folder, written
from foliant.sources.keyed_table import KeyedTable
from foliant.streaming import progress, sites, state, watch_sync

# Progress of syncs.

#: Steps in the order in which a source reports them, over and over: an import, a large one, one without news.
SCRIPT = ["queued", "checking_google", "exporting", "importing", "converting", "updating_post", "complete", "checking_google", "exporting", "large_doc_fallback", "importing", "large_doc_partial_import", "large_doc_partial_import", "converting", "updating_post", "complete", "queued", "checking_google", "complete"]
#: Two minutes of the events are a second of the reports; one in 13 is an error, one in 17 comes at a wrong time.
REPORT_COLUMNS = {
    "post_id": "user_id",
    "at": "1700000000 + CAST(floor(seconds / 120) AS BIGINT)",
    "seq": "event_id",
    "step": "CASE WHEN event_id % 13 = 0 THEN 'error' WHEN event_id % 17 = 0 THEN 'converting' ELSE script END",
    "done": "CAST(event_id % 8 AS INT)",
    "total": "CAST(5 + event_id % 5 AS INT)",
    "code": "CASE WHEN event_id % 13 = 0 THEN event_type END",
}


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of steps, made of the events."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    script = F.element_at(F.array(*[F.lit(s) for s in SCRIPT]), (place % len(SCRIPT) + 1).cast("int"))
    rows = table(spark, sf_dir, "events").withColumn("script", script).withColumn("seconds", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '2024-01-01', ts)"))
    return rows.select(*[F.expr(e).alias(c) for c, e in REPORT_COLUMNS.items()]).withColumn("ts", F.timestamp_seconds("at")).drop("at")


def _name(column: str) -> str:
    """A column's name in SQL, where at is a word of its own."""
    return f'"{column}"'


def _as_stream(rows: DataFrame) -> DataFrame:
    """Rows as a written table, read as a stream."""
    table_of = written(rows, "stream-rows")
    return rows.sparkSession.readStream.schema(table_of.schema).parquet(table_of.inputFiles()[0].rsplit("/", 1)[0])


_NUMBERED = f"""
SELECT {", ".join(f"{e} AS {_name(c)}" for c, e in REPORT_COLUMNS.items())} FROM (
  SELECT *, date_diff('second', TIMESTAMP '2024-01-01', ts) AS seconds, list_extract({SCRIPT}, CAST((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) % {len(SCRIPT)} + 1 AS INT)) AS script FROM events)"""
_MAY = " OR ".join(f"step1 = '{a}' AND r_step IN ({', '.join(repr(b) for b in bs)})" for a, bs in progress.FOLLOWS.items())
_PERCENT = " ".join(f"WHEN '{s}' THEN {p}" for s, p in progress.PERCENT.items())
PROGRESS_SQL = f"""
WITH RECURSIVE reports AS ({_NUMBERED}),
mark AS (SELECT max("at") - 60 AS upto FROM reports),
r AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY "at", seq, step) AS k FROM reports, mark WHERE "at" + 1 <= upto),
run AS (
  SELECT DISTINCT post_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS attempt, 'idle' AS step, 0 AS progress, CAST(0 AS BIGINT) AS "at", FALSE AS ok, FALSE AS stall, CAST(0 AS BIGINT) AS stall_at,
    CAST(0 AS BIGINT) AS stall_attempt, 0 AS stall_progress, '' AS r_step, '' AS r_status, CAST(NULL AS VARCHAR) AS code FROM r
  UNION ALL
  SELECT post_id, k, n1 + CAST(ok AS INT), attempt + CAST(ok AND step1 = 'idle' AS INT),
    CASE WHEN NOT ok THEN step1 WHEN r_step IN ('error', 'complete') THEN 'idle' ELSE r_step END,
    CASE WHEN NOT ok THEN progress WHEN r_step = 'error' THEN before WHEN r_step = 'complete' THEN 100
      WHEN r_step = 'large_doc_partial_import' THEN greatest(before, least(69, 55 + CAST(floor(14 * least(1.0, done / greatest(1, total))) AS INT)))
      ELSE greatest(before, CASE r_step {_PERCENT} END) END,
    CASE WHEN ok THEN r_at WHEN stall THEN "at" + 600 ELSE "at" END, ok, stall, "at" + 600, attempt, progress, r_step,
    CASE WHEN r_step = 'error' THEN 'error' WHEN r_step = 'complete' THEN CASE WHEN step1 IN ('checking_google', 'converting') THEN 'skipped' ELSE 'synced' END ELSE 'syncing' END, code
  FROM (SELECT *, CASE WHEN step1 = 'idle' THEN 0 ELSE progress END AS before, ({_MAY}) AS ok FROM (
    SELECT s.post_id, r.k, s.n + CAST(s.step <> 'idle' AND r."at" >= s."at" + 600 AS INT) AS n1, s.attempt, CASE WHEN r."at" >= s."at" + 600 THEN 'idle' ELSE s.step END AS step1, s.progress, s."at",
      s.step <> 'idle' AND r."at" >= s."at" + 600 AS stall, r."at" AS r_at, r.step AS r_step, r.done, r.total, r.code
    FROM run s JOIN r ON r.post_id = s.post_id AND r.k = s.k + 1))),
last AS (SELECT post_id, max(k) AS k FROM run GROUP BY post_id)
SELECT post_id, n, attempt, "at", r_step AS step, r_status AS status, progress, CASE WHEN r_status = 'error' THEN 'error' WHEN r_step = 'large_doc_fallback' THEN 'warning' ELSE 'info' END AS level,
  CASE WHEN r_status = 'error' THEN code END AS code FROM run WHERE ok
UNION ALL SELECT post_id, n - CAST(ok AS INT), stall_attempt, stall_at, 'error', 'error', stall_progress, 'error', 'sync_stalled' FROM run WHERE stall
UNION ALL SELECT post_id, n + 1, attempt, "at" + 600, 'error', 'error', progress, 'error', 'sync_stalled' FROM run JOIN last USING (post_id, k), mark WHERE step <> 'idle' AND upto >= "at" + 600"""


@query("stream_progress_events", PROGRESS_SQL)
def stream_progress_events(spark, sf_dir):
    with state.with_states(spark):
        return state.drained(progress.progress_events(_as_stream(reports(spark, sf_dir))), "append")


# Locks: a third of the requests are for one key.

REQUEST_COLUMNS = {
    "key": "CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END",
    "at": "seconds",
    "seq": "event_id",
    "kind": "CASE event_type WHEN 'error' THEN 'release' WHEN 'click' THEN 'refresh' ELSE 'acquire' END",
    "owner": "user_id * 10 + event_id % 10",
}
LOCKS_SQL = f"""
WITH RECURSIVE requests AS (SELECT {", ".join(f"{e} AS {_name(c)}" for c, e in REQUEST_COLUMNS.items())} FROM (SELECT *, date_diff('second', TIMESTAMP '2024-01-01', ts) AS seconds FROM events)),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY "at", seq) AS k FROM requests),
run AS (
  SELECT DISTINCT key, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS "at", CAST(0 AS BIGINT) AS seq, '' AS kind, CAST(0 AS BIGINT) AS owner, FALSE AS ok, CAST(NULL AS BIGINT) AS holder, CAST(NULL AS BIGINT) AS until, CAST(NULL AS BIGINT) AS lock_of FROM r
  UNION ALL
  SELECT key, k, "at", seq, kind, owner, CASE WHEN kind = 'acquire' THEN NOT lives ELSE lives END, CASE WHEN lives THEN lock_of WHEN kind = 'acquire' THEN owner END,
    CASE WHEN kind = 'release' THEN NULL WHEN (kind = 'acquire') <> lives THEN "at" + 1800 ELSE until END,
    CASE WHEN kind = 'release' THEN NULL WHEN kind = 'acquire' AND NOT lives THEN owner ELSE lock_of END
  FROM (SELECT r.*, s.until, s.lock_of, coalesce(s.until > r."at", FALSE) AS lives FROM run s JOIN r ON r.key = s.key AND r.k = s.k + 1))
SELECT key, "at", seq, kind, owner, ok, holder FROM run WHERE k > 0"""


def lock_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("seconds", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '2024-01-01', ts)"))
    return rows.select(*[F.expr(e).alias(c) for c, e in REQUEST_COLUMNS.items()])


@query("lock_holders", LOCKS_SQL)
def lock_holders(spark, sf_dir):
    return locks.held(lock_requests(spark, sf_dir))


# Limits: all users and addresses are one connected group, whose calls are dealt out.


def roaming_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of users who share addresses with those before and after them; a day is six hours."""
    at = F.expr("CAST(timestampdiff(SECOND, TIMESTAMP_NTZ '2024-01-01', ts) AS DOUBLE) / 4")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), F.col("user_id").cast("string").alias("user"), F.expr("concat('10.0.0.', user_id div 4 + event_id % 3)").alias("ip"), at.alias("at"))


@query("rate_limit_one_group")
def rate_limit_one_group(spark, sf_dir):
    return state.rate_limited(roaming_calls(spark, sf_dir), most=1_000)


# Written tables: sites that a stream upserts and lets go after a day, and folder watches over four ticks.

_SECONDS = "date_diff('second', TIMESTAMP '2024-01-01', ts)"
SITE_TABLE_SQL = f"""
WITH c AS (SELECT user_id AS site, event_type AS version, event_id, {_SECONDS} AS s FROM events),
g AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY site ORDER BY s, event_id) >= 86400 THEN 1 ELSE 0 END AS anew FROM c WHERE s + 1 <= (SELECT max(s) - 60 FROM c)),
n AS (SELECT *, sum(anew) OVER (PARTITION BY site ORDER BY s, event_id) AS life FROM g),
l AS (SELECT site, life, arg_max(version, (s, event_id)) AS version, min(s) AS first_seen, max(s) AS last_seen, count(*) AS checkin_count FROM n GROUP BY site, life)
SELECT site, version, first_seen, last_seen, checkin_count FROM l WHERE last_seen + 86400 > (SELECT max(s) - 60 FROM c)"""


@query("stream_site_table", SITE_TABLE_SQL)
def stream_site_table(spark, sf_dir):
    """The first half of the events is there as a table, which is the stream's first state; the others are merged into it."""
    at = F.expr("CAST(timestampdiff(SECOND, TIMESTAMP_NTZ '2024-01-01', ts) AS BIGINT)")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("site"), F.col("event_type").alias("version"), F.col("event_id").alias("seq"), at.alias("at"), F.timestamp_seconds(at).alias("ts"))
    half = rows.filter(F.col("at") < 14 * sites.DAY)
    order = Window.partitionBy("site").orderBy("at", "seq")
    lives = half.withColumn("_anew", F.coalesce(F.col("at") - F.lag("at").over(order) >= sites.DAY, F.lit(False)).cast("int")).withColumn("_life", F.sum("_anew").over(order))
    stored = lives.groupBy("site", "_life").agg(F.max_by("version", F.struct("at", "seq")).alias("version"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.count("*").alias("checkin_count"))
    stored = stored.groupBy("site").agg(F.max_by(F.struct("version", "first_seen", "last_seen", "checkin_count"), "_life").alias("s")).select("site", "s.*")
    found = KeyedTable(spark, shared_folder(spark, "site-table"), sites.SITES, "site", 16)
    found.replace(stored)
    with state.with_states(spark):
        states = sites.site_states(_as_stream(rows.filter(F.col("at") >= 14 * sites.DAY).drop("at")), 1, stored=found.read())
        sites.follow(states, found, "check-ins", shared_folder(spark, "site-stream"))
    return found.read()


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four listings of each source's folder, the documents growing in number; a document of another source is in it, too, now and then."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), "source", F.concat(F.lit("f"), F.col("doc_id") % 397).alias("file_id"))
    seen = docs.select(F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long"))).alias("tick"), F.coalesce("source", F.lit("none")).alias("watch_id"), "file_id", "pos", (F.col("pos") % 11 != 0).alias("selectable"))
    return seen.filter(F.col("pos") % 4 < F.col("tick"))


def import_codes(files: DataFrame) -> DataFrame:
    """How imports of files go, by their names: most well, some softly wrong, few hard."""
    number = F.substring("file_id", 2, 9).cast("int")
    code = F.when(number % 29 == 0, F.lit(HARD[0])).when(number % 5 == 0, "export_too_large")
    return files.select("watch_id", "file_id", code.alias("code"))


@query("stream_watch_import")
def stream_watch_import(spark, sf_dir):
    """The state of each watch after four ticks: one row for the watch and for each file in line or failed."""
    watch = KeyedTable(spark, shared_folder(spark, "watch-table"), watch_sync.STATE, "watch_id", 8)
    linked = KeyedTable(spark, shared_folder(spark, "linked-table"), watch_sync.LINKED, "file_id", 8)
    watch_sync.run(_as_stream(listings(spark, sf_dir)), watch, linked, import_codes, shared_folder(spark, "watch-stream"))
    return watch.read()
