"""Every query of the library's operators by name, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import rules
from foliant.functions import text as tx
from foliant.operators import catalog, changes, documents, events, folders, telemetry, watches
from foliant.plans.models import EVENTS_SQL, GRANTS_SQL, NOW, SOURCES_SQL, TREE_SQL, grants, table, tree
from foliant.plans.models import events as event_table
from foliant.plans.models import sources as source_table
from foliant.sources import exports
from foliant.streaming import state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _time(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


SRC = f"WITH sources AS ({SOURCES_SQL}), linked AS (SELECT * FROM sources WHERE file_id <> '') "
EVT = f"WITH ev AS ({EVENTS_SQL}) "
HEALTH = "CASE WHEN status = 'syncing' THEN 1 WHEN status IN ('synced', 'skipped') AND last_synced_at <> '' THEN 2 ELSE 0 END"
T = "strftime({}, '%Y-%m-%d %H:%M:%S')"
SITES = f"SELECT user_id AS site, arg_max(event_type, (ts, event_id)) AS version, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS checkin_count FROM events GROUP BY user_id"
SINCE = "2024-01-25 00:00:00"


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("site"), F.col("event_type").alias("version"), "ts", "event_id")
    return telemetry.upsert(rows, "site", "ts", ["event_id"], ["version"])


# Check-ins.


@query("site_upsert", f"SELECT site, version, {T.format('first_seen')} AS first_seen, {T.format('last_seen')} AS last_seen, checkin_count FROM ({SITES})")
def site_upsert(spark, sf_dir):
    return _sites(spark, sf_dir).withColumns({"first_seen": _time("first_seen"), "last_seen": _time("last_seen")})


@query("site_upsert_merge", f"SELECT site, version, {T.format('first_seen')} AS first_seen, {T.format('last_seen')} AS last_seen, checkin_count FROM ({SITES})")
def site_upsert_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("site"), F.col("event_type").alias("version"), "ts", "event_id")
    old = telemetry.upsert(rows.filter("ts < TIMESTAMP_NTZ '2024-01-15'"), "site", "ts", ["event_id"], ["version"])
    new = telemetry.upsert(rows.filter("ts >= TIMESTAMP_NTZ '2024-01-15'"), "site", "ts", ["event_id"], ["version"], old)
    return new.withColumns({"first_seen": _time("first_seen"), "last_seen": _time("last_seen")})


@query("active_installs", f"SELECT count(*) AS installs FROM ({SITES}) WHERE last_seen >= TIMESTAMP '{SINCE}'")
def active_installs(spark, sf_dir):
    return telemetry.active(_sites(spark, sf_dir), F.expr(f"TIMESTAMP_NTZ '{SINCE}'")).agg(F.count("*").alias("installs"))


@query("installs_by_version", f"SELECT version AS key, count(*) AS installs FROM ({SITES}) WHERE last_seen >= TIMESTAMP '{SINCE}' GROUP BY 1")
def installs_by_version(spark, sf_dir):
    return telemetry.counts_by(telemetry.active(_sites(spark, sf_dir), F.expr(f"TIMESTAMP_NTZ '{SINCE}'")), ["version"]).select("key", "installs")


@query("installs_by_dimension", f"SELECT 'version' AS dimension, version AS key, count(*) AS installs FROM ({SITES}) GROUP BY 2 UNION ALL SELECT 'checkin_count', CAST(checkin_count AS STRING), count(*) FROM ({SITES}) GROUP BY 2")
def installs_by_dimension(spark, sf_dir):
    return telemetry.counts_by(_sites(spark, sf_dir), ["version", "checkin_count"])


@query("retention_keep", f"SELECT site, version, checkin_count FROM ({SITES}) WHERE last_seen >= TIMESTAMP '2024-04-28 12:00:00' - INTERVAL 90 DAY")
def retention_keep(spark, sf_dir):
    return telemetry.retain(_sites(spark, sf_dir), F.expr("TIMESTAMP_NTZ '2024-04-28 12:00:00'")).select("site", "version", "checkin_count")


_HASH = "lower(CASE WHEN user_id % 5 = 0 THEN 'nothex' ELSE {sha} END)"
_BODY = "CASE WHEN user_id % 7 = 0 THEN 'no json' WHEN user_id % 7 = 1 THEN '[1]' ELSE concat('{{\"siteHash\":\"', CASE WHEN user_id % 5 = 0 THEN 'nothex' ELSE {sha} END, '\",\"pluginSlug\":\"', CASE WHEN user_id % 11 = 0 THEN 'other' ELSE 'sync' END, '\",\"pluginVersion\":\" 1.0 \",\"wpVersion\":\"6\",\"phpVersion\":\"8\",\"consentVersion\":\"', CASE WHEN user_id % 3 = 0 THEN '' ELSE '1' END, '\"}}') END"


@query(
    "checkin_ingest",
    "SELECT event_id, CASE WHEN user_id % 7 < 2 THEN 'invalid_json' WHEN user_id % 5 = 0 THEN 'invalid_site_hash' WHEN user_id % 11 = 0 THEN 'invalid_plugin_slug' WHEN user_id % 3 = 0 THEN 'missing_metadata' END AS error, CASE WHEN user_id % 7 < 2 THEN '' ELSE '1.0' END AS plugin_version FROM events",
)
def checkin_ingest(spark, sf_dir):
    bodies = table(spark, sf_dir, "events").select("event_id", F.expr(_BODY.format(sha="sha2(CAST(user_id AS STRING), 256)")).alias("body"))
    return telemetry.ingest(bodies, "sync").select("event_id", "error", "plugin_version")


# Catalog.


@query("source_health_order", SRC + f"SELECT post_id, {HEALTH} AS health, row_number() OVER (ORDER BY {HEALTH}, post_modified DESC, post_id DESC) AS position FROM linked QUALIFY position <= 100")
def source_health_order(spark, sf_dir):
    rows = catalog.linked(source_table(spark, sf_dir))
    return catalog.page(rows, catalog.by_health(rows)).select("post_id", rules.health_rank(F.col("status"), F.col("last_synced_at")).alias("health"), "position")


@query("source_page", SRC + f"SELECT post_id, position, n > 40 AS has_more FROM (SELECT post_id, row_number() OVER (ORDER BY {HEALTH}, post_modified DESC, post_id DESC) AS position, count(*) OVER () AS n FROM linked WHERE status = 'linked' AND folder_watch_id <> 'none') WHERE position BETWEEN 21 AND 40")
def source_page(spark, sf_dir):
    rows = catalog.filtered(source_table(spark, sf_dir), status="linked")
    return catalog.page(rows, catalog.by_health(rows), number=2, size=20).select("post_id", "position", "has_more")


@query("source_watch_filter", SRC + "SELECT post_id, status FROM linked WHERE folder_watch_id = 'src3' AND status = 'linked' AND (contains(lower(post_title), 'th') OR contains(lower(title), 'th') OR contains(lower(file_id), 'th') OR contains(lower(doc_url), 'th'))")
def source_watch_filter(spark, sf_dir):
    return catalog.filtered(source_table(spark, sf_dir), status="linked", watch="src3", search="TH").select("post_id", "status")


@query(
    "source_summary",
    SRC + f"SELECT count(*) FILTER (r <= 500) AS total, count(*) FILTER (r <= 500 AND h = 1) AS syncing, count(*) FILTER (r <= 500 AND h = 2) AS healthy, count(*) FILTER (r <= 500 AND h = 0) AS attention, coalesce(bool_or(r <= 500 AND h = 2), FALSE) AS activated, count(*) > 500 AS truncated FROM (SELECT {HEALTH} AS h, row_number() OVER (ORDER BY post_id) AS r FROM linked)",
)
def source_summary(spark, sf_dir):
    return catalog.summary(source_table(spark, sf_dir))


@query("source_search_union", SRC + "SELECT post_id FROM linked WHERE contains(lower(post_title), 'tion') UNION SELECT post_id FROM linked WHERE contains(lower(title), 'tion') OR contains(lower(file_id), 'tion') OR contains(lower(doc_url), 'tion')")
def source_search_union(spark, sf_dir):
    return catalog.search_ids(source_table(spark, sf_dir), "TION")


_DUE = "last_synced_at <= '2024-01-15' AND status <> 'syncing'"


@query("source_due", SRC + f"SELECT post_id, last_synced_at FROM linked WHERE {_DUE} AND post_id % 10 <> 1 ORDER BY last_synced_at, post_modified, post_id LIMIT 50")
def source_due(spark, sf_dir):
    rows = source_table(spark, sf_dir)
    return catalog.due_page(rows, "2024-01-15", 50, rows.filter("post_id % 10 = 1")).select("post_id", "last_synced_at")


@query("source_due_union", SRC + f", g AS ({GRANTS_SQL}), r AS (SELECT post_id, row_number() OVER (ORDER BY CASE WHEN scope = 'all' THEN 0 ELSE 1 END, last_synced_at, post_modified, post_id) AS position FROM linked JOIN g USING (post_type) WHERE user_id = 7 AND {_DUE} AND (scope = 'all' OR post_author = 7)) SELECT * FROM r WHERE position <= 60")
def source_due_union(spark, sf_dir):
    return catalog.due_for_user(source_table(spark, sf_dir), grants(spark), 7, "2024-01-15", 60).select("post_id", "position")


@query("source_visible", SRC + f", g AS ({GRANTS_SQL}) SELECT post_id, post_type FROM linked JOIN g USING (post_type) WHERE user_id = 7 AND (scope = 'all' OR post_author = 7)")
def source_visible(spark, sf_dir):
    return catalog.visible(catalog.linked(source_table(spark, sf_dir)), grants(spark), 7).select("post_id", "post_type")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("doc-"), F.col("o_orderkey").cast("string")).alias("file_id"))


@query("source_lookup_semi", SRC + "SELECT file_id, min(post_id) AS post_id FROM linked WHERE file_id IN (SELECT concat('doc-', o_orderkey) FROM orders) GROUP BY file_id")
def source_lookup_semi(spark, sf_dir):
    return catalog.with_file(source_table(spark, sf_dir), _files(spark, sf_dir))


@query("source_missing_anti", SRC + "SELECT f.file_id FROM (SELECT concat('doc-', o_orderkey) AS file_id FROM orders) f WHERE NOT EXISTS (SELECT 1 FROM linked l WHERE l.file_id = f.file_id)")
def source_missing_anti(spark, sf_dir):
    return catalog.without_source(_files(spark, sf_dir), source_table(spark, sf_dir))


@query("source_format", SRC + 'SELECT post_id AS "postId", post_title AS "postTitle", file_id AS "fileId", status, last_synced_at AS "lastSyncedAt", nullif(last_method, \'\') AS "lastMethod", nullif(layout_preset, \'\') AS "layoutPreset", nullif(folder_watch_id, \'\') AS "folderWatchId" FROM sources')
def source_format(spark, sf_dir):
    return catalog.formatted(source_table(spark, sf_dir))


_META = ["file_id", "status", "last_synced_at", "folder_watch_id"]


@query("source_attributes_pivot", SRC + "SELECT post_id, file_id, status, last_synced_at, folder_watch_id FROM sources")
def source_attributes_pivot(spark, sf_dir):
    return catalog.from_attributes(catalog.to_attributes(source_table(spark, sf_dir), "post_id", _META), "post_id", _META)


@query("source_delete_attributes", SRC + "SELECT post_id, meta_key, meta_value FROM (UNPIVOT (SELECT post_id, file_id, status, last_synced_at, folder_watch_id FROM sources) ON file_id, status, last_synced_at, folder_watch_id INTO NAME meta_key VALUE meta_value) WHERE post_id % 4 <> 0 OR meta_key = 'folder_watch_id'")
def source_delete_attributes(spark, sf_dir):
    rows = source_table(spark, sf_dir)
    return catalog.delete_attributes(catalog.to_attributes(rows, "post_id", _META), rows.filter("post_id % 4 = 0"), "post_id", ["file_id", "status", "last_synced_at"])


@query("source_merge", SRC + "SELECT post_id, CASE WHEN post_id % 2 = 0 THEN 'queued' ELSE status END AS status, CASE WHEN post_id % 2 = 0 AND post_id % 3 = 0 THEN NULL WHEN post_id % 2 = 0 AND post_id % 3 = 1 THEN 'documentation' ELSE layout_preset END AS layout_preset FROM sources")
def source_merge(spark, sf_dir):
    rows = source_table(spark, sf_dir).select("post_id", "status", "layout_preset")
    new = rows.filter("post_id % 2 = 0").select("post_id", F.lit("queued").alias("status"), F.expr("CASE post_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'documentation' END").alias("layout_preset"))
    return catalog.merge(rows, new, "post_id", ["layout_preset"])


# Events.


@query("events_recent50", EVT + "SELECT event_id, post_id, rank FROM (SELECT event_id, post_id, row_number() OVER (PARTITION BY post_id ORDER BY ts DESC, event_id DESC) AS rank FROM ev) WHERE rank <= 50")
def events_recent50(spark, sf_dir):
    return events.recent(event_table(spark, sf_dir)).select("event_id", "post_id", "rank")


@query("events_filter", EVT + "SELECT event_id, level, step FROM ev WHERE level = 'warning' AND status = 'syncing' AND step = 'view'")
def events_filter(spark, sf_dir):
    return events.matching(event_table(spark, sf_dir), level="warning", status="syncing", step="view").select("event_id", "level", "step")


_FIELDS = ("CAST(post_id AS STRING)", "post_title", "status", "step", "message", "error_code")


@query("events_search", EVT + "SELECT event_id FROM ev WHERE " + " OR ".join(f"contains(lower({c}), 'abc77')" for c in _FIELDS))
def events_search(spark, sf_dir):
    return events.matching(event_table(spark, sf_dir), search="ABC77").select("event_id")


@query("events_page", EVT + "SELECT event_id, position, n > 100 AS has_more FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS position, count(*) OVER () AS n FROM ev WHERE level = 'error') WHERE position BETWEEN 51 AND 100")
def events_page(spark, sf_dir):
    rows = events.matching(event_table(spark, sf_dir), level="error")
    return events.page(rows, number=2).select("event_id", "position", "has_more")


@query("events_level_counts", EVT + f"SELECT level, count(*) AS n, {T.format('max(ts)')} AS latest FROM ev GROUP BY level")
def events_level_counts(spark, sf_dir):
    return events.level_counts(event_table(spark, sf_dir)).withColumn("latest", _time("latest"))


@query("events_clear_count", EVT + "SELECT count(*) AS cleared FROM ev WHERE post_id % 3 = 0")
def events_clear_count(spark, sf_dir):
    rows = event_table(spark, sf_dir)
    return events.clear(rows, rows.filter("post_id % 3 = 0"))[1]


@query("events_clear_rest", EVT + "SELECT event_id FROM ev WHERE post_id % 3 <> 0")
def events_clear_rest(spark, sf_dir):
    rows = event_table(spark, sf_dir)
    return events.clear(rows, rows.filter("post_id % 3 = 0"))[0].select("event_id")


@query("events_sanitized", EVT + "SELECT event_id, level, least(100, greatest(0, progress)) AS progress, concat('step ', step, ' Bearer [redacted] client_secret=[redacted] done') AS message FROM ev")
def events_sanitized(spark, sf_dir):
    return events.sanitized(event_table(spark, sf_dir)).select("event_id", "level", "progress", "message")


@query("event_context_json", "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN TRUE WHEN user_id % 3 = 1 THEN FALSE END AS has_lock, event_type AS mode FROM events")
def event_context_json(spark, sf_dir):
    lock = F.expr("CASE user_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'null' END")
    rows = table(spark, sf_dir, "events").withColumn("props", F.concat(F.lit('{"hasLock":'), lock, F.lit(',"other":1,"mode":"'), "event_type", F.lit('"}')))
    return events.context(rows).select("event_id", F.col("context.hasLock").alias("has_lock"), F.col("context.mode").alias("mode"))


@query("events_titled", EVT + "SELECT event_id, coalesce(nullif(post_title, ''), c_name, '') AS title FROM ev LEFT JOIN customer ON post_id = c_custkey")
def events_titled(spark, sf_dir):
    posts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("post_id"), F.col("c_name").alias("live_title"))
    return events.titled(event_table(spark, sf_dir), posts).select("event_id", "title")


@query("events_prepend", "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) SELECT user_id AS post_id, string_agg(CAST(event_id AS STRING), ',' ORDER BY k) AS ids FROM r WHERE k <= 50 GROUP BY user_id")
def events_prepend(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("post_id"), F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("event"), (F.col("event_id") % 7 == 0).alias("_x"))
    cut = rows.agg(F.percentile_approx("seq", 0.5).alias("m"))
    split = rows.crossJoin(F.broadcast(cut))
    none = spark.createDataFrame([], "post_id long, events array<string>")
    old = events.prepend(none, split.filter("seq <= m"))
    return events.prepend(old, split.filter("seq > m")).select("post_id", F.array_join("events", ",").alias("ids"))


# Folders.

_BFS = f"""WITH RECURSIVE items AS ({TREE_SQL}),
walk AS (
  SELECT concat('r', r_regionkey) AS root_id, concat('r', r_regionkey) AS folder_id, '' AS path, 0 AS depth FROM region
  UNION ALL
  SELECT root_id, file_id, path || CASE WHEN path = '' THEN '' ELSE ' / ' END || name, depth + 1 FROM walk JOIN items ON parent_id = folder_id WHERE item_type = 'folder' AND depth < 3),
docs AS (SELECT root_id, file_id, name, depth, path FROM walk JOIN items ON parent_id = folder_id WHERE item_type = 'document' AND selectable)
"""


def _roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("root_id"))


@query("folder_children", f"SELECT file_id, name, row_number() OVER (ORDER BY name, file_id) AS position FROM ({TREE_SQL}) WHERE parent_id = 'n3'")
def folder_children(spark, sf_dir):
    rows = folders.children(tree(spark, sf_dir), "n3")
    return rows.withColumn("position", F.row_number().over(Window.orderBy(tx.natural_key(F.col("name")), "file_id"))).select("file_id", "name", "position")


@query("folder_inventory_bfs", _BFS + "SELECT root_id, file_id, name, depth, path FROM docs")
def folder_inventory_bfs(spark, sf_dir):
    return folders.inventory(tree(spark, sf_dir), _roots(spark, sf_dir), most=1_000_000).drop("place")


@query("folder_inventory_capped", _BFS + "SELECT root_id, count(*) AS n, bool_and(overflow) AS overflow FROM (SELECT root_id, count(*) OVER (PARTITION BY root_id) > 50 AS overflow, row_number() OVER (PARTITION BY root_id ORDER BY depth, path, file_id) AS r FROM docs) WHERE r <= 50 GROUP BY root_id")
def folder_inventory_capped(spark, sf_dir):
    rows = folders.capped(folders.inventory(tree(spark, sf_dir), _roots(spark, sf_dir), most=1_000_000))
    return rows.groupBy("root_id").agg(F.count("*").alias("n"), F.bool_and("overflow").alias("overflow"))


def _watch_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    scope = table(spark, sf_dir, "orders").select(F.expr("o_custkey % 100").alias("watch_id"), F.expr("o_orderkey % 5000").alias("file_id"), F.col("o_orderkey").alias("pos"))
    pending = scope.filter("pos % 3 = 0").select("watch_id", F.expr("file_id + pos % 2 * 100000").alias("file_id"), F.expr("-pos").alias("pos"))
    return pending, scope, scope.filter("pos % 11 = 0"), scope.filter("pos % 7 = 0")


_WATCH = """WITH scope AS (SELECT o_custkey % 100 AS watch_id, o_orderkey % 5000 AS file_id, o_orderkey AS pos FROM orders),
pending AS (SELECT watch_id, file_id + pos % 2 * 100000 AS file_id, -pos AS pos FROM scope WHERE pos % 3 = 0),
excluded AS (SELECT * FROM scope WHERE pos % 11 = 0), done AS (SELECT * FROM scope WHERE pos % 7 = 0)
"""


@query(
    "reconcile_pending",
    _WATCH + """, parts AS (
      SELECT watch_id, file_id, 0 AS part, min(pos) AS pos FROM pending WHERE (watch_id, file_id) IN (SELECT watch_id, file_id FROM scope) GROUP BY 1, 2
      UNION ALL SELECT watch_id, file_id, 1, min(pos) FROM scope GROUP BY 1, 2),
    best AS (SELECT watch_id, file_id, min((part, pos)) AS place FROM parts WHERE (watch_id, file_id) NOT IN (SELECT watch_id, file_id FROM excluded) AND (watch_id, file_id) NOT IN (SELECT watch_id, file_id FROM done) GROUP BY 1, 2)
    SELECT watch_id, file_id, row_number() OVER (PARTITION BY watch_id ORDER BY place, file_id) AS pos FROM best""",
)
def reconcile_pending(spark, sf_dir):
    return folders.reconcile(*_watch_parts(spark, sf_dir))


@query("failed_retryable", _WATCH + "SELECT DISTINCT watch_id, file_id FROM pending WHERE (watch_id, file_id) IN (SELECT watch_id, file_id FROM scope) AND (watch_id, file_id) NOT IN (SELECT watch_id, file_id FROM excluded)")
def failed_retryable(spark, sf_dir):
    pending, scope, excluded, _ = _watch_parts(spark, sf_dir)
    return folders.retryable(pending, scope, excluded).select("watch_id", "file_id")


@query("selected_count", _WATCH + "SELECT watch_id, count(*) AS selected FROM scope WHERE (watch_id, file_id) NOT IN (SELECT watch_id, file_id FROM excluded) GROUP BY watch_id")
def selected_count(spark, sf_dir):
    _, scope, excluded, _ = _watch_parts(spark, sf_dir)
    return folders.selected(scope, excluded)


@query("watch_summary", "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS importing, count(*) FILTER (o_orderstatus = 'F') AS watching, count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) AS attention FROM orders")
def watch_summary(spark, sf_dir):
    return folders.watch_summary(table(spark, sf_dir, "orders").select(F.expr("CASE o_orderstatus WHEN 'O' THEN 'importing' WHEN 'F' THEN 'watching' ELSE 'paused' END").alias("status")))


@query("natural_order", "WITH n AS (SELECT c_custkey, CAST(c_nationkey % 3 AS STRING) AS a, concat(CAST(c_custkey + 1 AS STRING), CASE WHEN c_custkey % 7 = 0 THEN repeat('0', 30) ELSE '' END) AS b FROM customer) SELECT c_custkey, concat('folder ', lpad(CAST(length(a) AS STRING), 10, '0'), a, ' item ', lpad(CAST(length(b) AS STRING), 10, '0'), b) AS sort_key, row_number() OVER (ORDER BY a, length(b), b) AS position FROM n")
def natural_order(spark, sf_dir):
    name = F.concat(F.lit("Folder "), F.expr("c_nationkey % 3"), F.lit(" item "), F.expr("CASE WHEN c_custkey % 5 = 0 THEN '000' ELSE '' END"), F.expr("c_custkey + 1"), F.expr("CASE WHEN c_custkey % 7 = 0 THEN repeat('0', 30) ELSE '' END"))
    keys = table(spark, sf_dir, "customer").select("c_custkey", tx.natural_key(name).alias("sort_key"))
    return keys.withColumn("position", F.row_number().over(Window.orderBy("sort_key")))


# Changes and liveness.


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source_table(spark, sf_dir).filter("post_id % 17 <> 0 AND file_id <> ''")
    return rows.select("file_id", F.expr("CASE WHEN post_id % 5 = 0 THEN 'new' ELSE modified_time END").alias("new_time"), F.col("version").alias("new_version"), F.lit("now").alias("new_layout_hash"), F.expr("CASE WHEN post_id % 6 = 0 THEN 'other' ELSE last_hash END").alias("new_hash"))


_LAYOUT = "CASE WHEN last_layout_hash = '' THEN layout_preset = 'plain_blocks' ELSE last_layout_hash = 'now' END"


@query("change_plan", SRC + f"SELECT post_id, CASE WHEN post_id % 17 = 0 THEN 'missing' WHEN last_hash <> '' AND post_id % 5 <> 0 AND {_LAYOUT} THEN 'skip_metadata' WHEN post_id % 6 <> 0 THEN 'skip_content' ELSE 'sync' END AS action FROM linked")
def change_plan(spark, sf_dir):
    return changes.plan(catalog.linked(source_table(spark, sf_dir)), _current(spark, sf_dir)).select("post_id", "action")


@query("layout_fingerprint", SRC + f"SELECT post_id, {_LAYOUT} AS layout_current FROM sources")
def layout_fingerprint(spark, sf_dir):
    return source_table(spark, sf_dir).select("post_id", rules.fingerprint_current(F.lit("now"), F.col("last_layout_hash"), F.col("layout_preset")).alias("layout_current"))


@query("stale_sync", SRC + f"SELECT post_id FROM sources WHERE status = 'syncing' AND post_id % 4 <> 0 AND (updated_at IS NULL OR {NOW} - updated_at >= 600)")
def stale_sync(spark, sf_dir):
    rows = source_table(spark, sf_dir)
    return rows.filter(rules.is_stale(F.col("status"), F.col("post_id") % 4 == 0, F.col("updated_at"), NOW)).select("post_id")


@query("heartbeat_stalled", SRC + f"SELECT folder_watch_id, max(updated_at) AS last_run, coalesce({NOW} - max(updated_at) > 7200, FALSE) AS stalled FROM sources GROUP BY folder_watch_id")
def heartbeat_stalled(spark, sf_dir):
    runs = source_table(spark, sf_dir).groupBy("folder_watch_id").agg(F.max("updated_at").alias("last_run"))
    every = rules.shortest_interval(F.array(F.lit("hourly"), F.lit("daily"), F.lit("never")))
    return runs.select("folder_watch_id", "last_run", rules.is_stalled(every, F.col("last_run"), F.lit(NOW), NOW).alias("stalled"))


@query("attempt_transitions", EVT + f"SELECT event_id, CAST(sum(b) OVER w AS BIGINT) AS attempt, {T.format('max(CASE WHEN b = 1 THEN ts END) OVER w')} AS started_at FROM (SELECT *, CASE WHEN status = 'syncing' AND coalesce(lag(status) OVER (PARTITION BY post_id ORDER BY ts, event_id), '') <> 'syncing' THEN 1 ELSE 0 END AS b FROM ev) WINDOW w AS (PARTITION BY post_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def attempt_transitions(spark, sf_dir):
    return changes.attempts(event_table(spark, sf_dir)).select("event_id", "attempt", _time("started_at").alias("started_at"))


@query("monotone_progress", EVT + "SELECT event_id, CASE WHEN status = 'error' THEN max(least(100, greatest(0, progress))) OVER (PARTITION BY post_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) ELSE least(100, greatest(0, progress)) END AS progress FROM ev")
def monotone_progress(spark, sf_dir):
    return changes.progress(event_table(spark, sf_dir)).select("event_id", "progress")


@query("live_locks", "SELECT user_id AS key, max(CAST(floor(epoch(ts)) AS BIGINT)) + 1800 AS expires FROM events GROUP BY user_id HAVING max(CAST(floor(epoch(ts)) AS BIGINT)) + 1800 > 1706572800")
def live_locks(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01', ts)").alias("at"))
    return changes.live_locks(rows, 1_706_572_800)


# Scalars.


@query("doc_id_parse", SRC + "SELECT post_id, CASE WHEN post_id % 4 = 0 THEN concat('document-', post_id) WHEN post_id % 4 = 1 AND length(concat('doc-', post_id)) >= 10 THEN concat('doc-', post_id) END AS document_id FROM sources")
def doc_id_parse(spark, sf_dir):
    rows = source_table(spark, sf_dir)
    kind = F.expr("CASE post_id % 4 WHEN 0 THEN 'url' WHEN 1 THEN 'file_id' WHEN 2 THEN 'url' ELSE 'other' END")
    value = F.expr("CASE post_id % 4 WHEN 0 THEN doc_url WHEN 1 THEN concat(' doc-', post_id, ' ') WHEN 2 THEN concat('https://example.com/document/d/document-', post_id) ELSE doc_url END")
    return rows.select("post_id", tx.parse_document_id(kind, value).alias("document_id"))


@query("redact_text", "SELECT event_id, concat('x Bearer [redacted] then authorization=[redacted], refresh_token=[redacted];') AS redacted FROM events")
def redact_text(spark, sf_dir):
    message = F.concat(F.lit("x bearer "), F.col("event_id"), F.lit("._~ then authorization: "), F.col("props"), F.lit(", refresh_token="), F.col("user_id"), F.lit(";"))
    clean = F.regexp_replace(message, r'[{}" ]{1}(?=k|:)|(?<=:) (?=[0-9])|[{}"]', "")
    return table(spark, sf_dir, "events").select("event_id", tx.redact(clean).alias("redacted"))


@query("truncate_text", "SELECT doc_id, substring(text, 1, 160) AS short FROM documents")
def truncate_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.truncate(F.col("text"), tx.EVENT_FIELD).alias("short"))


@query("sanitize_key", "SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9_\\-]', '', 'g') AS key FROM documents")
def sanitize_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.sanitize_key(F.col("text")).alias("key"))


@query("sanitize_text", "SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '[\\r\\n\\t ]+', ' ', 'g')) AS plain FROM pages")
def sanitize_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.sanitize_text(F.col("html")).alias("plain"))


@query("whole_numbers", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN l_partkey END AS parsed FROM lineitem")
def whole_numbers(spark, sf_dir):
    text = F.concat(F.expr("CASE WHEN l_returnflag = 'A' THEN '' ELSE '-' END"), F.col("l_partkey").cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tx.whole_number(text).alias("parsed"))


@query("window_parse", "SELECT o_orderkey, CASE WHEN o_orderkey % 100 BETWEEN 1 AND 90 THEN CAST(o_orderkey % 100 AS INT) END AS days FROM orders")
def window_parse(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.window_days(F.concat(F.expr("o_orderkey % 100").cast("string"), F.lit("d"))).alias("days"))


@query("image_paths", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat('images/image ', doc_id, '.png') END AS path, CASE WHEN doc_id % 2 = 0 THEN '.jpg' ELSE '.png' END AS suffix FROM documents")
def image_paths(spark, sf_dir):
    source = F.expr("CASE doc_id % 3 WHEN 0 THEN concat('images/image%20', doc_id, '.png?w=1#x') WHEN 1 THEN '../up.png' ELSE 'https://host/x.png' END")
    return table(spark, sf_dir, "documents").select("doc_id", tx.image_path(source).alias("path"), tx.image_suffix(F.expr("CASE WHEN doc_id % 2 = 0 THEN 'image/JPEG; q=1' ELSE 'text/x' END")).alias("suffix"))


@query("compatibility", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'download_blocked' WHEN o_totalprice * 20 >= 8388608 THEN 'large_doc_possible' END AS warning FROM orders")
def compatibility(spark, sf_dir):
    allowed = F.expr("CASE o_orderstatus WHEN 'P' THEN FALSE WHEN 'O' THEN TRUE END")
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.compatibility(allowed, F.expr("CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice * 20 END"), F.expr("CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice * 20 END")).alias("warning"))


@query("remote_errors", "SELECT event_id, CASE WHEN user_id % 5 = 0 OR user_id % 5 = 4 THEN 'transient_failure' WHEN event_type = 'view' THEN 'export_too_large' WHEN user_id % 5 IN (1, 2) THEN 'access_denied' ELSE 'bad_response' END AS error FROM events")
def remote_errors(spark, sf_dir):
    status = F.expr("CASE user_id % 5 WHEN 0 THEN 429 WHEN 1 THEN 403 WHEN 2 THEN 404 WHEN 3 THEN 400 ELSE 503 END")
    return table(spark, sf_dir, "events").select("event_id", rules.remote_error(status, F.expr("CASE WHEN event_type = 'view' THEN 'File Too Large' END")).alias("error"))


@query("recovery_hints", EVT + "SELECT event_id, CASE WHEN error_code = 'sync_stalled' THEN 'retry_then_server_cron' WHEN status = 'syncing' AND post_id % 2 = 0 THEN 'retry_check_schedule' WHEN error_code = 'access_denied' THEN 'reconnect' ELSE '' END AS hint FROM ev")
def recovery_hints(spark, sf_dir):
    lock = F.expr("CASE WHEN post_id % 2 = 0 THEN FALSE END")
    return event_table(spark, sf_dir).select("event_id", rules.recovery_hint(F.col("error_code"), F.col("step"), F.col("status"), lock, F.lit(False)).alias("hint"))


@query("activation_states", SRC + f"SELECT post_author, CASE WHEN post_author % 7 = 0 THEN 'site_needs_admin' WHEN post_author % 7 = 1 THEN 'account_disconnected' WHEN post_author % 7 = 2 THEN 'scope_outdated' WHEN count(*) FILTER ({HEALTH} = 0) > 2 THEN 'needs_attention' WHEN bool_or({HEALTH} = 2) THEN 'activated' WHEN count(*) FILTER ({HEALTH} = 1) > 0 THEN 'syncing' ELSE 'ready_for_source' END AS state FROM sources GROUP BY post_author")
def activation_states(spark, sf_dir):
    rank = rules.health_rank(F.col("status"), F.col("last_synced_at"))
    found = source_table(spark, sf_dir).groupBy("post_author").agg((F.count_if(rank == 0) - 2).alias("attention"), F.bool_or(rank == 2).alias("activated"), F.count_if(rank == 1).alias("syncing"))
    k = F.col("post_author") % 7
    return found.select("post_author", rules.activation_state(k != 0, k != 1, k != 2, F.col("attention"), F.col("activated"), F.col("syncing")).alias("state"))


# Documents.


@query("asset_dedupe", "SELECT DISTINCT CAST(doc_id % 100 AS BIGINT) AS file_id, source AS asset_path, sha256(text) AS sha256 FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 = 0)")
def asset_dedupe(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select(F.expr("doc_id % 100").alias("file_id"), F.col("source").alias("asset_path"), F.sha2("text", 256).alias("sha256"), "doc_id")
    seen = found.filter("doc_id % 10 = 0").select("sha256").distinct()
    known = found.join(seen, "sha256", "left_semi")
    return documents.new_assets(found, known)


@query("role_runs", "WITH t AS (SELECT *, CASE WHEN role = lag(role) OVER w THEN 0 ELSE 1 END AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), r AS (SELECT *, CAST(sum(b) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM t) SELECT conv_id, run, role, min(turn) AS first, max(turn) AS last, count(*) AS n FROM r GROUP BY 1, 2, 3")
def role_runs(spark, sf_dir):
    return documents.runs(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


@query("heading_sections", "WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents), s AS (SELECT doc_id, pos, CASE WHEN length(line) < 40 AND row_number() OVER (PARTITION BY doc_id ORDER BY pos) > 1 THEN 1 ELSE 0 END AS b FROM l) SELECT doc_id, CAST(sum(b) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section, CAST(pos AS INT) AS pos FROM s")
def heading_sections(spark, sf_dir):
    return documents.sections(_lines(spark, sf_dir).withColumn("is_heading", F.length("line") < 40), "doc_id").select("doc_id", "section", "pos")


@query("seeded_ids", "SELECT doc_id, substring(sha256(concat(source, ':', doc_id)), 1, 8) AS widget_id FROM documents")
def seeded_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.short_id(F.col("source"), F.col("doc_id")).alias("widget_id"))


@query("partial_flushes", "WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) SELECT doc_id, CAST(pos AS INT) AS pos FROM l QUALIFY pos % 20 = 0 OR pos = max(pos) OVER (PARTITION BY doc_id)")
def partial_flushes(spark, sf_dir):
    return documents.flushes(_lines(spark, sf_dir).select("doc_id", (F.col("pos") + 1).alias("pos")), "doc_id")


@query("line_text", "SELECT doc_id, string_agg(rtrim(line), chr(10) ORDER BY pos) AS joined FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id")
def line_text(spark, sf_dir):
    return documents.joined(_lines(spark, sf_dir).withColumn("line", F.rtrim("line")), "doc_id", "pos", "line")


@query("html_blocks")
def html_blocks(spark, sf_dir):
    return documents.blocks(table(spark, sf_dir, "pages"), preset="documentation")


@query("html_rendered")
def html_rendered(spark, sf_dir):
    return documents.rendered(table(spark, sf_dir, "pages"), preset="clean_article")


@query("html_widgets")
def html_widgets(spark, sf_dir):
    return documents.widgets(documents.blocks(table(spark, sf_dir, "pages"), whole=False), "page_id").select("page_id", "pos", "section", "widget", "widget_id", "section_id")


@query("html_heroes")
def html_heroes(spark, sf_dir):
    return documents.heroes(documents.blocks(table(spark, sf_dir, "pages"), whole=False), "page_id")


@query("code_runs")
def code_runs(spark, sf_dir):
    return documents.code_runs(table(spark, sf_dir, "documents"))


@query("list_runs", "WITH p AS (SELECT o_custkey AS doc_id, o_orderkey AS pos, CASE WHEN o_orderstatus <> 'O' THEN concat(o_orderstatus, ':0:') END AS list_key FROM orders WHERE o_orderkey % 4 <> 0), t AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND list_key IS NOT DISTINCT FROM lag(list_key) OVER w THEN 0 ELSE 1 END AS b FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), r AS (SELECT *, CAST(sum(b) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM t) SELECT doc_id, run, list_key, min(pos) AS first, max(pos) AS last, count(*) AS n FROM r WHERE list_key IS NOT NULL GROUP BY 1, 2, 3")
def list_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pos"), F.expr("CASE WHEN o_orderstatus <> 'O' THEN concat(o_orderstatus, ':0:') END").alias("list_key"), F.expr("CASE WHEN o_orderkey % 4 = 0 THEN ' ' ELSE 'x' END").alias("text"))
    return documents.list_runs(rows, "doc_id")


def limiter_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls in which users change addresses: ten users share four addresses, each day is a minute and a half."""
    at = F.expr("CAST(timestampdiff(SECOND, TIMESTAMP_NTZ '2024-01-01', ts) AS DOUBLE) / 960")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), F.col("user_id").cast("string").alias("user"), F.expr("concat('10.0.', user_id div 10, '.', event_id % 4)").alias("ip"), at.alias("at"))


@query("rate_limit_idle_reset")
def rate_limit_idle_reset(spark, sf_dir):
    return state.rate_limited(limiter_calls(spark, sf_dir))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files, with time as a timestamp; the pattern lets the table be a file or a folder."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_site_upsert", f"SELECT user_id AS site, {T.format('min(ts)')} AS first_seen, {T.format('max(ts)')} AS last_seen, count(*) AS checkin_count FROM events GROUP BY user_id")
def stream_site_upsert(spark, sf_dir):
    rows = _stream(spark, sf_dir).withColumnRenamed("user_id", "site")
    found = state.drained(state.stream_upsert(rows, "site", "ts"), "complete")
    return found.withColumns({"first_seen": _time("first_seen"), "last_seen": _time("last_seen")})


@query("stream_window_counts", f"SELECT {T.format("date_trunc('hour', ts)")} AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_window_counts(spark, sf_dir):
    found = state.drained(state.windowed_counts(_stream(spark, sf_dir), "ts", "event_type"), "complete")
    return found.select(_time("window.start").alias("hour"), "event_type", "n")


_BEATS = "SELECT user_id AS post_id, ts, CASE WHEN event_type IN ('view', 'signup') THEN 'syncing' ELSE 'synced' END AS status, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, CASE WHEN event_type IN ('view', 'signup') THEN 'syncing' ELSE 'synced' END) AS next FROM events"


@query("stream_stale_timer", f"SELECT post_id, {T.format('ts')} AS last_at FROM ({_BEATS}) WHERE status = 'syncing' AND coalesce(next, (SELECT max(ts) - INTERVAL 1 MINUTE FROM events)) >= ts + INTERVAL 600 SECOND")
def stream_stale_timer(spark, sf_dir):
    beats = _stream(spark, sf_dir).select(F.col("user_id").alias("post_id"), F.expr("CASE WHEN event_type IN ('view', 'signup') THEN 'syncing' ELSE 'synced' END").alias("status"), "ts")
    return state.drained(state.stale_sources(beats.withWatermark("ts", "1 minute")), "append").select("post_id", _time("last_at").alias("last_at"))


# Listings, pages of keys, small lookups.


@query("source_author", SRC + f", g AS ({GRANTS_SQL}) SELECT post_id FROM linked JOIN g USING (post_type) WHERE user_id = 7 AND post_type IN ('en', 'fr') AND post_author = 7")
def source_author(spark, sf_dir):
    return catalog.visible(catalog.linked(source_table(spark, sf_dir)), grants(spark), 7, author=7, types=("en", "fr")).select("post_id")


@query("source_page_after", SRC + "SELECT post_id FROM linked WHERE post_modified < 1600300000 OR post_modified = 1600300000 AND post_id < 500 ORDER BY post_modified DESC, post_id DESC LIMIT 30")
def source_page_after(spark, sf_dir):
    return catalog.page_after(catalog.linked(source_table(spark, sf_dir)), [("post_modified", True), ("post_id", True)], (1_600_300_000, 500), 30).select("post_id")


@query("source_exists", SRC + f", g AS ({GRANTS_SQL}), u AS (SELECT unnest([7, 8, 9]) AS user_id) SELECT u.user_id, EXISTS (SELECT 1 FROM linked JOIN g USING (post_type) WHERE g.user_id = u.user_id AND (scope = 'all' OR post_author = g.user_id)) AS found FROM u")
def source_exists(spark, sf_dir):
    one = lambda u: catalog.any_visible(source_table(spark, sf_dir), grants(spark), u).select(F.lit(u).alias("user_id"), "found")
    return one(7).union(one(8)).union(one(9))


@query("due_batch", SRC + f"SELECT post_id FROM linked WHERE {_DUE} ORDER BY last_synced_at, post_modified, post_id LIMIT 20")
def due_batch(spark, sf_dir):
    return catalog.batch(source_table(spark, sf_dir), "2024-01-15", "cron").select("post_id")


@query("post_types", "WITH t AS (SELECT DISTINCT lang AS post_type FROM documents UNION SELECT unnest(['page', 'post'])) SELECT post_type, row_number() OVER (ORDER BY CASE post_type WHEN 'post' THEN 0 WHEN 'page' THEN 1 ELSE 2 END, post_type) AS position FROM t WHERE post_type IS NOT NULL")
def post_types(spark, sf_dir):
    types = table(spark, sf_dir, "documents").select(F.col("lang").alias("post_type")).filter("lang IS NOT NULL")
    return catalog.ordered_types(types.union(spark.createDataFrame([("page",), ("post",)], "post_type string")))


@query("known_keys", "SELECT event_id, concat_ws(',', CASE WHEN user_id % 2 = 0 THEN 'level=' || event_type END, 'step=' || user_id) AS kept FROM events")
def known_keys(spark, sf_dir):
    values = F.create_map(F.expr("CASE WHEN user_id % 2 = 0 THEN 'level' ELSE 'other' END"), F.col("event_type"), F.lit("step"), F.col("user_id").cast("string"))
    kept = F.transform(F.map_entries(catalog.whitelisted(values, ["level", "step"])), lambda e: F.concat(e.key, F.lit("="), e.value))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(kept, ",").alias("kept"))


@query("events_summary", EVT + f"SELECT count(*) AS total, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warning') AS warnings, arg_max(event_id, (ts, event_id)) AS latest_id, {T.format('max(ts)')} AS latest FROM ev")
def events_summary(spark, sf_dir):
    return events.summary(event_table(spark, sf_dir)).withColumn("latest", _time("latest"))


@query("events_search_context", "SELECT event_id FROM events LEFT JOIN customer ON user_id = c_custkey WHERE event_id % 50 = 0 OR contains(lower(c_name), '00001')")
def events_search_context(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("post_id"), F.expr("CASE WHEN event_id % 50 = 0 THEN '{\"layoutPreset\":\"wide-00001\"}' ELSE '{\"hasLock\":true,\"lastStep\":\"00001\"}' END").alias("props")).withColumn("post_id", F.concat(F.lit("p"), F.col("post_id").cast("string")))
    posts = table(spark, sf_dir, "customer").select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("post_id"), F.col("c_name").alias("live_title"))
    return events.matching(events.context(rows), search="00001", posts=posts).select("event_id")


def _files_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, trashed = F.expr("CASE WHEN o_orderkey % 9 = 0 THEN 'folder' ELSE 'document' END"), F.expr("CASE WHEN o_orderpriority = '5-LOW' THEN TRUE WHEN o_orderkey % 2 = 0 THEN FALSE END")
    return table(spark, sf_dir, "orders").select(F.expr("concat('f', o_orderkey % 40)").alias("parent_id"), F.expr("concat('o', o_orderkey)").alias("file_id"), F.expr("concat('Order ', o_orderkey)").alias("name"), kind.alias("item_type"), trashed.alias("trashed"), F.col("o_orderdate").alias("modified"))


_LISTED = "SELECT concat('f', o_orderkey % 40) AS parent_id, concat('o', o_orderkey) AS file_id, o_orderkey AS k, concat('Order ', o_orderkey) AS name, CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE 1 END AS r, coalesce(o_orderpriority = '5-LOW', FALSE) AS trashed, o_orderdate AS modified FROM orders"


@query("document_listing", f"SELECT file_id FROM ({_LISTED}) WHERE r = 1 ORDER BY modified DESC, name, file_id LIMIT 50")
def document_listing(spark, sf_dir):
    return folders.documents(_files_listed(spark, sf_dir), 500).select("file_id")


@query("folder_children_page", f"SELECT file_id FROM ({_LISTED}) WHERE parent_id = 'f7' AND NOT trashed AND (r, k) > (1, 200) ORDER BY r, k LIMIT 50")
def folder_children_page(spark, sf_dir):
    after = (1, "order 0000000003200", "o200")
    return folders.children_page(_files_listed(spark, sf_dir), "f7", after, 60).select("file_id")


@query("shared_drives", "SELECT c_custkey, concat('d', c_custkey) AS id, c_name AS name FROM customer WHERE c_custkey % 5 IN (0, 1) UNION ALL SELECT c_custkey, CAST(c_custkey AS STRING), c_name FROM customer WHERE c_custkey % 5 = 2")
def shared_drives(spark, sf_dir):
    body = F.expr("concat('{\"name\":\"', c_name, '\"', CASE c_custkey % 5 WHEN 2 THEN concat(',\"id\":', c_custkey) WHEN 3 THEN ',\"id\":{\"x\":1}' WHEN 4 THEN ',\"id\":null' ELSE concat(',\"id\":\"d', c_custkey, '\"') END, '}')")
    return folders.drives(table(spark, sf_dir, "customer").select("c_custkey", body.alias("body")))


@query("file_metadata", "SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 1) THEN 'bad_metadata' WHEN o_orderkey % 6 = 2 THEN 'not_document' END AS error FROM orders")
def file_metadata(spark, sf_dir):
    body = F.expr("CASE o_orderkey % 6 WHEN 0 THEN '[1]' ELSE concat('{\"id\":\"', o_orderkey, '\",\"name\":\"n\",\"mimeType\":\"', CASE o_orderkey % 6 WHEN 2 THEN 'image/png' ELSE 'application/vnd.google-apps.document' END, '\",\"modifiedTime\":\"t\",\"version\":', CASE o_orderkey % 6 WHEN 1 THEN 'null' ELSE '7' END, '}') END")
    return folders.metadata(table(spark, sf_dir, "orders").select("o_orderkey", body.alias("body"))).select("o_orderkey", "error")


# Watches.


@query("watch_same_members", "SELECT user_id, list_sort(list(event_id % 7)) = list_sort(list((event_id + CASE WHEN user_id % 2 = 0 THEN 7 ELSE 1 END) % 7)) AS same FROM events GROUP BY user_id")
def watch_same_members(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.expr("event_id % 7")).alias("a"), F.collect_list(F.expr("(event_id + CASE WHEN user_id % 2 = 0 THEN 7 ELSE 1 END) % 7")).alias("b"))
    return rows.select("user_id", folders.same_members(F.col("a"), F.col("b")).alias("same"))


@query("watch_retry", "SELECT c_custkey, concat_ws(',', 'a' || c_custkey % 3, 'b', CASE WHEN c_custkey % 3 <> 2 THEN 'a2' END, 'c') AS files FROM customer")
def watch_retry(spark, sf_dir):
    pending = F.array(F.expr("concat('a', c_custkey % 3)"), F.lit("b"), F.lit("b"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(watches.retry(pending, F.array(F.lit("a2"), F.lit("c"))), ",").alias("files"))


@query("watch_schedule", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' WHEN 2 THEN 'off' ELSE 'weekly' END AS every FROM customer")
def watch_schedule(spark, sf_dir):
    own = F.expr("CASE c_custkey % 4 WHEN 0 THEN 'daily' WHEN 1 THEN 'site' WHEN 2 THEN 'sometimes' END")
    return table(spark, sf_dir, "customer").select("c_custkey", rules.interval(own, F.lit("weekly")).alias("every"))


_STORED = "SELECT c_nationkey AS site, concat('w', c_custkey) AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS pos, 'old' AS payload FROM customer QUALIFY pos <= 6"
_CHANGED = "SELECT s_nationkey AS site, concat('N', s_suppkey) AS id, s_suppkey AS seq, 'new' AS payload FROM supplier UNION ALL SELECT c_nationkey, concat('w', c_custkey), c_custkey, 'changed' FROM customer WHERE c_custkey % 2 = 0"


def _stored_watches(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("site"), F.expr("concat('w', c_custkey)").alias("id"), F.row_number().over(order).alias("pos"), F.lit("old").alias("payload"))
    return rows.filter("pos <= 6")


def _watch_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("site"), F.expr("concat('N', s_suppkey, '!')").alias("id"), F.col("s_suppkey").alias("seq"), F.lit("new").alias("payload"))
    return new.union(table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select("c_nationkey", F.expr("concat('w', c_custkey)"), "c_custkey", F.lit("changed")))


@query("watch_save", f"WITH s AS ({_STORED}), c AS (SELECT site, lower(id) AS id, seq, payload FROM ({_CHANGED})), b AS (SELECT site, id, s.pos AS old, c.seq, coalesce(c.payload, s.payload) AS payload FROM s FULL JOIN c USING (site, id)), r AS (SELECT site, id, payload, row_number() OVER (PARTITION BY site ORDER BY old NULLS LAST, seq, id) AS pos FROM b) SELECT * FROM r WHERE pos <= 10")
def watch_save(spark, sf_dir):
    return watches.save(_stored_watches(spark, sf_dir), _watch_changes(spark, sf_dir))


@query("watch_refused", f"WITH s AS ({_STORED}), c AS ({_CHANGED}), b AS (SELECT c.site, c.id, s.pos AS old, c.seq, lower(c.id) AS low FROM c LEFT JOIN s ON c.site = s.site AND lower(c.id) = s.id), n AS (SELECT site, count(*) AS held FROM s GROUP BY site), f AS (SELECT site, id, row_number() OVER (PARTITION BY site ORDER BY seq, low) + coalesce(held, 0) AS pos FROM b LEFT JOIN n USING (site) WHERE old IS NULL) SELECT site, CASE WHEN id LIKE 'N%' THEN id || '!' ELSE id END AS id FROM f WHERE pos > 10")
def watch_refused(spark, sf_dir):
    return watches.refused(_stored_watches(spark, sf_dir), _watch_changes(spark, sf_dir))


@query("watch_access", "WITH u AS (SELECT c_custkey - 1 AS user_id, c_custkey % 500 = 7 AS admin, c_mktsegment AS t FROM customer), w AS (SELECT s_suppkey AS watch_id, s_suppkey % 20 AS owner_id, CASE WHEN s_suppkey % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS t FROM supplier) SELECT user_id, watch_id FROM u, w WHERE user_id > 0 AND (admin OR owner_id = user_id AND u.t = w.t)")
def watch_access(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(F.expr("c_custkey - 1").alias("user_id"), F.expr("c_custkey % 500 = 7").alias("admin"), F.array("c_mktsegment").alias("post_types"))
    found = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("watch_id"), F.expr("s_suppkey % 20").alias("owner_id"), F.expr("CASE WHEN s_suppkey % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END").alias("post_type"))
    return watches.accessible(found, users)


_SCAN = _WATCH + """, linked AS (SELECT DISTINCT file_id FROM done WHERE file_id % 3 = 0), had AS (SELECT watch_id, file_id, min(pos) AS pos FROM pending GROUP BY 1, 2),
fresh AS (SELECT watch_id, file_id, min(pos) AS pos FROM scope WHERE file_id % 13 <> 0 AND (watch_id, file_id) NOT IN (SELECT watch_id, file_id FROM excluded) AND (watch_id, file_id) NOT IN (SELECT watch_id, file_id FROM had) AND file_id NOT IN (SELECT file_id FROM linked) GROUP BY 1, 2),
both_ AS (SELECT *, 0 AS part FROM had UNION ALL SELECT *, 1 FROM fresh)
"""


def _scanned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pending, scope, excluded, done = _watch_parts(spark, sf_dir)
    had = pending.groupBy("watch_id", "file_id").agg(F.min("pos").alias("pos"))
    every = scope.select("watch_id").distinct().withColumn("total", F.col("watch_id") * 10)
    return watches.scan(every, scope.withColumn("selectable", F.expr("CASE WHEN file_id % 13 = 0 THEN FALSE END")).withColumn("file_id", F.col("file_id")), had, excluded, done.filter("file_id % 3 = 0"))


@query("watch_scan", _SCAN + "SELECT watch_id, file_id, row_number() OVER (PARTITION BY watch_id ORDER BY part, pos, file_id) AS pos FROM both_")
def watch_scan(spark, sf_dir):
    return _scanned(spark, sf_dir)[0]


@query("watch_scan_totals", _SCAN + "SELECT watch_id, watch_id * 10 + count(*) FILTER (part = 1) AS total, count(*) FILTER (part = 1) AS added, CASE WHEN count(part) > 0 THEN 'importing' ELSE 'watching' END AS status FROM (SELECT DISTINCT watch_id FROM scope) LEFT JOIN both_ USING (watch_id) GROUP BY watch_id")
def watch_scan_totals(spark, sf_dir):
    return _scanned(spark, sf_dir)[1]


def _import_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("watch_id"), F.col("o_orderkey").alias("file_id"), F.col("o_orderkey").alias("pos"))
    return files, files.select("watch_id", "file_id", F.expr("CASE WHEN file_id % 11 = 0 THEN 'access_denied' WHEN file_id % 4 = 0 THEN 'too_large' END").alias("code"))


_IMPORT = """WITH f AS (SELECT o_custkey AS watch_id, o_orderkey AS file_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'access_denied' WHEN o_orderkey % 4 = 0 THEN 'too_large' END AS code FROM orders),
s AS (SELECT *, coalesce(min(CASE WHEN k <= 5 AND code = 'access_denied' THEN k END) OVER (PARTITION BY watch_id), 6) AS stop FROM f),
d AS (SELECT watch_id, file_id, k, stop, CASE WHEN k >= stop THEN 'pending' WHEN code IS NULL THEN 'imported' ELSE 'failed' END AS state, CASE WHEN k < stop THEN code END AS code FROM s)
"""


@query("watch_import", _IMPORT + "SELECT watch_id, file_id, state, code, CASE WHEN state = 'pending' THEN k - stop + 1 END AS pos FROM d")
def watch_import(spark, sf_dir):
    return watches.import_batch(*_import_parts(spark, sf_dir)).drop("stopped")


@query("watch_after_import", _IMPORT + "SELECT watch_id, count(*) FILTER (state = 'imported') + 3 AS imported, CASE WHEN min(stop) <= 5 THEN 'error' WHEN bool_or(state = 'pending') THEN 'importing' ELSE 'watching' END AS status FROM d GROUP BY watch_id")
def watch_after_import(spark, sf_dir):
    files, outcomes = _import_parts(spark, sf_dir)
    every = files.select("watch_id").distinct().withColumn("imported", F.lit(3))
    return watches.after_batch(every, watches.import_batch(files, outcomes))


# Progress and writes.


@query("step_progress", "SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN 0 WHEN 1 THEN 10 WHEN 2 THEN 25 WHEN 3 THEN 35 WHEN 4 THEN 55 WHEN 5 THEN 55 + CAST(floor(14 * (o_orderkey % 8) / 7) AS INT) WHEN 6 THEN 70 WHEN 7 THEN 90 WHEN 8 THEN 100 END AS progress FROM orders")
def step_progress(spark, sf_dir):
    step = F.get(F.array(*[F.lit(s) for s in (*rules.STEPS, "unknown")]), F.expr("CAST(o_orderkey % 10 AS INT)"))
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.step_progress(step, F.expr("o_orderkey % 8"), F.lit(7)).alias("progress"))


@query("document_errors", "SELECT event_id, CASE WHEN user_id % 5 IN (0, 4) THEN 'transient_failure' WHEN user_id % 5 = 1 AND event_type = 'view' THEN 'api_unavailable' WHEN user_id % 5 IN (1, 2) THEN 'access_denied' ELSE 'bad_response' END AS error FROM events")
def document_errors(spark, sf_dir):
    status = F.expr("CASE user_id % 5 WHEN 0 THEN 429 WHEN 1 THEN 403 WHEN 2 THEN 404 WHEN 3 THEN 400 ELSE 503 END")
    return table(spark, sf_dir, "events").select("event_id", rules.document_error(status, F.expr("CASE WHEN event_type = 'view' THEN 'API Has Not Been Used before' END")).alias("error"))


@query("still_current", SRC + "SELECT post_id, CASE WHEN post_id % 4 = 0 OR post_id % 5 = 0 THEN 'source_changed' END AS error FROM linked")
def still_current(spark, sf_dir):
    rows = catalog.linked(source_table(spark, sf_dir))
    now = rows.filter("post_id % 5 <> 0").withColumn("file_id", F.expr("CASE WHEN post_id % 4 = 0 THEN concat(file_id, 'x') ELSE file_id END"))
    return changes.still_current(rows.select("post_id", "file_id"), now).select("post_id", "error")


@query("post_writes", "SELECT doc_id AS post_id, source AS title, CASE WHEN doc_id % 3 = 0 THEN concat('new ', doc_id) ELSE lang END AS content, 'publish' AS status FROM documents UNION ALL SELECT doc_id + 100000000, 'draft', 'text', CASE WHEN doc_id % 4 = 0 THEN 'publish' ELSE 'draft' END FROM documents WHERE doc_id % 2 = 0")
def post_writes(spark, sf_dir):
    posts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("post_id"), F.col("source").alias("title"), F.col("lang").alias("content"), F.lit("publish").alias("status"))
    updates = posts.filter("post_id % 3 = 0").select("post_id", F.expr("concat('new ', post_id)").alias("content"))
    drafts = posts.select(F.expr("CASE WHEN post_id % 2 = 0 THEN post_id + 100000000 ELSE post_id END").alias("post_id"), F.lit("draft").alias("title"), F.lit("text").alias("content"), F.expr("CASE WHEN post_id % 4 = 0 THEN 'publish' ELSE 'trash' END").alias("status"))
    return documents.write_posts(posts, updates, drafts)


@query("plain_strings", "SELECT doc_id, substring(regexp_replace(regexp_replace(replace(concat('  x', text), chr(7), ''), '^\\s+', ''), '\\s+$', ''), 1, 300) AS plain FROM documents")
def plain_strings(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.normalized(F.concat(F.lit(" \u0007 x\u200b"), "text"), 300).alias("plain"))


# Documents of known shape: SQL states what they become.

_PAGES = "SELECT o_orderkey AS page_id, o_orderstatus AS s, o_orderpriority AS p, o_orderkey % 3 AS k FROM orders"
_HTML = "concat('<div class=\"page\"><h1>Order ', page_id, '</h1><p>State <b>', s, '</b> &amp; more.</p><p>npm install ', page_id, '</p><p>  --save=', s, '</p><script>x</script><ul><li>', p, '<li>two</ul>', CASE WHEN k = 1 THEN '<p>```</p><p>a < b</p><p></p><p>```</p>' WHEN k = 2 THEN '<p>```</p><p>open</p>' ELSE '<p class=\"note\">Note: short</p>' END, '<hr></div>')"
_BLOCK = "concat('<!-- wp:paragraph --><p>', {}, '</p><!-- /wp:paragraph -->')"
_CODE = "concat('<!-- wp:code --><pre class=\"wp-block-code\"><code>', {}, '</code></pre><!-- /wp:code -->')"
_RENDERED = (
    "concat('<!-- wp:heading {\"level\":1} --><h1>Order ', page_id, '</h1><!-- /wp:heading -->', " + _BLOCK.format("'State ' || s || ' &amp; more.'") + ", " + _CODE.format("'npm install ' || page_id || chr(10) || '  --save=' || s")
    + ", '<!-- wp:list --><ul class=\"wp-block-list\"><!-- wp:list-item --><li>', p, '</li><!-- /wp:list-item --><!-- wp:list-item --><li>two</li><!-- /wp:list-item --></ul><!-- /wp:list -->', CASE WHEN k = 1 THEN "
    + _CODE.format("'a &lt; b'") + " WHEN k = 2 THEN " + _BLOCK.format("'```'") + " || " + _BLOCK.format("'open'")
    + " ELSE '<!-- wp:quote {\"className\":\"doc-callout\"} --><blockquote class=\"wp-block-quote doc-callout\"><p>Note: short</p></blockquote><!-- /wp:quote -->' END, '<!-- wp:separator --><hr class=\"wp-block-separator has-alpha-channel-opacity\"/><!-- /wp:separator -->')"
)


def _known_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"), F.expr("o_orderkey % 3").alias("k"))
    return rows.select("page_id", F.expr(_HTML).alias("html"))


@query("known_pages_rendered", f"SELECT page_id, {_RENDERED} AS content FROM ({_PAGES})")
def known_pages_rendered(spark, sf_dir):
    return documents.rendered(_known_pages(spark, sf_dir), preset="documentation").select("page_id", "content")


_KINDS = "CASE k WHEN 1 THEN ['heading', 'paragraph', 'code', 'list', 'code', 'separator'] WHEN 2 THEN ['heading', 'paragraph', 'code', 'list', 'paragraph', 'paragraph', 'separator'] ELSE ['heading', 'paragraph', 'code', 'list', 'quote', 'separator'] END"


@query("known_pages_blocks", f"SELECT page_id, CAST(generate_subscripts({_KINDS}, 1) - 1 AS INT) AS pos, unnest({_KINDS}) AS name FROM ({_PAGES})")
def known_pages_blocks(spark, sf_dir):
    return documents.blocks(_known_pages(spark, sf_dir), preset="documentation", whole=False).select("page_id", "pos", "name")


@query("known_code_runs", "SELECT o_orderkey AS doc_id, 1 AS first_line, 2 AS last_line, 'lines' AS kind, 'git pull ' || o_orderkey || chr(10) || 'const x = 1' AS code FROM orders UNION ALL SELECT o_orderkey, 4, 7, 'fenced', o_orderstatus FROM orders WHERE o_orderkey % 2 = 0")
def known_code_runs(spark, sf_dir):
    text = F.expr("concat('Words.\\ngit pull ', o_orderkey, '  \\nconst x = 1\\nMore words.\\n', CASE WHEN o_orderkey % 2 = 0 THEN concat('```\\n', o_orderstatus, '\\n\\n~~~\\nEnd.') ELSE '```' END)")
    return documents.code_runs(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text")))


def _hero_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.expr("concat('<p>before</p>', CASE WHEN o_orderkey % 2 = 0 THEN concat('<h1>T', o_orderkey, '</h1>') ELSE '' END, '<p><img src=\"i.png\"></p><p></p><p>lead</p><h3>S</h3><ul><li>x</li></ul>')")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), html.alias("html"))


_HEROES = "CASE WHEN o_orderkey % 2 = 0 THEN [1, 0, 0, 1, 0, 2, 2] ELSE [0, 0, 0, 0, 1, 1] END"


@query("known_heroes", "SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 2 = 0 THEN 1 END AS heading_pos, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS image_pos, CASE WHEN o_orderkey % 2 = 0 THEN 4 END AS text_pos, o_orderkey % 2 = 0 AS hero FROM orders")
def known_heroes(spark, sf_dir):
    return documents.heroes(documents.blocks(_hero_pages(spark, sf_dir), whole=False), "page_id")


@query("known_hero_groups", f'SELECT o_orderkey AS page_id, CAST(generate_subscripts({_HEROES}, 1) - 1 AS INT) AS pos, unnest({_HEROES}) AS "group" FROM orders')
def known_hero_groups(spark, sf_dir):
    return documents.grouped(documents.blocks(_hero_pages(spark, sf_dir), whole=False), "page_id").select("page_id", "pos", "group")


_ID = "substring(sha256(concat('layout:', o_orderkey, ':', {})), 1, 8)"


def _node(number: int, kind: str, settings: str) -> str:
    return f"""'{{"id":"' || {_ID.format(number)} || '","elType":"widget","widgetType":"{kind}","isInner":false,"settings":{{' || {settings} || '}},"elements":[]}}'"""


@query("known_widget_trees", "SELECT o_orderkey AS page_id, '[{\"id\":\"' || " + _ID.format(4) + " || '\",\"elType\":\"container\",\"isInner\":false,\"style\":\"hero\",\"elements\":[' || " + _node(1, "heading", "'\"title\":\"T' || o_orderkey || '\",\"header_size\":\"h2\"'") + " || ',' || " + _node(2, "text-editor", "'\"editor\":\"<p>lead</p>\"'") + " || ']},{\"id\":\"' || " + _ID.format(5) + " || '\",\"elType\":\"container\",\"isInner\":false,\"style\":\"feature\",\"elements\":[' || " + _node(3, "divider", "''") + " || ']}]' AS tree FROM orders")
def known_widget_trees(spark, sf_dir):
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), F.expr("concat('<h2>T', o_orderkey, '</h2><p>lead</p><hr>')").alias("html"))
    return documents.widget_tree(documents.blocks(pages), "page_id")


@query("widget_attributes", "SELECT doc_id, 'layout_data' AS meta_key, concat('[', doc_id, ']') AS meta_value FROM documents UNION ALL SELECT doc_id, 'layout_mode', 'builder' FROM documents UNION ALL SELECT doc_id, 'title', source FROM documents")
def widget_attributes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    pair = lambda k, v: docs.select("doc_id", F.lit(k).alias("meta_key"), v.alias("meta_value"))
    old = pair("layout_data", F.lit("old")).union(pair("layout_styles", F.lit("css"))).union(pair("title", F.col("source")))
    return documents.widget_attributes(docs.select("doc_id", F.expr("concat('[', doc_id, ']')").alias("tree")), "doc_id", old)


# Exports.


@query("run_styles", "WITH r AS (SELECT o_orderkey AS k, 'A<b>' || o_orderkey AS c FROM orders), h AS (SELECT k, '' || replace(replace(c, '<', '&lt;'), '>', '&gt;') || '<br>' || chr(10) || '&quot;' AS h FROM r), b AS (SELECT k, CASE WHEN k % 2 = 0 THEN '<strong>' || h || '</strong>' ELSE h END AS h FROM h), i AS (SELECT k, CASE WHEN k % 3 = 0 THEN '<em>' || h || '</em>' ELSE h END AS h FROM b), u AS (SELECT k, CASE WHEN k % 5 = 0 THEN '<u>' || h || '</u>' ELSE h END AS h FROM i) SELECT k AS o_orderkey, CASE WHEN k % 7 = 0 THEN '<a href=\"https://host/?a=1&#038;b=2\">' || h || '</a>' ELSE h END AS html FROM u")
def run_styles(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    content = F.concat(F.lit("A<b>"), F.col("o_orderkey").cast("string"), F.lit('\n"\n'))
    url = F.expr("CASE WHEN o_orderkey % 7 = 0 THEN 'https://host/?a=1&b=2' END")
    return rows.select("o_orderkey", exports.styled(content, F.expr("o_orderkey % 2 = 0"), F.expr("o_orderkey % 3 = 0"), F.expr("o_orderkey % 5 = 0"), url).alias("html"))


_LINE = """concat('{{"paragraph":{{"elements":[{{"textRun":{{"content":"', {}, '\\n"}}}}]}}}}')"""


@query("element_counts", "SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 1 END AS INT) AS n FROM orders")
def element_counts(spark, sf_dir):
    body = '"body":{"content":[{"a":1},{"b":2}]}'
    tree = F.expr("CASE o_orderkey % 4 WHEN 0 THEN '{\"body\":{\"content\":[]}}' WHEN 1 THEN '{" + body + "}' WHEN 2 THEN '{\"tabs\":[{\"documentTab\":{" + body + "},\"childTabs\":[{\"documentTab\":{" + body + "}}]}]," + body + "}' ELSE 'no json' END")
    return table(spark, sf_dir, "orders").select("o_orderkey", exports.element_count(tree).alias("n"))


@query("tree_paragraphs", "SELECT o_orderkey AS doc_id, 0 AS pos, 't1' AS tab, 0 AS depth, o_orderpriority AS text, '' AS objects FROM orders UNION ALL SELECT o_orderkey, 1, 't2', 1, o_orderstatus, '<img src=\"i?' || o_orderkey || '\" alt=\"A\">' FROM orders")
def tree_paragraphs(spark, sf_dir):
    line = lambda value, more="": """'{"paragraph":{"elements":[{"textRun":{"content":"', """ + value + """, '\\\\n"}}""" + more + """]}}'"""
    picture = """,{"inlineObjectElement":{"inlineObjectId":"o1"}}"""
    tree = "concat('{\"tabs\":[{\"tabProperties\":{\"tabId\":\"t1\"},\"documentTab\":{\"body\":{\"content\":[', " + line("o_orderpriority") + ", ']}},\"childTabs\":[{\"tabProperties\":{\"tabId\":\"t2\"},\"documentTab\":{\"inlineObjects\":{\"o1\":{\"inlineObjectProperties\":{\"embeddedObject\":{\"title\":\"A\",\"imageProperties\":{\"contentUri\":\"i?', o_orderkey, '\"}}}}},\"body\":{\"content\":[', " + line("o_orderstatus", picture) + ", ']}}}]}]}')"
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(tree).alias("document"))
    return exports.paragraphs(rows).select("doc_id", "pos", "tab", "depth", "text", "objects")


@query("package_pages", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'a/INDEX.html' ELSE 'b.htm' END AS entry, html, CAST(NULL AS STRING) AS error FROM pages WHERE page_id % 4 <> 3 UNION ALL SELECT page_id, NULL, NULL, CASE WHEN page_id % 8 = 3 THEN 'no_page' ELSE 'bad_package' END FROM pages WHERE page_id % 4 = 3")
def package_pages(spark, sf_dir):
    @F.pandas_udf("binary")
    def packed(ids: pd.Series, pages: pd.Series) -> pd.Series:
        import io
        import zipfile

        def one(k: int, html: str) -> bytes:
            data = io.BytesIO()
            with zipfile.ZipFile(data, "w") as package:
                package.writestr("../index.html", "outside")
                package.writestr("t.txt", "text")
                if k % 4 != 3:
                    package.writestr("b.htm", "other" if k % 3 == 0 else html)
                    if k % 3 == 0:
                        package.writestr("a/INDEX.html", html)
            return data.getvalue() if k % 8 != 7 else b"no package"

        return pd.Series([one(k, h or "") for k, h in zip(ids, pages, strict=True)])

    rows = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), packed("page_id", "html").alias("content"))
    found = exports.package_pages(rows.withColumn("length", F.length("content").cast("long")))
    return found.select(F.col("path").cast("long").alias("page_id"), "entry", "html", "error")


# Stored sources: defaults, sanitising, updates; streams with attributes.

_RAW = "CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'Expor-ting!' END"


@query("source_progress", "WITH s AS (SELECT doc_id AS post_id, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'synced' ELSE 'error' END AS status FROM documents), t AS (SELECT *, CASE WHEN post_id % 4 = 1 THEN 'expor-ting' WHEN status = '' THEN 'linked' ELSE status END AS step FROM s) SELECT post_id, step, CASE WHEN post_id % 5 = 0 THEN 'Half done authorization=[redacted]' WHEN step = 'linked' THEN 'Linked and ready to sync.' ELSE '' END AS message, CAST(CASE WHEN post_id % 7 = 0 THEN 100 WHEN post_id % 7 = 1 THEN 0 WHEN status = 'synced' THEN 100 ELSE 0 END AS INT) AS progress FROM t")
def source_progress(spark, sf_dir):
    status = F.expr("CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'synced' ELSE 'error' END").alias("status")
    message = F.expr("CASE doc_id % 5 WHEN 0 THEN 'Half <b>done</b>\nauthorization: abc' WHEN 1 THEN '' END").alias("message")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("post_id"), status, F.expr(_RAW).alias("step"), message, F.expr("CASE doc_id % 7 WHEN 0 THEN '140' WHEN 1 THEN 'none' END").alias("progress"))
    return catalog.with_progress(rows).select("post_id", "step", "message", "progress")


@query("source_sanitized", "SELECT doc_id AS post_id, CASE WHEN doc_id % 2 = 0 THEN 'synced' ELSE '' END AS status, CASE WHEN doc_id % 3 = 0 THEN 'linked' ELSE 'converting' END AS step, substring(trim('Error ' || repeat('x', CAST(doc_id % 700 AS INT))), 1, 500) AS error, CAST(least(100, doc_id % 130) AS INT) AS progress FROM documents")
def source_sanitized(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("post_id"), F.expr("CASE WHEN doc_id % 2 = 0 THEN ' Synced! ' END").alias("status"), F.expr("CASE WHEN doc_id % 3 <> 0 THEN 'Converting.' END").alias("step"), F.expr("concat('<p>Error\n\n', repeat('x', CAST(doc_id % 700 AS INT)), '</p>')").alias("error"), F.expr("CAST(doc_id % 130 AS INT)").alias("progress"))
    return catalog.sanitized(rows)


@query("source_update", SRC + "SELECT post_id, CASE WHEN post_id % 3 = 0 THEN 'queued' ELSE status END AS status, layout_preset FROM sources")
def source_update(spark, sf_dir):
    rows = source_table(spark, sf_dir).select("post_id", "status", "layout_preset")
    new = rows.filter("post_id % 3 = 0").select("post_id", F.lit("queued").alias("status")).union(rows.select(F.expr("-1 - post_id"), F.lit("unknown")))
    return catalog.update(rows, new, "post_id")


@query("stream_site_attributes", f"SELECT site, version, {T.format('last_seen')} AS last_seen, checkin_count FROM ({SITES})")
def stream_site_attributes(spark, sf_dir):
    rows = _stream(spark, sf_dir).select(F.col("user_id").alias("site"), F.col("event_type").alias("version"), "ts", "event_id")
    found = state.drained(state.stream_upsert(rows, "site", "ts", ("version",), ("event_id",)), "complete")
    return found.select("site", "version", _time("last_seen").alias("last_seen"), "checkin_count")


# More of what the first queries only touch: the order of an inventory, secrets of many forms.

_RANKED = f"""WITH RECURSIVE tree AS ({TREE_SQL}),
items AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY CASE item_type WHEN 'folder' THEN 0 ELSE 1 END, CASE WHEN name LIKE 'NATION%' THEN CAST(substring(name, 8) AS BIGINT) WHEN name LIKE 'Order %' THEN CAST(substring(name, 7) AS BIGINT) END, name, file_id) AS k FROM tree),
walk AS (
  SELECT concat('r', r_regionkey) AS root_id, concat('r', r_regionkey) AS folder_id, 0 AS depth, CAST([] AS BIGINT[]) AS place FROM region
  UNION ALL
  SELECT root_id, file_id, depth + 1, list_append(place, k) FROM walk JOIN items ON parent_id = folder_id WHERE item_type = 'folder' AND depth < 3),
docs AS (SELECT root_id, file_id, depth, list_append(place, k) AS place FROM walk JOIN items ON parent_id = folder_id WHERE item_type = 'document' AND selectable)
"""


@query("folder_inventory_first", _RANKED + "SELECT * FROM (SELECT root_id, file_id, row_number() OVER (PARTITION BY root_id ORDER BY depth, place, file_id) AS position FROM docs) WHERE position <= 50")
def folder_inventory_first(spark, sf_dir):
    return folders.capped(folders.inventory(tree(spark, sf_dir), _roots(spark, sf_dir))).select("root_id", "file_id", "position")


_SECRETS = "CASE event_id % 6 WHEN 0 THEN concat('Authorization: bearer ', event_id, '.a_b~c+d/e=-') WHEN 1 THEN concat('ACCESS_TOKEN=', event_id, ';next') WHEN 2 THEN concat('client_secret :  ', event_id, ', refresh_token=z') WHEN 3 THEN concat('bearer', event_id) WHEN 4 THEN concat('token=', event_id) ELSE concat('Bearer  ', event_id, ' Bearer x authorization') END"


@query("redact_forms", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'authorization=[redacted] [redacted]' WHEN 1 THEN 'access_token=[redacted];next' WHEN 2 THEN 'client_secret=[redacted], refresh_token=[redacted]' WHEN 3 THEN concat('bearer', event_id) WHEN 4 THEN concat('token=', event_id) ELSE 'bearer [redacted] bearer [redacted] authorization' END AS redacted FROM events")
def redact_forms(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.lower(tx.redact(F.expr(_SECRETS))).alias("redacted"))
