"""Event history: the newest of each source, filters, search, pages, clearing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import EVENT_FIELD, EVENT_MESSAGE, contains_any, diagnostic
from foliant.operators import catalog

#: Events kept for each source and shown on a page, levels, keys of the context.
KEPT, PAGE = 50, 50
LEVELS = ("info", "warning", "error")
SEARCHED = ("outputType", "layoutPreset", "mode", "widgetPreset")
CONTEXT = {"hasLock": "boolean", "hasCronEvent": "boolean", "lastHeartbeat": "string", "lastStep": "string", "outputType": "string", "layoutPreset": "string", "mode": "string", "widgetPreset": "string"}


def recent(events: DataFrame, key: str = "post_id", keep: int = KEPT) -> DataFrame:
    """The newest events of each key, with rank; a limit on the window's rank lets Spark drop rows before the shuffle."""
    order = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def prepend(history: DataFrame, new: DataFrame, keep: int = KEPT) -> DataFrame:
    """Arrays of events (post_id, events), newest first, after new ones (post_id, event) are put in front in the order of seq.

    The new ones are ranked before they are collected, so that no post gathers more than keep of them.
    """
    order = Window.partitionBy("post_id").orderBy(F.desc("seq"), F.desc("event"))
    ranked = new.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= max(keep, 1))
    fresh = ranked.groupBy("post_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("seq", "event")))).alias("_new"))
    both = history.join(fresh, "post_id", "full")
    added = F.coalesce(F.transform("_new", lambda x: x.event), F.array().cast("array<string>"))
    old = F.coalesce("events", F.array().cast("array<string>"))
    return both.select("post_id", F.slice(F.concat(added, old), 1, keep).alias("events"))


def sanitized(events: DataFrame) -> DataFrame:
    """Redacts, then cuts, the texts of events; progress is held within 0 and 100; levels that aren't known are info."""
    return events.withColumns({
        "level": F.when(F.col("level").isin(*LEVELS), F.col("level")).otherwise("info"),
        "post_title": diagnostic(F.col("post_title"), EVENT_FIELD),
        "message": diagnostic(F.col("message"), EVENT_MESSAGE),
        "progress": F.greatest(F.lit(0), F.least(F.lit(100), F.col("progress"))),
    })


def context(events: DataFrame, column: str = "props") -> DataFrame:
    """Adds context, a struct of the known keys of a JSON object; other keys are dropped."""
    schema = ", ".join(f"{k} {t}" for k, t in CONTEXT.items())
    return events.withColumn("context", F.from_json(column, schema))


def matching(events: DataFrame, level: str | None = None, status: str | None = None, step: str | None = None, search: str | None = None, posts: DataFrame | None = None) -> DataFrame:
    """Events of a level, status and step that contain a term in any field, where given; an unknown level is an error.

    A term is looked for in the title of the live post, too, where posts (post_id, live_title) are given, and in SEARCHED of a context, where there is one.
    """
    if level is not None and level not in LEVELS:
        raise ValueError(f"unsupported level: {level}")
    rows = events
    for name, value in (("level", level), ("status", status), ("step", step)):
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    if search:
        fields = [c for c in ("post_id", "post_title", "doc_title", "status", "step", "message", "error_code") if c in events.columns]
        found = [F.col(c) for c in fields] + ([F.col(f"context.{c}") for c in SEARCHED] if "context" in events.columns else [])
        if posts is None:
            return rows.filter(contains_any(found, search))
        rows = rows.join(posts.select("post_id", F.col("live_title").alias("_live")), "post_id", "left")
        return rows.filter(contains_any([*found, F.col("_live")], search)).drop("_live")
    return rows


def summary(events: DataFrame) -> DataFrame:
    """One row over events: total, errors, warnings, latest_id and latest (time) of the newest one."""
    newest = F.max_by(F.struct("event_id", "ts"), F.struct("ts", "event_id"))
    rows = events.agg(F.count("*").alias("total"), F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"), newest.alias("_n"))
    return rows.select("total", "errors", "warnings", F.col("_n.event_id").alias("latest_id"), F.col("_n.ts").alias("latest"))


def level_counts(events: DataFrame) -> DataFrame:
    """Events of each level, with the latest one's time."""
    return events.groupBy("level").agg(F.count("*").alias("n"), F.max("ts").alias("latest"))


def newest_first() -> list:
    return [F.desc("ts"), F.desc("event_id")]


def page(events: DataFrame, number: int = 1, size: int = PAGE) -> DataFrame:
    """A page of events, the newest first: PAGE of them unless asked otherwise, and no more than any page holds."""
    return catalog.page(events, newest_first(), number, size)


def titled(events: DataFrame, posts: DataFrame) -> DataFrame:
    """Events with a title: the stored one, else that of the live post (post_id, live_title)."""
    return events.join(posts, "post_id", "left").withColumn("title", F.coalesce(F.nullif("post_title", F.lit("")), "live_title", F.lit("")))


def clear(events: DataFrame, posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the events left, one row with cleared) after the events of posts (post_id) are removed."""
    gone = posts.select("post_id").distinct()
    return events.join(gone, "post_id", "left_anti"), events.join(gone, "post_id", "left_semi").agg(F.count("*").alias("cleared"))
