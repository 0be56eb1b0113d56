"""The catalog of linked documents: lookup, filters, order, paging, search, due sets, summaries, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.rules import health_rank, post_type_rank
from foliant.functions.text import ERROR_MESSAGE, PROGRESS_MESSAGE, blank_to_null, clamp, contains_any, redact, sanitize_key, sanitize_text, truncate

#: Statuses, page and summary limits.
STATUSES = ("linked", "queued", "syncing", "synced", "skipped", "error")
PAGE_MAX, SUMMARY_MAX = 100, 500
READY = "Linked and ready to sync."
BATCHES = {"cron": 20, "import": 5, "all": 20}


def linked(sources: DataFrame) -> DataFrame:
    """Sources with a document; a missing id is an empty string."""
    return sources.filter(F.col("file_id").isNotNull() & (F.col("file_id") != ""))


def visible(sources: DataFrame, grants: DataFrame, user: int, author: int = 0, types: tuple[str, ...] | None = None) -> DataFrame:
    """Sources that a user may edit, of an author where one is given (above 0), of the enabled post types. grants: user_id, post_type, scope (all, own)."""
    sources = sources.filter(F.col("post_author") == author) if author > 0 else sources
    sources = sources if types is None else sources.filter(F.col("post_type").isin(*types))
    own = grants.filter(F.col("user_id") == user).groupBy("post_type").agg(F.max(F.col("scope") == "all").alias("_all"))
    return sources.join(own, "post_type").filter(F.col("_all") | (F.col("post_author") == user)).drop("_all").select(sources.columns)


def filtered(sources: DataFrame, status: str | None = None, watch: str | None = None, search: str | None = None) -> DataFrame:
    """Sources of a status, a folder watch and a search term, where given; an unknown status is an error."""
    if status is not None and status not in STATUSES:
        raise ValueError(f"unsupported status: {status}")
    rows = linked(sources)
    if status is not None:
        rows = rows.filter(F.col("status") == status)
    if watch is not None:
        rows = rows.filter(F.col("folder_watch_id") == watch)
    if search:
        rows = rows.filter(contains_any([F.col(c) for c in ("post_title", "title", "file_id", "doc_url")], search))
    return rows


def search_ids(sources: DataFrame, term: str) -> DataFrame:
    """Ids found in the post or in the document's attributes, each once."""
    posts = linked(sources).filter(contains_any([F.col("post_title")], term)).select("post_id")
    meta = linked(sources).filter(contains_any([F.col(c) for c in ("title", "file_id", "doc_url")], term)).select("post_id")
    return posts.union(meta).distinct()


def by_health(sources: DataFrame) -> list[Column]:
    """Order: attention first, then syncing, then healthy; the newest first."""
    return [health_rank(F.col("status"), F.col("last_synced_at")), F.desc("post_modified"), F.desc("post_id")]


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = PAGE_MAX) -> DataFrame:
    """One page in order, with position (from 1) and has_more. Only the rows up to one after the page are sorted out."""
    size, number = max(1, min(size, PAGE_MAX)), max(1, number)
    first = (number - 1) * size
    top = rows.orderBy(*order).limit(first + size + 1)
    placed = top.withColumn("position", F.row_number().over(Window.orderBy(*order)))
    found = placed.filter(F.col("position") > first).withColumn("has_more", F.max("position").over(Window.partitionBy()) > first + size)
    return found.filter(F.col("position") <= first + size)


def page_after(rows: DataFrame, order: list[tuple[str, bool]], after: tuple | None, size: int = PAGE_MAX) -> DataFrame:
    """The page that follows a row, by its values of the order's columns (name, descending), which tell rows apart; null values come first either way.

    Only what follows is sorted, and no more than a page of each partition is kept, however deep the page is.
    """
    if after is not None:
        follows, same = F.lit(False), F.lit(True)
        for (name, descending), value in zip(order, after, strict=True):
            column, given = F.col(name), F.lit(value)
            beyond = column.isNotNull() if value is None else column < given if descending else column > given
            follows, same = follows | same & beyond, same & column.eqNullSafe(given)
        rows = rows.filter(F.coalesce(follows, F.lit(False)))
    return rows.orderBy(*[F.desc_nulls_first(n) if d else F.asc_nulls_first(n) for n, d in order]).limit(max(1, min(size, PAGE_MAX)))


def any_visible(sources: DataFrame, grants: DataFrame, user: int) -> DataFrame:
    """One row: whether a user may edit any linked source. The first one found ends the search."""
    return visible(linked(sources), grants, user).limit(1).agg((F.count("*") > 0).alias("found"))


def batch(sources: DataFrame, before: str, kind: str) -> DataFrame:
    """The due sources that one run of a kind (BATCHES) takes."""
    return due_page(sources, before, BATCHES[kind])


def ordered_types(types: DataFrame) -> DataFrame:
    """Distinct post types (post_type) with position: post, page, then by name. A row for each type."""
    order = Window.orderBy(post_type_rank(F.col("post_type")), "post_type")
    return types.select("post_type").distinct().withColumn("position", F.row_number().over(order))


def whitelisted(values: Column, keys: list[str]) -> Column:
    """The entries of a map whose keys are known."""
    return F.map_filter(values, lambda k, v: k.isin(*keys))


def summary(sources: DataFrame, most: int = SUMMARY_MAX) -> DataFrame:
    """One row: total, syncing, healthy, attention, activated, truncated, over the first sources by id."""
    rows = linked(sources).orderBy("post_id").limit(most + 1).withColumn("_n", F.row_number().over(Window.orderBy("post_id")))
    rank, used = health_rank(F.col("status"), F.col("last_synced_at")), F.col("_n") <= most
    count = lambda c: F.count_if(used & c).alias
    return rows.agg(
        count(F.lit(True))("total"), count(rank == 1)("syncing"), count(rank == 2)("healthy"), count(rank == 0)("attention"),
        F.coalesce(F.bool_or(used & (rank == 2)), F.lit(False)).alias("activated"), (F.count("*") > most).alias("truncated"),
    )


def due(sources: DataFrame, before: str, seen: DataFrame | None = None) -> DataFrame:
    """Sources last synced up to before, as strings (never synced is empty and always due), not syncing, and not in seen."""
    rows = linked(sources).filter((F.col("last_synced_at") <= before) & (F.col("status").isNull() | (F.col("status") != "syncing")))
    return rows if seen is None else rows.join(seen.select("post_id"), "post_id", "left_anti")


def due_order() -> list[Column]:
    return [F.asc("last_synced_at"), F.asc("post_modified"), F.asc("post_id")]


def due_page(sources: DataFrame, before: str, limit: int, seen: DataFrame | None = None) -> DataFrame:
    return due(sources, before, seen).orderBy(*due_order()).limit(max(1, min(limit, PAGE_MAX)))


def due_for_user(sources: DataFrame, grants: DataFrame, user: int, before: str, limit: int) -> DataFrame:
    """Due sources of a user: those of types it may edit wholly come first, its own of other types after; position in that order."""
    own = grants.filter(F.col("user_id") == user).groupBy("post_type").agg(F.max(F.col("scope") == "all").alias("_all"))
    rows = due(sources, before).join(own, "post_type").filter(F.col("_all") | (F.col("post_author") == user))
    order = [F.when(F.col("_all"), 0).otherwise(1), *due_order()]
    top = rows.orderBy(*order).limit(limit)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order))).drop("_all")


def with_file(sources: DataFrame, files: DataFrame) -> DataFrame:
    """The first source (by id) of each file of files (file_id)."""
    return linked(sources).join(files.select("file_id").distinct(), "file_id", "left_semi").groupBy("file_id").agg(F.min("post_id").alias("post_id"))


def without_source(files: DataFrame, sources: DataFrame) -> DataFrame:
    """Files that no source links."""
    return files.join(linked(sources).select("file_id"), "file_id", "left_anti")


def formatted(sources: DataFrame) -> DataFrame:
    """Rows for output: camelCase names, empty optional fields as null."""
    optional = {"last_method": "lastMethod", "layout_preset": "layoutPreset", "folder_watch_id": "folderWatchId"}
    plain = {"post_id": "postId", "post_title": "postTitle", "file_id": "fileId", "status": "status", "last_synced_at": "lastSyncedAt"}
    return sources.select(*[F.col(c).alias(n) for c, n in plain.items()], *[blank_to_null(F.col(c)).alias(n) for c, n in optional.items()])


def to_attributes(rows: DataFrame, key: str, names: list[str]) -> DataFrame:
    """One row for each attribute that isn't null: key, meta_key, meta_value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("meta_key"), F.col(n).cast("string").alias("meta_value")) for n in names]))
    return rows.select(key, pairs.alias("p")).select(key, "p.meta_key", "p.meta_value").filter("meta_value IS NOT NULL")


def from_attributes(attributes: DataFrame, key: str, names: list[str]) -> DataFrame:
    """One row for each key; a missing attribute is an empty string."""
    rows = attributes.filter(F.col("meta_key").isin(names)).groupBy(key)
    return rows.agg(*[F.coalesce(F.max(F.when(F.col("meta_key") == n, F.col("meta_value"))), F.lit("")).alias(n) for n in names])


def short_message(text: Column, length: int = PROGRESS_MESSAGE) -> Column:
    """A message as it is kept: without tags, then without secrets, then cut."""
    return truncate(redact(sanitize_text(text)), length)


def with_progress(rows: DataFrame) -> DataFrame:
    """Sources with step, message and progress (text) filled in where they are missing: the status, or linked, as the step; a message for linked
    ones; all of the way for finished ones, else none."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    step = F.when(sanitize_key(empty("step")) != "", sanitize_key(empty("step"))).when(empty("status") != "", sanitize_key(empty("status"))).otherwise("linked")
    given = F.when(F.col("progress").isNotNull(), clamp(F.coalesce(F.col("progress").try_cast("int"), F.lit(0)), 0, 100))
    found = rows.withColumn("progress", F.coalesce(given, F.when(F.col("status").isin("synced", "skipped"), 100).otherwise(0))).withColumn("step", step)
    return found.withColumn("message", F.when(empty("message") != "", short_message(F.col("message"))).when(F.col("step") == "linked", READY).otherwise(""))


def sanitized(changes: DataFrame) -> DataFrame:
    """Changes of sources as they are stored: keys are cleaned, messages shortened, progress held within 0 and 100; missing values get their defaults."""
    key = lambda c, default="": F.coalesce(sanitize_key(F.col(c)), F.lit(default))
    forms = {
        "status": key("status"), "step": key("step", "linked"), "folder_watch_id": key("folder_watch_id"), "error_code": key("error_code"),
        "error": F.coalesce(short_message(F.col("error"), ERROR_MESSAGE) if "error" in changes.columns else F.lit(""), F.lit("")),
        "message": F.coalesce(short_message(F.col("message")) if "message" in changes.columns else F.lit(READY), F.lit(READY)),
        "progress": clamp(F.coalesce(F.col("progress"), F.lit(0)), 0, 100),
    }
    return changes.withColumns({c: v for c, v in forms.items() if c in changes.columns})


def last_change(changes: DataFrame, key: str, order: str | None) -> DataFrame:
    """One change of each key: the last by a column, or of those that tie, or where none is named, the greatest row."""
    rest = [c for c in changes.columns if c != key]
    turn = F.struct(*([order] if order else []), *rest)
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), turn).alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def update(state: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows by key with the values of changes where there are any; changes of keys that aren't there are left out. Of several changes of a key the last by order counts."""
    changes = last_change(changes, key, order)
    new = changes.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in changes.columns if c != key])
    rows = state.join(new, F.col(key) == F.col("_key"), "left")
    return rows.select(*[F.coalesce(f"_{c}", c).alias(c) if c in changes.columns and c != key else c for c in state.columns])


def delete_attributes(attributes: DataFrame, keys: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Attributes without those names of those keys; names that aren't listed survive."""
    gone = keys.select(key).distinct().withColumn("_gone", F.lit(True))
    return attributes.join(gone, key, "left").filter(F.col("_gone").isNull() | ~F.col("meta_key").isin(names)).drop("_gone")


def merge(state: DataFrame, changes: DataFrame, key: str, optional: list[str], order: str | None = None) -> DataFrame:
    """Overwrites rows by key; a null in an optional column of the changes leaves the old value, an empty string removes it. Of several changes of a key the last by order counts."""
    changes = last_change(changes, key, order)
    new = changes.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in state.columns if c != key])
    both = state.join(new, F.col(key) == F.col("_key"), "full")
    changed = F.col("_key").isNotNull()
    value = lambda c: F.nullif(F.coalesce(F.col(f"_{c}"), F.col(c)), F.lit("")) if c in optional else F.when(changed, F.col(f"_{c}")).otherwise(F.col(c))
    return both.select(F.coalesce(key, "_key").alias(key), *[value(c).alias(c) for c in state.columns if c != key])
