"""Folder watches: saving, access, scans for new files, batches of imports, retries and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import sanitize_key

#: Watches of a site, files of a batch, failures that stop a watch.
WATCHES, BATCH = 10, 5
HARD = ("reconnect_required", "credentials_missing", "access_denied", "forbidden")


def save(stored: DataFrame, changes: DataFrame, most: int = WATCHES) -> DataFrame:
    """The watches of each site after changes: site, id, pos (from 1), payload. stored: site, id, pos, payload; changes: site, id, seq, payload.

    A change replaces the watch of its id, where it stands, or is put at the end; of several for one id the last counts. Sites have at most so
    many watches: new ones beyond that are refused. Ids are sanitised, and changes without one are refused.
    """
    key = ["site", "id"]
    clean = lambda df: df.withColumn("id", sanitize_key(F.col("id"))).filter("id <> ''")
    new = clean(changes).groupBy(*key).agg(F.min("seq").alias("seq"), F.max_by("payload", "seq").alias("new"))
    both = clean(stored).join(new, key, "full")
    place = Window.partitionBy("site").orderBy(F.col("pos").asc_nulls_last(), "seq", "id")
    rows = both.withColumn("pos", F.row_number().over(place)).withColumn("_old", F.count("payload").over(Window.partitionBy("site")))
    return rows.filter(F.col("pos") <= F.greatest(F.lit(most), F.col("_old"))).select(*key, "pos", F.coalesce("new", "payload").alias("payload"))


def refused(stored: DataFrame, changes: DataFrame, most: int = WATCHES) -> DataFrame:
    """The changes (site, id) that save doesn't take."""
    kept = save(stored, changes, most).select("site", F.col("id").alias("_id"))
    return changes.join(kept, (changes.site == kept.site) & (sanitize_key(changes.id) == F.col("_id")), "left_anti").select("site", "id").distinct()


def accessible(watches: DataFrame, users: DataFrame) -> DataFrame:
    """Pairs (user_id, watch_id) of those who may use a watch: administrators, and owners who may use its post type.

    watches: watch_id, owner_id, post_type; users: user_id, admin, post_types (array). User 0 is nobody. Owners are met by id; administrators see all watches.
    """
    real = users.filter("user_id > 0")
    own = watches.join(real.filter(~F.coalesce("admin", F.lit(False))), F.col("owner_id") == F.col("user_id")).filter(F.array_contains("post_types", F.col("post_type")))
    every = real.filter("admin").select("user_id").crossJoin(watches.select("watch_id"))  # the answer itself: each administrator with each watch
    return own.select("user_id", "watch_id").union(every.select("user_id", "watch_id"))


def scan(watches: DataFrame, listing: DataFrame, pending: DataFrame, excluded: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pending files, watches) after a scan: watch_id, file_id, pos; watch_id, total, added, status.

    Files of the listing (watch_id, file_id, pos, selectable) that aren't excluded, pending or linked (sources: file_id) are put at the end in listing order,
    each once; total grows by how many they are; a watch with pending files is importing, else watching.
    """
    key = ["watch_id", "file_id"]
    fresh = listing.filter((F.col("file_id").cast("string") != "") & F.coalesce("selectable", F.lit(True))).groupBy(*key).agg(F.min("pos").alias("pos"))
    fresh = fresh.join(excluded.select(*key), key, "left_anti").join(pending.select(*key), key, "left_anti").join(sources.select("file_id"), "file_id", "left_anti")
    both = pending.select(*key, "pos", F.lit(0).alias("part")).unionByName(fresh.select(*key, "pos", F.lit(1).alias("part")))
    order = Window.partitionBy("watch_id").orderBy("part", "pos", "file_id")
    placed = both.select(*key, F.row_number().over(order).alias("pos"), "part")
    counts = placed.groupBy("watch_id").agg(F.sum("part").alias("added"), F.count("*").alias("n"))
    state = watches.join(counts, "watch_id", "left").fillna(0, ["added", "n"])
    state = state.select("watch_id", (F.col("total") + F.col("added")).alias("total"), "added", F.when(F.col("n") > 0, "importing").otherwise("watching").alias("status"))
    return placed.drop("part"), state


def import_batch(pending: DataFrame, outcomes: DataFrame, size: int = BATCH) -> DataFrame:
    """Pending files (watch_id, file_id, pos) after a batch of each watch: state (imported, failed, pending), code, pos (of those pending, from 1) and
    stopped (whether the file's failure ended the batch).

    outcomes: watch_id, file_id, code (null where the import went well). The first size files are tried in order. A hard failure ends the batch: its file and
    all after it stay pending; other failures are noted and the batch goes on. A file without an outcome stays pending, too.
    """
    key, order = ["watch_id", "file_id"], Window.partitionBy("watch_id").orderBy("pos", "file_id")
    ranked = pending.select(*key, "pos").withColumn("_k", F.row_number().over(order))
    tried = ranked.join(outcomes.select(*key, "code", F.lit(True).alias("_tried")), key, "left")
    in_batch = F.col("_k") <= max(1, size)
    stops = F.when(in_batch & (F.col("code").isin(*HARD) | F.col("_tried").isNull()), F.col("_k"))
    tried = tried.withColumn("_end", F.coalesce(F.min(stops).over(Window.partitionBy("watch_id")), F.lit(2**31 - 1)))
    handled = in_batch & (F.col("_k") < F.col("_end"))
    stopped = F.coalesce((F.col("_k") == F.col("_end")) & F.col("code").isin(*HARD), F.lit(False))
    rows = tried.withColumn("state", F.when(~handled, "pending").when(F.col("code").isNull(), "imported").otherwise("failed"))
    left = F.row_number().over(Window.partitionBy("watch_id", "state").orderBy("_k"))
    return rows.select(*key, "state", F.when(handled, F.col("code")).alias("code"), F.when(F.col("state") == "pending", left).alias("pos"), stopped.alias("stopped"))


def after_batch(watches: DataFrame, files: DataFrame) -> DataFrame:
    """Watches (watch_id, imported) after import_batch: imported grows, status is error where a hard failure stopped the batch, else importing or watching."""
    count = lambda c, n: F.count_if(c).alias(n)
    sums = files.groupBy("watch_id").agg(count(F.col("state") == "imported", "n"), count(F.col("state") == "pending", "left"), count(F.col("stopped"), "stopped"))
    found = watches.join(sums, "watch_id", "left").fillna(0, ["n", "left", "stopped"])
    status = F.when(F.col("stopped") == 1, "error").when(F.col("left") > 0, "importing").otherwise("watching")
    return found.select("watch_id", (F.col("imported") + F.col("n")).alias("imported"), status.alias("status"))


def retry(pending: Column, failed: Column) -> Column:
    """An array of pending files with those to try again behind them, each once."""
    return F.array_union(pending, failed)
