"""Folder watches over a written table: scans put new files in line, and a few of each watch are imported at each tick."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators import watches
from foliant.session import removed, written
from foliant.sources.keyed_table import KeyedTable

#: Rows of a watch's state, by kind: watch (total, imported, status), pending (file_id, pos), failed (file_id, pos: the tick, code) and excluded (file_id).
STATE = "watch_id string, kind string, file_id string, pos long, code string, total long, imported long, status string"
#: Files that a source links, with the tick and watch that imported them.
LINKED = "file_id string, watch_id string, tick long"


def tick(state: DataFrame, linked: DataFrame, listing: DataFrame, number: int, imports: Callable[[DataFrame], DataFrame], size: int = watches.BATCH) -> tuple[DataFrame, DataFrame]:
    """(the new state of the watches that listing has, the files imported: LINKED) after one tick: a scan and an import of up to size files of each of them.

    listing: watch_id, file_id, pos, selectable. imports(files) tries files (watch_id, file_id) and gives watch_id, file_id, code (null where it went well). Files
    that another source links by then count as imported. A hard failure keeps its file and all after it in line, and parks the watch until its next
    scan; others are noted, and the next scan that lists such a file puts it in line again.
    """
    key = ["watch_id", "file_id"]
    own = state.join(listing.select("watch_id").distinct(), "watch_id", "left_semi")
    of = lambda kind: own.filter(F.col("kind") == kind)
    known = listing.select("watch_id").distinct().join(of("watch").select("watch_id", "total", "imported"), "watch_id", "left").fillna(0, ["total", "imported"])
    before = linked.filter(F.col("tick") < number)
    line, scanned = watches.scan(known, listing, of("pending"), of("excluded"), before)
    line = written(line, "watch-line")
    first = line.filter(F.col("pos") <= size).select(*key)
    there = first.join(before.select("file_id").distinct(), "file_id", "left_semi").select(*key, F.lit(None).cast("string").alias("code"))
    tried = imports(first.join(there.select(*key), key, "left_anti")).select(*key, "code")
    files = written(watches.import_batch(line, there.union(tried), size), "watch-files")
    after = watches.after_batch(known.select("watch_id", "imported"), files).join(scanned.select("watch_id", "total"), "watch_id")
    none = lambda kind: F.lit(None).cast(kind)
    heads = after.select("watch_id", F.lit("watch").alias("kind"), none("string").alias("file_id"), none("long").alias("pos"), none("string").alias("code"), "total", "imported", "status")
    rest = lambda rows, kind, pos: rows.select("watch_id", F.lit(kind).alias("kind"), "file_id", pos.cast("long").alias("pos"), "code", none("long").alias("total"), none("long").alias("imported"), none("string").alias("status"))
    pending = rest(files.filter("state = 'pending'").withColumn("code", none("string")), "pending", F.col("pos"))
    failed = rest(files.filter("state = 'failed'"), "failed", F.lit(number))
    kept = own.filter("kind IN ('failed', 'excluded')").select(*heads.columns)
    imported = files.filter("state = 'imported'").groupBy("file_id").agg(F.min("watch_id").alias("watch_id")).join(before.select("file_id"), "file_id", "left_anti")
    return heads.unionByName(pending).unionByName(failed).unionByName(kept), imported.select("file_id", "watch_id", F.lit(number).cast("long").alias("tick"))


def run(listings: DataFrame, state: KeyedTable, linked: KeyedTable, imports: Callable[[DataFrame], DataFrame], checkpoint: str, name: str = "watches", size: int = watches.BATCH) -> None:
    """Runs a stream of listings (tick, watch_id, file_id, pos, selectable) until nothing is left to read, a tick after the other; a tick's listing comes in one file.

    state is keyed by watch_id, linked by file_id. What a tick imports is merged before the state is, and each tick is merged once, so that the tables are right after a batch that is
    killed anywhere and comes again, and don't depend on how many ticks a batch holds. imports may be called again then for the same files.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        for number in sorted(r[0] for r in batch.select("tick").distinct().collect()):
            if state.manifest().batches.get(name, -1) >= number:
                continue
            new, imported = tick(state.read(), linked.read(), batch.filter(F.col("tick") == number), number, imports, size)
            new, imported = written(new, "watch-state"), written(imported, "watch-imported")
            linked.merge(imported, lambda rows, more: rows.unionByName(more.join(rows.select("file_id"), "file_id", "left_anti").select(*rows.columns)), name, number)
            state.merge(new, lambda rows, more: rows.join(more.select("watch_id").distinct(), "watch_id", "left_anti").select(*more.columns).unionByName(more), name, number)
            for table in (new, imported):
                removed(table)
        batch.unpersist()

    listings.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start().awaitTermination()
