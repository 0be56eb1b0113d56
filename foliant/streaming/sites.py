"""Check-ins of sites as a stream: upserts and retention in one state, which a written table follows."""

from __future__ import annotations

from typing import Any, NamedTuple

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from foliant.operators.telemetry import KEEP_DAYS
from foliant.sources.keyed_table import KeyedTable, overwrite
from foliant.streaming.in_order import InOrder

DAY = 86_400
SITES = "site long, version string, first_seen long, last_seen long, checkin_count long"


class Site(NamedTuple):
    version: str | None
    first_seen: int
    last_seen: int
    checkin_count: int


class Sites(InOrder):
    """A site's row, which goes when it hasn't been seen for so many days; a check-in after that makes a new one."""

    rows = "at long, seq long, version string"

    def __init__(self, days: int = KEEP_DAYS):
        self.keep = days * DAY

    def variables(self, handle: StatefulProcessorHandle) -> None:
        self.site = handle.getValueState("site", "version string, first_seen long, last_seen long, checkin_count long")

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        site = Site(initialState["version"], initialState["first_seen"], initialState["last_seen"], initialState["checkin_count"])
        self.save(site)
        self.rearm(site, None, timerValues.getCurrentWatermarkInMs())

    def load(self) -> Site | None:
        return Site(*self.site.get()) if self.site.exists() else None

    def save(self, site: Site | None) -> None:
        if site is None:
            self.site.clear()
        else:
            self.site.update(tuple(site))

    def due(self, site: Site | None) -> int | None:
        return None if site is None else site.last_seen + self.keep

    def pass_time(self, site: Site | None, now: int) -> tuple[Site | None, list]:
        return (None, [(site, True)]) if site and now >= site.last_seen + self.keep else (site, [])

    def move(self, site: Site | None, row: tuple) -> tuple[Site, list]:
        at, _, version = row
        site, gone = self.pass_time(site, at)
        new = Site(version, at, at, 1) if site is None else Site(version, site.first_seen, at, site.checkin_count + 1)
        return new, [*gone, (new, False)]

    def output(self, key: Any, told: tuple[Site, bool]) -> Row:
        site, gone = told
        return Row(site=key[0], version=site.version, first_seen=site.first_seen, last_seen=site.last_seen, checkin_count=site.checkin_count, gone=gone)


def site_states(checkins: DataFrame, days: int = KEEP_DAYS, late: str = "1 minute", stored: DataFrame | None = None) -> DataFrame:
    """A stream of the rows of sites after each check-in (site, ts, seq, version): SITES and gone, which is true where a site's row goes, days after its last one.

    stored: rows that were there before (SITES; batch), the stream's first state. The state holds sites seen within days alone. Check-ins of one second go by seq,
    then version; those without a site or a time are left out. Needs the RocksDB state store.
    """
    rows = checkins.filter("site IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    rows = rows.select(F.col("site").cast("long").alias("site"), "ts", F.unix_seconds("ts").alias("at"), F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq"), F.coalesce("version", F.lit("")).alias("version"))
    first = None if stored is None else stored.groupBy("site")
    return rows.groupBy("site").transformWithState(Sites(days), f"{SITES}, gone boolean", "Append", "EventTime", initialState=first)


def follow(states: DataFrame, table: KeyedTable, name: str, checkpoint: str) -> None:
    """Merges a stream of site_states into a table keyed by site until nothing is left to read: each site's last state, or none where it has gone. A batch that
    comes again changes nothing."""

    def merge(batch: DataFrame, epoch: int) -> None:
        # of one site the rows of a batch follow each other in time: a row that goes does so after its last check-in, and before the next one
        order = batch.withColumn("_turn", F.struct("last_seen", F.col("gone").cast("int"), "checkin_count"))
        overwrite(table, order, ["_turn"], name, epoch, deleted_if="gone")

    states.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start().awaitTermination()
