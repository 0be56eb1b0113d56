"""The progress of syncs as a stateful stream: reports in, one event for each legal change of step out."""

from __future__ import annotations

from typing import Any, NamedTuple

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from foliant.streaming.in_order import InOrder

#: How far each step is, and which may follow it; what isn't listed is refused. idle stands for linked, complete and error.
PERCENT = {"queued": 0, "checking_google": 10, "exporting": 25, "large_doc_fallback": 35, "importing": 55, "large_doc_partial_import": 55, "converting": 70, "updating_post": 90, "complete": 100}
FOLLOWS = {
    "idle": ("queued", "checking_google"),
    "queued": ("checking_google", "error"),
    "checking_google": ("exporting", "complete", "error"),
    "exporting": ("importing", "large_doc_fallback", "error"),
    "large_doc_fallback": ("importing", "error"),
    "importing": ("large_doc_partial_import", "converting", "error"),
    "large_doc_partial_import": ("large_doc_partial_import", "converting", "error"),
    "converting": ("updating_post", "complete", "error"),
    "updating_post": ("complete", "error"),
}
#: Steps whose completion finds nothing new, the most that a partial import reaches, and the seconds without a report after which a sync has stalled.
UNCHANGED, PARTIAL_MOST, STALE_SECONDS = ("checking_google", "converting"), 69, 600

EVENTS = "post_id long, n long, attempt long, at long, step string, status string, progress int, level string, code string"


class Run(NamedTuple):
    """Where a source is: its last event's number, attempt, step (idle where none is going on), highest progress of the attempt, and time of the last event."""

    n: int = 0
    attempt: int = 0
    step: str = "idle"
    progress: int = 0
    at: int = 0


class Report(NamedTuple):
    """A report of a step: seconds, order among those of one second, step, parts done and parts in all, code of an error."""

    at: int
    seq: int
    step: str
    done: int | None = None
    total: int | None = None
    code: str | None = None


def partial_progress(before: int, done: int | None, total: int | None) -> int:
    """How far a partial import is; it doesn't fall."""
    share = min(1.0, (done or 0) / max(1, total or 0))
    return max(before, min(PARTIAL_MOST, PERCENT["large_doc_partial_import"] + int(14 * max(0.0, share))))


def step_on(run: Run, report: Report) -> tuple[Run, tuple | None]:
    """The run after a report, and the event of the change; none where the report's step may not follow."""
    if report.step not in FOLLOWS[run.step]:
        return run, None
    begins = run.step == "idle"
    before = 0 if begins else run.progress
    if report.step == "error":
        progress, status, level = before, "error", "error"
    elif report.step == "complete":
        progress, status, level = 100, "skipped" if run.step in UNCHANGED else "synced", "info"
    else:
        partial = report.step == "large_doc_partial_import"
        progress = partial_progress(before, report.done, report.total) if partial else max(before, PERCENT[report.step])
        status, level = "syncing", "warning" if report.step == "large_doc_fallback" else "info"
    after = Run(run.n + 1, run.attempt + begins, report.step if status == "syncing" else "idle", progress, report.at)
    return after, (after.n, after.attempt, report.at, report.step, status, progress, level, report.code if status == "error" else None)


def stalled(run: Run, now: int, seconds: int = STALE_SECONDS) -> tuple[Run, tuple | None]:
    """The run after time has passed: a sync without an event for so many seconds ends in an error at that moment."""
    if run.step == "idle" or now < run.at + seconds:
        return run, None
    return step_on(run, Report(run.at + seconds, 0, "error", code="sync_stalled"))


class ProgressMachine(InOrder):
    """A source's run as three state variables, moved on by reports and by time."""

    rows = "at long, seq long, step string, done int, total int, code string"

    def __init__(self, seconds: int = STALE_SECONDS):
        self.seconds = seconds

    def variables(self, handle: StatefulProcessorHandle) -> None:
        self.step = handle.getValueState("step", "step string, attempt long, n long")
        self.highest = handle.getValueState("progress", "progress int")
        self.heartbeat = handle.getValueState("heartbeat", "at long")

    def load(self) -> Run:
        if not self.step.exists():
            return Run()
        step, attempt, n = self.step.get()
        return Run(n, attempt, step, self.highest.get()[0], self.heartbeat.get()[0])

    def save(self, run: Run) -> None:
        self.step.update((run.step, run.attempt, run.n))
        self.highest.update((run.progress,))
        self.heartbeat.update((run.at,))

    def due(self, run: Run) -> int | None:
        return None if run.step == "idle" else run.at + self.seconds

    def move(self, run: Run, row: tuple) -> tuple[Run, list[tuple]]:
        after, stall = stalled(run, row[0], self.seconds)
        after, event = step_on(after, Report(*row))
        return after, [e for e in (stall, event) if e]

    def pass_time(self, run: Run, now: int) -> tuple[Run, list[tuple]]:
        after, stall = stalled(run, now, self.seconds)
        return after, [stall] if stall else []

    def output(self, key: Any, event: tuple) -> Row:
        return Row(post_id=key[0], n=event[0], attempt=event[1], at=event[2], step=event[3], status=event[4], progress=event[5], level=event[6], code=event[7])


def progress_events(reports: DataFrame, late: str = "1 minute", seconds: int = STALE_SECONDS) -> DataFrame:
    """The events of a stream of reports (post_id, ts, seq, step, done, total, code): post_id, n (from 1), attempt, at (epoch seconds), step, status, progress, level, code.

    Reports of one second go by seq, then step. A step that may not follow the last one gives no event and is no sign of life. A sync that had no event for so many seconds
    ends in an error then. Reports may come late, as long as the watermark says; the events don't depend on how the stream is cut. Reports without a
    source, a time or a step are left out. Needs the RocksDB state store (with_states).
    """
    at = F.unix_seconds("ts")
    rows = reports.filter("post_id IS NOT NULL AND ts IS NOT NULL AND step IS NOT NULL").withWatermark("ts", late)
    rows = rows.select(F.col("post_id").cast("long").alias("post_id"), "ts", at.alias("at"), F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq"), "step", F.col("done").cast("int").alias("done"), F.col("total").cast("int").alias("total"), "code")
    return rows.groupBy("post_id").transformWithState(ProgressMachine(seconds), EVENTS, "Append", "EventTime")
