"""Ordered decision rules as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed codes, levels and limits.
LARGE_BYTES = 8_388_608
STALE_SECONDS = 600
STALL_FLOOR = 7_200
INTERVALS = {"hourly": 3_600, "twicedaily": 43_200, "daily": 86_400, "weekly": 604_800}
#: Steps of a sync and how far it is at each; a partial import goes on from its own by the share that is done.
STEPS = {"queued": 0, "checking": 10, "exporting": 25, "large_doc_fallback": 35, "importing": 55, "large_doc_partial_import": 55, "converting": 70, "updating": 90, "complete": 100}
PARTIAL = 14
#: Presets: version, and whether first headings are lowered, code blocks and callouts made.
PRESETS = {"plain_blocks": ("2", False, False, False), "clean_article": ("2", True, False, False), "documentation": ("3", False, True, True)}
INTERVAL_NAMES = ("off", "hourly", "twicedaily", "daily", "weekly")
UNAVAILABLE = ("accessnotconfigured", "has not been used", "disabled")
RECONNECT_CODES = ("access_denied", "credentials_missing", "reconnect_required", "transient_failure")


def health_rank(status: Column, last_synced: Column) -> Column:
    """0 needs attention, 1 syncing, 2 healthy."""
    return F.when(status == "syncing", 1).when(status.isin("synced", "skipped") & (last_synced != ""), 2).otherwise(0)


def preset_fingerprint(preset: Column) -> Column:
    """The hash of what a preset (plain_blocks where it isn't known) does to a layout, as JSON: its id, version, and whether it lowers first headings, makes code blocks and callouts."""
    known = F.when(preset.isin(*PRESETS), preset).otherwise("plain_blocks")
    number = F.create_map(*[F.lit(x) for name, (version, *_) in PRESETS.items() for x in (name, version)])
    flags = [F.create_map(*[F.lit(x) for name, own in PRESETS.items() for x in (name, own[k + 1])])[known].alias(n) for k, n in enumerate(("demote_top_level_headings", "render_code_blocks", "render_callouts"))]
    return F.sha2(F.to_json(F.struct(known.alias("id"), number[known].alias("version"), *flags)), 256)


def fingerprint_current(current: Column, recorded: Column, preset: Column, plain: str = "plain_blocks", widget: Column | None = None) -> Column:
    """Whether the layout is what was last written; without a record only the plain preset counts as current, and widgets never."""
    widgets = F.lit(False) if widget is None else widget
    return F.when(current == "", True).when(recorded == "", ~widgets & (preset == plain)).otherwise(current == recorded)


def skip_by_metadata(forced: Column, last_hash: Column, same_time: Column, same_version: Column, layout_current: Column) -> Column:
    return ~forced & (last_hash != "") & same_time & same_version & layout_current


def skip_by_hash(forced: Column, new_hash: Column, last_hash: Column) -> Column:
    return ~forced & (new_hash == last_hash)


def is_stale(status: Column, locked: Column, updated: Column, now: int) -> Column:
    """Syncing without a live lock, and no heartbeat for STALE_SECONDS; a missing heartbeat is stale. Times are epoch seconds."""
    return (status == "syncing") & ~locked & F.coalesce(F.lit(now) - updated >= STALE_SECONDS, F.lit(True))


def shortest_interval(names: Column) -> Column:
    """The least seconds of an array of schedule names; unknown ones don't count, 0 if none is left."""
    known = F.create_map(*[F.lit(x) for pair in INTERVALS.items() for x in pair])
    return F.coalesce(F.array_min(F.transform(names, lambda n: F.try_element_at(known, n))), F.lit(0))


def is_stalled(shortest: Column, last_run: Column, baseline: Column, now: int) -> Column:
    """Whether nothing has run for longer than two intervals (two hours at least); before a first run, since the baseline."""
    return (shortest > 0) & (F.lit(now) - F.coalesce(last_run, baseline) > F.greatest(F.lit(STALL_FLOOR), 2 * shortest))


def compatibility(can_download: Column, size: Column, quota: Column) -> Column:
    large = (F.coalesce(size, F.lit(0)) >= LARGE_BYTES) | (F.coalesce(quota, F.lit(0)) >= LARGE_BYTES)
    return F.when(~F.coalesce(can_download, F.lit(True)), "download_blocked").when(large, "large_doc_possible")


def remote_error(http_status: Column, body: Column) -> Column:
    text = F.lower(F.coalesce(body, F.lit("")))
    transient = (http_status == 429) | (http_status >= 500)
    large = text.contains("exportsize") | text.contains("too large")
    return F.when(transient, "transient_failure").when(large, "export_too_large").when(http_status.isin(401, 403, 404), "access_denied").otherwise("bad_response")


def document_error(http_status: Column, body: Column) -> Column:
    """What a failed read of a document tree means."""
    text = F.lower(F.coalesce(body, F.lit("")))
    unavailable = text.contains(UNAVAILABLE[0]) | text.contains(UNAVAILABLE[1]) | text.contains(UNAVAILABLE[2])
    return (
        F.when((http_status == 429) | (http_status >= 500), "transient_failure")
        .when((http_status == 403) & unavailable, "api_unavailable")
        .when(http_status.isin(401, 403, 404), "access_denied")
        .otherwise("bad_response")
    )


def step_progress(step: Column, done: Column, total: Column) -> Column:
    """How far a sync is, in percent, at a step; null for an unknown one. done of total counts the elements of a partial import."""
    known = F.create_map(*[F.lit(x) for pair in STEPS.items() for x in pair])
    share = F.least(F.greatest(F.coalesce(done / F.nullif(total, F.lit(0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    more = F.when(step == "large_doc_partial_import", F.floor(share * PARTIAL)).otherwise(0)
    return (F.try_element_at(known, step) + more).cast("int")


def interval(own: Column, site: Column) -> Column:
    """The schedule of a watch: its own, or the site's where it says site; off where that isn't known."""
    chosen = F.when(F.coalesce(own, F.lit("site")) == "site", site).otherwise(own)
    return F.when(chosen.isin(*INTERVAL_NAMES), chosen).otherwise("off")


def post_type_rank(name: Column) -> Column:
    """post first, then page, then the others."""
    return F.when(name == "post", 0).when(name == "page", 1).otherwise(2)


def recovery_hint(code: Column, step: Column, status: Column, has_lock: Column, has_schedule: Column) -> Column:
    """The kind of help for an event; the first rule that fits counts, none gives an empty string."""
    lost = (status == "syncing") & (has_lock == F.lit(False)) & (has_schedule == F.lit(False))
    return (
        F.when(code == "sync_stalled", "retry_then_server_cron")
        .when((step == "large_doc_fallback") | (code == "export_too_large"), "await_fallback")
        .when(step == "large_doc_partial_import", "keep_open")
        .when(lost, "retry_check_schedule")
        .when(code == "drive_download_blocked", "check_permissions")
        .when(code.isin(*RECONNECT_CODES), "reconnect")
        .otherwise("")
    )


def activation_state(site_ready: Column, connected: Column, has_scope: Column, attention: Column, activated: Column, syncing: Column) -> Column:
    return (
        F.when(~site_ready, "site_needs_admin")
        .when(~connected, "account_disconnected")
        .when(~has_scope, "scope_outdated")
        .when(attention > 0, "needs_attention")
        .when(activated, "activated")
        .when(syncing > 0, "syncing")
        .otherwise("ready_for_source")
    )


def event_level(status: Column, step: Column) -> Column:
    return F.when(status == "error", "error").when(step.isin("large_doc_fallback", "large_doc_partial_import"), "warning").otherwise("info")
