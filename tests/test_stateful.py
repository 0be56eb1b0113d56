"""Streams, locks, limits and written tables against folds, however they are cut."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliant.operators import limits, locks, scans
from foliant.session import shared_folder, written
from foliant.sources import keyed_table
from foliant.sources.keyed_table import ConflictError, KeyedTable, Manifest, overwrite
from foliant.streaming import progress, sites, state, watch_sync


def streamed(spark, df, parts, order):
    """df as a stream of files in order, one file a batch."""
    folder = shared_folder(spark, "cut")
    for rows in parts:
        spark.createDataFrame(rows, df.schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.fixture
def many_chunks(spark):
    """Small tables in as many chunks as there are partitions."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


# Chains and scans.


def test_reached_follows_chains(spark):
    jumps = spark.createDataFrame([(k, k + 3) for k in range(200)] + [(500, None)], "id long, next long")
    found = scans.reached(spark.createDataFrame([(2,), (190,), (500,)], "id long"), jumps)
    assert sorted(r["id"] for r in found.collect()) == sorted({*range(2, 203, 3), *range(190, 203, 3), 500})


def test_scans_carry_values_over_chunks(spark, many_chunks):
    rng = random.Random(2)
    rows = [(rng.choice("aab"), k, rng.choice([None, None, k])) for k in range(300)]
    df = scans.ordered(spark.createDataFrame(rows, "key string, at long, v long").repartition(7), ["key"], ["at"])
    assert df.select("chunk").distinct().count() > 1
    got = scans.next_after(scans.last_before(scans.counted(df, ["key"], F.col("v").isNotNull(), "n"), ["key"], F.col("v"), "last"), ["key"], F.col("v"), "next")
    for r in got.collect():
        own = [x for x in rows if x[0] == r["key"]]
        assert r["n"] == sum(x[2] is not None and x[1] <= r["at"] for x in own)
        assert r["last"] == max((x[2] for x in own if x[2] is not None and x[1] < r["at"]), default=None)
        assert r["next"] == min((x[2] for x in own if x[2] is not None and x[1] > r["at"]), default=None)


def test_scans_send_nothing_through_the_driver(spark, monkeypatch):
    """However small the tables are: what is joined grows with the keys or rows."""
    plans = []

    def followed(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    for module in (scans, locks):
        monkeypatch.setattr(module, "written", followed)
    rows = [(k % 5, 10 * k, k, "acquire" if k % 3 else "refresh", k) for k in range(300)]
    found = locks.held(spark.createDataFrame(rows, "key long, at long, seq long, kind string, owner long"), 30)
    plans += [x._jdf.queryExecution().executedPlan().toString() for x in (found, scans.counted(scans.ordered(found, ["key"], ["at"]), ["key"], F.lit(1), "n"))]
    assert sum("SortMergeJoin" in p for p in plans) > 5 and not [p for p in plans if "Broadcast" in p]


# Locks.


def locks_by_fold(rows, seconds):
    held, out = {}, []
    rank = {"release": 0, "refresh": 1, "acquire": 2}
    for key, at, seq, kind, owner in sorted((r for r in rows if r[0] is not None and r[1] is not None and r[3] in rank), key=lambda r: (r[0], r[1], r[2], rank[r[3]], r[4])):
        until, by = held.get(key, (0, None))
        lives = until > at
        if kind == "acquire" and not lives:
            until, by = at + seconds, owner
        elif kind == "refresh" and lives:
            until = at + seconds
        out.append((key, at, seq, kind, owner, lives if kind != "acquire" else not lives, by if lives or kind == "acquire" else None))
        held[key] = (0, None) if kind == "release" else (until, by)
    return out


@pytest.mark.parametrize("gap", [4, 40])
def test_locks_by_fold(spark, gap, many_chunks):
    rng = random.Random(gap)
    rows = [(rng.choice(["hot", "hot", "a", "b"]), rng.randrange(400 * gap), rng.randrange(3), rng.choice(["acquire", "acquire", "refresh", "refresh", "release"]), k) for k in range(400)]
    rows += [(None, 5, 1, "acquire", 900), ("a", None, 1, "acquire", 901), ("a", 5, 1, "other", 902), ("c", 5, 1, "refresh", 903), ("c", 6, 1, "release", 904)]
    found = locks.held(spark.createDataFrame(rows, "key string, at long, seq long, kind string, owner long"), 30)
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, locks_by_fold(rows, 30)))


def test_no_locks(spark):
    assert locks.held(spark.createDataFrame([], "key string, at long, seq long, kind string, owner long")).collect() == []


# Limits.


def test_limits_in_turns_by_fold(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice(["u1", "u2", "u3", None]), rng.choice(["a", "a", "b"]), float(rng.randrange(9_000))) for k in range(120)]
    rows += [(200 + k, "u1", "a", 30_000.0) for k in range(7)] + [(300, "u9", "a", None)]
    calls = spark.createDataFrame(rows, "call_id long, user string, ip string, at double")
    found = {r["call_id"]: r["accepted"] for r in state.rate_limited(calls, most=10).collect()}
    timed = pd.DataFrame([r for r in rows if r[3] is not None], columns=["call_id", "user", "ip", "at"]).sort_values(["at", "call_id"])
    want = dict(zip(timed["call_id"], state.limit_calls(timed, {}), strict=True)) | {300: True}
    assert found == want and 20 < sum(found.values()) < 120


def test_limits_of_nothing(spark):
    assert limits.accepted(spark.createDataFrame([], "id long, user string, ip string, at double, call_id long"), (5, 20), 3_600).collect() == []


# Progress.

REPORTS = "post_id long, ts timestamp, seq long, step string, done int, total int, code string"


def reports(n, seed):
    rng = random.Random(seed)
    script = ["queued", "checking_google", "exporting", "large_doc_fallback", "importing", "large_doc_partial_import", "converting", "updating_post", "complete"]
    place, rows, at = dict.fromkeys(range(4), 0), [], 1_000
    for k in range(n):
        at += rng.choice([0, 5, 60, 250])
        post = rng.randrange(4)
        step = script[place[post] % 9] if rng.random() < 0.9 else rng.choice([*script, "error", "no such step"])
        place[post] += 1
        rows.append((post, pd.Timestamp(at, unit="s").to_pydatetime(), k, step, k % 7, 5, "c"))
    return rows


def progress_by_fold(rows, upto):
    """The machine's own functions for one step, over all rows in order."""
    out, runs = [], {}
    key = lambda r: (r[0], r[1], r[2], r[3])
    for post, ts, seq, step, done, total, code in sorted(rows, key=key):
        at = int(pd.Timestamp(ts).timestamp())
        if at + 1 > upto:
            continue
        run = runs.get(post, progress.Run())
        run, stall = progress.stalled(run, at)
        runs[post], event = progress.step_on(run, progress.Report(at, seq, step, done, total, code))
        out += [(post, *e) for e in (stall, event) if e]
    for post, run in runs.items():
        _, stall = progress.stalled(run, upto)
        out += [(post, *stall)] if stall else []
    return out


def test_progress_however_it_is_cut(spark):
    rows = reports(90, 3)
    df = spark.createDataFrame([*rows, (None, rows[0][1], 1, "queued", 1, 1, None), (1, None, 1, "queued", 1, 1, None), (1, rows[0][1], 1, None, 1, 1, None)], REPORTS)
    want = progress_by_fold(rows, int(pd.Timestamp(rows[-1][1]).timestamp()) - 600)
    late = random.Random(9)
    swapped = rows[:]
    for k in range(0, 88, 2):  # neighbours change places: late, but not too late
        if late.random() < 0.5:
            swapped[k], swapped[k + 1] = swapped[k + 1], swapped[k]
    for parts in ([df.collect()], [rows[:10], rows[10:50], rows[50:]], [swapped[k : k + 15] for k in range(0, 90, 15)]):
        with state.with_states(spark):
            found = state.drained(progress.progress_events(streamed(spark, df, parts, "ts"), "10 minutes"), "append")
        assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, want))


def test_rows_wait_in_few_values():
    """A thousand reports of a key are one value of its state, and none is read back for more to be put beside it."""
    calls = []

    class Variable:
        def __getattr__(self, name):
            return lambda *a: calls.append((name, *a))

    class Handle:
        def getListState(self, *a):
            return Variable()

        getValueState = getListState

        def listTimers(self):
            return iter([50_000])

        def deleteTimer(self, at):
            calls.append(("delete", at))

        def registerTimer(self, at):
            calls.append(("register", at))

    class Watermark:
        def getCurrentWatermarkInMs(self):
            return 0

    machine = progress.ProgressMachine()
    machine.init(Handle())
    report = dict(seq=1, step="queued", done=None, total=None, code=None)
    assert list(machine.handleInputRows((1,), iter([dict(report, at=60 + k) for k in range(1_000)]), Watermark())) == []
    assert [c[0] for c in calls] == ["appendList"] and len(calls[0][1]) == 1  # the timer is sooner already
    calls.clear()
    list(machine.handleInputRows((1,), iter([dict(report, at=40)]), Watermark()))
    assert [c[0] for c in calls] == ["appendList", "delete", "register"] and calls[1:] == [("delete", 50_000), ("register", 41_000)]


def test_steps_by_hand():
    run, told = progress.Run(), []
    for at, step, done in [(0, "importing", 0), (1, "checking_google", 0), (2, "exporting", 0), (3, "large_doc_fallback", 0), (4, "importing", 0), (5, "large_doc_partial_import", 4), (6, "large_doc_partial_import", 2), (7, "exporting", 0), (8, "converting", 0), (9, "complete", 0), (10, "error", 0), (11, "queued", 0), (12, "error", 0), (13, "queued", 0)]:
        run, event = progress.step_on(run, progress.Report(at, 0, step, done, 8, "bad"))
        told += [event] if event else []
    assert told == [
        (1, 1, 1, "checking_google", "syncing", 10, "info", None), (2, 1, 2, "exporting", "syncing", 25, "info", None), (3, 1, 3, "large_doc_fallback", "syncing", 35, "warning", None), (4, 1, 4, "importing", "syncing", 55, "info", None),
        (5, 1, 5, "large_doc_partial_import", "syncing", 62, "info", None), (6, 1, 6, "large_doc_partial_import", "syncing", 62, "info", None), (7, 1, 8, "converting", "syncing", 70, "info", None), (8, 1, 9, "complete", "skipped", 100, "info", None),
        (9, 2, 11, "queued", "syncing", 0, "info", None), (10, 2, 12, "error", "error", 0, "error", "bad"), (11, 3, 13, "queued", "syncing", 0, "info", None),
    ]


# Written tables.


def keyed(spark, buckets=4):
    return KeyedTable(spark, shared_folder(spark, "keyed"), "id long, v string, seq long", "id", buckets)


def rows_of(table, version=None):
    return sorted(tuple(r) for r in table.read(version).collect())


def changes(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, v string, seq long")


def test_merges_touch_their_buckets_and_count_once(spark):
    table = keyed(spark, 8)
    assert rows_of(table) == []
    assert overwrite(table, changes(spark, *[(k, "a", 1) for k in range(50)], (7, "z", 3), (7, "y", 2), (None, "x", 1)), ["seq"], "s", 0)
    first = table.manifest()
    assert rows_of(table) == [(k, "z" if k == 7 else "a", 3 if k == 7 else 1) for k in range(50)] and len(first.folders) > 4
    assert not overwrite(table, changes(spark, (1, "again", 9)), ["seq"], "s", 0)
    assert overwrite(table, changes(spark, (1, None, 9)), ["seq"], "s", 1, deleted_if="v IS NULL")
    after = table.manifest()
    assert len(rows_of(table)) == 49 and sum(first.folders[b] != after.folders.get(b) for b in first.folders) == 1
    assert overwrite(table, changes(spark), ["seq"], "s", 2) and len(rows_of(table)) == 49 and len(rows_of(table, 1)) == 50
    table.vacuum(1)
    assert table.versions() == [3] and len(rows_of(table)) == 49


def test_a_killed_merge_leaves_the_table(spark, monkeypatch):
    table = keyed(spark)
    overwrite(table, changes(spark, (1, "a", 1)), ["seq"], "s", 0)

    def killed(self, manifest):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(keyed_table.KeyedTable, "_put", killed)
        overwrite(table, changes(spark, (1, "b", 2), (2, "b", 2)), ["seq"], "s", 1)
    assert rows_of(table) == [(1, "a", 1)]
    assert overwrite(table, changes(spark, (1, "b", 2), (2, "b", 2)), ["seq"], "s", 1) and rows_of(table) == [(1, "b", 2), (2, "b", 2)]


def test_one_of_two_writers_wins(spark):
    table = keyed(spark)
    overwrite(table, changes(spark, (1, "a", 1)), ["seq"])
    with pytest.raises(ConflictError):
        table._put(Manifest(1, {}, {}))
    assert rows_of(table) == [(1, "a", 1)]


# Sites.


def sites_by_fold(rows, keep, upto):
    out = {}
    for site, at, seq, version in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if at + 1 <= upto:
            old = out.get(site)
            out[site] = (site, version, at, at, 1) if old is None or at >= old[3] + keep else (site, version, old[2], at, old[4] + 1)
    return sorted(r for r in out.values() if upto < r[3] + keep)


def test_site_table_however_it_is_cut(spark):
    rng = random.Random(6)
    day, rows = sites.DAY, []
    for k in range(160):
        rows.append((rng.randrange(12), 10 * day + k * 20_000 + rng.randrange(50), k, f"v{k % 5}"))
    want = sites_by_fold(rows, 4 * day, rows[-1][1] - 60)
    schema = "site long, ts timestamp, seq long, version string"
    as_ts = lambda rs: [(s, pd.Timestamp(a, unit="s").to_pydatetime(), q, v) for s, a, q, v in rs]
    df = spark.createDataFrame(as_ts(rows), schema)
    stored = spark.createDataFrame(sites_by_fold(rows[:60], 4 * day, rows[59][1] + 1), sites.SITES)
    for parts, first in (([rows], None), ([rows[:50], rows[50:90], rows[90:]], None), ([rows[60:100], rows[100:]], stored)):
        table = KeyedTable(spark, shared_folder(spark, "sites"), sites.SITES, "site", 3)
        if first is not None:
            table.replace(first)
        with state.with_states(spark):
            sites.follow(sites.site_states(streamed(spark, df, [as_ts(p) for p in parts], "ts"), 4, stored=first), table, "s", shared_folder(spark, "sites-stream"))
        assert sorted(tuple(r) for r in table.read().collect()) == want


# Watches.


def watches_by_fold(rows, code_of):
    linked, watch = {}, {}
    for tick in sorted({r[0] for r in rows}):
        here = [r for r in rows if r[0] == tick]
        before = set(linked)
        for name in sorted({r[1] for r in here}):
            w = watch.setdefault(name, {"pending": [], "failed": [], "total": 0, "imported": 0, "status": ""})
            for _, _, file, pos, ok in sorted((r for r in here if r[1] == name and r[2]), key=lambda r: (r[3], r[2])):
                if ok is not False and file not in w["pending"] and file not in before:
                    w["pending"].append(file)
                    w["total"] += 1
            batch, w["status"] = w["pending"][:5], None
            for file in batch:
                code = None if file in before else code_of(file)
                if code == "access_denied":
                    w["status"] = "error"
                    break
                w["pending"].remove(file)
                if code:
                    w["failed"].append((file, tick, code))
                else:
                    w["imported"] += 1
                    linked.setdefault(file, (name, tick))
            w["status"] = w["status"] or ("importing" if w["pending"] else "watching")
    out = []
    for name, w in watch.items():
        out.append((name, "watch", None, None, None, w["total"], w["imported"], w["status"]))
        out += [(name, "pending", f, k + 1, None, None, None, None) for k, f in enumerate(w["pending"])]
        out += [(name, "failed", f, t, c, None, None, None) for f, t, c in w["failed"]]
    return out, [(f, w, t) for f, (w, t) in linked.items()]


def test_watches_however_they_are_cut(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(t, w, f"f{n}", k, rng.random() > 0.1) for t in (1, 2, 3) for w in "ab" for k, n in enumerate(sorted(rng.sample(range(14), 4 + 2 * t)))]
    rows += [(2, "c", None, 0, True), (3, "a", "", 99, True), (3, "a", "f3", 98, None), (3, "a", "f3", 99, None)]
    schema = "tick long, watch_id string, file_id string, pos long, selectable boolean"
    code_of = lambda f: "access_denied" if f == "f6" else "too_large" if f in ("f2", "f9") else None
    imports = lambda files: files.select("watch_id", "file_id", F.when(F.col("file_id") == "f6", "access_denied").when(F.col("file_id").isin("f2", "f9"), "too_large").alias("code"))
    want, links = watches_by_fold(rows, code_of)
    df = spark.createDataFrame(rows, schema)
    ticks = [[r for r in rows if r[0] == t] for t in (1, 2, 3)]
    for parts, fails in (([rows], False), (ticks, True)):
        watch, linked = KeyedTable(spark, shared_folder(spark, "w"), watch_sync.STATE, "watch_id", 3), KeyedTable(spark, shared_folder(spark, "l"), watch_sync.LINKED, "file_id", 3)
        stream, place = streamed(spark, df, parts, "tick"), shared_folder(spark, "ws")
        if fails:  # dies between the two tables' merges of the second tick

            def merge(self, changes, merged, stream="", batch=-1, whole=keyed_table.KeyedTable.merge):
                if self is watch and batch == 2:
                    raise RuntimeError("killed")
                return whole(self, changes, merged, stream, batch)

            with monkeypatch.context() as m, pytest.raises(Exception, match="killed"):
                m.setattr(keyed_table.KeyedTable, "merge", merge)
                watch_sync.run(stream, watch, linked, imports, place)
            assert linked.manifest().batches == {"watches": 2} and watch.manifest().batches == {"watches": 1}
        watch_sync.run(stream, watch, linked, imports, place)
        assert sorted(map(str, (tuple(r) for r in watch.read().collect()))) == sorted(map(str, want))
        assert sorted(tuple(r) for r in linked.read().collect()) == sorted(links)


def test_old_tables_are_swept(spark):
    from foliant.session import swept, written

    kept = written(spark.range(3).toDF("a"), "swept")
    assert swept(spark, 1) == 0 and kept.count() == 3
