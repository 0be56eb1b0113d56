"""Streams: keyed upserts, stale sources, rate limits with idle reset."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliant.operators.groups import connected
from foliant.operators.limits import accepted
from foliant.session import shared_folder, written

#: Fixed limits: accepted calls in a window for a user and for an address, and the window's seconds.
USER_LIMIT, ADDRESS_LIMIT, WINDOW_SECONDS = 5, 20, 3_600
#: Calls of a connected group up to which one task goes through it.
TASK_CALLS = 100_000


@contextmanager
def with_states(spark: SparkSession) -> Iterator[None]:
    """Within, streams that are started keep their state in RocksDB, which operators with several state variables and timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that is there now and returns its output: in append mode all rows, in complete mode the last state.

    Output, offsets and state go to shared folders, so that a lost executor's work is done again from there.
    """
    spark = stream.sparkSession
    out = shared_folder(spark, "stream-out")
    last: list[str] = []

    def write(batch: DataFrame, epoch: int) -> None:
        path = f"{out}/{epoch:08d}"
        batch.write.mode("overwrite").parquet(path)
        if mode == "complete":
            last.clear()
        last.append(path)

    stream.writeStream.outputMode(mode).option("checkpointLocation", shared_folder(spark, "stream-state")).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(*last) if last else spark.createDataFrame([], stream.schema)


def stream_upsert(checkins: DataFrame, key: str, at: str, attributes: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """A running state of check-ins, for update or complete mode: key, first_seen, last_seen, checkin_count, and the attributes of the last one (by at, then order)."""
    last = F.struct(at, *order)
    kept = [F.max_by(c, last).alias(c) for c in attributes]
    return checkins.groupBy(key).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("checkin_count"), *kept)


def windowed_counts(events: DataFrame, at: str, by: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts by tumbling window with a watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count("*").alias("n"))


def limit_calls(calls: pd.DataFrame, state: dict[tuple[str, str], tuple[int, float]]) -> list[bool]:
    """Which calls (user, ip, at in seconds, in order) are accepted; state holds (count, expiry) of each user and address.

    Both counts are checked before either grows; an accepted call restarts both expiries, a rejected one changes nothing.
    """
    out = []
    for user, ip, at in zip(calls["user"], calls["ip"], calls["at"], strict=True):
        keys = (("user", str(user)), ("ip", str(ip)))
        counts = [c if at < until else 0 for c, until in (state.get(k, (0, 0.0)) for k in keys)]
        accepted = counts[0] < USER_LIMIT and counts[1] < ADDRESS_LIMIT
        if accepted:
            for k, c in zip(keys, counts, strict=True):
                state[k] = (c + 1, at + WINDOW_SECONDS)
        out.append(accepted)
    return out


def coupled(calls: DataFrame) -> DataFrame:
    """Adds group to calls (user, ip): the connected set of users and addresses that the call belongs to."""
    user = F.concat(F.lit("u:"), F.coalesce("user", F.lit("")))
    roots = connected(calls.select(user.alias("a"), F.concat(F.lit("a:"), F.coalesce("ip", F.lit(""))).alias("b")))
    return calls.withColumn("_node", user).join(roots.select(F.col("node").alias("_node"), F.col("root").alias("group")), "_node").drop("_node")


def rate_limited(calls: DataFrame, group: str | None = None, most: int = TASK_CALLS) -> DataFrame:
    """Adds accepted to calls (call_id, user, ip, at): in time order within each group, whose users and addresses don't occur elsewhere.

    Users and addresses are coupled, so a group is a connected set of them, which coupled finds unless a column names it. A call's fate depends on all
    earlier ones of its group. A group of up to most calls is one task's work, which reads its calls in order and holds two numbers for each user and address; the
    calls of larger ones are dealt out (limits.accepted).
    """

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, str], tuple[int, float]] = {}
        last: Any = None
        for batch in batches:  # sorted by group and time: counts are held for one group at a time
            for name, rows in batch.groupby("_group", sort=False, dropna=False):
                if name != last:
                    held.clear()
                    last = name
                yield rows.drop(columns="_group").assign(accepted=limit_calls(rows, held))

    named = coupled(calls).withColumnRenamed("group", "_group") if group is None else calls.withColumn("_group", F.col(group))
    columns, answer = ["call_id", "user", "ip", "at"], "call_id long, user string, ip string, at double, accepted boolean"
    fold = lambda rows: rows.repartition("_group").sortWithinPartitions("_group", "at", "call_id").select(*columns, "_group").mapInPandas(one, answer)
    sizes = named.groupBy("_group").agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(F.col("_group").alias("_large"))
    if sizes.isEmpty():
        return fold(named)
    large = F.col("_group").eqNullSafe(F.col("_large"))
    spread = written(named.join(sizes, large, "left_semi").select(*columns).withColumn("id", F.monotonically_increasing_id()), "limit-calls")
    verdict = accepted(spread, (USER_LIMIT, ADDRESS_LIMIT), WINDOW_SECONDS)
    return fold(named.join(sizes, large, "left_anti")).unionByName(spread.join(verdict, "id").select(*columns, "accepted"))


def stale_sources(heartbeats: DataFrame, seconds: int = 600) -> DataFrame:
    """A stream of the heartbeats after which a source was syncing for so many seconds without another one: post_id, last_at.

    heartbeats: post_id, status, ts (timestamp with a watermark). Gaps between the rows of one batch are seen as well as those that only the
    watermark ends, so that the answer doesn't depend on how the stream is cut. Rows of one time go by status.
    """
    wait = seconds * 1_000_000

    def step(key: tuple[Any, ...], rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (at,) = state.get
            state.remove()
            yield pd.DataFrame({"post_id": [key[0]], "last_at": [pd.Timestamp(at, unit="us")]})
            return
        last, busy = (state.get[0], True) if state.exists else (0, False)
        stale = []
        fresh = [x for batch in rows for x in zip(batch["ts"].astype("datetime64[us]").astype("int64"), batch["status"], strict=True)]
        for at, status in sorted(fresh):
            if at < last:
                continue
            if busy and at - last >= wait:
                stale.append(last)
            last, busy = int(at), status == "syncing"
        if stale:
            yield pd.DataFrame({"post_id": [key[0]] * len(stale), "last_at": [pd.Timestamp(at, unit="us") for at in stale]})
        if busy:
            state.update((last,))
            state.setTimeoutTimestamp(max(-(-(last + wait) // 1000), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    return heartbeats.groupBy("post_id").applyInPandasWithState(step, "post_id long, last_at timestamp", "at long", "append", GroupStateTimeout.EventTimeTimeout)
