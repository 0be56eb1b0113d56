"""Locks that run out: who holds a key's lock when acquires compete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.scans import dealt, last_before, next_after, ordered, reached
from foliant.session import written

#: Fixed value: seconds that a lock lives without being refreshed.
SECONDS = 1_800


def held(requests: DataFrame, seconds: int = SECONDS) -> DataFrame:
    """Requests (key, at, seq, kind: acquire, refresh or release, owner) with ok and holder, as if they came one by one in the order of at and seq.

    An acquire is ok where no lock lives: none was there, it was released, or it had run out by then. A refresh lengthens a living lock, whoever asks, a release ends
    one. holder is the owner of the lock after an acquire or refresh, and before a release; null where none lives. Requests without a key, a time or a
    kind that is known are left out; of requests with the same at and seq, releases come first, then refreshes.

    How long a lock lives if an acquire wins doesn't depend on who has won before: up to the first release, or to the end of the last of the refreshes that follow each
    other in time. So each acquire knows the first one after its end, and those that win are the chain of these from the first of a key, found by doubling.
    """
    kinds = F.create_map(*[F.lit(x) for x in ("release", 0, "refresh", 1, "acquire", 2)])
    rows = requests.select("key", F.col("at").cast("long").alias("at"), "seq", "kind", "owner").withColumn("_kind", kinds[F.col("kind")]).filter("key IS NOT NULL AND at IS NOT NULL AND _kind IS NOT NULL")
    rows = ordered(rows, ["key"], ["at", "seq", "_kind", "owner"])
    expiry = F.col("at") + seconds
    control = F.when(F.col("kind") != "acquire", F.struct("place", "at", "kind"))
    named = next_after(rows, ["key"], control, "_next")
    in_time = F.coalesce(F.col("_next.at") < expiry, F.lit(False))
    # where a row's lock ends by itself: at a release (its place), or at a time; null where a refresh goes on with it
    own = F.when(in_time & (F.col("_next.kind") == "release"), F.struct(F.col("_next.at").alias("at"), F.col("_next.place").alias("place")))
    own = own.when(in_time, F.lit(None)).otherwise(F.struct(expiry.alias("at"), F.lit(None).cast("long").alias("place")))
    own = written(named.withColumn("_end", own), "lock-ends")
    ends = next_after(own, ["key"], F.when(F.col("kind") == "refresh", F.col("_end")), "_later")
    ends = written(ends.filter("kind <> 'release'").select("key", "place", "kind", "at", "seq", "owner", F.coalesce("_end", "_later").alias("end")), "lock-ends")
    # the first acquire after each end: acquires and ends in one order; an end in time comes before the acquires of its second
    acquires = ends.filter("kind = 'acquire'")
    asked = acquires.select("key", F.col("end.at").alias("at"), F.coalesce("end.place", F.lit(-1)).alias("at_place"), F.lit(0).alias("is_acquire"), F.col("place").alias("of"))
    both = ordered(asked.union(acquires.select("key", "at", F.col("place").alias("at_place"), F.lit(1), "place")), ["key"], ["at", "at_place", "is_acquire", "of"])
    jumps = next_after(both, ["key"], F.when(F.col("is_acquire") == 1, F.col("of")), "next").filter("is_acquire = 0").select(F.col("of").alias("id"), "next")
    first = acquires.groupBy("key").agg(F.min("place").alias("id")).select("id")
    won = reached(first, jumps).select(F.col("id").alias("place"), F.lit(True).alias("_won"))
    winners = acquires.join(dealt(won), "place").select("place", F.struct("owner", "end").alias("_lock"))
    marked = written(rows.join(dealt(winners), "place", "left"), "lock-winners")
    known = last_before(marked, ["key"], F.col("_lock"), "_last")
    end = F.col("_last.end")
    lives = F.coalesce((F.col("at") < end.at) | (F.col("at") == end.at) & (F.col("place") <= end.place), F.lit(False))
    wins = F.col("_lock").isNotNull()
    return known.select("key", "at", "seq", "kind", "owner", F.when(F.col("kind") == "acquire", wins).otherwise(lives).alias("ok"), F.when(wins, F.col("owner")).when(lives, F.col("_last.owner")).alias("holder"))
