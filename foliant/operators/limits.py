"""Rate limits of users and addresses over one large group of them, without a task that reads it whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.scans import counted, last_before, next_after, ordered, reached
from foliant.session import removed, written


def _stretches(rows: DataFrame, seconds: float) -> DataFrame:
    """Adds index and stretch to rows of ordered (key, at, open): how many open calls there are up to each, and how many of these came seconds or more after
    the one before, so that nothing counts any more when a stretch begins."""
    before = last_before(counted(rows, ["key"], F.col("open"), "index"), ["key"], F.when(F.col("open"), F.col("at")), "_prior")
    begins = F.col("open") & (F.col("_prior").isNull() | (F.col("at") - F.col("_prior") >= seconds))
    return counted(before.withColumn("_begins", begins), ["key"], F.col("_begins"), "stretch").drop("_prior")


def _allowed(rows: DataFrame, limit: int, seconds: float) -> DataFrame:
    """Of rows of ordered (key, at, id, open): id and ok, whether a key's limit lets a call pass if of the open ones all that it lets pass do.

    From a fresh start the next open calls pass until there are limit of them, or their stretch ends; after the last of these none passes for seconds, and the first open
    one then is the next fresh start. So each open call knows the fresh start that would follow if it were one, and the real ones are the chains from the beginnings of stretches.
    """
    placed = written(_stretches(rows, seconds), "limit-stretches")
    opened = placed.filter("open").select("key", "stretch", "index", "at", "place", "_begins")
    full = opened.select("key", "stretch", (F.col("index") - limit + 1).alias("index"), (F.col("at") + seconds).alias("free"))
    starts = written(opened.join(full, ["key", "stretch", "index"], "left"), "limit-starts")  # free: when calls pass again after a fresh start here
    asked = starts.filter("free IS NOT NULL").select("key", "stretch", F.col("free").alias("at"), F.lit(0).alias("is_call"), F.col("place").alias("of"))
    both = ordered(asked.union(starts.select("key", "stretch", "at", F.lit(1), "place")), ["key", "stretch"], ["at", "is_call", "of"])
    jumps = next_after(both, ["key", "stretch"], F.when(F.col("is_call") == 1, F.col("of")), "next").filter("is_call = 0").select(F.col("of").alias("id"), "next")
    fresh = reached(starts.filter("_begins").select(F.col("place").alias("id")), jumps)
    begun = fresh.withColumnRenamed("id", "place").join(starts.select("place", F.struct("index", "free").alias("_start")), "place")
    marked = placed.join(begun, "place", "left")
    known = last_before(written(marked, "limit-marked"), ["key"], F.col("_start"), "_last")
    last = F.col("_last")
    shut = (F.col("index") - F.col("open").cast("int") - last.index + 1 >= limit) & (F.col("at") < last.free)
    ok = F.col("_start").isNotNull() | last.isNull() | ~F.coalesce(shut, F.lit(False))
    return known.select("id", ok.alias("ok"))


def accepted(calls: DataFrame, limits: tuple[int, int], seconds: float) -> DataFrame:
    """Calls (id, user, ip, at, call_id) that are accepted, in the order of at, call_id and id: id, accepted.

    A user's and an address's counts are both checked before either grows; an accepted call restarts both times, a rejected one changes nothing. Users and
    addresses take turns: given which calls the other side lets pass, each key's own are found in chunks of its calls, until nothing changes. The answer that
    is left is the one of going call by call, since the first call on which they differed would have the same calls before it. Calls of users and
    addresses that don't reach their limits within seconds of each other take no turns. A call without a time is accepted and doesn't count.
    """
    timed = calls.filter("at IS NOT NULL")
    order = ["at", "call_id", "id"]
    of = lambda rows, key: ordered(rows.select(F.coalesce(key, F.lit("")).alias("key"), *order), ["key"], order)

    def crowded(key: str, limit: int) -> DataFrame:
        """The ids of the calls in stretches of more than limit calls of a key."""
        rows = written(_stretches(of(timed, key).withColumn("open", F.lit(True)), seconds), "limit-all")
        long = rows.groupBy("key", "stretch").agg(F.count("*").alias("n")).filter(F.col("n") > limit)
        return rows.join(long.select("key", "stretch"), ["key", "stretch"], "left_semi").select("id")

    suspects = written(timed.join(crowded("user", limits[0]).union(crowded("ip", limits[1])).distinct(), "id", "left_semi"), "limit-suspects")
    users, addresses = of(suspects, "user"), of(suspects, "ip")
    by_address = written(suspects.select("id", F.lit(True).alias("ok")), "limit-open")
    while True:
        masked = lambda rows, mask: rows.join(mask.withColumnRenamed("ok", "open"), "id")
        by_user = written(_allowed(masked(users, by_address), limits[0], seconds), "limit-users")
        after = written(_allowed(masked(addresses, by_user), limits[1], seconds), "limit-addresses")
        same = after.join(by_address.withColumnRenamed("ok", "before"), "id").filter("ok <> before").isEmpty()
        removed(by_address)
        by_address = after
        if same:
            break
        removed(by_user)
    verdict = by_user.withColumnRenamed("ok", "by_user").join(by_address, "id").select("id", (F.col("by_user") & F.col("ok")).alias("_ok"))
    return calls.select("id").join(verdict, "id", "left").select("id", F.coalesce("_ok", F.lit(True)).alias("accepted"))
