"""Connected groups of values that occur together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import removed, written


def connected(pairs: DataFrame) -> DataFrame:
    """The groups of values that pairs (a, b) connect: node and root, the least value of its group.

    In each round every value takes the least one that it or a neighbour has reached, and then what that one has reached itself, so that distances
    halve; aggregates and joins do it, so that a value with very many neighbours is dealt out. It ends when nothing changes.
    """
    both = written(pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "group-pairs")
    roots = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "group-roots")
    while True:
        far = roots.select(F.col("node").alias("b"), F.col("root").alias("of_b"))
        near = both.join(far, "b").groupBy(F.col("a").alias("node")).agg(F.min("of_b").alias("least"))
        took = roots.join(near, "node").select("node", F.col("root").alias("before"), F.least("root", "least").alias("root"))
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
        after = written(took.join(jump, "root").select("node", "before", F.least("root", "next").alias("root")), "group-roots")
        still = after.filter("root <> before").isEmpty()
        removed(roots)
        roots = after.select("node", "root")
        if still:
            return roots
