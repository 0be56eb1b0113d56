"""Exact histogram of encoded lengths, with suffix sums for context limits."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import materialize

#: The vocabulary's place, as ranks of byte pieces, where the session doesn't name another in SETTING; every machine has it there.
SETTING = "spark.foliant.vocabulary"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed pattern by which this vocabulary's texts are cut before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Lengths whose sums meet in one task.
SPAN = 128


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """A text's encoded length; a null or empty text has none."""

    @F.pandas_udf("long")
    def lengths(texts: pd.Series) -> pd.Series:
        encode = encoding(vocabulary).encode_ordinary
        return texts.fillna("").map(lambda t: len(encode(t))).astype("int64")

    return lengths(text.cast("string"))


def length_histogram(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(length, docs): how many documents (text) have each encoded length. Very long texts are encoded whole;
    repeated rows count each; there are no ties, as a length is one row; an empty table gives no rows."""
    return docs.select(n_tokens(F.col("text"), vocabulary).alias("length")).groupBy("length").agg(F.count("*").alias("docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """Adds to each length of a histogram, taken as a context limit: docs_from and tokens_from (documents at least that long, and their tokens),
    docs_all, tokens_all, docs_cut (longer ones), tokens_kept (the total after truncation) and quantile (documents not longer, as a share)."""
    rows = materialize(histogram.withColumn("span", F.expr(f"length div {SPAN}")).withColumn("tokens", F.col("length") * F.col("docs")), "lengths")
    after = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each SPAN of lengths
    spans = rows.groupBy("span").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    later = spans.select("span", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t"))
    totals = spans.agg(F.sum("d").alias("docs_all"), F.sum("t").alias("tokens_all"))
    within = Window.partitionBy("span").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.withColumn("docs_own", F.sum("docs").over(within)).withColumn("tokens_own", F.sum("tokens").over(within)).join(later, "span")
    sums = sums.withColumn("docs_from", F.col("docs_own") + F.col("d")).withColumn("tokens_from", F.col("tokens_own") + F.col("t")).crossJoin(F.broadcast(totals))
    sums = sums.withColumn("docs_cut", F.col("docs_from") - F.col("docs"))
    kept = F.col("tokens_all") - F.col("tokens_from") + F.col("length") * F.col("docs_from")
    quantile = (F.col("docs_all") - F.col("docs_cut")) / F.col("docs_all")
    return sums.select("length", "docs", "tokens", "docs_from", "tokens_from", "docs_all", "tokens_all", "docs_cut", kept.alias("tokens_kept"), quantile.alias("quantile"))


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row: tokens left of all documents after truncation to limit, whether or not a document has that length."""
    short = F.coalesce(F.sum(F.when(F.col("length") <= limit, F.col("tokens"))), F.lit(0))
    return sums.agg((short + limit * F.coalesce(F.sum(F.when(F.col("length") > limit, F.col("docs"))), F.lit(0))).alias("tokens_kept"))


def length_quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row: the smallest length that at least a share q of the documents doesn't exceed."""
    return sums.filter(F.col("quantile") >= q).agg(F.min("length").alias("length"))


def op10_token_counts(docs: DataFrame) -> DataFrame:
    """The thin query over length_histogram and suffix_sums: every occurring length as a context limit."""
    return suffix_sums(length_histogram(docs, docs.sparkSession.conf.get(SETTING, VOCABULARY))).withColumn("quantile", F.round("quantile", 9))
