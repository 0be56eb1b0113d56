"""The corpus pipeline: quality, near-duplicates, decontamination, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm.common import materialize, scratch
from foliant.llm.decontaminate import remove_contaminated
from foliant.llm.mixing import mix_documents
from foliant.llm.quality import keep_good
from foliant.llm.sharding import shard_rows
from foliant.llm.simhash import deduplicate
from foliant.session import removed


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null, empty and very short texts go, very long ones are judged whole; repeated rows stay or go together, and
    equal texts too; an empty table stays empty; all columns stay."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: by fingerprint, and by five-word shingles or counted words that are similar to 0.8.

    A null or empty text is like any other empty one, very long ones are compared whole; of repeated rows one stays, of texts that tie the one with the smallest
    id (null last); an empty table stays empty; all columns stay.
    """
    return deduplicate(docs, similarity=0.8, width=5, words=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items. Null and empty texts stay, very long ones are searched whole; repeated rows stay or go together; it has no ties;
    an empty table stays empty; all columns stay."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes the block of their first word, none to two times.

    Null and empty texts are never taken, very long ones come whole; a null source is one of the sources; repeated rows come as often as they are taken together; ties
    can't happen, as blocks are numbered; an empty table stays empty; all columns stay.
    """
    return mix_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot, which replace columns of these names. Null metadata comes last on its axis; rows that tie on the curve go by a hash of the row; null,
    empty and very long texts and repeated rows each have a slot; an empty table stays empty."""
    return shard_rows(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: Mixing draws pseudorandom permutations, which SQL doesn't express; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's result is written and read again, and what it was made from is deleted, the stage before included."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        with scratch(spark):
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
        if before is not None:
            removed(before)
        before = docs
    return docs
