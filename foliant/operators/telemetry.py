"""Check-ins of installations: validation, keyed upsert, windowed counts, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import site_hash

#: Bytes of a check-in body, characters of a field, days that a site is kept.
BODY_BYTES, FIELD_CHARS, KEEP_DAYS = 2_048, 128, 90
FIELDS = {"siteHash": "site_hash", "pluginSlug": "plugin_slug", "pluginVersion": "plugin_version", "wpVersion": "wp_version", "phpVersion": "php_version", "consentVersion": "consent_version"}


def ingest(bodies: DataFrame, slug: str) -> DataFrame:
    """Adds the fields of JSON check-ins (body) and error, which is null for valid ones. Fields that aren't strings are empty."""
    rows = bodies.withColumn("_tree", F.try_parse_json("body"))
    tree = F.col("_tree")
    text = lambda name: F.try_variant_get(tree, f"$.{name}", "string")
    is_text = lambda name: F.schema_of_variant(F.try_variant_get(tree, f"$.{name}", "variant")) == "STRING"
    field = lambda name: F.when(text(name).isNotNull() & is_text(name), F.substring(F.trim(text(name)), 1, FIELD_CHARS))
    rows = rows.withColumns({c: F.coalesce(field(n), F.lit("")) for n, c in FIELDS.items()})
    missing = F.lit(False)
    for c in ("plugin_version", "wp_version", "php_version", "consent_version"):
        missing = missing | (F.col(c) == "")
    error = (
        F.when(F.octet_length("body") > BODY_BYTES, "payload_too_large")
        .when(tree.isNull() | ~F.schema_of_variant(tree).startswith("OBJECT"), "invalid_json")
        .when(site_hash(F.col("site_hash")).isNull(), "invalid_site_hash")
        .when(F.col("plugin_slug") != slug, "invalid_plugin_slug")
        .when(missing, "missing_metadata")
    )
    return rows.withColumn("error", error).withColumn("site_hash", F.lower("site_hash")).drop("_tree")


def upsert(checkins: DataFrame, key: str, at: str, order: list[str], attributes: list[str], state: DataFrame | None = None) -> DataFrame:
    """The state after check-ins: key, first_seen, last_seen, checkin_count and the attributes of the last one (by at, then order).

    An earlier state of the same columns is a row of the aggregation, so that one shuffle merges both.
    """
    columns = [key, *attributes, "first_seen", "last_seen", "checkin_count"]
    rows = checkins.select(key, *attributes, F.col(at).alias("first_seen"), F.col(at).alias("last_seen"), F.lit(1).cast("long").alias("checkin_count"), F.struct(F.lit(1).alias("new"), *order).alias("_tie"))
    if state is not None:
        none = [F.lit(None).cast(checkins.schema[c].dataType).alias(c) for c in order]
        rows = rows.unionByName(state.select(*columns).withColumn("_tie", F.struct(F.lit(0).alias("new"), *none)))
    last = F.struct("last_seen", "_tie")
    return rows.groupBy(key).agg(*[F.max_by(c, last).alias(c) for c in attributes], F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("checkin_count").alias("checkin_count"))


def active(sites: DataFrame, since) -> DataFrame:
    """Sites seen since a time; the comparison reaches the scan."""
    return sites.filter(F.col("last_seen") >= since)


def counts_by(sites: DataFrame, columns: list[str]) -> DataFrame:
    """Installs by each of the columns in one pass: dimension, key, installs; most installs first, then by key."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("key")) for c in columns]))
    found = sites.select(pairs.alias("p")).groupBy("p.dimension", "p.key").agg(F.count("*").alias("installs"))
    return found.orderBy("dimension", F.desc("installs"), "key")


def retain(sites: DataFrame, now, days: int = KEEP_DAYS) -> DataFrame:
    """Sites seen within days before now."""
    return sites.filter(F.col("last_seen") >= now - F.make_dt_interval(F.lit(days)))
