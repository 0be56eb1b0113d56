"""Folder trees and watches: listings, bounded inventory, reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import natural_key
from foliant.operators.catalog import page_after
from foliant.session import written

#: Fixed limits of an inventory: documents, depth, children read of each folder.
DOCUMENTS, DEPTH, CHILDREN = 50, 3, 1_000
#: Rows of a page at most, what a file's metadata must have, the type of documents.
PAGE, REQUIRED, DOCUMENT_TYPE = 50, ("id", "name", "mimeType", "modifiedTime", "version"), "application/vnd.google-apps.document"


def children(items: DataFrame, parent: str, search: str | None = None) -> DataFrame:
    """A folder's folders and documents: folders first, then by natural name and id."""
    rows = items.filter((F.col("parent_id") == parent) & F.col("item_type").isin("folder", "document"))
    if search:
        rows = rows.filter(F.lower("name").contains(search.lower()))
    return rows.orderBy(F.when(F.col("item_type") == "folder", 0).otherwise(1), natural_key(F.col("name")), "file_id")


def children_page(items: DataFrame, parent: str, after: tuple[int, str, str] | None = None, size: int = PAGE) -> DataFrame:
    """A page of a folder's children that aren't trashed, in the same order, with token (rank, sort_key, file_id), which asks for the page after a row."""
    rank = F.when(F.col("item_type") == "folder", 0).otherwise(1)
    rows = items.filter((F.col("parent_id") == parent) & F.col("item_type").isin("folder", "document"))
    if "trashed" in items.columns:
        rows = rows.filter(~F.coalesce("trashed", F.lit(False)))
    rows = rows.withColumns({"rank": rank, "sort_key": natural_key(F.col("name"))})
    found = page_after(rows, [("rank", False), ("sort_key", False), ("file_id", False)], after, max(1, min(size, PAGE)))
    return found.withColumn("token", F.struct("rank", "sort_key", "file_id")).drop("rank", "sort_key")


def documents(items: DataFrame, size: int = PAGE) -> DataFrame:
    """The documents changed last, at most a page: by modified from the newest, then by name and id."""
    rows = items.filter(F.col("item_type") == "document")
    return rows.orderBy(F.desc("modified"), "name", "file_id").limit(max(1, min(size, PAGE)))


def scalar(tree: Column, name: str) -> Column:
    """A field of a JSON object (variant) as text; null where it is missing, null, an object or an array."""
    kind = F.schema_of_variant(F.try_variant_get(tree, f"$.{name}", "variant"))
    return F.when(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY"), F.try_variant_get(tree, f"$.{name}", "string"))


def drives(answers: DataFrame) -> DataFrame:
    """Shared drives (id, name) of JSON objects (body); those without an id or a name are left out."""
    tree = F.try_parse_json("body")
    return answers.select(*[c for c in answers.columns if c != "body"], scalar(tree, "id").alias("id"), scalar(tree, "name").alias("name")).filter("id <> '' AND name <> ''")


def metadata(answers: DataFrame) -> DataFrame:
    """The metadata of files (JSON body): REQUIRED fields and error, bad_metadata where one is missing, not_document for another type, else null."""
    tree = F.try_parse_json("body")
    rows = answers.withColumns({c: F.coalesce(scalar(tree, c), F.lit("")) for c in REQUIRED})
    missing = F.least(*[F.length(c) for c in REQUIRED]) == 0
    return rows.withColumn("error", F.when(missing, "bad_metadata").when(F.col("mimeType") != DOCUMENT_TYPE, "not_document"))


def inventory(items: DataFrame, roots: DataFrame, depth: int = DEPTH, most: int = CHILDREN) -> DataFrame:
    """All documents below roots (root_id): root_id, file_id, name, depth, path (folders joined by " / "), level by level.

    A level is one join on the parent, so that the tree's width is dealt out; each folder is entered once, at its first place
    (which also ends cycles). Of each folder the first most children are read; only those of folders that the level enters are put in order. Each level's folders are
    a written table.
    """
    order = [F.when(F.col("item_type") == "folder", 0).otherwise(1), natural_key(F.col("name")), F.col("file_id")]
    rank = F.row_number().over(Window.partitionBy("parent_id").orderBy(*order))
    front = roots.select("root_id", F.col("root_id").alias("folder_id"), F.lit("").alias("path"), F.array().cast("array<int>").alias("place"))
    entered = front.select("root_id", "folder_id")
    found = []
    for level in range(depth + 1):
        inside = items.join(front.select(F.col("folder_id").alias("parent_id")).distinct(), "parent_id", "left_semi")
        ranked = inside.withColumn("_rank", rank).filter(F.col("_rank") <= most)
        met = front.join(ranked, F.col("folder_id") == F.col("parent_id"))
        met = met.withColumn("place", F.array_append("place", F.col("_rank")))
        documents = met.filter((F.col("item_type") == "document") & F.coalesce("selectable", F.lit(True)))
        found.append(documents.select("root_id", "file_id", "name", F.lit(level).alias("depth"), "path", "place"))
        if level == depth:
            break
        folders = met.filter(F.col("item_type") == "folder").groupBy("root_id", F.col("file_id").alias("folder_id")).agg(F.min_by(F.struct("name", "path", "place"), "place").alias("f"))
        fresh = folders.join(entered, ["root_id", "folder_id"], "left_anti")
        front = written(fresh.select("root_id", "folder_id", F.concat("f.path", F.when(F.col("f.path") == "", "").otherwise(" / "), "f.name").alias("path"), "f.place"), "entered-folders")
        entered = entered.union(front.select("root_id", "folder_id"))
    rows = reduce(DataFrame.union, found)
    first = rows.groupBy("root_id", "file_id").agg(F.min_by(F.struct("name", "depth", "path", "place"), F.struct("depth", "place")).alias("d"))
    return first.select("root_id", "file_id", "d.*")


def capped(found: DataFrame, most: int = DOCUMENTS) -> DataFrame:
    """The first documents of each root in breadth-first order, with position and overflow (whether there are more)."""
    order = Window.partitionBy("root_id").orderBy("depth", "place", "file_id")
    rows = found.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= most + 1)
    rows = rows.withColumn("overflow", F.max("position").over(Window.partitionBy("root_id")) > most)
    return rows.filter(F.col("position") <= most)


def reconcile(pending: DataFrame, scope: DataFrame, excluded: DataFrame, done: DataFrame) -> DataFrame:
    """The pending files after a scan: old ones that are still in scope in their order, then new ones in listing order; without excluded
    and linked ones. pending and scope: watch_id, file_id, pos; the others: watch_id, file_id. Returns watch_id, file_id, pos from 1."""
    key = ["watch_id", "file_id"]
    once = lambda df, part: df.groupBy(*key).agg(F.min("pos").alias("pos")).withColumn("part", F.lit(part))
    both = once(pending, 0).join(scope.select(*key).distinct(), key, "left_semi").unionByName(once(scope, 1))
    first = both.groupBy(*key).agg(F.min(F.struct("part", "pos")).alias("at"))
    left = first.join(excluded.select(*key), key, "left_anti").join(done.select(*key), key, "left_anti")
    return left.select(*key, F.row_number().over(Window.partitionBy("watch_id").orderBy("at", "file_id")).alias("pos"))


def retryable(failed: DataFrame, scope: DataFrame, excluded: DataFrame) -> DataFrame:
    """Failed files that are in scope and not excluded, each once."""
    key = ["watch_id", "file_id"]
    return failed.join(scope.select(*key), key, "left_semi").join(excluded.select(*key), key, "left_anti").dropDuplicates(key)


def selected(scope: DataFrame, excluded: DataFrame) -> DataFrame:
    """Files in scope that aren't excluded, counted for each watch with repeats."""
    return scope.join(excluded.select("watch_id", "file_id"), ["watch_id", "file_id"], "left_anti").groupBy("watch_id").agg(F.count("*").alias("selected"))


def watch_summary(watches: DataFrame) -> DataFrame:
    """One row: total, importing, watching, attention (all other states)."""
    return watches.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "importing").alias("importing"), F.count_if(F.col("status") == "watching").alias("watching"), F.count_if(~F.coalesce(F.col("status").isin("importing", "watching"), F.lit(False))).alias("attention"))


def same_members(a, b):
    """Whether two arrays hold the same values as often."""
    return F.array_sort(a) == F.array_sort(b)
