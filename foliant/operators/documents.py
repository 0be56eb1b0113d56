"""Documents as blocks: HTML parts, sections, heroes, code and list runs, widget ids, assets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from foliant.functions.text import image_source, short_id
from foliant.operators.catalog import delete_attributes
from foliant.session import written

BLOCK_SCHEMA = "pos int, name string, role string, tag string, level int, depth int, attrs string, text string, inner string"
#: Blocks, and characters of them, after which a task hands on what it has.
HANDED_ROWS, HANDED_CHARS = 4_096, 4_000_000


def blocks(pages: DataFrame, key: str = "page_id", preset: str = "plain_blocks", whole: bool = True) -> DataFrame:
    """One row for each block of pages (key, html): key, pos (from 0), name, role, tag, level, depth, attrs, text, inner; attrs and inner only where blocks are wanted whole.

    A task holds the blocks of a page, and those that it has still to hand on, but never those of a batch of pages.
    """
    fields = StructType([StructField(key, pages.schema[key].dataType), *[f for f in StructType.fromDDL(BLOCK_SCHEMA) if whole or f.name not in ("attrs", "inner")]])
    schema = [pa.int32() if f.dataType == IntegerType() else pa.string() for f in fields[1:]]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from foliant.functions.markup import block_rows

        for batch in batches:
            at, rows, chars = [], [], 0
            for k, html in enumerate(batch.column(1).to_pylist()):
                own = block_rows(html or "", preset, whole)
                for pos, (name, role, tag, level, depth, attrs, text, inner) in enumerate(own):
                    at.append(k)
                    rows.append((pos, name, role, tag, level, depth, attrs, text, inner) if whole else (pos, name, role, tag, level, depth, text))
                    chars += len(attrs) + len(text) + len(inner)
                    if len(at) >= HANDED_ROWS or chars >= HANDED_CHARS:
                        yield handed(batch.column(0), at, rows)
                        at, rows, chars = [], [], 0
            if at:
                yield handed(batch.column(0), at, rows)

    def handed(keys: pa.Array, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), schema, strict=True)]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(at)), *columns], fields.names)

    return spread(pages.select(key, "html")).mapInArrow(found, fields)


@F.udtf(returnType="pos: int, name: string, role: string, tag: string, level: int, depth: int, attrs: string, text: string, inner: string")
class HtmlBlocks:
    """html_blocks(html, preset) in SQL: the blocks of a page in order, as blocks has them."""

    def eval(self, html: str, preset: str):
        from foliant.functions.markup import page_blocks

        for pos, b in enumerate(page_blocks(html or "", preset)):
            yield pos, b["name"], b["role"], b["tag"], b["level"], b["depth"], b["attrs"], b["text"], b["inner"]


def register(spark: SparkSession) -> None:
    """Makes html_blocks known to SQL."""
    spark.udtf.register("html_blocks", HtmlBlocks)


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a few files dealt out to all cores, for work in Python that takes far longer than a shuffle; those of many files stay where they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.isStreaming or len(rows.inputFiles()) >= cores else rows.repartition(cores)


def rendered(pages: DataFrame, key: str = "page_id", preset: str = "plain_blocks") -> DataFrame:
    """The serialised blocks of each page: key, content, layout_hash."""

    @F.pandas_udf("string")
    def content(html: pd.Series) -> pd.Series:
        from foliant.functions.markup import page_blocks, serialized

        return html.fillna("").map(lambda h: serialized(page_blocks(h, preset)))

    return spread(pages.select(key, "html")).select(key, content("html").alias("content")).withColumn("layout_hash", F.sha2(F.concat(F.lit(f"{preset}:"), "content"), 256))


def sections(rows: DataFrame, key: str, heading: str = "is_heading") -> DataFrame:
    """Adds section: a heading begins a new one unless it is the first row, so that what stands before it is a section too."""
    order = Window.partitionBy(key).orderBy("pos")
    begins = F.when(F.col(heading) & (F.row_number().over(order) > 1), 1).otherwise(0)
    return rows.withColumn("_b", begins).withColumn("section", F.sum("_b").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_b")


def heroes(rows: DataFrame, key: str) -> DataFrame:
    """Of blocks: key, heading_pos (first h1 or h2), text_pos (first paragraph with text after it), image_pos (first image anywhere), hero
    (whether there are a heading and a text)."""
    is_text = _is_text()
    least = lambda c, n: F.min(F.when(c, F.col("pos"))).alias(n)
    texts = F.collect_list(F.when(is_text, F.col("pos"))).alias("_texts")  # one number for each paragraph of a page
    found = rows.groupBy(key).agg(least(F.col("level").isin(1, 2), "heading_pos"), least(F.col("name") == "image", "image_pos"), texts)
    found = found.withColumn("text_pos", F.array_min(F.filter("_texts", lambda p: p > F.col("heading_pos")))).drop("_texts")
    return found.select(key, "heading_pos", "image_pos", "text_pos", (F.col("heading_pos").isNotNull() & F.col("text_pos").isNotNull()).alias("hero"))


def grouped(rows: DataFrame, key: str) -> DataFrame:
    """Blocks with group and style: on a page with a hero, its heading, text and first image are group 0 (hero), in that order; the other blocks
    (feature) begin a group at each heading that isn't the first of them. place orders the blocks of a group."""
    return _in_groups(rows.withColumn("_x", _is_text()), key).drop("_x")


def _is_text() -> Column:
    return (F.col("tag") == "p") & (F.trim("text") != "") & (F.col("name") == "paragraph")


def _in_groups(rows: DataFrame, key: str) -> DataFrame:
    """grouped, of blocks with pos, level, name and _x (whether it is a paragraph with text)."""
    order = Window.partitionBy(key).orderBy("pos")  # one order for all that follows, so that blocks are sorted once
    page, upto = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    least = lambda c: F.min(F.when(c, F.col("pos"))).over(page)
    found = rows.withColumn("_h", least(F.col("level").isin(1, 2))).withColumn("_i", least(F.col("name") == "image"))
    found = found.withColumn("_t", least(F.col("_x") & (F.col("pos") > F.col("_h"))))
    has = F.col("_h").isNotNull() & F.col("_t").isNotNull()
    rank = F.when(has & (F.col("pos") == F.col("_h")), 0).when(has & (F.col("pos") == F.col("_t")), 1).when(has & (F.col("pos") == F.col("_i")), 2)
    found = found.withColumn("_r", rank).withColumn("style", F.when(F.col("_r").isNotNull(), "hero").otherwise("feature"))
    feature = F.col("_r").isNull()
    found = found.withColumn("_f", F.min(F.when(feature, F.col("pos"))).over(page))
    begins = F.when(feature & (F.col("level") > 0) & (F.col("pos") > F.col("_f")), 1).otherwise(0)
    turns = found.withColumn("_n", F.sum(begins).over(upto))
    group = F.when(F.col("style") == "hero", 0).otherwise(F.col("_n") + F.when(has, 1).otherwise(0))
    return turns.withColumn("group", group.cast("int")).withColumn("place", F.coalesce("_r", F.col("pos"))).drop("_h", "_i", "_t", "_r", "_f", "_n")


def runs(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Runs of equal values in order: key, run (from 1), value, first, last, n."""
    w = Window.partitionBy(key).orderBy(order)
    turns = rows.withColumn("_t", F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    numbered = turns.withColumn("run", F.sum("_t").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(key, "run").agg(F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def list_runs(paragraphs: DataFrame, key: str) -> DataFrame:
    """Lists of paragraphs (key, pos, list_key, text): neighbours of one list_key are a list; empty paragraphs don't part them, others do."""
    filled = paragraphs.filter(F.trim("text") != "")
    return runs(filled, key, "pos", "list_key").filter(F.col("list_key").isNotNull())


def code_runs(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Runs of code lines in documents: key, first_line, last_line, kind, code."""

    @F.pandas_udf("array<struct<first_line:int,last_line:int,kind:string,code:string>>")
    def found(texts: pd.Series) -> pd.Series:
        from foliant.functions.code_lines import code_runs

        return texts.fillna("").map(lambda t: [dict(zip(("first_line", "last_line", "kind", "code"), r, strict=True)) for r in code_runs(t.replace("\r\n", "\n").replace("\r", "\n").split("\n"))])

    return documents.select(key, F.explode(found(text)).alias("r")).select(key, "r.*")


def widget_kind() -> Column:
    """The kind of widget that a block becomes."""
    return F.when(F.col("level") > 0, "heading").when(F.col("name") == "image", "image").when(F.col("tag") == "ul", "icon-list").when(F.col("name").isin("table", "html"), "html").when(F.col("name") == "separator", "divider").when(F.trim("text") == "", "spacer").otherwise("text-editor")


def widget_tree(rows: DataFrame, key: str, seed: str = "layout") -> DataFrame:
    """The widget tree of each page as JSON (key, tree): a container for each group of grouped, with its widgets in order.

    Widgets are numbered through the page, then containers; an id is the short hash of seed, page and number. Settings hold a widget's title and size, its
    image, its list items as HTML, or its HTML.
    """
    image = lambda name: F.coalesce(F.get_json_object("attrs", f"$.{name}"), F.lit(""))
    none = F.lit(None).cast("string")
    settings = F.struct(
        F.when(widget_kind() == "heading", F.regexp_extract("inner", r"^<h[1-6]>(.*)</h[1-6]>$", 1)).alias("title"),
        F.when(widget_kind() == "heading", F.concat(F.lit("h"), F.col("level").cast("string"))).alias("header_size"),
        F.when(widget_kind() == "image", F.struct(image("url").alias("url"), F.lit(0).alias("id"), image("alt").alias("alt"))).alias("image"),
        F.when(widget_kind() == "text-editor", F.col("inner")).alias("editor"),
        F.when(widget_kind() == "icon-list", F.col("inner")).alias("icon_list"),
        F.when(widget_kind() == "html", F.col("inner")).alias("html"),
    )
    name = F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))
    # settings are made before blocks meet, so that nothing else of them moves; the blocks of a page meet in one list, and a group is a slice of it
    found = _in_groups(rows.select(key, "pos", "level", "name", _is_text().alias("_x"), widget_kind().alias("kind"), settings.alias("settings")), key)
    pages = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("group", "place", "style", "kind", "settings"))).alias("ns"))
    widget = lambda n, k: F.struct(short_id(name, k + 1).alias("id"), F.lit("widget").alias("elType"), n.kind.alias("widgetType"), F.lit(False).alias("isInner"), n.settings.alias("settings"), F.array().cast("array<string>").alias("elements"))
    pages = pages.withColumn("nodes", F.transform("ns", widget)).withColumn("_ends", F.expr("filter(sequence(1, size(ns)), k -> k = size(ns) OR element_at(ns, k).group <> element_at(ns, least(k + 1, size(ns))).group)"))
    pages = pages.withColumn("_begins", F.expr("transform(_ends, (e, k) -> IF(k = 0, 1, element_at(_ends, greatest(k, 1)) + 1))")).withColumn("cs", F.arrays_zip("_begins", "_ends"))
    first = lambda c: F.element_at("ns", c["_begins"])
    container = lambda c: F.struct(short_id(name, F.size("ns") + first(c).group + 1).alias("id"), F.lit("container").alias("elType"), none.alias("widgetType"), F.lit(False).alias("isInner"), first(c).style.alias("style"), F.slice("nodes", c["_begins"], c["_ends"] - c["_begins"] + 1).alias("elements"))
    return pages.select(key, F.to_json(F.transform("cs", container)).alias("tree"))


def widget_attributes(trees: DataFrame, key: str, attributes: DataFrame) -> DataFrame:
    """Attributes (key, meta_key, meta_value) after trees are stored: the tree and its mode replace what was there, and cached styles go."""
    gone = ["layout_data", "layout_mode", "layout_styles"]
    new = trees.select(key, F.explode(F.array(F.struct(F.lit("layout_data").alias("k"), F.col("tree").alias("v")), F.struct(F.lit("layout_mode").alias("k"), F.lit("builder").alias("v")))).alias("a"))
    return delete_attributes(attributes, trees, key, gone).unionByName(new.select(key, F.col("a.k").alias("meta_key"), F.col("a.v").alias("meta_value")))


def joined(lines: DataFrame, key: str, order: str, value: str, by: str = "\n") -> DataFrame:
    """The texts of each key in order, joined: key, joined. All lines of a key meet, as they are one text."""
    rows = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("_ls"))
    return rows.select(key, F.array_join(F.transform("_ls", lambda x: x.v), by).alias("joined"))


def write_posts(posts: DataFrame, updates: DataFrame, drafts: DataFrame) -> DataFrame:
    """Posts (post_id, title, content, status) after updates (post_id, content), which replace contents of posts that are there, and drafts (post_id, title, content, status), which
    are put in where the id is new; a status other than publish is draft."""
    new = updates.groupBy("post_id").agg(F.max_by("content", "content").alias("_new"))
    changed = posts.join(new, "post_id", "left").withColumn("content", F.coalesce("_new", "content")).drop("_new")
    status = F.when(F.col("status") == "publish", "publish").otherwise("draft")
    return changed.unionByName(drafts.join(posts.select("post_id"), "post_id", "left_anti").withColumn("status", status).select(*posts.columns))


def widgets(rows: DataFrame, key: str, seed: str = "layout") -> DataFrame:
    """Widgets of blocks in sections: adds widget, and ids that number a page's widgets first, then its sections."""
    order = Window.partitionBy(key).orderBy("pos")
    count = F.count("*").over(Window.partitionBy(key))
    name = F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))
    found = sections(rows.withColumn("is_heading", F.col("level") > 0), key).withColumn("widget", widget_kind())
    return found.withColumn("widget_id", short_id(name, F.row_number().over(order))).withColumn("section_id", short_id(name, count + F.col("section") + 1))


def new_assets(found: DataFrame, known: DataFrame) -> DataFrame:
    """Assets (file_id, asset_path, sha256) that aren't known, each once."""
    key = ["file_id", "asset_path", "sha256"]
    return found.select(*key).join(known.select(*key), key, "left_anti").dropDuplicates(key)


def asset_urls(found: DataFrame, known: DataFrame) -> DataFrame:
    """Each asset with the address it is known by, or null; of several that are known the first by address."""
    key = ["file_id", "asset_path", "sha256"]
    return found.join(known.groupBy(*key).agg(F.min("url").alias("url")), key, "left")


def put_images(pages: DataFrame, assets: DataFrame, key: str = "page_id") -> DataFrame:
    """Pages (key, file_id, html) with the addresses of their images in place: key, html, error (image_missing, image_unsafe or null).

    assets: file_id, asset_path, sha256 and url of what is stored; the least sha256 of a path counts. A local source is met by its path without query and fragment, decoded;
    remote, inline and empty sources stay. A page with a source that leaves its folder, or that isn't stored, has an error and no html.

    A page's html is cut into an array at its images and stays one row; only sources are exploded and joined, so that neither a page of very many images nor a file of very many
    pages moves html about. A null html is null; repeated keys are one page.
    """

    @F.pandas_udf("array<string>")
    def cuts(html: pd.Series) -> pd.Series:
        from foliant.functions.markup import image_cuts

        return html.map(lambda h: None if h is None else image_cuts(h))

    spark = pages.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # named, or small pages would be put together into one task, and be cut on one core
    once = pages.repartition(parts, key).groupBy(key).agg(F.min(F.struct("file_id", "html")).alias("_p")).select(key, "_p.file_id", cuts("_p.html").alias("_cut"))
    once = written(once, "image-cuts")  # so that pages are cut once
    is_source = F.transform("_cut", lambda x, k: F.struct(k.alias("k"), F.when(k % 2 == 1, x).alias("raw")))
    sources = once.select(key, "file_id", F.explode(F.filter(is_source, lambda x: x.raw.isNotNull())).alias("_s")).withColumn("_source", image_source(F.regexp_replace("_s.raw", "^[\"']|[\"']$", "")))
    local = sources.filter(F.col("_source.kind") != "remote").select(key, "file_id", F.col("_s.k").alias("_k"), "_source.kind", F.col("_source.path").alias("asset_path"))
    stored = assets.groupBy("file_id", "asset_path").agg(F.min(F.struct("sha256", "url")).alias("_a")).select("file_id", "asset_path", "_a.url")
    met = local.join(stored, ["file_id", "asset_path"], "left")
    wrong = F.when(F.col("kind") == "unsafe", "image_unsafe").when(F.col("url").isNull(), "image_missing")
    urls = met.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_k", "url"))).alias("_urls"), F.min_by(wrong, F.when(wrong.isNotNull(), F.col("_k"))).alias("error"))
    quoted = lambda url: F.concat(F.lit('"'), F.replace(F.replace(url, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit('"'))
    parts = F.transform("_cut", lambda x, k: F.coalesce(quoted(F.try_element_at("_urls", k)), x))
    return once.join(urls, key, "left").select(key, F.when(F.col("error").isNull(), F.array_join(parts, "")).alias("html"), "error")


def flushes(elements: DataFrame, key: str, every: int = 20) -> DataFrame:
    """The elements (key, pos from 1) after which a partial result is written: each every-th one and the last."""
    last = F.max("pos").over(Window.partitionBy(key))
    return elements.withColumn("_last", last).filter((F.col("pos") % every == 0) | (F.col("pos") == F.col("_last"))).drop("_last")


