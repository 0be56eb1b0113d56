"""Pages as trees of widgets with all their settings, in containers or in sections of one column."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import short_id
from foliant.operators.documents import grouped, widget_kind

#: Stands for a null that JSON is to show, as other nulls are left out.
_NULL = "\u0001null"


def list_items(lists: Column) -> Column:
    """The items of lists (HTML) as inline HTML, those of lists within them after their own."""

    @F.pandas_udf("array<string>")
    def items(found: pd.Series) -> pd.Series:
        from foliant.functions.markup import INLINE, cleaned, parse

        return found.map(lambda h: [" ".join(cleaned(li, INLINE).split()) for li in parse(h or "").find("li")])

    return items(lists)


def size(value: int, unit: str) -> Column:
    return F.struct(F.lit(unit).alias("unit"), F.lit(value).alias("size"), F.array().cast("array<string>").alias("sizes"))


def edge(top: int, right: int, bottom: int, left: int) -> Column:
    sides = [F.lit(str(v)).alias(n) for n, v in (("top", top), ("right", right), ("bottom", bottom), ("left", left))]
    return F.struct(F.lit("px").alias("unit"), *sides, F.lit(False).alias("isLinked"))


def wrapped(html: Column) -> Column:
    """HTML of a block; what isn't one is put into a paragraph."""
    text = F.trim(html)
    return F.when((text == "") | text.rlike(r"(?i)^<(p|h[1-6]|ul|ol|blockquote|pre|table|div|figure)\b"), text).otherwise(F.concat(F.lit("<p>"), text, F.lit("</p>")))


def widget_html() -> Column:
    """The HTML that a block's widget holds: that of an editor or of an html widget."""
    inner = F.col("inner")
    bare = F.replace(F.regexp_replace(inner, "<!-- /?wp:[^>]*-->", ""), F.lit(' class="wp-block-list"'), F.lit(""))
    table = F.regexp_extract(inner, r"(?s)(<table>.*</table>)", 1)
    quote = F.regexp_extract(inner, r"(?s)^<blockquote>(.*)</blockquote>$", 1)
    code = F.concat(F.lit("<code>"), F.regexp_extract(inner, r"(?s)^<pre>(.*)</pre>$", 1), F.lit("</code>"))
    plain = F.regexp_extract(inner, r"(?s)^<p>(.*)</p>$", 1)
    return wrapped(F.when(F.col("name") == "table", table).when(F.col("name") == "quote", quote).when(F.col("tag") == "ol", bare).when(F.col("tag") == "code", code).when(F.col("name") == "paragraph", plain).otherwise(inner))


def settings() -> Column:
    """The settings of a block's widget, by its kind and the style (hero, feature) of its group; what a kind hasn't got is null."""
    kind = widget_kind()
    is_, hero = lambda k: kind == k, F.col("style") == "hero"
    by_style = lambda a, b: F.when(hero, a).otherwise(b)
    attr = lambda name: F.coalesce(F.get_json_object("attrs", f"$.{name}"), F.lit(""))
    image = is_("image")
    icon = F.struct(F.lit("fas fa-check").alias("value"), F.lit("fa-solid").alias("library"))
    nowhere = F.struct(*[F.lit("").alias(n) for n in ("url", "is_external", "nofollow")])
    items = F.transform(list_items(F.col("inner")), lambda t: F.struct(t.alias("text"), icon.alias("selected_icon"), nowhere.alias("link")))
    large = F.when(F.col("level") <= 2, "xl").otherwise("large")
    margin = F.when(is_("heading"), edge(0, 0, 8, 0)).when(is_("text-editor"), by_style(edge(0, 0, 16, 0), edge(0, 0, 4, 0))).when(image | is_("html"), edge(8, 0, 0, 0)).when(is_("icon-list"), edge(4, 0, 4, 0))
    link = F.struct(attr("href").alias("url"), F.lit(False).alias("is_external"), F.lit(False).alias("nofollow"))
    return F.struct(
        F.when(is_("heading"), F.trim(F.regexp_extract("inner", r"(?s)^<h[1-6]>(.*)</h[1-6]>$", 1))).alias("title"),
        F.when(is_("heading"), F.concat(F.lit("h"), F.col("level").cast("string"))).alias("header_size"),
        F.when(is_("text-editor"), widget_html()).alias("editor"),
        F.when(image, F.struct(attr("url").alias("url"), F.lit(0).alias("id"), attr("alt").alias("alt"))).alias("image"),
        F.when(image, "large").alias("image_size"),
        F.when(is_("icon-list"), items).alias("icon_list"),
        F.when(is_("html"), widget_html()).alias("html"),
        F.when(is_("spacer"), F.struct(F.lit(20).alias("size"), F.lit("px").alias("unit"))).alias("space"),
        F.when(is_("heading"), by_style(F.lit("xxl"), large)).alias("size"),
        F.when(image, "center").when(is_("heading") | is_("text-editor"), by_style(F.lit("center"), F.lit("left"))).alias("align"),
        F.when(image, by_style(size(86, "%"), size(72, "%"))).alias("width"),
        F.when(image, by_style(size(92, "%"), size(86, "%"))).alias("width_tablet"),
        F.when(image, size(100, "%")).alias("width_mobile"),
        *[F.when(is_("icon-list"), size(v, "px")).alias(n) for n, v in (("space_between", 10), ("icon_size", 14), ("text_indent", 8))],
        margin.alias("_margin"),
        F.when(image & (attr("caption") != ""), "custom").alias("caption_source"),
        F.when(image & (attr("caption") != ""), attr("caption")).alias("caption"),
        F.when(image & (attr("href") != ""), link).alias("link"),
    )


def _paddings(hero: Column) -> list[Column]:
    both = {"padding": ((96, 24, 80, 24), (48, 24, 48, 24)), "padding_tablet": ((72, 22, 64, 22), (40, 22, 40, 22)), "padding_mobile": ((56, 18, 48, 18), (32, 18, 32, 18))}
    return [F.when(hero, edge(*a)).otherwise(edge(*b)).alias(n) for n, (a, b) in both.items()]


def container_settings(hero: Column) -> Column:
    only = lambda value, name: F.when(hero, value).alias(name)
    return F.struct(
        F.lit("boxed").alias("content_width"), F.when(hero, size(1120, "px")).otherwise(size(960, "px")).alias("boxed_width"), only("min-height", "height"), only(size(520, "px"), "min_height"), only(size(440, "px"), "min_height_tablet"),
        only("middle", "content_position"), F.lit("column").alias("flex_direction"), only("center", "justify_content"), F.when(hero, "center").otherwise("stretch").alias("align_items"), F.when(hero, size(24, "px")).otherwise(size(18, "px")).alias("gap"),
        only("classic", "background_background"), only("#f6f8fb", "background_color"), *_paddings(hero), F.lit("section").alias("html_tag"),
    )


def section_settings(hero: Column) -> Column:
    only = lambda value, name: F.when(hero, value).alias(name)
    return F.struct(
        F.lit("boxed").alias("layout"), F.when(hero, size(1120, "px")).otherwise(size(960, "px")).alias("content_width"), only("min-height", "height"), only(size(520, "px"), "custom_height"), only("middle", "content_position"),
        only("classic", "background_background"), only("#f6f8fb", "background_color"), *_paddings(hero), F.lit("section").alias("html_tag"),
    )


def column_settings(hero: Column) -> Column:
    return F.struct(F.lit(100).alias("_column_size"), F.lit(_NULL).alias("_inline_size"), F.when(hero, "center").alias("content_position"), F.when(hero, 24).otherwise(18).alias("space_between_widgets"))


def _node(number: Column, name: Column, kind: str, own: Column, elements: Column) -> Column:
    return F.struct(short_id(name, number).alias("id"), F.lit(kind).alias("elType"), F.lit(False).alias("isInner"), own.alias("settings"), elements.alias("elements"))


def layout(rows: DataFrame, key: str, seed: str = "layout", containers: bool = True) -> DataFrame:
    """The layout of each page as JSON (key, tree), of blocks: a container for each group of grouped with its widgets in order, or a section with one column.

    Widgets are numbered through the page, then containers, or for each group its column and its section; an id is the short hash of seed, page and number. The widgets of a page meet, as its
    tree is one text. A page without blocks has no row.
    """
    name = F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))
    placed = grouped(rows, key).withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("group", "place"))).withColumn("_all", F.count("*").over(Window.partitionBy(key)))
    node = F.struct(short_id(name, F.col("_k")).alias("id"), F.lit("widget").alias("elType"), widget_kind().alias("widgetType"), F.lit(False).alias("isInner"), settings().alias("settings"), F.array().cast("array<string>").alias("elements"))
    groups = placed.select(key, "group", "_all", "style", F.struct("_k", node.alias("node")).alias("_n")).groupBy(key, "group", "_all").agg(F.sort_array(F.collect_list(F.struct("_n._k", F.to_json("_n.node").alias("json")))).alias("_ns"), F.first("style").alias("style"))
    hero, at = F.col("style") == "hero", F.col("_all") + F.col("group") * (1 if containers else 2) + 1
    inside = F.lit("\u0002")
    if containers:
        outer = F.to_json(_node(at, name, "container", container_settings(hero), F.array(inside)))
    else:
        column = _node(at, name, "column", column_settings(hero), F.array(inside))
        outer = F.to_json(_node(at + 1, name, "section", section_settings(hero), F.array(column)))
    shown = F.replace(F.replace(outer, F.lit('"\\u0001null"'), F.lit("null")), F.lit('"\\u0002"'), F.array_join(F.transform("_ns", lambda n: n.json), ","))
    pages = groups.select(key, "group", shown.alias("_shown")).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("group", "_shown"))).alias("_gs"))
    return pages.select(key, F.concat(F.lit("["), F.array_join(F.transform("_gs", lambda g: g._shown), ","), F.lit("]")).alias("tree"))
