"""Queries of document trees as HTML, and of pages with their images put in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import rules
from foliant.operators import documents, layouts
from foliant.plans.models import table
from foliant.plans.queries import query
from foliant.sources import exports

# Trees made of parts: a heading, a list whose items change between bulleted and numbered, a table with a list and a table in it, and a tab with links, rules and images.


def _run(text: str, style: str = "") -> str:
    """SQL of a text run; text is SQL, style JSON."""
    return f"""'{{"textRun":{{"content":"', {text}, '"{f',"textStyle":{style}' if style else ''}}}}}'"""


def _paragraph(elements: str, more: str = "") -> str:
    return f"""'{{"paragraph":{{"elements":[', {elements}, ']{more}}}}}'"""


_BULLET = """array_join(transform(sequence(1, p_size % 6), i -> concat('{"paragraph":{"elements":[{"textRun":{"content":"item ', i, '\\\\n"}}],"bullet":{"listId":"L1","nestingLevel":', i div 2 % 2, '}}}')), ',')"""
_CELL_LIST = """'{"paragraph":{"elements":[{"textRun":{"content":"in"}}],"bullet":{"listId":"L1"}}}'"""
_TREE = (
    """concat('{"lists":{"L1":{"listProperties":{"nestingLevels":[{},{"glyphType":"DECIMAL"}]}}},"tabs":[{"documentTab":{"body":{"content":[{"sectionBreak":{}},', """
    + _paragraph(_run("p_name"), ""","paragraphStyle":{"namedStyleType":"HEADING_', p_partkey % 8, '"}""")
    + ", CASE WHEN p_size % 6 = 0 THEN '' ELSE ',' END, CASE WHEN p_size % 6 = 0 THEN '' ELSE " + _BULLET + " END, ',', "
    + _paragraph(_run("'\\\\n'"))
    + """, ',{"table":{"tableRows":[{"tableCells":[{"content":[', """ + _paragraph(_run("p_brand", '{"bold":true,"italic":true}'))
    + """, ']},{"content":[', """ + _CELL_LIST + """, ',{"table":{"tableRows":[{"tableCells":[{}]},7]}}]}]}]}}', """
    + """']}},"childTabs":[null,{"documentTab":{"inlineObjects":{"o":{"inlineObjectProperties":{"embeddedObject":{"description":"A & B","imageProperties":{"contentUri":"https://host/', p_partkey, '.png?a=1&b=2"}}}}},"body":{"content":[', """
    + _paragraph(_run("'go'", """{"underline":true,"link":{"url":"', CASE WHEN p_partkey % 5 = 0 THEN 'javascript:x()' ELSE 'https://host/?q=1' END, '"}}""") + """, ',{"richLink":{"richLinkProperties":{"title":"T","uri":"mailto:a"}}}'""")
    + """, CASE WHEN p_partkey % 3 = 0 THEN ',{"paragraph":{"elements":[{"inlineObjectElement":{"inlineObjectId":"o"}}]}}' ELSE '' END, CASE WHEN p_partkey % 4 = 0 THEN ',{"paragraph":{"elements":[{"horizontalRule":{}}]}}' ELSE '' END, """
    + """array_join(transform(CASE WHEN p_partkey % 30 > 0 THEN sequence(1, p_partkey % 30) ELSE array() END, i -> concat(',{"paragraph":{"elements":[{"textRun":{"content":"', i, '"}}],"bullet":{"listId":"L2"}}}')), ''), """
    + """']}}}]}]}')"""
)
#: The pieces of a tree in SQL: the html of each element, and what closes after it.
_TREE_SQL = """
WITH p AS (SELECT p_partkey AS k, p_name AS n, p_brand AS b, p_size % 6 AS s, p_partkey % 30 AS m FROM part),
e AS (
  SELECT k, 1 AS o, 0 AS i, '' AS html, '' AS closes FROM p
  UNION ALL SELECT k, 2, 0, CASE WHEN k % 8 BETWEEN 1 AND 6 THEN concat('<h', k % 8, '>', n, '</h', k % 8, '>') ELSE concat('<p>', n, '</p>') END, '' FROM p
  UNION ALL SELECT k, 3, i, concat(CASE WHEN i = 1 THEN '<ul>' WHEN (i // 2) % 2 <> ((i - 1) // 2) % 2 THEN CASE WHEN (i // 2) % 2 = 1 THEN '</ul><ol>' ELSE '</ol><ul>' END ELSE '' END, '<li>item ', i, '</li>'),
    CASE WHEN (i // 2) % 2 = 1 THEN '</ol>' ELSE '</ul>' END FROM p, unnest(generate_series(1, s)) AS g(i)
  UNION ALL SELECT k, 4, 0, '', CASE WHEN s = 0 THEN '' WHEN (s // 2) % 2 = 1 THEN '</ol>' ELSE '</ul>' END FROM p
  UNION ALL SELECT k, 5, 0, concat(CASE WHEN s = 0 THEN '' WHEN (s // 2) % 2 = 1 THEN '</ol>' ELSE '</ul>' END, '<table><tbody><tr><td><p><em><strong>', b, '</strong></em></p></td><td><ul><li>in</li></ul><table><tbody><tr><td></td></tr></tbody></table></td></tr></tbody></table>'), '' FROM p
  UNION ALL SELECT k, 6, 0, concat('<p><a href="', CASE WHEN k % 5 = 0 THEN '' ELSE 'https://host/?q=1' END, '"><u>go</u></a><a href="mailto:a">T</a></p>'), '' FROM p
  UNION ALL SELECT k, 7, 0, concat('<p><img src="https://host/', k, '.png?a=1&#038;b=2" alt="A &amp; B" /></p>'), '' FROM p WHERE k % 3 = 0
  UNION ALL SELECT k, 8, 0, '<hr />', '' FROM p WHERE k % 4 = 0
  UNION ALL SELECT k, 9, i, concat(CASE WHEN i = 1 THEN '<ul>' ELSE '' END, '<li>', i, '</li>', CASE WHEN i = m THEN '</ul>' ELSE '' END), CASE WHEN i = m THEN '' ELSE '</ul>' END FROM p, unnest(generate_series(1, m)) AS g(i)),
q AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o, i) AS pos, count(*) OVER (PARTITION BY k) AS total, string_agg(html, '') OVER (PARTITION BY k ORDER BY o, i) AS so_far FROM e)"""


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.expr(_TREE).alias("document"))


@query("tree_html", _TREE_SQL + " SELECT k AS doc_id, so_far AS html, CAST(NULL AS VARCHAR) AS error FROM q WHERE pos = total")
def tree_html(spark, sf_dir):
    return exports.document_html(exports.html_pieces(trees(spark, sf_dir)))


@query("tree_partials", _TREE_SQL + " SELECT k AS doc_id, pos AS rendered, total, so_far || closes AS html FROM q WHERE pos % 20 = 0 OR pos = total")
def tree_partials(spark, sf_dir):
    return exports.partial_html(exports.html_pieces(trees(spark, sf_dir)))


@query("tree_pieces_sql", _TREE_SQL + " SELECT k AS doc_id, pos, html, closes FROM q")
def tree_pieces_sql(spark, sf_dir):
    """The function as SQL calls it."""
    exports.register(spark)
    return spark.sql("SELECT doc_id, p.pos, p.html, p.closes FROM {trees} LATERAL VIEW inline(document_pieces(document)) p AS pos, total, html, closes, error", trees=documents.spread(trees(spark, sf_dir)))


@query("html_blocks_sql", "SELECT page_id, 0 AS pos, 'heading' AS name, 2 AS level, '<h2>' || replace(url, '&', '&amp;') || '</h2>' AS inner FROM pages UNION ALL SELECT page_id, 1, 'list', 0, '<ul class=\"wp-block-list\"><!-- wp:list-item --><li>' || page_id || '<!-- wp:list {\"ordered\":true} --><ol class=\"wp-block-list\"><!-- wp:list-item --><li>b</li><!-- /wp:list-item --></ol><!-- /wp:list --></li><!-- /wp:list-item --></ul>' FROM pages UNION ALL SELECT page_id, 2, 'table', 0, '<figure class=\"wp-block-table\"><table><tr><td colspan=\"2\">c</td></tr></table></figure>' FROM pages WHERE page_id % 2 = 0")
def html_blocks_sql(spark, sf_dir):
    documents.register(spark)
    html = F.expr("concat('<h2>', url, '</h2><ul><li>', page_id, '<ol><li>b</ol></ul>', CASE WHEN page_id % 2 = 0 THEN '<table class=x><tr><td colspan=2 style=y>c</table>' ELSE '' END)")
    pages = table(spark, sf_dir, "pages").select("page_id", html.alias("html"))
    return spark.sql("SELECT page_id, b.pos, b.name, b.level, b.inner FROM {pages}, LATERAL html_blocks(html, 'plain_blocks') AS b", pages=pages)


# Images: every order is a page with some, of which the parts are the files.

_PICTURES = """concat('<p>', o_orderkey, '</p><IMG alt="a > b" src="images/i', o_orderkey % 50, '.png?w=1"><p>x</p><img src=''https://host/r.png'' /><img src=images/i%20', o_orderkey % 3, '.png>', CASE WHEN o_orderkey % 40 = 7 THEN '<img src="../up.png"><img src="gone.png">' WHEN o_orderkey % 40 = 8 THEN '<img src="gone.png">' ELSE '<img class="none">' END, 'end')"""


@query("images_put", "SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 40 NOT IN (7, 8) THEN concat('<p>', o_orderkey, '</p><IMG alt=\"a > b\" src=\"images/i', o_orderkey % 50, '.png?w=1\"><p>x</p><img src=''https://host/r.png'' /><img src=\"https://media/', o_orderkey % 7, '/i ', o_orderkey % 3, '.png\"><img class=\"none\">end') END AS html, CASE o_orderkey % 40 WHEN 7 THEN 'image_unsafe' WHEN 8 THEN 'image_missing' END AS error FROM orders".replace('src="images/i\', o_orderkey % 50, \'.png?w=1"', 'src="https://media/\', o_orderkey % 7, \'/\', o_orderkey % 50, \'?a=1&amp;b=2"'))
def images_put(spark, sf_dir):
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), F.expr("concat('f', o_orderkey % 7)").alias("file_id"), F.expr(_PICTURES).alias("html"))
    keys = table(spark, sf_dir, "part").filter("p_partkey < 400").select((F.col("p_partkey") % 7).alias("f"), (F.col("p_partkey") % 50).alias("i")).distinct()
    plain = keys.select(F.expr("concat('f', f)").alias("file_id"), F.expr("concat('images/i', i, '.png')").alias("asset_path"), F.lit("a").alias("sha256"), F.expr("concat('https://media/', f, '/', i, '?a=1&b=2')").alias("url"))
    spaced = keys.filter("i < 3").select(F.expr("concat('f', f)").alias("file_id"), F.expr("concat('images/i ', i, '.png')").alias("asset_path"), F.lit("a").alias("sha256"), F.expr("concat('https://media/', f, '/i ', i, '.png')").alias("url"))
    return documents.put_images(pages, plain.union(spaced))


# Layouts: pages with a hero and a widget of every kind.

_LAYOUT_PAGE = """concat('<h1>T', page_id, '</h1><p>Lead of ', page_id, '</p><p><img src="https://h/', page_id, '.png" alt="A"></p><p> </p><h3>More</h3><ul><li>one <b>b</b><li>two</ul><ol><li>x</ol><table class="t"><tr><td>c</table><blockquote>said</blockquote><hr><a href="https://h/"><img src="i.png"></a>', CASE WHEN page_id % 2 = 0 THEN '<section><dl>d</dl></section>' ELSE '' END)"""


def _sized(value: int, unit: str = "px") -> str:
    return f'{{"unit":"{unit}","size":{value},"sizes":[]}}'


def _edged(top: int, right: int, bottom: int, left: int) -> str:
    return f'{{"unit":"px","top":"{top}","right":"{right}","bottom":"{bottom}","left":"{left}","isLinked":false}}'


def _id(number: str) -> str:
    return f"' || substring(sha256(concat('layout:', page_id, ':', {number})), 1, 8) || '"


def _widget(number: str, kind: str, own: str) -> str:
    return f'{{"id":"{_id(number)}","elType":"widget","widgetType":"{kind}","isInner":false,"settings":{{{own}}},"elements":[]}}'


def _item(text: str) -> str:
    return f'{{"text":"{text}","selected_icon":{{"value":"fas fa-check","library":"fa-solid"}},"link":{{"url":"","is_external":"","nofollow":""}}}}'


def _picture(url: str, alt: str, widths: tuple[int, int], more: str = "") -> str:
    return f'"image":{{"url":"{url}","id":0,"alt":"{alt}"}},"image_size":"large","align":"center","width":{_sized(widths[0], "%")},"width_tablet":{_sized(widths[1], "%")},"width_mobile":{_sized(100, "%")},"_margin":{_edged(8, 0, 0, 0)}{more}'


def _text(html: str, align: str = "left", below: int = 4) -> str:
    return f'"editor":"{html}","align":"{align}","_margin":{_edged(0, 0, below, 0)}'


_PADS = {True: [(96, 24, 80, 24), (72, 22, 64, 22), (56, 18, 48, 18)], False: [(48, 24, 48, 24), (40, 22, 40, 22), (32, 18, 32, 18)]}
_HERO = [
    _widget("1", "heading", f'"title":"T\' || page_id || \'","header_size":"h1","size":"xxl","align":"center","_margin":{_edged(0, 0, 8, 0)}'), _widget("2", "text-editor", _text("<p>Lead of ' || page_id || '</p>", "center", 16)), _widget("3", "image", _picture("https://h/' || page_id || '.png", "A", (86, 92))),
]
_SPACER = _widget("4", "spacer", '"space":{"size":20,"unit":"px"}')
_FEATURE = [
    _widget("5", "heading", f'"title":"More","header_size":"h3","size":"large","align":"left","_margin":{_edged(0, 0, 8, 0)}'),
    _widget("6", "icon-list", f'"icon_list":[{_item("one b")},{_item("two")}],"space_between":{_sized(10)},"icon_size":{_sized(14)},"text_indent":{_sized(8)},"_margin":{_edged(4, 0, 4, 0)}'),
    _widget("7", "text-editor", _text("<ol><li>x</li></ol>")), _widget("8", "html", f'"html":"<table><tr><td>c</td></tr></table>","_margin":{_edged(8, 0, 0, 0)}'), _widget("9", "text-editor", _text("<p>said</p>")), _widget("10", "divider", ""),
    _widget("11", "image", _picture("i.png", "", (72, 86), ',"link":{"url":"https://h/","is_external":false,"nofollow":false}')),
]
_LAST = """' || CASE WHEN page_id % 2 = 0 THEN '""" + "," + _widget("12", "html", f'"html":"<dl>d</dl>","_margin":{_edged(8, 0, 0, 0)}').replace("<dl>d</dl>", "<p><dl>d</dl></p>") + """' ELSE '' END || '"""
_ALL = "(11 + CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END)"


def _box(group: int, hero: bool, elements: str) -> str:
    pads = ",".join(f'"{n}":{_edged(*p)}' for n, p in zip(("padding", "padding_tablet", "padding_mobile"), _PADS[hero], strict=True))
    own = f'"content_width":"boxed","boxed_width":{_sized(1120 if hero else 960)},' + (f'"height":"min-height","min_height":{_sized(520)},"min_height_tablet":{_sized(440)},"content_position":"middle",' if hero else "") + '"flex_direction":"column",' + ('"justify_content":"center",' if hero else "")
    own += f'"align_items":"{"center" if hero else "stretch"}","gap":{_sized(24 if hero else 18)},' + ('"background_background":"classic","background_color":"#f6f8fb",' if hero else "") + pads + ',"html_tag":"section"'
    return f'{{"id":"{_id(f"{_ALL} + {group + 1}")}","elType":"container","isInner":false,"settings":{{{own}}},"elements":[{elements}]}}'


def _section(group: int, hero: bool, elements: str) -> str:
    pads = ",".join(f'"{n}":{_edged(*p)}' for n, p in zip(("padding", "padding_tablet", "padding_mobile"), _PADS[hero], strict=True))
    own = f'"layout":"boxed","content_width":{_sized(1120 if hero else 960)},' + (f'"height":"min-height","custom_height":{_sized(520)},"content_position":"middle","background_background":"classic","background_color":"#f6f8fb",' if hero else "") + pads + ',"html_tag":"section"'
    column = f'{{"id":"{_id(f"{_ALL} + {2 * group + 1}")}","elType":"column","isInner":false,"settings":{{"_column_size":100,"_inline_size":null,' + ('"content_position":"center",' if hero else "") + f'"space_between_widgets":{24 if hero else 18}}},"elements":[{elements}]}}'
    return f'{{"id":"{_id(f"{_ALL} + {2 * group + 2}")}","elType":"section","isInner":false,"settings":{{{own}}},"elements":[{column}]}}'


def _layout_sql(box) -> str:
    return "SELECT page_id, '[" + ",".join([box(0, True, ",".join(_HERO)), box(1, False, _SPACER), box(2, False, ",".join(_FEATURE) + _LAST)]) + "]' AS tree FROM pages"


def layout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.blocks(table(spark, sf_dir, "pages").select("page_id", F.expr(_LAYOUT_PAGE).alias("html")))


@query("layout_containers", _layout_sql(_box))
def layout_containers(spark, sf_dir):
    return layouts.layout(layout_blocks(spark, sf_dir), "page_id")


@query("layout_sections", _layout_sql(_section))
def layout_sections(spark, sf_dir):
    return layouts.layout(layout_blocks(spark, sf_dir), "page_id", containers=False)


_SEED = '{{"id":"{}","version":"{}","demote_top_level_headings":{},"render_code_blocks":{},"render_callouts":{}}}'


@query("preset_fingerprints", "SELECT doc_id, sha256(CASE doc_id % 4 WHEN 1 THEN '" + _SEED.format("clean_article", 2, "true", "false", "false") + "' WHEN 2 THEN '" + _SEED.format("documentation", 3, "false", "true", "true") + "' ELSE '" + _SEED.format("plain_blocks", 2, "false", "false", "false") + "' END) AS fingerprint FROM documents")
def preset_fingerprints(spark, sf_dir):
    preset = F.expr("CASE doc_id % 4 WHEN 0 THEN 'plain_blocks' WHEN 1 THEN 'clean_article' WHEN 2 THEN 'documentation' ELSE 'other' END")
    return table(spark, sf_dir, "documents").select("doc_id", rules.preset_fingerprint(preset).alias("fingerprint"))
