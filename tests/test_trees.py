"""Readers of trees, packages and pages: odd and damaged input, any depth, images put in place."""

from __future__ import annotations

import io
import json
import random
import zipfile

import pytest

from foliant.functions import doc_trees, markup, nested
from foliant.operators import catalog, documents, events
from foliant.sources import exports

DEEP = 100_000


@pytest.mark.parametrize("html", ["<div>" * DEEP + "x", "<b>" * DEEP + "x", "<ul><li>" * DEEP + "x", "<table><tr><td>" * DEEP + "x", "<p>" + "<i>" * DEEP + "x</i><p>x", "<foo>" * DEEP + "x", "<blockquote>" * DEEP + "x"])
def test_pages_of_any_depth(html):
    for preset in markup.PRESETS:
        assert "x" in markup.page_blocks(html, preset)[-1]["inner"]


def test_nested_lists_by_hand():
    html = "<ul><li>a<ol><li>b<ul><li>c</ul></ol>d<li>e</ul>"
    item = lambda x: f"<!-- wp:list-item --><li>{x}</li><!-- /wp:list-item -->"
    block = lambda tag, attrs, x: f'<!-- wp:list{attrs} --><{tag} class="wp-block-list">{x}</{tag}><!-- /wp:list -->'
    want = block("ul", "", item("ad" + block("ol", ' {"ordered":true}', item("b" + block("ul", "", item("c"))))) + item("e"))
    assert markup.serialized(markup.page_blocks(html)) == want


@pytest.mark.parametrize(("address", "kept"), [("java\tscript:x()", False), (" javascript:x()", False), ("JaVaScRiPt:x", False), ("data:text/html;x", False), ("vbscript:x", False), ("java​script:x", False), ("\x01javascript:x", False), ("https://a/?b:c", True), ("MAILTO:x@y", True), ("/a:b", True), ("#a:b", True), ("a/b", True), ("", True), ("//host/x", True), ("tel:1", True)])
def test_addresses_by_scheme(address, kept):
    assert nested.safe_address(address) == kept
    node = markup.Node("div")
    node.children = [markup.Node("a", {"href": address})]
    assert ("href" in markup.cleaned(node, markup.INLINE)) == kept
    assert ("href" in markup.outer(node)) == kept


def test_sql_function_has_the_rows_of_blocks(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html").union(spark.createDataFrame([(-1, None), (-2, "")], "page_id long, html string"))
    documents.register(spark)
    for preset in markup.PRESETS:
        found = spark.sql(f"SELECT page_id, b.* FROM {{pages}}, LATERAL html_blocks(html, '{preset}') AS b", pages=pages)
        want = documents.blocks(pages, preset=preset)
        assert found.columns == want.columns and sorted(map(str, found.collect())) == sorted(map(str, want.collect()))


def test_blocks_of_real_pages(spark):
    """Articles of the pages hold headings, paragraphs and lists alone: their words, in order, are those of the blocks."""
    import re
    from html import unescape

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = documents.blocks(pages).filter("depth > 0 OR tag NOT IN ('nav', 'header', 'footer')").orderBy("page_id", "pos").collect()
    for page in pages.collect():
        article = re.search("<article>(.*)</article>", page["html"], re.S)[1]
        words = unescape(re.sub("<[^<>]+>", " ", article)).split()
        blocks = [r for r in found if r["page_id"] == page["page_id"]]
        text = " ".join(unescape(re.sub("<[^<>]+>", " ", re.sub("<!--.*?-->", " ", r["inner"]))) for r in blocks).split()
        assert " ".join(words) in " ".join(text)
        first = re.search(r"<h1>(.*?)</h1>", article, re.S)
        assert not first or [(r["name"], r["level"]) for r in blocks if r["tag"] == "h1"][:1] == [("heading", 1)]


# Trees.

VALUES = [None, True, 1, -3, 2.5, "text", [], {}, [1, None, "x", {}], {"a": 1}]
TREE = {
    "lists": {"L": {"listProperties": {"nestingLevels": [{}, {"glyphType": "DECIMAL"}]}}}, "inlineObjects": {"o": {"inlineObjectProperties": {"embeddedObject": {"title": "t", "imageProperties": {"contentUri": "https://h/i"}}}}},
    "tabs": [{"tabProperties": {"tabId": "t"}, "documentTab": {"body": {"content": [
        {"paragraph": {"elements": [{"textRun": {"content": "a\n", "textStyle": {"bold": True, "link": {"url": "https://h"}}}}, {"inlineObjectElement": {"inlineObjectId": "o"}}, {"richLink": {"richLinkProperties": {"title": "r", "uri": "u"}}}, {"person": {"personProperties": {"name": "n"}}}], "bullet": {"listId": "L", "nestingLevel": 1}, "paragraphStyle": {"namedStyleType": "HEADING_1"}}},
        {"table": {"tableRows": [{"tableCells": [{"content": [{"paragraph": {"elements": [{"horizontalRule": {}}]}}]}]}]}},
    ]}}, "childTabs": [{"documentTab": {"body": {"content": [{"paragraph": {"elements": [{"textRun": {"content": "b"}}]}}]}}}]}],
}


def places(tree, path=()):
    """Every place of a tree."""
    yield path
    for k, v in tree.items() if isinstance(tree, dict) else enumerate(tree) if isinstance(tree, list) else ():
        yield from places(v, (*path, k))


def test_any_value_in_any_place():
    assert "".join(p.html for p in doc_trees.pieces(json.dumps(TREE))) == '<ol><li><a href="https://h"><strong>a</strong></a><img src="https://h/i" alt="t" /><a href="u">r</a>n</li></ol><table><tbody><tr><td><hr /></td></tr></tbody></table><p>b</p>'
    for path in places(TREE):
        for value in VALUES:
            tree = json.loads(json.dumps(TREE))
            if path:
                at = tree
                for k in path[:-1]:
                    at = at[k]
                at[path[-1]] = value
            else:
                tree = value
            text = json.dumps(tree)
            found = doc_trees.pieces(text)
            assert (found is None) == (not isinstance(tree, dict))
            if found is not None:
                list(found)
            assert isinstance(doc_trees.paragraphs(text), list) and doc_trees.element_count(text) >= 1


def test_trees_of_any_depth(spark):
    tabs = '{"documentTab":{"body":{"content":[{"a":1}]}},"childTabs":['
    deep = '{"tabs":[' + tabs * 200 + "]}" * 200 + "]}"
    cells = '{"table":{"tableRows":[{"tableCells":[{"content":['
    table = '{"body":{"content":[' + cells * 150 + "]}]}]}}" * 150 + "]}}"
    rows = [(1, deep), (2, table), (3, '{"a":' * 200_000), (4, None), (5, "[1]"), (6, "{}"), (7, "[" * 200_000)]
    trees = spark.createDataFrame(rows, "doc_id long, document string")
    assert {r["doc_id"]: r["n"] for r in trees.select("doc_id", exports.element_count("document").alias("n")).collect()} == {1: 200, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1}
    found = {r["doc_id"]: r for r in exports.document_html(exports.html_pieces(trees)).collect()}
    assert {k: r["error"] for k, r in found.items()} == {1: None, 2: None, 3: "bad_tree", 4: "bad_tree", 5: "bad_tree", 7: "bad_tree"}
    assert found[2]["html"].count("<table>") == 150 and found[1]["html"] == ""


# Packages.


def package(pages):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as found:
        for name, text in pages.items():
            found.writestr(name, text)
    return data.getvalue()


def test_damaged_packages_are_error_rows(spark, monkeypatch):
    monkeypatch.setattr(exports, "PAGE_BYTES", 50_000)
    rng = random.Random(1)
    whole = package({"index.html": "".join(rng.choice("abcdef <p>") for _ in range(3_000))})
    rows = [("ok", whole), ("bomb", package({"index.html": "x" * 60_000})), ("empty", b""), ("none", None)]
    rows += [(f"cut{k}", whole[:k]) for k in range(0, len(whole), 97)]
    for k in range(300):
        data = bytearray(whole)
        for _ in range(1 + k % 4):
            data[rng.randrange(len(data))] = rng.randrange(256)
        rows.append((f"bits{k}", bytes(data)))
    df = spark.createDataFrame([(p, len(d or b""), d) for p, d in rows], "path string, length long, content binary")
    found = {r["path"]: r for r in exports.package_pages(df).collect()}
    assert len(found) == len(rows) and found["ok"]["error"] is None and len(found["ok"]["html"]) == 3_000
    assert found["bomb"]["error"] == "too_large" and found["none"]["error"] == "bad_package"
    assert {r["error"] for p, r in found.items() if p.startswith("cut")} == {"bad_package"}
    assert all((r["html"] is None) == (r["error"] is not None) for r in found.values())


# Images.


def test_images_put_in_place(spark):
    pages = [
        (1, "f", '<p><img src="a.png"><IMG SRC=\'a.png#x\' alt="src=b.png"><img alt=x src=./i%20j.png ><img data-src="a.png"><!-- <img src="no.png"> --></p>'),
        (2, "f", '<img src="../a.png">'), (3, "f", '<img src="a.png"><img src="no.png">'), (4, "f", None), (5, "g", '<img src="a.png">'), (6, "f", '<img src="data:image/png;base64,x"><img src="//h/x"><img src=""><img>'),
        (7, "f", '<img src="file:///a.png?x">text'), (8, "f", "no image"), (8, "f", "no image"), (9, "f", '<img "' * 2_000 + '<img src="a.png">'), (10, "f", '<img src="a.png">' * 3_000), (11, "f", ""),
    ]
    assets = [("f", "a.png", "2", "https://m/late"), ("f", "a.png", "1", 'https://m/a?x=1&y="'), ("f", "i j.png", "1", "https://m/ij")]
    found = {r["page_id"]: r for r in documents.put_images(spark.createDataFrame(pages, "page_id long, file_id string, html string"), spark.createDataFrame(assets, "file_id string, asset_path string, sha256 string, url string")).collect()}
    a = '"https://m/a?x=1&amp;y=&quot;"'
    assert found[1]["html"] == f'<p><img src={a}><IMG SRC={a} alt="src=b.png"><img alt=x src="https://m/ij" ><img data-src="a.png"><!-- <img src="no.png"> --></p>'
    assert [found[k]["error"] for k in (2, 3, 5)] == ["image_unsafe", "image_missing", "image_missing"] and found[3]["html"] is None
    assert [found[k]["html"] for k in (4, 6, 7, 8, 11)] == [None, pages[5][2], f"<img src={a}>text", "no image", ""]
    assert len(found) == 11 and found[10]["html"] == f"<img src={a}>" * 3_000


# Wrong answers of before.


def test_the_last_change_of_a_key_counts(spark):
    state = spark.createDataFrame([(1, "a", "p"), (2, "b", None)], "id long, v string, o string")
    changes = spark.createDataFrame([(1, "x", "", 2), (1, "y", None, 3), (1, "z", "q", 1), (3, "n", "r", 1), (3, "m", "s", 1)], "id long, v string, o string, seq long")
    merged = catalog.merge(state, changes, "id", ["o"], "seq").collect()
    assert sorted(map(tuple, merged), key=str) == [(1, "y", "p"), (2, "b", None), (3, "n", "r")]
    assert sorted(map(tuple, catalog.update(state, changes, "id", "seq").collect())) == [(1, "y", "p"), (2, "b", None)]


def test_a_level_is_not_searched(spark):
    rows = spark.createDataFrame([(1, "error", "m"), (2, "info", "an Error")], "event_id long, level string, message string")
    assert [r["event_id"] for r in events.matching(rows, search="error").collect()] == [2]


def test_plain_pages_are_read_as_html_parser_reads_them(monkeypatch):
    parts = ["<p>", "</p>", "<p>a &amp; b</p>", "<h2>x</h2>", '<img src="a > b" alt=\'c\'/>', "<ul><li>x</li><li>y", "</ul>", "a < b", "&lt", "<!-- c -->", "<title>t &lt; </title>", '<script>"</p>" < 1</script>', "<br/>", '<div class="note" hidden>', "</DIV>", "<td>z</td>", "<b>", "</b >", "<", "<a href=x>"]
    draw = random.Random(7)
    pages = ["".join(draw.choices(parts, k=draw.randrange(1, 9))) for _ in range(2000)]
    plain = [h for h in pages if markup._pieces(h) is not None]
    assert len(plain) > 800 and "<p>a" not in plain
    for preset in markup.PRESETS:
        quick = [markup.page_blocks(h, preset) for h in plain]
        with monkeypatch.context() as m:
            m.setattr(markup, "_pieces", lambda html: None)
            assert quick == [markup.page_blocks(h, preset) for h in plain]
        short = [[{**b, "attrs": "", "inner": ""} for b in page] for page in quick]
        assert short == [markup.page_blocks(h, preset, whole=False) for h in plain]


def test_blocks_are_handed_on_in_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(documents, "HANDED_ROWS", 7)
    pages = spark.createDataFrame([(k, "<p>a</p>" * (k % 30) + "<h2>b</h2>") for k in range(100)] + [(None, None)], "page_id int, html string")
    found = documents.blocks(pages, whole=False)
    assert found.columns == ["page_id", "pos", "name", "role", "tag", "level", "depth", "text"]
    got = sorted((r.page_id, r.pos, r.name) for r in found.collect())
    assert got == sorted((k, p, "paragraph" if p < k % 30 else "heading") for k in range(100) for p in range(k % 30 + 1))


def test_blocks_of_a_page_are_sorted_once(spark):
    rows = spark.createDataFrame([], "page_id long, pos int, name string, tag string, level int, text string")
    plan = documents.grouped(rows, "page_id")._jdf.queryExecution().sparkPlan().toString() + documents.grouped(rows, "page_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1


def test_trees_of_one_file_are_dealt_out(spark, tmp_path):
    """As html_pieces and as document_pieces in SQL, the rows are those of document_html."""
    plain = '{"body":{"content":[{"paragraph":{"elements":[{"textRun":{"content":"a"}}]}},{"table":{}},{"x":1}]}}'
    spark.createDataFrame([(1, plain), (2, "no"), (3, '{"tabs":[]}'), (4, None)], "doc_id int, document string").coalesce(1).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    exports.register(spark)
    want = spark.sql("SELECT doc_id, p.* FROM {t}, LATERAL document_html(document) AS p", t=rows).collect()
    found = exports.html_pieces(rows)
    assert sorted(map(str, found.collect())) == sorted(map(str, want)) and len(want) == 5
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(map(str, spark.sql("SELECT doc_id, inline(document_pieces(document)) FROM {t}", t=rows).collect())) == sorted(map(str, want))


def test_images_of_plain_pages_are_cut_as_html_parser_finds_them(monkeypatch):
    parts = ['<img src="a > b.png">', "<IMG alt='x' src='c'/>", "<img src=i/%20d.png>", "<img class=x>", "<p>t &amp; u</p>", '<script>"<img src=z>"</script>', "a < b", "<!-- c -->"]
    draw = random.Random(3)
    pages = ["".join(draw.choices(parts, k=draw.randrange(1, 7))) for _ in range(500)]
    assert all(markup._pieces(h) is not None for h in pages)
    quick = [markup.image_cuts(h) for h in pages]
    monkeypatch.setattr(markup, "_pieces", lambda html: None)
    assert quick == [markup.image_cuts(h) for h in pages]
