"""Rules on hand-made rows: blocks, code runs, packages, document trees, limits, merges, errors."""

from __future__ import annotations

import io
import json
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliant.functions import code_lines, markup, text
from foliant.operators import catalog, changes, documents, events, folders, telemetry
from foliant.sources import exports
from foliant.streaming import state


def html(page: str, preset: str = "plain_blocks") -> str:
    return markup.serialized(markup.page_blocks(page, preset))


def test_heading_levels_by_preset():
    assert html("<h1>Title</h1>", "clean_article") == '<!-- wp:heading {"level":2} --><h2>Title</h2><!-- /wp:heading -->'
    assert html("<h1>Title</h1>", "documentation") == '<!-- wp:heading {"level":1} --><h1>Title</h1><!-- /wp:heading -->'


def test_open_paragraphs_and_lists():
    page = "<div><p>One<p>Two <b>bold</b><ul><li>a<li>b<ol><li>c</ol></ul></div>"
    assert [b["name"] for b in markup.page_blocks(page)] == ["paragraph", "paragraph", "list"]
    assert html("<ul><li>a<li>b</ul>") == '<!-- wp:list --><ul class="wp-block-list"><!-- wp:list-item --><li>a</li><!-- /wp:list-item --><!-- wp:list-item --><li>b</li><!-- /wp:list-item --></ul><!-- /wp:list -->'
    assert '<!-- wp:list {"ordered":true} -->' in html(page)


def test_images_and_callouts():
    linked = html('<p><a href="/full"><img src="/t.jpg" alt="A"></a></p>')
    assert linked == '<!-- wp:image {"url":"/t.jpg","alt":"A","href":"/full","linkDestination":"custom"} --><figure class="wp-block-image"><a href="/full"><img src="/t.jpg" alt="A" /></a></figure><!-- /wp:image -->'
    assert [b["name"] for b in markup.page_blocks('<p>see <img src="x"></p>')] == ["paragraph"]
    assert [b["role"] for b in markup.page_blocks("<p>Note: short</p><aside>x</aside>", "documentation")] == ["callout", "callout"]
    assert markup.page_blocks("<script>x()</script><p>a &amp; b</p>")[0]["inner"] == "<p>a &amp; b</p>"


def test_unsafe_attributes_go():
    assert html('<p onclick="x()"><a href="javascript:x()" class="k">go</a><blink>b</blink></p>') == "<!-- wp:paragraph --><p><a>go</a>b</p><!-- /wp:paragraph -->"


@pytest.mark.parametrize(
    ("lines", "want"),
    [
        (["text", "```json", "{", "}", "```", "more"], [(1, 4, "fenced")]),
        (["```", "never closed"], []),
        (["$ npm install", "", "words"], [(0, 0, "lines")]),
        (["Given a user"], []),
        (["Given a user", "When it acts", "prose"], [(0, 1, "lines")]),
        (["curl -X POST \\", "--data x", "prose here"], [(0, 1, "lines")]),
        (['"""', "inside", "", '"""', "x"], [(0, 3, "lines")]),
        (['"""', "left open"], []),
        (["class A {", "  int x = 1;", "}"], [(0, 2, "lines")]),
    ],
)
def test_code_runs(lines, want):
    assert [r[:3] for r in code_lines.code_runs(lines)] == want


@pytest.mark.parametrize(
    ("lines", "want"),
    [
        (["```", "a", "", "  ", "```"], [(0, 4, "fenced", "a")]),
        (["```js", "never closed", "words"], [(0, 0, "lines", "```js")]),
        (["~~~", "x", "```", "y"], [(0, 2, "fenced", "x")]),
        (["curl x \\", "-H 'a' \\", "-d b \\", "https://host/x", "prose"], [(0, 3, "lines", "curl x \\\n-H 'a' \\\n-d b \\\nhttps://host/x")]),
        (["curl x", "-H a", "prose"], [(0, 0, "lines", "curl x")]),
        (["-H a", "-d b"], []),
        (["Given a", '"""', "any words", '"""', "Then b"], [(0, 4, "lines", 'Given a\n"""\nany words\n"""\nThen b')]),
        (["class A {", '"""', "left open"], []),
        (["root/", "├── a.txt", "│   └── b/", "End."], [(0, 2, "lines", "root/\n├── a.txt\n│   └── b/")]),
        (["<a>", "  text = 1", "</a>", ""], [(0, 2, "lines", "<a>\n  text = 1\n</a>")]),
        (["};"], []),
        (["* item", "* other"], [(0, 1, "lines", "* item\n* other")]),
        (["a\u00a0b {", "return x;\u00a0"], [(1, 1, "lines", "return x;")]),
    ],
)
def test_texts_of_code_runs(lines, want):
    assert code_lines.code_runs(lines) == want


def folded(lines):
    """Runs by a fold over the lines one at a time."""
    out, k = [], 0
    text = [code_lines.normalized(x) for x in lines]
    while k < len(text):
        if code_lines.FENCE.fullmatch(text[k]) and (ends := [j for j in range(k + 1, len(text)) if code_lines.FENCE.fullmatch(text[j])]):
            out.append((k, ends[0]))
            k = ends[0] + 1
            continue
        open_quote = shell = False
        j = k
        while j < len(text):
            c, on = code_lines.letter(text[j]), text[j].endswith("\\")
            if open_quote:
                open_quote = c != "Q"
            elif c in "bp" or c in "oO" and not shell:
                break
            else:
                open_quote, shell = c == "Q", c == "C" or shell and c in "XOK" and on
            j += 1
        if not open_quote and j > k and (j > k + 1 or code_lines.letter(text[k]) in "CSXx"):
            out.append((k, j - 1))
            k = j
        else:
            k += 1
    return out


def test_code_runs_by_a_fold():
    import random

    draw = random.Random(3)
    lines = ["prose here", "", "```", "~~~py", "curl a \\", "-d b \\", "-d c", "  --x=1 \\", '"""', "Given a", "class B {", "}", "  y(z)", "root/", "https://host/x \\", "--a-b/"]
    for _ in range(3_000):
        some = draw.choices(lines, k=draw.randint(1, 9))
        assert [r[:2] for r in code_lines.code_runs(some)] == folded(some), some


P = lambda *lines: "".join(f"<p>{x}</p>\n" for x in lines)
MARKED = lambda name, inner, attrs="": f"<!-- wp:{name}{attrs} -->{inner}<!-- /wp:{name} -->"
CODE = lambda text: MARKED("code", f'<pre class="wp-block-code"><code>{text}</code></pre>')


@pytest.mark.parametrize(
    ("preset", "page", "want"),
    [
        ("documentation", P("Words.", "```yaml", "key: 'v'", "", "</p><p>other: 1", "```", "More."), MARKED("paragraph", "<p>Words.</p>") + CODE("key: &#039;v&#039;\n\n\nother: 1") + MARKED("paragraph", "<p>More.</p>")),
        ("documentation", P("npm install", "  -g x"), CODE("npm install\n  -g x")),
        ("clean_article", P("npm install"), MARKED("paragraph", "<p>npm install</p>")),
        ("documentation", P("&lt;a b=\"c\"&gt;", "&nbsp;&nbsp;&lt;d/&gt;", "&lt;/a&gt;"), CODE("&lt;a b=&quot;c&quot;&gt;\n  &lt;d/&gt;\n&lt;/a&gt;")),
        ("documentation", P("class A {") + "<h2>T</h2>" + P("}"), CODE("class A {") + MARKED("heading", "<h2>T</h2>", ' {"level":2}') + CODE("}")),
        ("documentation", P("class A {", 'x <img src="i"> y', "}"), CODE("class A {") + MARKED("paragraph", '<p>x <img src="i"> y</p>') + CODE("}")),
        ("documentation", "<div>" + P("$ ls", "Note: words") + "</div>", CODE("$ ls") + MARKED("quote", '<blockquote class="wp-block-quote doc-callout"><p>Note: words</p></blockquote>', ' {"className":"doc-callout"}')),
        ("documentation", "<pre>a &amp; 'b'\n\n</pre>", CODE("a &amp; &#039;b&#039;")),
        ("plain_blocks", '<aside class="x" onclick="y()">Un<b>supp</b>orted<br>&amp; <script>z</script></aside>', MARKED("html", '<aside class="x">Un<b>supp</b>orted<br>&amp; </aside>')),
        ("plain_blocks", '<video controls src="v"></video>', MARKED("html", '<video controls="" src="v"></video>')),
        ("clean_article", '<figure><img src="a" alt="it\'s"><figcaption>Cap</figcaption></figure>', MARKED("image", '<figure class="wp-block-image"><img src="a" alt="it&#039;s" /><figcaption class="wp-element-caption">Cap</figcaption></figure>', ' {"url":"a","alt":"it\'s","caption":"Cap"}')),
        ("clean_article", "<h3>2. Two</h3><ul><li><span>a</span><p>b</p></li></ul>words<ul><li>c</li></ul>", MARKED("heading", "<h3>2. Two</h3>", ' {"level":3}') + MARKED("list", '<ul class="wp-block-list">' + MARKED("list-item", "<li>ab</li>") + "</ul>") + MARKED("paragraph", "<p>words</p>") + MARKED("list", '<ul class="wp-block-list">' + MARKED("list-item", "<li>c</li>") + "</ul>")),
        ("documentation", "<table><tr><th>S</th></tr><tr><td>R</td></tr></table><hr>", MARKED("table", '<figure class="wp-block-table"><table><tr><th>S</th></tr><tr><td>R</td></tr></table></figure>') + MARKED("separator", '<hr class="wp-block-separator has-alpha-channel-opacity"/>')),
    ],
)
def test_pages_by_preset(preset, page, want):
    assert html(page, preset) == want


def test_heroes_and_sections(spark):
    pages = spark.createDataFrame([(1, '<p>before</p><h1>T</h1><p><img src="a"></p><p>lead</p><h2>S</h2><p>x</p>'), (2, "<p>only</p>")], "page_id long, html string")
    rows = documents.blocks(pages)
    heroes = {r["page_id"]: r for r in documents.heroes(rows, "page_id").collect()}
    assert (heroes[1]["heading_pos"], heroes[1]["text_pos"], heroes[1]["image_pos"], heroes[1]["hero"]) == (1, 3, 2, True)
    assert not heroes[2]["hero"]
    found = documents.widgets(rows, "page_id").filter("page_id = 1").orderBy("pos").collect()
    assert [r["section"] for r in found] == [0, 1, 1, 1, 2, 2]
    assert len({r["widget_id"] for r in found} | {r["section_id"] for r in found}) == 9


def _zip(files: dict[str, str]) -> bytes:
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, content in files.items():
            z.writestr(name, content)
    return data.getvalue()


def test_packages(spark):
    rows = [("a", 10, _zip({"x.htm": "first", "index.html": "page"})), ("b", 10, _zip({"../index.html": "bad", "p.html": "p"})), ("c", 10, _zip({"t.txt": ""})), ("d", 10, b"nothing"), ("e", 99_999_999, b"")]
    found = {r["path"]: r for r in exports.package_pages(spark.createDataFrame(rows, "path string, length long, content binary")).collect()}
    assert (found["a"]["html"], found["b"]["entry"]) == ("page", "p.html")
    assert [found[k]["error"] for k in "abcde"] == [None, None, "no_page", "bad_package", "too_large"]


def test_document_tree(spark):
    para = lambda t, **k: {"paragraph": {"elements": [{"textRun": {"content": t + "\n"}}], **k}}
    tree = {"tabs": [{"tabProperties": {"tabId": "t1"}, "documentTab": {"body": {"content": [para("A"), para("i", bullet={"listId": "L"})]}}, "childTabs": [{"tabProperties": {"tabId": "t2"}, "documentTab": {"body": {"content": [para("B")]}}}]}, {"tabProperties": {"tabId": "t3"}, "documentTab": {"body": {"content": [para("C")]}}}]}
    rows = exports.paragraphs(spark.createDataFrame([(1, json.dumps(tree)), (2, None), (3, "[")], "doc_id long, document string")).orderBy("pos").collect()
    assert [(r["tab"], r["depth"], r["text"], r["list_key"]) for r in rows] == [("t1", 0, "A", None), ("t1", 0, "i", "L:0:"), ("t2", 1, "B", None), ("t3", 0, "C", None)]


def test_rate_limit_restarts_on_accepted_calls_only():
    at = [0, 1, 2, 3, 4, 5, 3_603, 3_604, 3_605]
    calls = pd.DataFrame({"user": "u", "ip": "i", "at": at})
    assert state.limit_calls(calls, {}) == [True] * 5 + [False, False, True, True]


def test_rate_limit_by_a_fold(spark):
    from foliant.plans.queries import limiter_calls

    calls = limiter_calls(spark, "/root/testdata/sf0.01")
    rows = calls.toPandas().sort_values(["at", "call_id"])
    rows["accepted"] = state.limit_calls(rows, {})
    found = {r["call_id"]: r["accepted"] for r in state.rate_limited(calls).collect()}
    assert found == dict(zip(rows["call_id"], rows["accepted"], strict=True))
    assert calls.groupBy("user").agg(F.countDistinct("ip").alias("n")).agg(F.max("n")).first()[0] > 1 and 0 < sum(found.values()) < len(found)


def test_a_user_of_two_addresses_has_one_limit(spark):
    rows = [(k, "u", f"a{k % 2}", float(k)) for k in range(12)]
    found = state.rate_limited(spark.createDataFrame(rows, "call_id long, user string, ip string, at double")).collect()
    assert sorted(r["call_id"] for r in found if r["accepted"]) == [0, 1, 2, 3, 4]


def test_connected_groups(spark):
    import random

    from foliant.operators.groups import connected

    draw = random.Random(2)
    pairs = [(f"x{draw.randrange(60)}", f"y{draw.randrange(60)}") for _ in range(45)] + [(f"c{k:02}", f"c{k + 1:02}") for k in range(30)]
    root = {v: v for p in pairs for v in p}
    for _ in pairs:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    found = {r["node"]: r["root"] for r in connected(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert found == root
    assert connected(spark.createDataFrame([], "a string, b string")).count() == 0


@pytest.mark.parametrize("cuts", [1, 5])
def test_stale_heartbeats_in_one_and_many_batches(spark, tmp_path, cuts):
    beats = [(1, "syncing", 0), (1, "syncing", 700), (1, "synced", 800), (2, "syncing", 0), (2, "syncing", 599), (2, "syncing", 1_198), (3, "synced", 0), (4, "syncing", 2_000), (5, "syncing", 2_050), (9, "synced", 2_700)]
    size = -(-len(beats) // cuts)
    ordered = sorted(beats, key=lambda b: b[2])
    for k in range(cuts):
        rows = spark.createDataFrame(ordered[k * size : (k + 1) * size], "post_id long, status string, at long").withColumn("ts", F.timestamp_seconds(F.col("at") + 1_700_000_000))
        rows.coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("post_id long, status string, at long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*")).withWatermark("ts", "1 second")
    found = state.drained(state.stale_sources(stream), "append").withColumn("at", F.unix_timestamp("last_at") - 1_700_000_000)
    assert sorted((r["post_id"], r["at"]) for r in found.collect()) == [(1, 0), (2, 1_198), (4, 2_000), (5, 2_050)]


def test_upsert_keeps_the_types_of_tie_breaks(spark):
    rows = spark.createDataFrame([("s", 1, 9, "old"), ("s", 1, 10, "new")], "site string, at long, event long, version string")
    assert telemetry.upsert(rows, "site", "at", ["event"], ["version"]).first()["version"] == "new"
    state_before = telemetry.upsert(rows.filter("event = 10"), "site", "at", ["event"], ["version"])
    assert telemetry.upsert(rows.filter("event = 9"), "site", "at", ["event"], ["version"], state_before).first()["checkin_count"] == 2


def test_numbers_and_long_digit_runs(spark):
    texts = ["9223372036854775807", "9223372036854775808", "007", "-1", "1.5", "", "x", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    assert [r[0] for r in rows.orderBy("k").select(text.whole_number(F.col("t"))).collect()] == [2**63 - 1, None, 7, None, None, None, None, None]
    names = ["a" + "1" * 22, "a" + "2" * 21, "a9", "a10", "a" + "0" * 30 + "8", "A2"]
    found = [r["n"] for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(text.natural_key(F.col("n"))).collect()]
    assert found == ["A2", "a" + "0" * 30 + "8", "a9", "a10", "a" + "2" * 21, "a" + "1" * 22]


def test_inventory_reads_its_limit_of_children(spark):
    items = spark.range(30).selectExpr("'r' AS parent_id", "concat('d', id) AS file_id", "concat('n', id) AS name", "'document' AS item_type", "true AS selectable")
    roots = spark.createDataFrame([("r",)], "root_id string")
    found = folders.inventory(items, roots, most=12)
    assert sorted(int(r["name"][1:]) for r in found.collect()) == list(range(12))
    first = folders.capped(folders.inventory(items, roots), 5).orderBy("position").collect()
    assert [r["name"] for r in first] == [f"n{k}" for k in range(5)] and first[0]["overflow"]


def test_shared_folder_on_a_cluster(monkeypatch):
    from foliant import session as sessions

    class Conf:
        def __init__(self, values):
            self.values = values

        def get(self, name, default=None):
            return self.values.get(name, default)

    class Spark:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        sessions.shared_folder(Spark(), "x")


def test_reconcile_order(spark):
    make = lambda rows: spark.createDataFrame(rows, "watch_id long, file_id string, pos long")
    found = folders.reconcile(make([(1, "c", 0), (1, "gone", 1), (1, "a", 2), (1, "c", 3)]), make([(1, "a", 0), (1, "b", 1), (1, "c", 2), (1, "x", 3), (1, "done", 4)]), make([(1, "x", 0)]), make([(1, "done", 0)]))
    assert [r["file_id"] for r in found.orderBy("pos").collect()] == ["c", "a", "b"]


def test_inventory_ends_cycles_and_depth(spark):
    items = [("r", "a", "a", "folder", None), ("a", "r", "up", "folder", None), ("a", "b", "b", "folder", None), ("b", "c", "c", "folder", None), ("c", "d", "d", "folder", None), ("d", "deep", "deep", "document", None), ("c", "ok", "ok", "document", True), ("c", "no", "no", "document", False), ("a", "ok", "ok", "document", True)]
    tree = spark.createDataFrame(items, "parent_id string, file_id string, name string, item_type string, selectable boolean")
    found = folders.inventory(tree, spark.createDataFrame([("r",)], "root_id string")).collect()
    assert [(r["file_id"], r["depth"], r["path"]) for r in found] == [("ok", 1, "a")]


def test_change_plan(spark):
    old = spark.createDataFrame([("f1", "h", "t", "1", "L", "x"), ("f2", "h", "t", "1", "", "documentation"), ("f3", "", "t", "1", "L", "x"), ("f4", "h", "t", "1", "L", "x")], "file_id string, last_hash string, modified_time string, version string, last_layout_hash string, layout_preset string")
    new = spark.createDataFrame([("f1", "t", "1", "L", "h"), ("f2", "t", "1", "L", "h"), ("f3", "t", "1", "L", "")], "file_id string, new_time string, new_version string, new_layout_hash string, new_hash string")
    assert {r["file_id"]: r["action"] for r in changes.plan(old, new).collect()} == {"f1": "skip_metadata", "f2": "skip_content", "f3": "skip_content", "f4": "missing"}


def test_unknown_filters_are_errors(spark):
    rows = spark.createDataFrame([(1,)], "post_id long")
    with pytest.raises(ValueError, match="status"):
        catalog.filtered(rows, status="odd")
    with pytest.raises(ValueError, match="level"):
        events.matching(rows, level="odd")


def test_oversized_check_in(spark):
    body = json.dumps({"siteHash": "A" * 64, "pluginSlug": "s", "pluginVersion": "1", "wpVersion": "1", "phpVersion": "1", "consentVersion": "1"})
    rows = telemetry.ingest(spark.createDataFrame([(body,), (body + " " * 3_000,), (json.dumps({"siteHash": 5}),)], "body string"), "s").collect()
    assert [r["error"] for r in rows] == [None, "payload_too_large", "invalid_site_hash"]
    assert rows[0]["site_hash"] == "a" * 64


def test_natural_key(spark):
    names = spark.createDataFrame([("b10",), ("B9",), ("a2x",), ("a02y",)], "n string")
    assert [r["n"] for r in names.orderBy(text.natural_key(F.col("n"))).collect()] == ["a2x", "a02y", "B9", "b10"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, html string")
    assert documents.blocks(none).count() == 0
    assert documents.code_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_prepend_collects_what_it_keeps(spark, capsys):
    new = spark.range(5_000).selectExpr("id % 2 * (id % 3) AS post_id", "id AS seq", "CAST(id AS STRING) AS event")
    history = spark.createDataFrame([(1, ["old"]), (9, ["old"])], "post_id long, events array<string>")
    found = events.prepend(history, new, 3)
    found.explain()
    assert "WindowGroupLimit" in capsys.readouterr().out
    want = {p: [str(k) for k in range(4_999, -1, -1) if k % 2 * (k % 3) == p][:3] for p in (0, 1, 2)} | {9: ["old"]}
    assert {r["post_id"]: r["events"] for r in found.collect()} == want


LINES = {
    "npm install left-pad": "S", "git pull": "S", "curl -s https://host \\": "C", "  --save=x": "k", "  --save=x \\": "K", '"""': "Q", "": "b", "   ": "b", "This is a sentence of plain words.": "p", "const x = 1": "S", "<div>": "S",
}


def test_lines_by_a_table():
    """What each kind of line is, by hand; the fold over runs takes its letters from the same function."""
    found = {line: code_lines.letter(line) for line in LINES}
    assert found == LINES
