"""Each registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import hashlib

import pytest

from foliant.functions import code_lines, markup
from foliant.plans import stateful, trees  # noqa: F401  they add their queries
from foliant.plans.queries import ORACLE_SQL, QUERIES
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    compare(QUERIES[name](spark, SF), ORACLE_SQL[name], SF)


def read(name):
    import pyarrow.parquet as pq

    return pq.read_table(f"{SF}/{name}.parquet").to_pandas()


def by_hand(preset):
    return {(r.page_id, pos): b for r in read("pages").itertuples() for pos, b in enumerate(markup.page_blocks(r.html or "", preset))}


def test_html_blocks_by_hand(spark):
    found = {(r["page_id"], r["pos"]): {k: v for k, v in r.asDict().items() if k not in ("page_id", "pos")} for r in QUERIES["html_blocks"](spark, SF).collect()}
    assert found == by_hand("documentation")


def test_html_rendered_by_hand(spark):
    pages = read("pages")
    want = {r.page_id: markup.serialized(markup.page_blocks(r.html or "", "clean_article")) for r in pages.itertuples()}
    found = QUERIES["html_rendered"](spark, SF).collect()
    assert {r["page_id"]: r["content"] for r in found} == want
    assert {r["page_id"]: r["layout_hash"] for r in found} == {k: hashlib.sha256(f"clean_article:{v}".encode()).hexdigest() for k, v in want.items()}


def kind_of(b):
    if b["level"] > 0:
        return "heading"
    named = {"image": "image", "table": "html", "html": "html", "separator": "divider"}
    return "icon-list" if b["tag"] == "ul" and b["name"] != "image" else named.get(b["name"]) or ("text-editor" if b["text"].strip(" ") else "spacer")


def test_html_widgets_by_hand(spark):
    blocks = by_hand("plain_blocks")
    short = lambda page, k: hashlib.sha256(f"layout:{page}:{k}".encode()).hexdigest()[:8]
    want = set()
    for page in {p for p, _ in blocks}:
        own = [blocks[k] for k in sorted(k for k in blocks if k[0] == page)]
        section = 0
        for pos, b in enumerate(own):
            section += b["level"] > 0 and pos > 0
            want.add((page, pos, section, kind_of(b), short(page, pos + 1), short(page, len(own) + section + 1)))
    found = QUERIES["html_widgets"](spark, SF).select("page_id", "pos", "section", "widget", "widget_id", "section_id").collect()
    assert {tuple(r) for r in found} == want


def test_html_heroes_by_hand(spark):
    blocks = by_hand("plain_blocks")
    want = set()
    for page in {p for p, _ in blocks}:
        own = [blocks[k] for k in sorted(k for k in blocks if k[0] == page)]
        first = lambda test, after=-1: next((k for k, b in enumerate(own) if k > after and test(b)), None)
        heading, image = first(lambda b: b["level"] in (1, 2)), first(lambda b: b["name"] == "image")
        text = None if heading is None else first(lambda b: b["tag"] == "p" and b["name"] == "paragraph" and b["text"].strip(" "), heading)
        want.add((page, heading, image, text, heading is not None and text is not None))
    assert {tuple(r) for r in QUERIES["html_heroes"](spark, SF).select("page_id", "heading_pos", "image_pos", "text_pos", "hero").collect()} == want


def test_code_runs_by_hand(spark):
    want = {(r.doc_id, *run) for r in read("documents").itertuples() for run in code_lines.code_runs((r.text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n"))}
    assert {tuple(r) for r in QUERIES["code_runs"](spark, SF).select("doc_id", "first_line", "last_line", "kind", "code").collect()} == want


def test_every_query_is_tested():
    assert set(QUERIES) - set(ORACLE_SQL) == {"html_blocks", "html_rendered", "html_widgets", "html_heroes", "code_runs", "rate_limit_idle_reset"}  # the last one: test_rate_limit_by_a_fold


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
