"""URL rules and aliases against brute force."""

from __future__ import annotations

import re

import pytest

from foliant.llm import url_filter
from foliant.plans.models import table

SCHEMA = "page_id long, url string, html string"
CANONICAL = '<html><head><link href="{}" rel="canonical"></head><body>x</body></html>'
REFRESH = "<META content='0; URL={}' http-equiv=Refresh>"


def place(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")


def ruled(url, rules):
    host, path = place(url)
    fits = [(len(h + p), len(h), v == "allow", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else (None, None)


def by_hand(pages, rules, edges):
    """edges: pairs of whole urls."""
    def key(url):
        host, path = place(url)
        return host, path or "/", (re.match(r"(?s)[^?#]*(\?[^#]*)?", url)[1] or "")

    near, urls = {}, {}
    for a, b in edges:
        near.setdefault(key(a), set()).add(key(b))
        near.setdefault(key(b), set()).add(key(a))
        urls.setdefault(key(a), set()).add(a)
        urls.setdefault(key(b), set()).add(b)
    bad = set()
    todo = [k for k, us in urls.items() if any(ruled(u, rules)[1] == "block" for u in us)]
    while todo:
        k = todo.pop()
        if k not in bad:
            bad.add(k)
            todo += near.get(k, ())
    out = []
    for page_id, url, _ in pages:
        rule, verdict = ruled(url, rules)
        out.append((page_id, *place(url), rule, verdict or ("block" if url and "://" in url and key(url) in bad else "allow")))
    return out


PAGES = [
    (1, "https://a.example.com/de/1", ""), (2, "http://other.test/x", CANONICAL.format("https://a.example.com/de/1#top")), (3, "http://other.test/y?q=1#f", REFRESH.format("/x")),
    (4, "https://b.org/fr/1", CANONICAL.format("http://other.test/x")), (5, "https://c.org/1", CANONICAL.format("https://b.org/fr/1")), (6, "https://d.org/1", CANONICAL.format("https://d.org/2")),
    (7, "https://x.NET/a", None), (8, "http://net", ""), (9, "http://m.example.net/en/1?u=http://q/", CANONICAL.format("//a.example.com/de/1")), (10, None, CANONICAL.format("http://x.net/")),
    (11, "no address", CANONICAL.format("http://x.net/")), (12, "http://notexample.com/de/", ""), (13, "", ""), (14, "http://e.org/", "<!-- " + CANONICAL.format("http://x.net/") + " -->"),
    (15, "http://f.org", "<script>'" + CANONICAL.format("http://x.net/").replace("/", "\\/") + "'</script><template>" + CANONICAL.format("http://x.net/") + "</template>"),
    (16, "http://g.org/a/b", '<base href="http://other.test/"><link rel="alternate canonical" href="x">'), (17, "http://h.org/", "<link rel=canonical href='http://[bad'>" + "x" * 300_000),
    (18, "https://e.org:80/fr/", ""), (1, "https://a.example.com/de/1", ""), (None, "http://other.test/x", None), (19, "http://z.org/\n?x", CANONICAL.format("http://y.net/\n1")), (20, "HTTP://OTHER.test/x", ""),
]
EDGES = [("http://other.test/x", "https://a.example.com/de/1"), ("http://other.test/y?q=1", "http://other.test/x"), ("https://b.org/fr/1", "http://other.test/x"), ("https://c.org/1", "https://b.org/fr/1"), ("https://d.org/1", "https://d.org/2"), ("http://m.example.net/en/1?u=http://q/", "http://a.example.com/de/1"), ("http://g.org/a/b", "http://other.test/x"), ("http://z.org/\n?x", "http://y.net/\n1")]


def answered(df):
    return [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in df.collect()]


def test_urls_by_hand(spark):
    found = answered(url_filter.op12_url_filter(spark.createDataFrame(PAGES, SCHEMA)))
    want = by_hand(PAGES, url_filter.RULES, EDGES)
    assert sorted(map(str, found)) == sorted(map(str, want))
    verdict = {r[0]: r[4] for r in want}
    assert [verdict[k] for k in (1, 2, 3, 4, 5, 6, 7, 8, 9, 14, 15, 16, 20)] == ["block", "block", "block", "allow", "block", "allow", "block", "allow", "allow", "allow", "allow", "block", "block"]


def test_urls_of_the_pages(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    found = answered(url_filter.op12_url_filter(pages))
    assert sorted(map(str, found)) == sorted(map(str, by_hand([tuple(r) for r in pages.select("page_id", "url", "html").collect()], url_filter.RULES, [])))
    assert {r[3] for r in found} == {None, "net/", "example.net/en/", "example.com/de/", "org/fr/"}


def test_redirects_of_a_chain_and_a_hub(spark):
    pages = [(k, f"http://hop.test/{k}", "") for k in range(120)] + [(1000 + k, f"http://leaf.test/{k}", CANONICAL.format("http://hub.test/")) for k in range(200)]
    hops = [(f"http://hop.test/{k}", f"https://hop.test/{k + 1}#x") for k in range(119)] + [("http://hop.test/119", "http://spam.net/"), (None, "http://x.net/"), ("odd", "http://x.net/")]
    redirects = spark.createDataFrame(hops, "a string, b string")
    rules = url_filter.rules_of(spark, url_filter.RULES)
    verdict = {r["page_id"]: r["verdict"] for r in url_filter.judged(spark.createDataFrame(pages, SCHEMA), rules, redirects).collect()}
    assert {verdict[k] for k in range(120)} == {"block"} and {verdict[1000 + k] for k in range(200)} == {"allow"}


def test_many_rules_are_met_by_joins(spark, monkeypatch):
    rules = [*url_filter.RULES, ("test", "/x", "block"), ("other.test", "/", "allow"), ("test", "", "block"), ("g.org", "/a/b", "allow"), ("g.org", "/a/b", "block"), ("", "/", "block"), ("x.net", None, "allow"), ("h.org", "/", "other")]
    pages, table_of = spark.createDataFrame(PAGES, SCHEMA), url_filter.rules_of(spark, rules)
    want = by_hand(PAGES, [(h, p or "", v) for h, p, v in rules if h and v != "other"], EDGES)
    for inline in (64, 3):
        monkeypatch.setattr(url_filter, "INLINE", inline)
        assert sorted(map(str, answered(url_filter.judged(pages, table_of)))) == sorted(map(str, want)), inline


@pytest.mark.parametrize("extra", ["node", "_node", "host", "ruling", "a", "root"])
def test_other_columns_and_empty_tables(spark, extra):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame(PAGES[:6], SCHEMA)
    assert sorted(answered(url_filter.op12_url_filter(pages.withColumn(extra, F.lit("x"))))) == sorted(answered(url_filter.op12_url_filter(pages)))
    assert url_filter.op12_url_filter(spark.createDataFrame([], SCHEMA)).collect() == []
