"""URL rules, and block decisions that spread to aliases over redirects and canonical links."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import materialize
from foliant.operators.groups import connected

#: The rules of the query: host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Rules up to which each url is tried against all of them in its row; more are met by joins.
INLINE = 64


def rules_of(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules as a table: host, path, verdict."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, with A-Z in lower case; empty without ://."""
    return F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def located(urls: DataFrame) -> DataFrame:
    """Adds host and path of url; a null url has empty ones."""
    url = F.coalesce(F.col("url"), F.lit(""))
    return urls.withColumn("host", host_of(url)).withColumn("path", path_of(url))


def with_rule(places: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds rule (host and path joined) and ruling (allow, block) to places (host, path): of the rules for the host or a domain above it whose path
    begins the place's, the longest; of equally long ones that of the longest host, then allow. Null where none fits.

    A few rules are tried in the row. Many are met by their host and a beginning of the path, for each length that rules of the host have, once
    for each distinct place, so that neither a host with very many rules nor one with very many urls is a task of its own.
    """
    rules = rules.filter("host <> '' AND verdict IN ('allow', 'block')").select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict").distinct()
    rank = [F.length(F.concat("host", "path")), F.length("host"), F.col("verdict") == "allow"]
    few = rules.orderBy(*[F.desc_nulls_last(c) for c in rank], "host", "path").limit(INLINE + 1).collect()
    if len(few) <= INLINE:
        rule, ruling = F.lit(None).cast("string"), F.lit(None).cast("string")
        for r in reversed(few):
            fits = ((F.col("host") == r["host"]) | F.endswith("host", F.lit(f".{r['host']}"))) & F.startswith("path", F.lit(r["path"]))
            rule, ruling = F.when(fits, r["host"] + r["path"]).otherwise(rule), F.when(fits, r["verdict"]).otherwise(ruling)
        return places.withColumn("rule", rule).withColumn("ruling", ruling)
    known = rules.groupBy(F.col("host").alias("_domain")).agg(F.collect_set(F.length("path")).alias("_lengths"))
    parts = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    named = places.select("host", "path").filter("host <> ''").distinct().withColumn("_domain", F.explode(domains)).join(known, "_domain")
    tried = named.withColumn("_length", F.explode("_lengths")).filter(F.col("_length") <= F.length("path"))
    tried = tried.withColumn("_begin", F.expr("substring(path, 1, _length)"))
    met = tried.join(rules.select(F.col("host").alias("_domain"), F.col("path").alias("_begin"), "verdict"), ["_domain", "_begin"])
    order = F.struct(F.length(F.concat("_domain", "_begin")), F.length("_domain"), F.col("verdict") == "allow")
    best = met.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("_domain", "_begin").alias("rule"), F.col("verdict").alias("ruling")), order).alias("_best"))
    return places.join(best, ["host", "path"], "left").select(*places.columns, "_best.rule", "_best.ruling")


class Aliases(HTMLParser):
    """The addresses that a page names as its own: canonical links and refreshes to another address, and the base that they are relative to."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.base, self.inert = [], None, 0

    def handle_starttag(self, tag, attrs):
        own = {k: v or "" for k, v in reversed(attrs)}
        if tag == "template":
            self.inert += 1
        elif self.inert:
            return
        elif tag == "base" and self.base is None and own.get("href", "").strip():
            self.base = own["href"].strip()
        elif tag == "link" and "canonical" in own.get("rel", "").lower().split():
            self.found.append(own.get("href", "").strip())
        elif tag == "meta" and own.get("http-equiv", "").strip().lower() == "refresh":
            _, _, rest = own.get("content", "").replace(",", ";").partition(";")
            name, _, target = rest.strip().partition("=")
            if name.strip().lower() == "url":
                self.found.append(target.strip().strip("'\""))

    def handle_endtag(self, tag):
        if tag == "template":
            self.inert = max(0, self.inert - 1)


def aliases(url: str, html: str) -> list[str]:
    """The whole addresses, other than its own, that a page's canonical links and refreshes name; relative ones follow its base or url."""
    page = Aliases()
    page.feed(html)
    page.close()
    found = []
    for target in page.found:
        try:
            full = urljoin(urljoin(url, page.base or ""), target) if target else ""
        except ValueError:  # not an address
            continue
        if "://" in full and full != url:
            found.append(full)
    return found


def node(url: Column) -> Column:
    """How a url is known among aliases: without scheme and fragment, its host in lower case, a slash where the path is empty."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.concat(host_of(url), F.when(path_of(url) == "", "/").otherwise(path_of(url)), query)


def links(pages: DataFrame) -> DataFrame:
    """Pairs (a, b) of a page's url and another that its html names as the same. Only pages that may hold such a link go to Python."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(u, t) for u, h in zip(batch["url"], batch["html"], strict=True) for t in aliases(u, h)], columns=["a", "b"])

    some = pages.select("url", "html").filter(F.col("url").contains("://") & F.col("html").rlike("(?i)canonical|http-equiv"))
    return some.mapInPandas(read, "a string, b string")


def blocked_aliases(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """The nodes (node) of components of edges (a, b: urls) in which a url is blocked by a rule."""
    named = materialize(edges.filter("a LIKE '%://%' AND b LIKE '%://%'").select(node(F.col("a")).alias("a"), node(F.col("b")).alias("b"), F.col("a").alias("url_a"), F.col("b").alias("url_b")), "url-edges")
    pairs = named.filter("a <> b").select("a", "b").distinct()
    if pairs.isEmpty():
        return pairs.select(F.col("a").alias("node"))
    urls = named.select(F.col("a").alias("node"), F.col("url_a").alias("url")).union(named.select("b", "url_b")).distinct()
    bad = with_rule(located(urls), rules).filter("ruling = 'block'").select("node").distinct()
    roots = connected(pairs)
    return roots.join(roots.join(bad, "node").select("root").distinct(), "root", "left_semi").select("node")


def judged(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Pages (page_id, url, html) with host, path, rule and verdict (allow, block), and alias: whether an alias decided.

    The longest rule that fits a url decides. A url that no rule fits is blocked where a rule blocks one of its aliases, which are joined by
    canonical links, refreshes and redirects (a, b: urls), over any number of steps; else it is allowed. A rule that allows holds against blocked aliases, but for the urls it fits alone, or
    else a link to an allowed page would clear a blocked one. A null url, or one without ://, has an empty host and path and no alias; a null or empty html
    names no alias, a very long one is read whole; repeated rows are judged each; an empty table gives none; other columns are ignored.
    """
    edges = links(pages)
    if redirects is not None:
        edges = edges.union(redirects.select("a", "b"))
    blocked = blocked_aliases(edges, rules)
    rows = with_rule(located(pages.select("page_id", "url")), rules)
    met = rows.withColumn("_node", F.when(F.col("ruling").isNull() & F.col("url").contains("://"), node(F.col("url"))))
    met = met.join(blocked.select(F.col("node").alias("_node"), F.lit(True).alias("_bad")), "_node", "left")
    alias = F.coalesce("_bad", F.lit(False))
    return met.select("page_id", "url", "host", "path", "rule", F.coalesce("ruling", F.when(alias, "block").otherwise("allow")).alias("verdict"), alias.alias("alias"))


def op12_url_filter(pages: DataFrame) -> DataFrame:
    """The thin query over judged."""
    return judged(pages, rules_of(pages.sparkSession, RULES)).drop("url")
