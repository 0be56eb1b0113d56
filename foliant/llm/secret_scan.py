"""Secret scan with multipart credential linking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import let, materialize, running, text_of

# Fixed patterns of the base kinds; letters of the key names match in either case.
KEY_NAMES = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = f"({KEY_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
# Fixed patterns of the weak parts.
WEAK_ID = "(?i:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9_.@-]{3,}"
WEAK_SECRET = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
ENDPOINT = "https?://[^\\x00-\\x20\"'<>]+"

#: The kinds, in the order in which spans of the same start are listed.
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
SPAN = "struct<start:int,kind:int,end:int>"


def _found(text: Column, pattern: str, kind: str, keep=None, group: int = 0) -> Column:
    """The spans of a pattern in a text, as an array of (start, kind, end) in code points.

    What lies between the matches comes from split and the matches from regexp_extract_all; running sums
    of both lengths are the places.
    """
    none = F.array().cast(f"array<{SPAN}>")
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches

    def spans(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
        widths = F.transform(found, lambda m: F.length(m))
        ends = running(F.zip_with(F.slice(gaps, 1, F.size(widths)), widths, lambda g, w: g + w))
        whole = F.zip_with(ends, widths, lambda e, w: F.struct((e - w).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), e.alias("end")))
        if keep is None:
            return whole
        kept = F.zip_with(whole, F.transform(tested, keep), lambda s, k: F.when(k, s))
        return F.filter(kept, lambda s: s.isNotNull())

    return F.when(text.rlike(pattern), let(matches, spans)).otherwise(none)


def _mixed(token: Column) -> Column:
    """Whether a token has digits and letters of both cases, as random keys have and words haven't."""
    return token.rlike("[0-9]") & token.rlike("[a-z]") & token.rlike("[A-Z]")


def parts(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, row_key (hash of the text), base and weak spans."""
    text = F.col("_text")
    return docs.select("doc_id", text_of().alias("_text")).select(
        "doc_id",
        F.xxhash64("_text").alias("row_key"),
        F.concat(
            _found(text, ASSIGN, "assign", lambda g: F.length(g) >= 8, 2),
            _found(text, ACCESS, "access"),
            _found(text, HEX, "hex"),
        ).alias("base"),
        F.concat(
            _found(text, WEAK_ID, "weak_id"),
            _found(text, WEAK_SECRET, "weak_secret", _mixed),
            _found(text, ENDPOINT, "endpoint"),
        ).alias("weak"),
    )


def link_parts(found: DataFrame, scope: list[str], max_gap: int = 256) -> DataFrame:
    """The weak parts whose complement lies at most max_gap code points away in the same scope.

    found: scope columns, kind, start, end. A weak identifier needs a secret, a weak secret an identifier,
    an endpoint both; weak parts that overlap a strong one are dropped, as it is reported already. The
    interval join meets parts by scope and block of max_gap code points, the neighbouring blocks included;
    a block holds a bounded number of parts, and semi joins make no pairs.
    """
    code = {k: i for i, k in enumerate(KINDS)}
    block = F.floor(F.col("start") / max_gap)
    last = F.floor(F.col("end") / max_gap)
    names = [f"_s{i}" for i in range(len(scope))]

    def side(kinds: tuple[str, ...]) -> DataFrame:
        rows = found.filter(F.col("kind").isin([code[k] for k in kinds]))
        rows = rows.select(*[F.col(c).alias(n) for c, n in zip(scope, names, strict=True)], F.col("start").alias("_b"), F.col("end").alias("_e"), F.explode(F.sequence(block - 1, last + 1)).alias("_block"))
        return rows

    left = found.filter(F.col("kind") > 2).withColumn("block", F.explode(F.sequence(block, last)))
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(scope, names, strict=True)] + [F.col("block") == F.col("_block")]
    near = [F.col("_b") - F.col("end") <= max_gap, F.col("start") - F.col("_e") <= max_gap]
    over = [F.col("_b") < F.col("end"), F.col("start") < F.col("_e")]

    def all_of(conditions: list[Column]) -> Column:
        out = conditions[0]
        for c in conditions[1:]:
            out = out & c
        return out

    taken = left.join(side(("assign", "access", "hex")), all_of(same + over), "left_semi").drop("block").distinct()
    taken = taken.select(*[F.col(c).alias(f"_t{i}") for i, c in enumerate(found.columns)])
    left = left.join(taken, all_of([F.col(c).eqNullSafe(F.col(f"_t{i}")) for i, c in enumerate(found.columns)]), "left_anti")
    secrets, ids = side(("assign", "hex", "weak_secret")), side(("access", "weak_id"))
    with_id = left.filter(F.col("kind") != code["weak_id"]).join(ids, all_of(same + near), "left_semi").drop("block").distinct()
    with_id = with_id.withColumn("block", F.explode(F.sequence(block, last)))
    need_secret = left.filter(F.col("kind") == code["weak_id"]).unionByName(with_id.filter(F.col("kind") == code["endpoint"]))
    with_secret = need_secret.join(secrets, all_of(same + near), "left_semi")
    return with_secret.unionByName(with_id.filter(F.col("kind") == code["weak_secret"])).drop("block").distinct()


def scan_secrets(docs: DataFrame, max_gap: int = 256) -> DataFrame:
    """Finds secrets in documents (doc_id, text): doc_id, base and linked, arrays of (start, kind, end).

    A null text is empty and has no spans; an empty table gives no rows; repeated rows are answered each;
    very long texts are searched whole; spans that tie in start and kind are one; other columns are ignored. Weak parts are reported only if link_parts keeps them.
    """
    rows = materialize(parts(docs), "secret-parts")
    scope = ["doc_id", "row_key"]
    some = rows.filter(F.size("weak") > 0).dropDuplicates(scope)
    flat = some.select(*scope, F.explode(F.concat("base", "weak")).alias("s")).select(*scope, "s.start", "s.kind", "s.end")
    linked = link_parts(flat, scope, max_gap).groupBy(*scope).agg(F.collect_set(F.struct("start", "kind", "end")).alias("linked"))
    right = linked.select(F.col("doc_id").alias("_d"), F.col("row_key").alias("_k"), "linked")
    joined = rows.join(right, rows.doc_id.eqNullSafe(F.col("_d")) & (rows.row_key == F.col("_k")), "left")
    return joined.select("doc_id", "base", F.coalesce("linked", F.array().cast(f"array<{SPAN}>")).alias("linked"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.end.cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def op1_secret_scan(docs: DataFrame) -> DataFrame:
    """The thin query over scan_secrets."""
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == KINDS.index(k))).cast("long")
    return scan_secrets(docs).select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(F.concat("base", "linked")).alias("spans"),
    )
