"""Quality rules: base counts, then Jensen-Shannon distances to language references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import framed, let, materialize, text_of, words_of

#: Character classes, in the order of the histogram: small letters, white space, digits, symbols, capitals, punctuation, others.
CLASSES = 7
#: Common words of a language.
COMMON = 16
#: Tables of languages are at most this many rows when they are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 10_000


def _sum(xs: Column, kind: str = "bigint") -> Column:
    return F.aggregate(xs, F.lit(0).cast(kind), lambda t, x: t + x)


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words of an array that lie in windows of five words found twice or more, the first one included."""
    if width != 5:
        raise ValueError("the windows are hashed by doubling, for five words")

    def marked(pairs: Column) -> Column:
        at = F.transform(pairs, lambda p, k: F.when((F.get(pairs, k - 1).h == p.h) | (F.get(pairs, k + 1).h == p.h), p.i))
        places = F.sort_array(F.filter(at, lambda i: i.isNotNull()))
        return let(places, lambda ps: _sum(F.transform(ps, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(ps, k + 1) - p, F.lit(width))))))

    def of(hashes: Column) -> Column:
        windows = F.slice(F.transform(hashes, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, width)])), 1, F.size(hashes) - width + 1)
        pairs = lambda w: F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("bigint")).otherwise(let(pairs(w), marked)))

    return F.when(F.size(words) > width, let(F.transform(words, lambda w: F.xxhash64(w)), of)).otherwise(F.lit(0).cast("bigint"))


def few(table: DataFrame) -> DataFrame:
    """A written table of languages, to be broadcast where it is small."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def hashed_words(words: Column) -> Column:
    """The hashes of lower-cased words."""
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def common_words(docs: DataFrame) -> DataFrame:
    """The hashes of the COMMON commonest words of each language in documents (text, lang), lower-cased, by count, then by hash: _lang, _listed."""
    words = docs.select("lang", F.explode(hashed_words(words_of(text_of()))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = words.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= COMMON)  # cut before the shuffle, too
    listed = F.transform(F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda x: x.word)
    return top.groupBy(F.col("lang").alias("_lang")).agg(listed.alias("_listed"))


def features(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """Per document (doc_id, text, lang): row_key, lang, the base counts, and the histograms chars and common (other words, then those of listed)."""
    rows = docs.select("doc_id", "lang", text_of().alias("_text")).join(listed, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    rows = rows.withColumn("_words", words_of(F.col("_text"))).withColumn("_rest", F.regexp_replace("_text", r"\p{Ll}+", ""))
    rows = rows.withColumn("_black", F.regexp_replace("_rest", r"[\x20\x09-\x0D]+", ""))
    only = lambda kept: F.length(F.regexp_replace("_black", f"[^{kept}]+", ""))
    rows = rows.withColumn("_symbols", only("#*$%&|<>")).withColumn("_digits", only("0-9")).withColumn("_capitals", only(r"\p{Lu}")).withColumn("_marks", only(r"\p{P}&&[^#*%&]"))
    mine = F.filter(hashed_words(F.col("_words")), lambda w: F.array_contains("_listed", w))
    counted = let(mine, lambda m: F.transform(F.coalesce("_listed", F.array().cast("array<bigint>")), lambda w: F.size(F.filter(m, lambda x: x == w)).cast("bigint")))
    padded = let(counted, lambda c: F.concat(F.array(F.size("_words") - _sum(c)), c, F.array_repeat(F.lit(0).cast("bigint"), COMMON - F.size(c))))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    space, small = F.length("_rest") - F.length("_black"), F.length("_text") - F.length("_rest")
    chars = [small, space, F.col("_digits"), F.col("_symbols"), F.col("_capitals"), F.col("_marks")]
    chars.append(F.length("_black") - F.col("_digits") - F.col("_symbols") - F.col("_capitals") - F.col("_marks"))
    return rows.select(
        "doc_id",
        F.xxhash64("_text").alias("row_key"),
        "lang",
        F.size("_words").cast("long").alias("n_words"),
        (F.length("_text") - space).cast("long").alias("word_chars"),
        F.col("_symbols").cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        F.array(*[c.cast("long") for c in chars]).alias("chars"),
        padded.alias("common"),
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two histograms of counts; null if either is empty."""
    share = lambda xs: let(_sum(F.transform(xs, lambda x: x.cast("double")), "double"), lambda t: F.when(t > 0, F.transform(xs, lambda x: x / t)))

    def term(a: Column, b: Column) -> Column:
        m = (a + b) / 2
        part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
        return (part(a) + part(b)) / 2

    total = _sum(F.zip_with(share(p), share(q), term), "double")
    return F.sqrt(F.when(total < 0, 0.0).otherwise(total))


def judge(docs: DataFrame, min_words: int = 20, min_common_words: int = 50, max_chars: float = 0.12, noise: float = 0.8, max_common: float = 0.25, common_noise: float = 0.7, max_trim: float = 0.2) -> DataFrame:
    """Judges documents (doc_id, text, lang): row_key, base counts, base_failed, js_chars, js_common, kept.

    A language's common words are its COMMON commonest ones in these documents. Its references are the summed histograms of its documents that the base keeps and that have
    min_words, summed again without those further than max_trim from the first sums. A document that passes the base goes if it has min_words and its characters are further from
    the reference than max_chars and what chance adds to so few words (noise over their root), or has min_common_words and its common words are further than
    max_common and what chance adds to them (common_noise over the root). Where common words are a share r of a language, a text
    without any is at sqrt((r + (1 - r) log2(1 - r) - (2 - r) log2(1 - r / 2)) / 2), 0.36 for a quarter: beyond that limit from min_common_words on.
    Null and empty texts have no words and fail; very long ones are judged whole; a null language is a language of its own; repeated rows
    are judged each; words that tie for the last of the common ones go by hash; other columns are ignored; an empty table gives no rows.
    """
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    found = materialize(features(docs, few(materialize(common_words(docs), "quality-words"))).withColumn("base_failed", base_failed), "quality")
    sums = lambda name, n: F.array(*[F.coalesce(F.sum(F.get(name, F.lit(i))), F.lit(0)) for i in range(n)])
    odd = ((F.col("n_words") >= min_words) & (F.col("js_chars") > max_chars + noise / F.sqrt("n_words"))) | ((F.col("n_words") >= min_common_words) & (F.col("js_common") > max_common + common_noise / F.sqrt("n_words")))
    judged, usable = found, ~F.col("base_failed") & (F.col("n_words") >= min_words)
    for trimmed in (False, True):  # the second references leave out what is far from the first
        taken = judged.filter(usable & (F.coalesce(F.col("js_chars"), F.lit(0.0)) <= max_trim)) if trimmed else judged.filter(usable)
        references = taken.groupBy(F.col("lang").alias("_lang")).agg(sums("chars", CLASSES).alias("_chars"), sums("common", COMMON + 1).alias("_common"))
        references = few(materialize(references, "quality-references"))
        judged = found.join(references, F.col("lang").eqNullSafe(F.col("_lang")), "left")
        judged = judged.withColumn("js_chars", js_distance(F.col("chars"), F.col("_chars"))).withColumn("js_common", js_distance(F.col("common"), F.col("_common")))
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(odd, F.lit(False))).drop("_lang", "_chars", "_common", "chars", "common")


def op5_quality(docs: DataFrame) -> DataFrame:
    """The thin query over judge."""
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("js_chars", 6).alias("js_chars"), F.round("js_common", 6).alias("js_common"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that judge keeps, with all their columns, whatever their names; repeated rows stay or go together. Null, empty and short texts go."""
    bad = materialize(judge(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")).distinct(), "quality-rejected")
    return framed(docs, ["doc_id"]).join(bad, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_key") == F.col("_key")), "left_anti").select("row.*")
