"""Benchmark decontamination by template windows with slot checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import framed, let, materialize, text_of

#: Words in a window; windows are hashed by doubling.
WINDOW = 8
#: Words that an item has at least; a shorter one stands in texts that have nothing to do with it ("the" in nearly all) and is never met.
SHORTEST = 4
#: A benchmark is broadcast up to this many windows (some 100 bytes each); a larger one is joined by a shuffle.
BROADCAST_WINDOWS = 500_000
# Fixed list of units, as lower-case words after a number.
UNITS = ["mm", "cm", "m", "km", "mg", "g", "kg", "ml", "l", "s", "ms", "min", "h", "hz", "w", "kw", "v", "a", "c", "f", "k", "inch", "inches", "foot", "feet", "yards", "miles", "meters", "metres", "kilometers", "kilometres", "grams", "kilograms", "pounds", "ounces", "liters", "litres", "seconds", "minutes", "hours", "days", "weeks", "months", "years", "percent", "dollars", "cents", "euros"]
# Fixed list of words that are no names though they are capitalised, as at a sentence's start.
OPENERS = ["a", "after", "all", "an", "and", "are", "as", "at", "because", "before", "but", "by", "can", "did", "do", "does", "each", "every", "find", "for", "from", "give", "given", "has", "have", "he", "her", "his", "how", "i", "if", "in", "is", "it", "its", "let", "many", "my", "no", "not", "of", "on", "one", "or", "our", "out", "she", "so", "some", "that", "the", "their", "then", "there", "these", "they", "this", "those", "to", "two", "was", "we", "were", "what", "when", "where", "which", "while", "who", "why", "will", "with", "you", "your"]
#: Before a capitalised word.
NAME = "\u0001"


def templates(rows: DataFrame, lengths: list[int] | None = None) -> DataFrame:
    """Adds windows, an array of (at, hash, raw), slots, an array of (at, type, value), and n, the number of words, to rows with _text.

    A word is letters or a number. Numbers (type 1), capitalised words that aren't OPENERS (2) and units after
    numbers (3) become typed placeholders, other words count in lower case. Windows are of WINDOW canonical words; each is
    given as raw too, hashed by its words in lower case, so that what is word for word the same is met however it is capitalised. Raw windows of some lengths below WINDOW are added; without
    lengths a text of fewer words has one, of its whole length.
    """
    marked = F.lower(F.regexp_replace("_text", r"(?<![\p{L}\p{M}])(?=\p{Lu})", NAME))
    tokens = F.regexp_extract_all(marked, F.lit(rf"{NAME}?[\p{{L}}\p{{M}}]+|\p{{N}}+(?:[.,]\p{{N}}+)*"), F.lit(0))
    digit = lambda x: x.rlike(r"^\p{N}")

    def typed(ts: Column) -> Column:
        plain = lambda x: F.when(x.startswith(NAME), F.substring(x, 2, 2**31 - 1)).otherwise(x)

        def kind(x: Column, word: Column, i: Column) -> Column:
            unit = word.isin(UNITS) & F.coalesce(digit(F.get(ts, i - 1)), F.lit(False))
            return F.when(digit(x), 1).when(unit, 3).when(x.startswith(NAME) & ~word.isin(OPENERS), 2).otherwise(0)

        one = lambda x, word, i: F.struct(i.alias("at"), kind(x, word, i).alias("type"), F.xxhash64(word).alias("word"))
        return F.transform(ts, lambda x, i: let(plain(x), lambda word: one(x, word, i)))

    def windows(hashes: Column) -> Column:
        n = F.size(hashes)
        two = lambda x, y: F.xxhash64(x, y)
        c2 = F.zip_with(F.slice(hashes, 1, n - 1), F.slice(hashes, 2, n - 1), two)
        c4 = let(c2, lambda c: F.zip_with(F.slice(c, 1, n - 3), F.slice(c, 3, n - 3), two))
        return let(c4, lambda c: F.zip_with(F.slice(c, 1, n - 7), F.slice(c, 5, n - 7), two))

    def raw(ts: Column, at: Column, n: Column | int) -> Column:
        words = F.transform(F.slice(ts, at + 1, n), lambda t: t.word)
        return F.struct(at.alias("at"), F.xxhash64(F.lit("raw"), words).alias("hash"), F.lit(True).alias("raw"))

    def short(ts: Column) -> Column:
        none = F.array().cast("array<struct<at: int, hash: bigint, raw: boolean>>")
        if lengths is None:
            return F.when((F.size(ts) > 0) & (F.size(ts) < WINDOW), F.array(raw(ts, F.lit(0), WINDOW - 1))).otherwise(none)
        every = lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.size(ts) - n, F.lit(0))), lambda i: raw(ts, i, n))
        found = [F.when(F.size(ts) >= n, every(n)).otherwise(none) for n in lengths]
        return F.concat(none, *found)

    def both(ts: Column) -> Column:
        none = F.array().cast("array<bigint>")
        hashes = lambda of: F.when(F.size(ts) >= WINDOW, let(F.transform(ts, of), windows)).otherwise(none)
        placed = lambda found, is_raw: F.transform(found, lambda h, i: F.struct(i.alias("at"), h.alias("hash"), F.lit(is_raw).alias("raw")))
        typed_windows = placed(hashes(lambda t: F.when(t.type > 0, t.type.cast("bigint")).otherwise(t.word)), False)
        raw_windows = placed(hashes(lambda t: F.xxhash64(F.lit("raw"), t.word)), True)
        slots = F.filter(ts, lambda t: t.type > 0)
        kept = F.transform(slots, lambda t: F.struct(t.at.alias("at"), t.type.alias("type"), t.word.alias("value")))
        return F.struct(kept.alias("slots"), F.concat(typed_windows, raw_windows, short(ts)).alias("windows"), F.size(ts).alias("n"))

    # bound by let, not by columns: a filter that Spark moves below would repeat a column's expression for each element
    found = let(let(tokens, typed), both)
    return rows.withColumn("_found", found).select(*[c for c in rows.columns if c != "_text"], "_found.slots", "_found.windows", "_found.n")


def _inside(at: Column) -> Column:
    """The slots of the window that begins at a place, with places from there."""
    some = F.filter("slots", lambda s: (s.at >= at) & (s.at < at + WINDOW))
    return F.transform(some, lambda s: F.struct((s.at - at).alias("at"), s.value.alias("value")))


def contaminated(docs: DataFrame, benchmark: DataFrame, min_windows: int = 6, min_share: float = 0.5) -> DataFrame:
    """Benchmark items in documents: doc_id, row_key (hash of the text), item_id, n_windows, share, same_values.

    docs: doc_id, text; benchmark: item_id, text. Windows of both are met by hash and counted by alignment.
    A document holds an item if, at one alignment, min_windows of its windows match (13 words in a row, or more
    in pieces) or min_share of them, and the slots agree: each value of the item always stands for the same
    value of the document, and the reverse. Where they don't, the windows whose values are all the same still count by themselves, so that
    a copy of which one mention was changed is found. same_values tells whole copies from re-parameterised or changed items. Windows match by template or word for word, those of the item
    with more than half placeholders word for word only; an item of fewer than WINDOW words is one such window, one of fewer than SHORTEST is never met. Null and
    empty texts hold nothing; very long ones are read whole; repeated rows and items with one id and text count once; of alignments that tie, one of
    the same values goes first; an empty table of either gives no rows; other columns are ignored.
    """
    items = templates(benchmark.select("item_id", text_of().alias("_text")).distinct()).filter(F.col("n") >= SHORTEST)
    parts = items.select("item_id", "slots", "n", F.inline("windows")).withColumnRenamed("at", "ipos").select("item_id", "hash", "ipos", "raw", "n", _inside(F.col("ipos")).alias("islots"))
    parts = parts.filter(F.col("raw") | (F.size("islots") <= WINDOW // 2))
    parts = materialize(parts, "benchmark-windows")
    lengths = [r["n"] for r in parts.filter(F.col("n") < WINDOW).select("n").distinct().orderBy("n").collect()]
    sizes = parts.groupBy("item_id").agg(F.countDistinct("ipos").alias("windows"))
    small = parts.count() <= BROADCAST_WINDOWS
    right = F.broadcast(parts.drop("n")) if small else parts.drop("n")
    texts = docs.select("doc_id", text_of().alias("_text")).withColumn("row_key", F.xxhash64("_text"))
    rows = templates(texts, lengths).select("doc_id", "row_key", "slots", F.inline_outer("windows")).select("doc_id", "row_key", "slots", F.col("at").alias("pos"), "hash")
    if not small:
        rows = rows.select("doc_id", "row_key", "pos", "hash", _inside(F.col("pos")).alias("dslots"))
    met = rows.join(right, "hash")
    if small:
        met = met.withColumn("dslots", _inside(F.col("pos")))
    pairs = F.zip_with("islots", F.when(F.col("raw"), F.col("islots")).otherwise(F.col("dslots")), lambda i, d: F.struct(i.value.alias("i"), d.value.alias("d")))
    met = met.select("doc_id", "row_key", "item_id", (F.col("pos") - F.col("ipos")).alias("shift"), "ipos", pairs.alias("pairs"))
    verbatim = F.when(~F.exists("pairs", lambda p: p.i != p.d), F.col("ipos"))
    aligned = met.groupBy("doc_id", "row_key", "item_id", "shift").agg(F.size(F.collect_set("ipos")).cast("long").alias("all"), F.size(F.collect_set(verbatim)).cast("long").alias("same"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    side = lambda name: F.size(F.array_distinct(F.transform("pairs", lambda p: p[name])))
    consistent = (side("i") == F.size("pairs")) & (side("d") == F.size("pairs"))
    aligned = aligned.select("doc_id", "row_key", "item_id", F.when(consistent, F.col("all")).otherwise(F.col("same")).alias("n_windows"), (~F.exists("pairs", lambda p: p.i != p.d)).alias("same_values"))
    best = aligned.groupBy("doc_id", "row_key", "item_id").agg(F.max(F.struct("n_windows", "same_values")).alias("b"))
    best = best.select("doc_id", "row_key", "item_id", "b.n_windows", "b.same_values").join(sizes, "item_id").withColumn("share", F.col("n_windows") / F.col("windows"))
    return best.filter((F.col("n_windows") >= min_windows) | (F.col("share") >= min_share)).select("doc_id", "row_key", "item_id", "n_windows", "share", "same_values")


def op6_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every document that holds a benchmark item, with the item."""
    return contaminated(docs, benchmark).select("doc_id", "item_id", "n_windows", F.round("share", 6).alias("share"), "same_values")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without benchmark items, with all their columns, whatever their names; repeated rows stay or go together. Null and empty texts stay."""
    bad = materialize(contaminated(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")).distinct(), "contaminated")
    return framed(docs, ["doc_id"]).join(bad, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_key") == F.col("_key")), "left_anti").select("row.*")
