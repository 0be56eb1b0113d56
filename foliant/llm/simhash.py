"""SimHash near-duplicates, searched in BK-trees of shards."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import components, framed, materialize, released, small_batches, text_of, words_of
from foliant.session import removed

#: Fingerprints in one shard tree; with 8 bytes each this bounds what a task holds.
TREE = 4096
#: So many of the commonest shingles come last in the order of all; they are counted in all texts, whatever their number. COUNTED, from which a share was counted once, is read by nothing any more.
COUNTED, COMMONEST = 20_000, 100_000
#: Texts of one shingle, or of one leader, that a task of a join compares with all the others of it.
SALTED = 1_000
#: Shingles in a text's sketch, the share of them that two texts must have in common to be compared, and rounds of comparisons with leaders.
SKETCH, MET, ROUNDS = 24, 0.2, 2


def fingerprint(text: Column, shingle: int = 3, seed: int = 42) -> Column:
    """The 64-bit SimHash of a text that isn't null, as a signed long: letters A-Z lower-cased, word shingles with repeats, XXH64."""

    @F.pandas_udf("long")
    def simhash(raw: pd.Series) -> pd.Series:
        import xxhash

        digest = xxhash.xxh64_intdigest
        out = np.zeros(len(raw), dtype=np.uint64)
        for k, data in enumerate(raw):
            words = data.lower().split()  # of bytes: ASCII letters and white space alone
            if not words:
                continue
            if len(words) < shingle:
                grams = [b" ".join(words)]
            else:
                grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
            hashes = np.array([digest(g, seed) for g in grams], dtype="<u8")
            counts = np.zeros(64, dtype=np.int64)
            for part in np.array_split(hashes, len(hashes) // 4096 + 1):
                counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
            out[k] = np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0]
        return pd.Series(out.view(np.int64))

    return simhash(text.cast("binary"))


def shard_keys(fp: Column, radius: int) -> Column:
    """The shards in which a fingerprint is searched, as longs.

    With radius + 2 bands, two fingerprints within the radius agree in two bands at least, so that they
    meet in the shard of one pair of bands.
    """
    bands = radius + 2
    edges = [64 * i // bands for i in range(bands + 1)]
    part = lambda i: F.shiftrightunsigned(fp, edges[i]).bitwiseAND((1 << (edges[i + 1] - edges[i])) - 1)
    pairs = list(combinations(range(bands), 2))
    return F.array(*[F.xxhash64(F.lit(k), part(i), part(j)) for k, (i, j) in enumerate(pairs)])


class ShardTree:
    """A BK-tree: a node's children are keyed by their Hamming distance to it."""

    def __init__(self, values: np.ndarray):
        self.values, self.children = values, [{} for _ in values]
        todo = [np.arange(len(values))] if len(values) else []
        while todo:
            own = todo.pop()
            root, rest = own[0], own[1:]
            far = np.bitwise_count(values[rest] ^ values[root])
            for k in np.unique(far):
                below = rest[far == k]
                self.children[root][int(k)] = int(below[0])
                todo.append(below)

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, indices of the queries within the radius); follows only edges within the radius of the distance."""
        todo = [(0, np.arange(len(queries)))] if len(self.values) else []
        while todo:
            node, some = todo.pop()
            far = np.bitwise_count(queries[some] ^ self.values[node]).astype(np.int64)
            if len(hits := some[far <= radius]):
                yield node, hits
            for k, child in self.children[node].items():
                if len(below := some[np.abs(far - k) <= radius]):
                    todo.append((child, below))


def links(tree: np.ndarray, queries: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the links within a block, or between two, a forest with the same components: (value, root value)."""
    values = tree if queries is None else np.concatenate([tree, queries])
    at, n = np.arange(len(values)), 0 if queries is None else len(tree)
    for node, hits in ShardTree(tree).search(tree if queries is None else queries, radius):
        met = np.unique(at[np.append(hits + n, node)])
        if len(met) > 1:
            at[np.isin(at, met)] = met[0]
    moved = at != np.arange(len(values))
    return values[moved], values[at[moved]]


def near_edges(fingerprints: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) among distinct fingerprints (fp long), whose components are those of all links within the radius.

    Each shard is cut into blocks of TREE fingerprints; every block's tree is searched by the block itself
    and by the blocks after it.
    """
    keyed = fingerprints.select("fp", F.explode(shard_keys(F.col("fp"), radius)).alias("shard"))
    shared = keyed.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1")
    members = keyed.join(shared, "shard").withColumn("block", F.pmod(F.xxhash64("fp", F.lit("block")), F.ceil(F.col("n") / TREE)))
    blocks = materialize(members.groupBy("shard", "block").agg(F.collect_list("fp").alias("tree"), F.first("n").alias("n")), "simhash-blocks")
    one = blocks.select("tree", F.lit(None).cast("array<long>").alias("queries"))
    large = blocks.filter(F.col("n") > TREE)
    right = large.select(F.col("shard").alias("s"), F.col("block").alias("k"), F.col("tree").alias("queries"))
    two = large.join(right, (F.col("shard") == F.col("s")) & (F.col("block") < F.col("k"))).select("tree", "queries")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [links(np.asarray(t, dtype=np.int64).view(np.uint64), None if q is None else np.asarray(q, dtype=np.int64).view(np.uint64), radius) for t, q in zip(batch["tree"], batch["queries"], strict=True)]
            if found:
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
                yield pd.DataFrame({"a": a, "b": b})

    return one.unionByName(two).mapInPandas(search, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """Near-duplicates of documents (doc_id, text): doc_id, fp (signed long), row_key (hash of the text), component_id.

    Fingerprints at most radius bits apart are linked and component_id is the smallest doc_id reachable.
    Null and empty texts have fingerprint 0, which links like any other; repeated rows share a component;
    null ids never name one unless all of its ids are null; very long texts are fingerprinted whole; a bit that half of the hashes
    set, a tie, is 0; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select("doc_id", text_of().alias("_text"))
    rows = materialize(rows.select("doc_id", F.xxhash64("_text").alias("row_key"), fingerprint(F.col("_text"), shingle).alias("fp")), "simhash")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-distinct")
    roots = components(near_edges(distinct, radius)).select(F.col("node").alias("fp"), "root")
    linked = distinct.join(roots, "fp")
    first = linked.groupBy("root").agg(F.min("first").alias("least"))
    known = linked.join(first, "root").select("fp", "least")
    alone = distinct.join(roots, "fp", "left_anti").filter("n > 1").select("fp", F.col("first").alias("least"))
    return rows.join(known.union(alone), "fp", "left").select("doc_id", "fp", "row_key", F.coalesce("least", "doc_id").alias("component_id"))


def op4_simhash(docs: DataFrame) -> DataFrame:
    """The thin query over near_duplicates."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def hashed_words(text: Column, plain: bool = False) -> Column:
    """The hashes of a text's words in lower case, as an array; plain words are runs of letters and digits."""
    small = F.lower(text)
    words = words_of(F.regexp_replace(small, r"[^\p{L}\p{M}\p{N}]+", " ") if plain else small)
    return F.transform(words, lambda w: F.xxhash64(w))


def _shingles(words: np.ndarray, width: int) -> np.ndarray:
    """The distinct hashes of shingles of words (hashes), in order; fewer words are one shingle, none has none."""
    n = max(len(words) - width + 1, min(len(words), 1))
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for part in (words[i : i + n] for i in range(min(width, len(words)))):
            out = (out ^ part.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return np.unique(out)


def _numbered(words: np.ndarray) -> np.ndarray:
    """A bag of words (hashes) as a set: each word's hash mixed with how often it has come before."""
    words = np.sort(words.view(np.uint64))
    at = np.arange(len(words))
    begins = np.concatenate(([True], words[1:] != words[:-1])) if len(words) else np.zeros(0, bool)
    with np.errstate(over="ignore"):
        return (words + (at - np.maximum.accumulate(np.where(begins, at, 0))).astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(words: Column, plain: Column, width: int = 5) -> Column:
    """Of two arrays of hashed words: the sets of shingles of the first (grams) and of numbered words of the second (bag)."""

    @F.pandas_udf("grams array<long>, bag array<long>")
    def sets(all_words: pd.Series, all_plain: pd.Series) -> pd.DataFrame:
        longs = lambda found: [x.view(np.int64) for x in found]
        return pd.DataFrame({"grams": longs(_shingles(np.asarray(w, dtype=np.int64), width) for w in all_words), "bag": longs(_numbered(np.asarray(w, dtype=np.int64)) for w in all_plain)})

    return sets(words, plain)


def commonest(rows: DataFrame, size: int, width: int) -> np.ndarray:
    """The commonest shingles of rows (row_key, _text), the rarer first, as counted in all texts (size is read by nothing any more). Of the texts themselves only those that come more than once are shuffled."""
    twice = materialize(rows.groupBy("row_key").agg(F.count("*").alias("rows")).filter("rows > 1").select("row_key"), "similar-twice")
    texts = rows.select("row_key", "_text")
    once = texts.join(twice, "row_key", "left_anti").union(texts.join(twice, "row_key").dropDuplicates(["row_key"]))
    grams = shingle_sets(hashed_words(F.col("_text")), F.array().cast("array<long>"), width)
    counts = once.select(F.explode(grams["grams"]).alias("gram")).groupBy("gram").agg(F.count("*").alias("held")).filter("held > 3")
    with released(rows.sparkSession):
        found = counts.orderBy(F.desc("held"), "gram").limit(COMMONEST).select("gram").toPandas()
    return found["gram"].to_numpy(dtype=np.int64)[::-1]


def meeting_shingles(words: Column, last: np.ndarray, similarity: float, width: int = 5, sketch: int = 0) -> Column:
    """The shingles at which a text meets others, as a struct: n (its distinct shingles), p, and arrays gram and code (rank * 4 + sketched * 2 + common).

    The first p = n - ceil(similarity * n) + 1 shingles have a rank from 1, in one order for all texts: by hash, those of last at the end. Two
    texts that are similar have one of these in common, whatever the order is. The sketch shingles with the least hashes are sketched (and have rank 0 if
    they aren't among the first); two texts have about as many of these in common as their similarity says. common: whether it is one of last.
    """
    order = np.argsort(last)
    known = last[order]

    @F.pandas_udf("n int, p int, gram array<long>, code array<int>")
    def met(all_words: pd.Series) -> pd.DataFrame:
        out = []
        for words in all_words:
            own = _shingles(np.asarray(words, dtype=np.int64), width)
            late = np.zeros(len(own), dtype=np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, own.view(np.int64)), len(known) - 1)
                late = np.where(known[at] == own.view(np.int64), order[at] + 1, 0)
            p = len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1 if len(own) else 0
            rank = np.zeros(len(own), dtype=np.int64)
            rank[np.lexsort((own, late))[:p]] = np.arange(1, p + 1)
            sketched = np.arange(len(own)) < sketch
            k = np.flatnonzero((rank > 0) | sketched)
            out.append((len(own), p, own[k].view(np.int64), (rank * 4 + sketched * 2 + (late > 0))[k].astype(np.int32)))
        return pd.DataFrame(out, columns=["n", "p", "gram", "code"])

    return met(words)


def alike_anywhere(texts: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float, words: float | None = None) -> DataFrame:
    """Of texts, those similar to one with a smaller place: row_key, leader_key, jaccard (of shingles).

    texts: row_key, place, and the fields of meeting_shingles; sets_of(row_key) looks up the shingle_sets of some texts. Texts meet at the shingles that they
    share. In each of ROUNDS rounds a text is compared with the texts of the smallest place at one of its shingles, and goes if it is similar to one,
    which clears large groups; of the others all pairs are looked at, but for those that meet at common shingles beyond their first ones.
    Where two have c first shingles in common, they have at most c + what follows the first ones of the longer in common, and at each no more
    than their places allow, so that no pair as similar as asked is left out. With words, texts whose numbered words are as similar as that go too, if
    they share MET of their sketches.
    """
    seen = texts.select("row_key", F.explode(F.arrays_zip("gram", "code")).alias("m")).select("row_key", "m.*")  # narrow, as most shingles are one text's own
    counts = seen.groupBy("gram").agg(F.count("*").alias("held")).filter("held > 1").select("gram")
    met = seen.join(counts, "gram").join(texts.select("row_key", "place", "n", "p"), "row_key")
    bit = lambda k: F.col("code").bitwiseAND(k) != 0
    rest = materialize(met.select("row_key", "place", "n", "p", "gram", F.shiftright("code", 2).alias("rank"), bit(2).alias("sketched"), bit(1).alias("common")), "similar-met")
    fields = ("row_key", "place", "n", "p", "rank", "sketched")
    leader = lambda value: [value(c).alias(f"leader_{c}") for c in fields]

    def verified(pairs: DataFrame) -> DataFrame:
        asked = similarity / (1 + similarity) * (F.col("n") + F.col("leader_n")) - 1e-9
        most = F.least("rank", "leader_rank") + F.least(F.col("n") - F.col("rank"), F.col("leader_n") - F.col("leader_rank"))
        first = (F.col("rank") > 0) & (F.col("leader_rank") > 0) & (most >= asked)
        both = F.lit(words is not None) & F.col("sketched") & F.col("leader_sketched")
        kept = pairs.filter((F.col("place") > F.col("leader_place")) & (first | both))
        kept = kept.groupBy("row_key", "leader_row_key", "n", "p", "leader_n", "leader_p").agg(F.count_if(first).alias("c"), F.count_if(both).alias("s"))
        may = (F.col("c") > 0) & (F.col("c") + F.greatest(F.col("n") - F.col("p"), F.col("leader_n") - F.col("leader_p")) >= asked)
        kept = kept.filter(may | (F.col("s") > 0) & (F.col("s") >= MET * F.least(F.lit(SKETCH), "n", "leader_n")))
        kept = materialize(kept.select("row_key", F.col("leader_row_key").alias("leader_key")), "similar-pairs")
        sets = materialize(sets_of(kept.select("row_key").union(kept.select("leader_key")).distinct()), "similar-pair-sets")
        sized = kept.groupBy("leader_key").agg(F.ceil(F.count("*") / SALTED).alias("parts"))  # a leader of very many is dealt out
        own = kept.join(sized, "leader_key").withColumn("part", F.pmod("row_key", "parts")).drop("parts").join(sets, "row_key")
        other = sets.withColumnsRenamed({"row_key": "leader_key", "grams": "leader_grams", "bag": "leader_bag"}).join(sized, "leader_key")
        other = other.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).drop("parts")
        scored = own.join(other, ["leader_key", "part"]).select("row_key", "leader_key", jaccard("grams", "leader_grams").alias("jaccard"), jaccard("bag", "leader_bag").alias("words"))
        near = F.col("jaccard") >= similarity
        best = scored.filter(near if words is None else near | (F.col("words") >= words)).groupBy("row_key").agg(F.max(F.struct("jaccard", "leader_key")).alias("best"))
        found = materialize(best.select("row_key", "best.leader_key", "best.jaccard"), "similar-found")
        removed(sets)
        removed(kept)
        return found

    taken = None
    for _ in range(ROUNDS if words is not None else 1):
        least = rest.groupBy("gram").agg(F.min(F.struct("place", *[c for c in fields if c != "place"])).alias("l")).select("gram", *leader(lambda c: F.col(f"l.{c}")))
        found = verified(rest.join(materialize(least, "similar-least"), "gram"))
        taken = found if taken is None else taken.union(found)
        before, rest = rest, materialize(rest.join(found.select("row_key"), "row_key", "left_anti"), "similar-rest")
        removed(before)
    rest = rest.filter((F.col("rank") > 0) | ~F.col("common"))
    sized = rest.groupBy("gram").agg(F.count("*").alias("held")).filter("held > 1").select("gram", F.ceil(F.col("held") / SALTED).alias("parts"))
    rest = materialize(rest.join(sized, "gram"), "similar-rest")
    left = rest.withColumn("part", F.pmod("row_key", F.col("parts"))).drop("parts")
    right = rest.select("gram", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), *leader(F.col))
    return taken.union(verified(left.join(right, ["gram", "part"])))


def jaccard(a: str, b: str) -> Column:
    """The similarity of two arrays of distinct values; null where both are empty."""
    common = F.size(F.array_intersect(a, b))
    return common / F.nullif(F.size(a) + F.size(b) - common, F.lit(0))


def similar_texts(docs: DataFrame, similarity: float = 0.8, width: int = 5, words: float | None = None, only: DataFrame | None = None) -> DataFrame:
    """Texts to drop as copies of others: doc_id, row_key (hash of the text), leader_key, jaccard. Of every two similar texts one goes at least.

    Texts are similar if the Jaccard similarity of their distinct word shingles is at least as asked; all pairs of these are found. With words,
    texts are similar too if that of their words (of letters and digits, counted with repeats) is at least that: copies with single words changed
    here and there, of which few shingles are left. Candidates of these share MET of the SKETCH shingles of least hash, which misses next to none of them. A text
    goes in favour of one with a smaller doc_id (null last). only (_id, _key): the rows that are compared. Texts without words are not compared; repeated rows
    and rows of one text are one; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select("doc_id", text_of().alias("_text")).filter(F.col("_text").rlike(r"[^\x20\x09-\x0D]")).withColumn("row_key", F.xxhash64("_text"))
    last = commonest(rows, 0, width)
    with small_batches(docs.sparkSession):
        prints = rows.select("doc_id", "row_key", meeting_shingles(hashed_words(F.col("_text")), last, similarity, width, SKETCH if words is not None else 0).alias("m"))
        all_prints = materialize(prints.select("doc_id", "row_key", "m.*"), "similar-prints")
    prints = all_prints
    if only is not None:
        prints = prints.join(only, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_key") == F.col("_key")), "left_semi")
    first = lambda c: F.first(c).alias(c)
    texts = prints.groupBy("row_key").agg(F.min("doc_id").alias("doc_id"), *[first(c) for c in ("n", "p", "gram", "code")])
    texts = materialize(texts.withColumn("place", F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_key"))), "similar-texts")
    removed(all_prints)

    def read(named: DataFrame) -> DataFrame:
        """Texts by row_key and doc_id: one row of each, met by id too, so that the copies of a text are dealt out."""
        named = named.select("row_key", F.xxhash64("doc_id").alias("id_key"))
        return rows.select("row_key", F.xxhash64("doc_id").alias("id_key"), "_text").join(named, ["row_key", "id_key"]).dropDuplicates(["row_key", "id_key"])

    def sets_of(wanted: DataFrame) -> DataFrame:
        found = read(texts.join(wanted, "row_key"))
        sets = shingle_sets(hashed_words(F.col("_text")), hashed_words(F.col("_text"), plain=True) if words is not None else F.array().cast("array<long>"), width)
        return found.select("row_key", sets.alias("s")).select("row_key", "s.*")

    with small_batches(docs.sparkSession):
        found = alike_anywhere(texts, sets_of, similarity, words)
    return found.join(texts.select("row_key", "doc_id"), "row_key").select("doc_id", "row_key", "leader_key", "jaccard")


def deduplicate(docs: DataFrame, radius: int = 2, shingle: int = 3, similarity: float | None = None, width: int = 5, words: float | None = None) -> DataFrame:
    """The documents, one of each component: the row with the smallest id; of rows with the same id and text, one.

    With a similarity (and words), rows of these whose texts similar_texts takes as copies of others go too; since a row always goes in favour of a smaller
    id, of each group one stays. Where all ids of a component are null, one row of each text stays. Null and empty texts are one component; an empty table
    stays empty; very long texts are compared whole; all columns stay, whatever their names.
    """
    found = near_duplicates(docs, radius, shingle)
    ranked = materialize(found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("component_id", "row_key"), "simhash-first")
    nameless = F.when(F.col("component_id").isNull(), F.col("row_key"))
    keep = ranked.groupBy("component_id", nameless.alias("_own")).agg(F.min("row_key").alias("_key"), F.count("*").alias("_rows"))
    keep = keep.select(F.col("component_id").alias("_id"), "_key", "_rows")
    keep = materialize(keep, "simhash-keep")
    if similarity is not None:
        gone = similar_texts(docs, similarity, width, words, keep).select("doc_id", "row_key")
        keep = materialize(keep.join(gone, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("row_key")), "left_anti"), "simhash-left")
    kept = framed(docs, ["doc_id"]).join(keep, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_key") == F.col("_key")), "left_semi")
    if not keep.filter("_rows > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "row_key"])
    return kept.select("row.*")
