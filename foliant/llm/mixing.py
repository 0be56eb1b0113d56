"""Mixing sources to target weights, in blocks of tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import framed, materialize, prefix_sums, text_of, words_of

#: Words in a block, slots in an output shard, and chunks in which the documents of a source are laid out.
BLOCK, SLOTS, CHUNKS = 128, 1024, 1024
#: Sources that are drawn together: a shard draws its counts of groups first, then of the sources of each.
GROUP = 1024


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words wanted from each source: share of all words by weight; no source above most times its size, the excess reshared."""
    wanted, capped, left = [0.0] * len(sizes), set(), share * sum(sizes)
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        total = sum(weights[i] for i in free)
        for i in free:
            wanted[i] = left * weights[i] / total
        over = [i for i in free if wanted[i] > most * sizes[i]]
        if not over:
            return wanted
        for i in over:
            wanted[i] = most * sizes[i]
            left -= wanted[i]
        capped.update(over)


def with_targets(sources: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds target to sources (source_size, weight), as targets does: rounds of sums over the table, of which the driver sees one row each."""
    limit, level, before = most * F.col("source_size"), 0.0, -1
    while True:
        free = level * F.col("weight") <= limit
        row = sources.agg(F.sum("source_size").alias("all"), F.sum(F.when(~free, limit)).alias("full"), F.sum(F.when(free, F.col("weight"))).alias("weights"), F.count_if(~free).alias("n")).first()
        if row["n"] == before or not row["weights"]:
            return sources.withColumn("target", F.when(free, level * F.col("weight")).otherwise(limit))
        level, before = (share * row["all"] - (row["full"] or 0.0)) / row["weights"], row["n"]


def _mixed(right: np.ndarray, key: np.ndarray, turn: int) -> np.ndarray:
    z = (right + key * np.uint64(0x9E3779B97F4A7C15) + np.uint64((turn + 1) * 0xD1B54A32D192ED03 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(29)
    z *= np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(32))


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of range(size) for each key: a Feistel network over 2 * half bits, walked until below size; or its inverse."""
    out, size = index.astype(np.uint64), size.astype(np.uint64)
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2).astype(np.float64))).astype(np.int64) + 2) // 2).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        h, k = half[todo], key[todo].astype(np.uint64)
        mask = (np.uint64(1) << h) - np.uint64(1)
        left, right = out[todo] >> h, out[todo] & mask
        for turn in range(4):
            if back:
                left, right = right ^ (_mixed(left, k, 3 - turn) & mask), left
            else:
                left, right = right, left ^ (_mixed(right, k, turn) & mask)
        out[todo] = left << h | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def pass_key(src: np.ndarray, turn: np.ndarray | int, seed: int) -> np.ndarray:
    """The key of a pass over a source's blocks."""
    return src * 1_000_003 + turn * 97 + seed


def quotas(src: np.ndarray, size: np.ndarray, target: np.ndarray, seed: int) -> np.ndarray:
    """Blocks to take from each source, so that their words come nearest to its target.

    A source's last block is shorter; where it comes in the last pass over the source tells how many words so many blocks have.
    """
    blocks = -(-size // BLOCK)
    turns = np.where(size > 0, target // np.maximum(size, 1), 0).astype(np.int64)
    left, tail = target - turns * size, size - BLOCK * (blocks - 1)
    at = permute(np.maximum(blocks - 1, 0), np.maximum(blocks, 1), pass_key(src, turns, seed), back=True)
    words = lambda n: np.where(n > at, BLOCK * (n - 1) + tail, BLOCK * n)
    low = np.minimum((left // BLOCK).astype(np.int64), blocks)
    near = np.stack([np.minimum(low + k, blocks) for k in range(3)])
    best = near[np.abs(words(near) - left).argmin(axis=0), np.arange(len(size))]
    return np.where(size > 0, turns * blocks + best, 0)


class Mix:
    """A drawn mix: sized (each document's words and place), sources (one row each), slots (the output's blocks)."""

    def __init__(self, sized: DataFrame, sources: DataFrame, slots: DataFrame):
        self.sized, self.sources, self.slots = sized, sources, slots


def _sources(rows: DataFrame, weights: tuple[float, ...], share: float, most: float, seed: int) -> DataFrame:
    """One row for each source of rows (source, size): source, source_size, src (its number), target, quota (blocks to take), blocks."""
    found = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = found.withColumn("src", (F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1).cast("long"))  # sources, not rows
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    numbered = materialize(numbered.withColumn("weight", weight), "mix-sources")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            size = batch["source_size"].to_numpy(np.int64)
            yield batch.assign(quota=quotas(batch["src"].to_numpy(np.int64), size, batch["target"].to_numpy(np.float64), seed), blocks=-(-size // BLOCK))

    with_target = with_targets(numbered, share, most).select("source", "source_size", "src", "target")
    return materialize(with_target.mapInPandas(counted, "source string, source_size long, src long, target double, quota long, blocks long"), "mix-quotas")


def _multinomial(seed: list[int], n: int, chances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.random.default_rng(seed).multinomial(n, chances / chances.sum())
    some = np.flatnonzero(counts)
    return some, counts[some]


def _draws(sources: DataFrame, total: int, seed: int) -> DataFrame:
    """The multinomial counts of each output shard: shard, src, n, and first, its slots before these. Groups of sources first, then the sources of each."""
    spark = sources.sparkSession
    groups = sources.withColumn("grp", F.expr(f"src div {GROUP}")).groupBy("grp").agg(F.sum("quota").alias("quota"), F.array_sort(F.collect_list(F.struct("src", "quota"))).alias("members"))
    sums = groups.select("grp", "quota").orderBy("grp").collect()  # a row for each GROUP sources
    names, chances = np.array([r["grp"] for r in sums], dtype=np.int64), np.array([r["quota"] for r in sums], dtype=np.float64)

    def of_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                some, n = _multinomial([seed, shard], min(SLOTS, total - shard * SLOTS), chances)
                yield pd.DataFrame({"shard": shard, "grp": names[some], "n": n, "first": np.cumsum(n) - n})

    def of_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, grp, n, first, members in batch[["shard", "grp", "n", "first", "members"]].itertuples(index=False):
                src, quota = (np.array([m[k] for m in members], dtype=np.int64) for k in ("src", "quota"))
                some, n = _multinomial([seed, shard, grp], n, quota.astype(np.float64))
                yield pd.DataFrame({"shard": shard, "src": src[some], "n": n, "first": first + np.cumsum(n) - n})

    drawn = spark.range(-(-total // SLOTS)).mapInPandas(of_groups, "shard long, grp long, n long, first long")
    met = drawn.join(groups.select(F.col("grp").alias("g"), "members"), F.col("grp") == F.col("g"))
    return materialize(met.select("shard", "grp", "n", "first", "members").mapInPandas(of_members, "shard long, src long, n long, first long"), "mix-draws")


def draw(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: int = 7) -> Mix:
    """Draws a mix of documents (doc_id, text, source).

    Sources, by code point with null last, have the weights in turn. Their documents are laid end to end (in
    chunks by hash, by id within) and cut into blocks of BLOCK words; a source's last block may be shorter. Each output shard of SLOTS slots draws
    multinomial counts; what a source is drawn beyond its quota of blocks goes to those below theirs, so that
    no block comes more than most times and each source's words are within half a block of its target. Slot i of a source holds block
    permute(i); each pass over the source has a permutation of its own. The draw depends on seed and rows alone.

    Null and empty texts have no words and are never drawn; very long ones are cut into as many blocks as they fill; repeated rows are laid out each; an
    empty table, or one without words, gives no slots; other columns are ignored.
    """
    rows = docs.select("doc_id", "source", text_of().alias("_text"))
    rows = rows.select("doc_id", "source", F.xxhash64("_text").alias("row_key"), F.size(words_of(F.col("_text"))).cast("long").alias("size"))
    rows = materialize(rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "row_key"), F.lit(CHUNKS))), "mix-sizes")
    sources = _sources(rows, weights, share, most, seed)
    known = sources.select(F.col("source").alias("_source"), "src", "source_size", "target")
    sized = rows.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    sized = materialize(prefix_sums(sized, ["src"], "chunk", ["doc_id", "row_key"], "size", "place"), "mix-places")
    spark = docs.sparkSession
    total = sources.agg(F.coalesce(F.sum("quota"), F.lit(0)).alias("n")).first()["n"]
    if not total:
        return Mix(sized, sources, spark.createDataFrame([], "shard long, slot long, src long, block long"))
    drawn = _draws(sources, total, seed)
    before = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, -1)  # over sources, not rows
    sums = sources.join(drawn.groupBy(F.col("src").alias("_src")).agg(F.sum("n").alias("drawn")), F.col("src") == F.col("_src"), "left").fillna(0, ["drawn"])
    over, under = F.greatest(F.expr("drawn - quota"), F.lit(0)), F.greatest(F.expr("quota - drawn"), F.lit(0))
    sums = sums.select("src", "quota", "blocks", "drawn", over.alias("over"), under.alias("under"))
    sums = sums.withColumns({c + "_at": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("over", "under")})
    sums = materialize(sums, "mix-sums")
    numbered = prefix_sums(drawn.withColumn("chunk", F.expr("shard div 256")), ["src"], "chunk", ["shard"], "n", "start")
    numbered = numbered.join(sums.select(F.col("src").alias("_src"), "quota", "blocks", "over_at"), F.col("src") == F.col("_src"))

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = batch["n"].to_numpy()
            row = np.repeat(np.arange(len(batch)), n)
            within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            of = {c: batch[c].to_numpy(np.int64)[row] for c in ("shard", "src", "first", "start", "quota", "blocks", "over_at")}
            index = of["start"] + within
            slot = permute(of["first"] + within, np.minimum(SLOTS, total - of["shard"] * SLOTS), of["shard"] * 7919 + seed + 1)
            extra = np.where(index >= of["quota"], of["over_at"] + index - of["quota"], -1)
            yield pd.DataFrame({"shard": of["shard"], "slot": slot, "src": of["src"], "index": index, "blocks": of["blocks"], "extra": extra})

    dealt = numbered.select("shard", "src", "n", "first", "start", "quota", "blocks", "over_at").repartition("shard")
    dealt = materialize(dealt.mapInPandas(slots, "shard long, slot long, src long, index long, blocks long, extra long"), "mix-dealt")
    room = sums.filter("under > 0").select("src", "blocks", "drawn", "under_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("under") - 1)).alias("k"))
    room = room.select(F.expr("under_at + k").alias("extra"), "src", F.expr("drawn + k").alias("index"), "blocks")
    moved = dealt.filter("extra >= 0").select("shard", "slot", "extra").join(room, "extra")
    columns = ["shard", "slot", "src", "index", "blocks"]

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            src, index, blocks = (batch[c].to_numpy(np.int64) for c in ("src", "index", "blocks"))
            yield pd.DataFrame({"shard": batch["shard"], "slot": batch["slot"], "src": src, "block": permute(index % blocks, blocks, pass_key(src, index // blocks, seed))})

    both = dealt.filter("extra < 0").select(columns).union(moved.select(columns))
    return Mix(sized, sources, materialize(both.mapInPandas(placed, "shard long, slot long, src long, block long"), "mix-slots"))


def _pieces(sized: DataFrame) -> DataFrame:
    """One row for each document and block that it reaches into, with the words there: from begin, n of them."""
    ends = F.expr("place + size - 1")
    cut = sized.filter("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"place div {BLOCK}"), F.floor(ends / BLOCK).cast("long"))))
    begin = F.greatest(F.col("block") * BLOCK - F.col("place"), F.lit(0))
    return cut.withColumn("begin", begin).withColumn("n", F.least((F.col("block") + 1) * BLOCK - F.col("place"), F.col("size")) - begin)


def taken(mix: Mix) -> DataFrame:
    """Each document's words in the mix: doc_id, row_key, size, source_size, target, taken, starts (times its first word comes)."""
    times = mix.slots.groupBy("src", "block").agg(F.count("*").alias("times"))
    met = _pieces(mix.sized).join(times, ["src", "block"], "left").fillna(0, ["times"])
    drawn = met.groupBy("src", "place", "doc_id", "row_key", "size", "source_size", "target").agg(F.sum(F.expr("n * times")).alias("taken"), F.sum(F.when(F.col("begin") == 0, F.col("times")).otherwise(0)).alias("starts"))
    empty = mix.sized.filter("size = 0").withColumns({"taken": F.lit(0).cast("long"), "starts": F.lit(0).cast("long")})
    columns = ["doc_id", "row_key", "size", "source_size", "target", "taken", "starts"]
    return drawn.select(columns).union(empty.select(columns))


def mixed_texts(docs: DataFrame, mix: Mix) -> DataFrame:
    """The output: shard, slot, source number and the block's words, joined by spaces. docs are those that were drawn from."""
    words = docs.select(F.col("doc_id").alias("_id"), text_of().alias("_text")).withColumn("_key", F.xxhash64("_text")).dropDuplicates(["_id", "_key"])
    cut = _pieces(mix.sized).join(words, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_key") == F.col("_key")))
    part = F.array_join(F.slice(words_of(F.col("_text")), F.col("begin").cast("int") + 1, F.col("n").cast("int")), " ")
    texts = cut.select("src", "block", F.struct("place", part.alias("part")).alias("p")).groupBy("src", "block").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    texts = texts.select("src", "block", F.array_join(F.transform("ps", lambda p: p.part), " ").alias("text"))
    return mix.slots.join(texts, ["src", "block"]).select("shard", "slot", "src", "text")


def op2_mixing(docs: DataFrame) -> DataFrame:
    """The thin query over draw and taken."""
    return taken(draw(docs)).select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The documents as often as the mix takes the block of their first word, with all their columns.

    Rows of one id and text are one document here and come as often as they are taken together. Null and empty texts, which have no words, are never
    taken; a very long text comes whole, and its source may then be above its target; an empty table stays empty.
    """
    found = taken(draw(docs)).groupBy("doc_id", "row_key").agg(F.sum("starts").alias("_starts"), F.count("*").alias("_rows"))
    found = materialize(found.select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), "_starts", "_rows").filter("_starts > 0"), "mix-taken")
    once = framed(docs, ["doc_id"])
    if not found.filter("_rows > 1").isEmpty():
        once = once.dropDuplicates(["doc_id", "row_key"])
    met = once.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_key") == F.col("_key")))
    return met.select("row", F.explode(F.sequence(F.lit(1), F.col("_starts").cast("int")))).select("row.*")
