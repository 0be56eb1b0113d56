"""Hard negatives by a dual-tree search: trees over anchors and candidates, pruned by the intervals of inner products between nodes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import materialize, small_batches

#: A component x becomes floor(SCALE * x).
SCALE = 256
#: Vectors, about, that the tree's planes are fitted on, numbers in these, and leaves that it may have. They bound the driver's part; every row is indexed whatever they are.
FITTED, FITTED_NUMBERS, LEAVES = 16_384, 2**21, 1_024
#: Bytes of vectors in a block of candidates, and anchors in a group.
BLOCK_BYTES, GROUP = 262_144, 256
#: Slack for rounding, as a share of the numbers that an interval is made of.
SLACK = 1e-9
#: What a plan sends to Python in one batch.
ROWS = 16


class Planes(NamedTuple):
    """A full binary tree in levels: node k of a level has the children 2k (up to cuts) and 2k + 1; centers are those of the fitted vectors of all nodes, the root first."""

    depth: int
    normals: np.ndarray
    cuts: np.ndarray
    centers: np.ndarray


def fit_planes(values: np.ndarray, depth: int) -> Planes:
    """Cuts vectors at the median along the line between two that are far apart, depth times."""
    dims = values.shape[1]
    normals, cuts, centers = np.zeros((2**depth - 1, dims)), np.zeros(2**depth - 1), np.zeros((2 ** (depth + 1) - 1, dims))
    parts = {0: values}
    for k in range(2 ** (depth + 1) - 1):
        own = parts.pop(k)
        centers[k] = own.mean(axis=0) if len(own) else centers[(k - 1) // 2]
        if k < len(cuts):
            if len(own):
                far = own[np.argmax(((own - centers[k]) ** 2).sum(axis=1))]
                normals[k] = far - own[np.argmax(((own - far) ** 2).sum(axis=1))]
            along = own @ normals[k]
            cuts[k] = np.median(along) if len(own) else 0.0
            parts[2 * k + 1], parts[2 * k + 2] = own[along <= cuts[k]], own[along > cuts[k]]
    return Planes(depth, normals, cuts, centers)


def leaf_of(values: np.ndarray, planes: Planes) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, distance to the leaf's center) of each vector."""
    at = np.zeros(len(values), dtype=np.int64)
    for _ in range(planes.depth):
        at = 2 * at + 1 + ((values * planes.normals[at]).sum(axis=1) > planes.cuts[at])
    return at - (2**planes.depth - 1), np.sqrt(((values - planes.centers[at]) ** 2).sum(axis=1))


def radii(planes: Planes, leaves: np.ndarray) -> np.ndarray:
    """The radius of every node, given those of the leaves (below 0: nothing is in it): each ball holds its children's."""
    inner = 2**planes.depth - 1
    out = np.concatenate([np.full(inner, -1.0), leaves])
    for k in range(inner - 1, -1, -1):
        for child in (2 * k + 1, 2 * k + 2):
            if out[child] >= 0:
                out[k] = max(out[k], out[child] + np.sqrt(((planes.centers[k] - planes.centers[child]) ** 2).sum()))
    return out


def surviving(planes: Planes, anchors: np.ndarray, candidates: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Pairs (anchor leaf, candidate leaf) that a descent of both trees from their roots can't rule out, as an array of two columns.

    anchors, candidates: radii of all nodes. least, most: of each anchor leaf, between which scores matter. A pair of nodes goes with all that is below it
    where the interval of its inner products doesn't meet the anchors' one.
    """
    inner = 2**planes.depth - 1
    low, high = np.concatenate([np.full(inner, np.inf), least]), np.concatenate([np.full(inner, -np.inf), most])
    for k in range(inner - 1, -1, -1):
        low[k], high[k] = min(low[2 * k + 1], low[2 * k + 2]), max(high[2 * k + 1], high[2 * k + 2])
    size = np.sqrt((planes.centers**2).sum(axis=1))
    a = c = np.zeros(1, dtype=np.int64)
    for level in range(planes.depth + 1):
        if level:
            a, c = (np.repeat(2 * a + 1, 4) + np.tile([0, 0, 1, 1], len(a)), np.repeat(2 * c + 1, 4) + np.tile([0, 1, 0, 1], len(c)))
        there = (anchors[a] >= 0) & (candidates[c] >= 0)
        a, c = a[there], c[there]
        middle = np.concatenate([(planes.centers[x] * planes.centers[y]).sum(axis=1) for x, y in zip(np.array_split(a, len(a) // 65_536 + 1), np.array_split(c, len(a) // 65_536 + 1), strict=True)])
        reach = anchors[a] * size[c] + candidates[c] * size[a] + anchors[a] * candidates[c]
        reach += SLACK * (np.abs(middle) + reach + (size[a] + anchors[a]) * (size[c] + candidates[c])) + SLACK
        kept = (middle + reach >= low[a]) & (middle - reach <= high[a])
        a, c = a[kept], c[kept]
    return np.stack([a - inner, c - inner], axis=1)


def usable(vectors: DataFrame, anchor: Column) -> DataFrame:
    """vec_id, label, embedding (doubles) and anchor (boolean) of the rows with a label and a vector of finite numbers that has the commonest length (of several the greatest)."""
    odd = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    return rows.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~odd & (F.size("embedding") > 0))


def quantised(flat: np.ndarray, dims: int) -> np.ndarray:
    """The whole numbers of vectors, a row each, held where an inner product of dims of them still fits a long."""
    most = float(int(np.sqrt(2**62 / dims)))
    return np.clip(np.floor(flat * SCALE), -most, most).astype(np.int64).reshape(-1, dims)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner products of rows of whole numbers, exact: by doubles where they hold them."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


class Index(NamedTuple):
    """The candidates in blocks (leaf, named, ids, labels, vectors; by id, the named first ones having one), the anchors (aid, anchor_id, label, vector, leaf, copies), the tree, and both sides' radii."""

    blocks: DataFrame
    anchors: DataFrame
    planes: Planes
    dims: int
    anchor_radii: np.ndarray
    candidate_radii: np.ndarray


def indexed(rows: DataFrame) -> Index | None:
    """The index of usable rows; None without anchors. Equal anchors (in id, label and vector) are one with its number of copies; candidates stay apart."""
    sizes = rows.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    if not sizes or not sizes[0]["anchors"]:
        return None
    dims, n = sizes[0]["size"], sizes[0]["n"]
    rows = rows.filter(F.size("embedding") == dims)
    each = max(16, BLOCK_BYTES // (4 * dims))
    asked = min(FITTED, max(64, FITTED_NUMBERS // dims))
    some = rows.filter(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(2**31)) < int(2**31 * min(1.0, asked / n))).limit(2 * asked).select("embedding").toPandas()["embedding"]
    fitted = quantised(np.concatenate(some.to_list()) if len(some) else np.zeros(dims), dims).astype(np.float64)
    depth = max(0, min(int(np.log2(LEAVES)), int(np.ceil(np.log2(n / each))), int(np.log2(max(1, len(fitted) // 16)))))
    planes = fit_planes(fitted, depth)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = quantised(batch.column(2).flatten().to_numpy(zero_copy_only=False), dims)
            leaf, far = leaf_of(x.astype(np.float64), planes)
            narrow = np.abs(x).max(axis=1, initial=0) < 2**31
            data = [row.astype("<i4" if few else "<i8").tobytes() for row, few in zip(x, narrow, strict=True)]
            yield pa.record_batch({"vec_id": batch.column(0), "label": batch.column(1), "anchor": batch.column(3), "vector": pa.array(data, pa.binary()), "leaf": pa.array(leaf), "far": pa.array(far)})

    held = materialize(rows.mapInArrow(placed, "vec_id long, label long, anchor boolean, vector binary, leaf long, far double"), "negatives-rows")
    by_leaf = held.groupBy("leaf").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.max(F.when(F.col("anchor"), F.col("far"))).alias("anchor_far")).collect()  # LEAVES rows at most
    reach = {name: np.full(2**depth, -1.0) for name in ("far", "anchor_far")}
    for r in by_leaf:
        for name, all_of in reach.items():
            all_of[r["leaf"]] = -1.0 if r[name] is None else r[name] * (1 + SLACK) + SLACK
    sizes_of = {r["leaf"]: r["n"] for r in by_leaf}
    parts = F.array(*[F.lit(max(1, -(-sizes_of.get(k, 0) // each))) for k in range(2**depth)])
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.element_at(parts, (F.col("leaf") + 1).cast("int")))
    lists = held.withColumn("block", block).groupBy("leaf", "block").agg(F.collect_list(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id", "label", "vector")).alias("rows"))
    lists = lists.select("leaf", F.array_sort("rows").alias("r"))
    ids = F.transform("r", lambda x: F.coalesce(x.vec_id, F.lit(0)))
    blocks = lists.select("leaf", F.size(F.filter("r", lambda x: ~x.none)).alias("named"), ids.alias("ids"), F.col("r.label").alias("labels"), F.col("r.vector").alias("vectors"))
    own = held.filter("anchor").groupBy("vec_id", "label", "vector", "leaf").agg(F.count("*").alias("copies"))
    own = own.select(F.xxhash64("vec_id", "label", "vector").alias("aid"), F.col("vec_id").alias("anchor_id"), "label", "vector", "leaf", "copies")
    return Index(materialize(blocks, "negatives-blocks"), materialize(own, "negatives-anchors"), planes, dims, radii(planes, reach["anchor_far"]), radii(planes, reach["far"]))


def unpacked(vectors: np.ndarray, dims: int) -> np.ndarray:
    """Vectors (4 bytes a number, or 8 where one is large) as rows of longs."""
    if all(len(v) == 4 * dims for v in vectors):
        return np.frombuffer(b"".join(vectors), dtype="<i4").astype(np.int64).reshape(-1, dims)
    return np.stack([np.frombuffer(v, dtype="<i4" if len(v) == 4 * dims else "<i8").astype(np.int64) for v in vectors])


#: What a pair of blocks is scored by: (scores of anchors by candidates, whether their labels are the same, anchors, candidates) to columns of rows of the result.
Scorer = Callable[[np.ndarray, np.ndarray, dict[str, np.ndarray], np.ndarray], list[tuple[np.ndarray, ...]]]


def leaf_pairs(found: Index, anchors: DataFrame, pairs: np.ndarray, fields: list[str], scorer: Scorer, schema: str, name: str) -> DataFrame:
    """The scorer's rows over all blocks of the pairs of leaves, whose anchors (aid, label, vector, leaf and fields) come in groups of about GROUP."""
    spark = anchors.sparkSession
    many = anchors.groupBy("leaf").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    split = anchors.join(many, "leaf").withColumn("part", F.pmod("aid", "parts"))
    groups = split.groupBy("leaf", "part").agg(F.collect_list(F.struct("aid", "anchor_id", "label", "vector", *fields)).alias("a"))
    met = spark.createDataFrame(pd.DataFrame({"leaf": pairs[:, 0], "other": pairs[:, 1]}), "leaf long, other long")
    to = groups.join(met, "leaf").select("other", *[F.col(f"a.{c}").alias(f"a_{c}") for c in ("aid", "anchor_id", "label", "vector", *fields)])
    both = to.join(found.blocks.withColumnRenamed("leaf", "other"), "other").drop("other")
    columns, dims = [c.split()[0] for c in schema.split(", ")], found.dims

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                a = {c.removeprefix("a_"): v for c, v in row.items() if c.startswith("a_")}
                value = scores(unpacked(a["vector"], dims), unpacked(row["vectors"], dims))
                row["ids"] = np.array([*row["ids"][: row["named"]].tolist(), *[None] * (len(row["ids"]) - row["named"])], dtype=object)
                same = np.asarray(a["label"])[:, None] == np.asarray(row["labels"])[None, :]
                out += scorer(value, same, a, row)
            if out:
                yield pd.DataFrame({c: pd.array(np.concatenate([o[k] for o in out]), dtype="Int64") if c.endswith("_id") else np.concatenate([o[k] for o in out]) for k, c in enumerate(columns)})

    with small_batches(spark, ROWS):
        return materialize(both.mapInPandas(score, schema), name)


def best_positives(value: np.ndarray, same: np.ndarray, a: dict, row: dict, most: int) -> list[tuple[np.ndarray, ...]]:
    """Of each anchor the most + 1 best rows of its label that reach its least score, the anchor's own row perhaps among them, which is marked."""
    out = []
    ids = row["ids"]
    for k in range(len(value)):
        may = np.flatnonzero(same[k] & (value[k] >= a["least"][k]))
        top = may[np.argsort(-value[k][may], kind="stable")[: most + 1]]
        if len(top):
            own = np.array([ids[j] == a["anchor_id"][k] and row["vectors"][j] == a["vector"][k] for j in top])
            out.append((np.full(len(top), a["aid"][k]), np.full(len(top), a["anchor_id"][k], dtype=object), value[k][top], ids[top], own))
    return out


def best_negatives(value: np.ndarray, same: np.ndarray, a: dict, row: dict, most: int) -> list[tuple[np.ndarray, ...]]:
    """Of each anchor, for each of its positives, the most best rows of other labels between its bounds."""
    out = []
    ids = row["ids"]
    for k in range(len(value)):
        lows, highs = np.asarray(a["lows"][k]), np.asarray(a["highs"][k])
        may = np.flatnonzero(~same[k] & (value[k] >= lows.min()) & (value[k] <= highs.max()))
        if not len(may):
            continue
        order = may[np.argsort(-value[k][may], kind="stable")]
        falling = -value[k][order]
        for place, low, high in zip(a["places"][k], lows, highs, strict=True):
            first, last = np.searchsorted(falling, -high, "left"), np.searchsorted(falling, -low, "right")
            top = order[first : min(last, first + most)]
            if len(top):
                out.append((np.full(len(top), a["aid"][k]), np.full(len(top), a["anchor_id"][k], dtype=object), np.full(len(top), place, dtype=np.int32), value[k][top], ids[top]))
    return out


def leading(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The first most rows of each key, by score, then vec_id (null last), with rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def by_anchor_leaf(anchors: DataFrame, least: str, most: str, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each leaf the least and the greatest score that matters to its anchors; where it has none, nothing does."""
    low, high = np.full(leaves, np.inf), np.full(leaves, -np.inf)
    for r in anchors.groupBy("leaf").agg(F.min(least).alias("low"), F.max(most).alias("high")).collect():  # LEAVES rows at most
        low[r["leaf"]], high[r["leaf"]] = r["low"], r["high"]
    return low, high


def positives(found: Index, most: int) -> DataFrame:
    """The most best other rows of each anchor's label: aid, anchor_id, place (from 1), positive_id, score.

    Each anchor is first compared with the candidates of its own leaf; the score of its last positive there is what the descent prunes by.
    """
    n, schema = 2**found.planes.depth, "aid long, anchor_id long, score long, vec_id long, own boolean"
    scorer: Scorer = lambda v, s, a, r: best_positives(v, s, a, r, most)
    nothing = -(2**63)

    def first(rows: DataFrame) -> DataFrame:
        """The anchor's own row goes where it is among the first; of equal rows one goes."""
        mine = F.min(F.when(F.col("own"), F.col("rank"))).over(Window.partitionBy("aid", "anchor_id"))
        top = leading(rows, ["aid", "anchor_id"], most + 1).withColumn("_mine", F.coalesce(mine, F.lit(most + 1)))
        place = F.col("rank") - F.when(F.col("rank") > F.col("_mine"), 1).otherwise(0)
        return top.filter(F.col("rank") != F.col("_mine")).withColumn("place", place).drop("_mine")

    seeds = np.stack([np.arange(n)] * 2, axis=1)
    near = leaf_pairs(found, found.anchors.withColumn("least", F.lit(nothing)), seeds, ["least"], scorer, schema, "negatives-near")
    known = first(near).filter(F.col("place") == most).select("aid", "anchor_id", F.col("score").alias("least"))
    bounded = materialize(found.anchors.join(known, ["aid", "anchor_id"], "left").fillna({"least": nothing}), "negatives-bounded")
    low, _ = by_anchor_leaf(bounded, "least", "least", n)
    pairs = surviving(found.planes, found.anchor_radii, found.candidate_radii, low, np.where(low < np.inf, np.inf, -np.inf))
    far = leaf_pairs(found, bounded, pairs[pairs[:, 0] != pairs[:, 1]], ["least"], scorer, schema, "negatives-far")
    return materialize(first(near.union(far)).select("aid", "anchor_id", "place", F.col("vec_id").alias("positive_id"), "score"), "negatives-positives")


def mined(vectors: DataFrame, anchor: Column, most_positives: int = 5, most_negatives: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """Hard negatives of embeddings (vec_id, embedding, label): anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Anchors are the rows for which anchor (of columns vec_id, embedding and label) is true. A score is the inner product of the whole numbers floor(256 * x); higher ones
    come first, ties by smaller vec_id, null last. An anchor's positives are its first rows of the same label, itself left out; of each positive the negatives are
    the first rows of other labels whose score is share of the positive's at least, and not above it. All is exact, however well the tree prunes.

    Rows with a null label or vector, with a null or non-finite entry, without entries, or of another length than most, take no part; a null id is no
    anchor's; repeated rows are others of each other, and a repeated anchor is answered as often; entries are held where an inner product would not fit a
    long; no anchors or an empty table give no rows; other columns are ignored.
    """
    answer = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = usable(vectors, anchor)
    found = indexed(rows)
    if found is None:
        return vectors.sparkSession.createDataFrame([], answer)
    n, schema = 2**found.planes.depth, "aid long, anchor_id long, place int, score long, vec_id long"
    scorer: Scorer = lambda v, s, a, r: best_negatives(v, s, a, r, most_negatives)
    best = positives(found, most_positives)
    part, all_of = share
    # share of the score, rounded up, without a product that a long can't hold
    low = F.ceil(F.col("score").cast("decimal(38,0)") * part / all_of).cast("long")
    asked = best.filter("score >= 0").select("aid", "anchor_id", "place", F.col("score").alias("high"), low.alias("low"))

    def with_bounds(bounds: DataFrame) -> DataFrame:
        lists = bounds.groupBy("aid", "anchor_id").agg(F.collect_list(F.struct("place", "low", "high")).alias("b"))
        lists = lists.select("aid", "anchor_id", F.col("b.place").alias("places"), F.col("b.low").alias("lows"), F.col("b.high").alias("highs"))
        return materialize(found.anchors.join(lists, ["aid", "anchor_id"]), "negatives-asked")

    fields = ["places", "lows", "highs"]
    seeds = np.stack([np.arange(n)] * 2, axis=1)
    near = leaf_pairs(found, with_bounds(asked), seeds, fields, scorer, schema, "negatives-near")
    keys = ["aid", "anchor_id", "place"]
    last = leading(near, keys, most_negatives).filter(F.col("rank") == most_negatives).select(*keys, F.col("score").alias("last"))
    closer = with_bounds(asked.join(last, keys, "left").withColumn("low", F.greatest("low", "last")))
    low_of, high_of = by_anchor_leaf(closer.select("leaf", F.array_min("lows").alias("low"), F.array_max("highs").alias("high")), "low", "high", n)
    pairs = surviving(found.planes, found.anchor_radii, found.candidate_radii, low_of, high_of)
    far = leaf_pairs(found, closer, pairs[pairs[:, 0] != pairs[:, 1]], fields, scorer, schema, "negatives-far")
    top = leading(near.union(far), keys, most_negatives).select(*keys, "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    copies = found.anchors.filter("copies > 1").select("aid", "anchor_id", "copies")
    out = top.join(best.withColumnRenamed("score", "positive_score"), keys).join(copies, ["aid", "anchor_id"], "left")
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("copies", F.lit(1)))))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(vectors: DataFrame) -> DataFrame:
    """The thin query over mined: where vec_id is divisible by 7, the label becomes (label + 1) % 10; ids divisible by 100 are anchors."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(vectors.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE label = own),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id WHERE p.k <= 5 AND s.label <> s.own AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
