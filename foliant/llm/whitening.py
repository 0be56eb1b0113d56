"""Whitened embeddings: principal components of centred whole numbers by MLlib's singular values."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A component c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Dimensions up to which all singular values are asked for, which MLlib finds by a dense decomposition; beyond, only those that are returned.
DENSE = 2_048
#: Singular values below this share of the greatest are rounding errors of the matrix of products, and count as none.
SMALLEST = 1e-6
#: The largest whole number that a component becomes, so that one fits a long.
LARGEST = 2**62


class Fit(NamedTuple):
    """What the fit list says: rows, sums of each dimension, components (columns) and their variances, the greatest first, and the variance of all dimensions."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    total: float


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows whose vector is there, without a null or non-finite entry, and has the commonest length (of several the greatest)."""
    odd = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    found = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("embedding").isNotNull() & ~odd)
    lengths = found.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    return found.filter(F.size("embedding") == (lengths[0]["size"] if lengths else 0))


def whole(flat: np.ndarray, dims: int) -> np.ndarray:
    """The whole numbers of a batch's entries, a row for each vector: longs, held at LARGEST."""
    scaled = np.floor(flat * SCALE)
    held = np.clip(scaled, -float(LARGEST), float(LARGEST)).astype(np.int64) + SHIFT
    return held.reshape(-1, dims) if dims else held.reshape(0, 0)


def spread(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: longs, or Python's whole numbers where longs can't hold the squares' sums."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if most * most * max(1, x.shape[1]) < 2**62:
        return n * x - np.asarray(sums, dtype=np.int64)
    near = n * x.astype(object) - np.asarray(sums, dtype=object)
    most = max((abs(int(v)) for v in near.flat), default=0)
    return near.astype(np.int64) if most * most * max(1, x.shape[1]) < 2**62 else near


def by_batch(df: DataFrame, dims: int, schema: str, work: Callable[[pa.Array, np.ndarray], pa.RecordBatch]) -> DataFrame:
    """work(vec_id, whole numbers) of each batch of rows (vec_id, embedding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield work(batch.column(0), whole(batch.column(1).flatten().to_numpy(zero_copy_only=False), dims))

    return df.mapInArrow(run, schema)


def sums_of(rows: DataFrame, dims: int) -> tuple[int, list[int]]:
    """(rows, exact sums of each dimension); tasks send a row for each dimension of a batch, which Spark adds up."""

    def partial(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        small = int(np.abs(x).max()) * len(x) < 2**62
        sums = x.sum(axis=0) if small else x.astype(object).sum(axis=0)
        return pa.record_batch({"dim": pa.array(range(dims), pa.int32()), "n": pa.array([len(x)] * dims, pa.int64()), "total": pa.array([str(int(s)) for s in sums], pa.string())})

    parts = by_batch(rows, dims, "dim int, n long, total string", partial)
    found = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("dim").collect()
    return (found[0]["n"], [int(r["total"]) for r in found]) if found else (0, [])


def centred(rows: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """The distributed rows of x - S/n, as vectors for MLlib."""

    def minus_mean(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        flat = (spread(x, n, sums) / n).astype(np.float64).ravel()
        return pa.record_batch({"row": pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(flat))})

    values = by_batch(rows, len(sums), "row array<double>", minus_mean)
    return MLUtils.convertVectorColumnsFromML(values.select(array_to_vector("row").alias("row")), "row")


def fit(rows: DataFrame, most: int) -> Fit:
    """The fit over usable rows. The total variance is the sum of the rows' own deviations, not of the singular values.

    Components without variance are left out, so that there are fewer than most of them where the rows span fewer dimensions.
    """
    first = rows.select(F.size("embedding")).first()
    dims = first[0] if first else 0
    n, sums = sums_of(rows, dims) if dims else (0, [])
    if n == 0:
        return Fit(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)

    def squares(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        far = spread(x, n, sums)
        return pa.record_batch({"total": pa.array([float((far * far).sum(axis=1).astype(np.float64).sum())])})

    total = by_batch(rows, dims, "total double", squares).agg(F.sum("total")).first()[0] / n**3
    if total == 0:
        return Fit(n, sums, np.zeros((dims, 0)), np.zeros(0), 0.0)
    svd = RowMatrix(centred(rows, n, sums), n, dims).computeSVD(dims if dims <= DENSE else min(most, dims - 1), computeU=False, rCond=SMALLEST)
    variances = svd.s.toArray() ** 2 / n
    return Fit(n, sums, svd.V.toArray()[:, :most], variances[:most], total)


def projected(x: np.ndarray, found: Fit) -> np.ndarray:
    """Whitened rows: a column for each component."""
    return (spread(x, found.n, found.sums) / found.n).astype(np.float64) @ found.components / np.sqrt(found.variances)


def identity_error(rows: DataFrame, found: Fit) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    k = len(found.variances)

    def products(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        w = projected(x, found)
        return pa.record_batch({"at": pa.array(range(k * k + k), pa.int32()), "total": pa.array(np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)]))})

    sums = by_batch(rows, len(found.sums), "at int, total double", products).groupBy("at").agg(F.sum("total").alias("total")).orderBy("at").collect()
    totals = np.array([r["total"] for r in sums]) / found.n
    mean = totals[k * k :]
    return float(np.abs(totals[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = 8) -> DataFrame:
    """Whitened embeddings (vec_id, embedding) as vec_id, component (from 1), n, deviation, whitened, explained, identity_error, a row for each component.

    Rows are read four times and never gathered: only sums by dimension, and MLlib's matrix of dimensions by dimensions, reach the driver. A null vector, or one
    with a null or non-finite entry, or of another length than most, gives no row; a null id stays; repeated rows count each; components without variance give
    no rows, so that equal vectors, one vector or an empty table give none; entries beyond 2^62 are held there, and a deviation beyond a long is null;
    other columns are ignored.
    """
    rows = usable(vectors)
    found = fit(rows, components)
    k = len(found.variances)
    error = identity_error(rows, found) if k else 0.0
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def answer(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        far = spread(x, found.n, found.sums)
        squares = [int(v) for v in (far * far).sum(axis=1)]
        deviation = pa.array([v if v < 2**63 else None for v in squares], pa.int64())
        rows_of = pa.array(np.repeat(np.arange(len(x)), k))
        size = len(x) * k
        return pa.record_batch({
            "vec_id": ids.take(rows_of), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), "n": pa.array(np.full(size, found.n)),
            "deviation": deviation.take(rows_of), "whitened": pa.array(projected(x, found).ravel()),
            "explained": pa.array(np.tile(found.variances / found.total, len(x))), "identity_error": pa.array(np.full(size, error)),
        })

    if not k:
        return vectors.sparkSession.createDataFrame([], schema)
    return by_batch(rows.withColumn("vec_id", F.col("vec_id").cast("long")), len(found.sums), schema, answer)


def op11_whitening(vectors: DataFrame) -> DataFrame:
    """The thin query over whiten."""
    return whiten(vectors)
