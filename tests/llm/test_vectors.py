"""Whitened embeddings and hard negatives against numpy and brute force."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import hard_negatives, whitening
from foliant.plans.models import table
from tests.oracle import compare

SCHEMA = "vec_id long, embedding array<float>, label int"


def odd_vectors(dims=6, n=300, seed=1):
    """Clusters, ties and repeated rows beside rows that take no part."""
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 1, (5, dims))
    rows = [(i, (centers[i % 5] + rng.normal(0, 0.2, dims)).astype(np.float32).tolist(), int(i % 4)) for i in range(n)]
    rows += [(n + i, rows[7][1], i % 3) for i in range(40)]
    rows += [rows[100], rows[100], rows[0], (None, rows[3][1], 1), (None, rows[4][1], None), (1000, None, 1), (1001, [None] * dims, 1), (1002, [], 2)]
    rows += [(1003, [float("nan")] * dims, 1), (1004, [float("inf")] * dims, 1), (1005, [1.0] * (dims + 1), 1), (1100, rows[5][1], None), (-200, rows[6][1], 0)]
    return rows


def usable(rows, dims=6):
    return [r for r in rows if r[1] is not None and len(r[1]) == dims and all(c is not None and math.isfinite(c) for c in r[1])]


# op11


def whitened_by_numpy(rows):
    x = np.array([[math.floor(1024 * c) + 100_000 for c in np.float32(r[1]).astype(float)] for r in rows], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    far = n * x - sums
    deviation = [int(v) for v in (far * far).sum(axis=1)]
    centred = (far / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    return deviation, centred, values[order], vectors[:, order], float(Fraction(sum(deviation), n**3))


@pytest.mark.parametrize("source", ["odd", "table"])
def test_whitening_by_numpy(spark, source):
    df = spark.createDataFrame(odd_vectors(), SCHEMA) if source == "odd" else table(spark, "/root/testdata/sf0.001", "embeddings")
    rows = usable([tuple(r) for r in df.collect()], 6 if source == "odd" else 64)
    deviation, centred, values, vectors, total = whitened_by_numpy(rows)
    k = min(8, len(values))
    found = [r.asDict() for r in whitening.op11_whitening(df).collect()]
    assert len(found) == k * len(rows) and {r["component"] for r in found} == set(range(1, k + 1))
    assert {r["n"] for r in found} == {len(rows)} and len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-9
    want = {}
    for r, d, c in zip(rows, deviation, centred, strict=True):
        want.setdefault(r[0], []).append((d, c))
    signs = {}
    for r in found:
        d, c = want[r["vec_id"]][0] if r["vec_id"] is not None else next(x for x in want[None] if x[0] == r["deviation"])
        assert r["deviation"] in {x[0] for x in want[r["vec_id"]]}
        j = r["component"] - 1
        value = c @ vectors[:, j] / math.sqrt(values[j])
        if r["deviation"] == d and abs(value) > 1e-3:
            assert abs(abs(r["whitened"]) - abs(value)) < 1e-6 * max(1, abs(value))
            signs.setdefault(j, set()).add(np.sign(r["whitened"]) == np.sign(value))
        assert abs(r["explained"] / (values[j] / total) - 1) < 1e-9
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_of_little(spark):
    of = lambda rows: whitening.op11_whitening(spark.createDataFrame(rows, SCHEMA)).collect()
    assert of([]) == [] and of([(1, None, 1), (2, [None], 1), (3, [], 1)]) == []
    assert of([(1, [1.0, 2.0], 1)]) == [] and of([(i, [1.0, 2.0], 1) for i in range(5)]) == []
    flat = of([(i, [float(i), 2.0 * i, 1.0], None) for i in range(5)])  # one dimension in three
    assert {r["component"] for r in flat} == {1} and all(abs(r["explained"] - 1) < 1e-9 for r in flat)
    large = of([(i, [3e38 * (-1) ** i, 1.0 * i], 1) for i in range(4)])
    assert {r["deviation"] for r in large} == {None} and large[0]["identity_error"] < 1e-6


def test_whitening_other_columns(spark):
    df = spark.createDataFrame(odd_vectors(), SCHEMA)
    more = df.select("*", *[F.lit("x").alias(c) for c in ("n", "component", "size", "row", "dim")])
    order = lambda d: sorted(str(r) for r in d.drop("whitened").collect())
    assert order(whitening.op11_whitening(df)) == order(whitening.op11_whitening(more))


# op13


def mined_by_hand(rows, dims=6):
    some = []
    for i, e, label in usable([r for r in rows if r[2] is not None], dims):
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        some.append((i, label, np.array([math.floor(256 * float(np.float32(c))) for c in e], dtype=object)))
    out = []
    first = lambda xs: sorted(xs, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:5]
    for k, (i, label, q) in enumerate(some):
        if i is None or i % 100:
            continue
        scored = [(int((q * v).sum()), j, other, m) for m, (j, other, v) in enumerate(some)]
        for p, pid, *_ in first([s for s in scored if s[2] == label and s[3] != k]):
            negatives = first([s for s in scored if s[2] != label and 80 * p <= 100 * s[0] <= 100 * p])
            out += [(i, pid, r + 1, s[1], p, s[0]) for r, s in enumerate(negatives)]
    return out


@pytest.mark.parametrize("kind", ["odd", "many leaves", "table"])
def test_hard_negatives_by_hand(spark, kind, monkeypatch):
    if kind == "many leaves":
        monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 384)
        monkeypatch.setattr(hard_negatives, "GROUP", 2)
    df = table(spark, "/root/testdata/sf0.001", "embeddings") if kind == "table" else spark.createDataFrame(odd_vectors(n=400 if kind == "many leaves" else 300), SCHEMA)
    found = [tuple(r) for r in hard_negatives.op13_hard_negatives(df).collect()]
    want = mined_by_hand([tuple(r) for r in df.collect()], 64 if kind == "table" else 6)
    assert sorted(map(str, found)) == sorted(map(str, want)) and want


def test_hard_negatives_by_sql(spark):
    compare(hard_negatives.op13_hard_negatives(table(spark, "/root/testdata/sf0.01", "embeddings")), hard_negatives.OP13_SQL, "/root/testdata/sf0.01")


def test_hard_negatives_of_little(spark):
    of = lambda rows: hard_negatives.op13_hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect()
    assert of([]) == [] and of([(1, [1.0], 1)]) == [] and of([(100, [1.0], 1)]) == []
    assert of([(100, [1.0], 1), (3, [1.0], 1), (5, [1.0], 2), (100, None, 3)])[0].asDict() == {"anchor_id": 100, "positive_id": 3, "rank": 1, "negative_id": 5, "positive_score": 65536, "negative_score": 65536}
    assert of([(100, [-1.0], 1), (3, [1.0], 1), (5, [1.0], 2)]) == []
    assert len(of([(100, [3e38, 1.0], 1), (3, [3e38, 1.0], 1), (5, [3e38, 1.0], 2)])) == 1


def test_the_descent_prunes_and_loses_nothing():
    rng = np.random.default_rng(3)
    x = np.floor(np.concatenate([rng.normal(c, 0.3, (400, 4)) * 100 for c in rng.normal(0, 4, (8, 4))]))
    planes = hard_negatives.fit_planes(x[::3], 5)
    leaf, far = hard_negatives.leaf_of(x, planes)
    size = np.array([far[leaf == k].max(initial=-1) for k in range(32)])
    reach = hard_negatives.radii(planes, size)
    value = x @ x.T
    least = np.sort(value, axis=1)[:, -10]
    low = np.array([least[leaf == k].min(initial=np.inf) for k in range(32)])
    pairs = {tuple(p) for p in hard_negatives.surviving(planes, reach, reach, low, np.where(low < np.inf, np.inf, -np.inf))}
    assert len(pairs) < 32 * 32 / 2
    assert all((leaf[i], leaf[j]) in pairs for i, j in zip(*np.nonzero(value >= least[:, None]), strict=True))
