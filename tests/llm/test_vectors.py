"""Operators on embedding tables against brute force, and odd inputs."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinrisk.llm import hard_negatives, queries, whitening
from clinrisk.llm.hard_negatives import Anchors, First, mine
from clinrisk.llm.whitening import levels, scatter, whiten

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])
CLASHING = ["q", "v", "id", "anchor", "score", "rank", "own", "component", "n", "copies", "count", "size", "pair"]
ODD = [(None, [0.25, -0.5, 0.125], 1), (7, None, 1), (8, [0.1, None, 0.2], 2), (9, [float("nan"), 0.0, 0.0], 2), (10, [float("inf"), 0.0, 0.0], 2),
       (11, [], 1), (12, [1.0], 1), (13, [0.5, 0.5, 0.5], None), (50, [0.3, 0.1, -0.2], 1), (50, [0.3, 0.1, -0.2], 1), (50, [0.3, 0.1, -0.2], 2), (100, [0.3, 0.1, -0.2], 1)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in CLASHING})


def some(n, d, labels, seed, copies=0):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 0.3) for _ in range(d)] for _ in range(labels)]
    rows = []
    for i in range(n):
        label = rng.randrange(labels)
        rows.append((i, [c + rng.gauss(0, 0.15) for c in centre[label]], label))
    return rows + [rows[i] for i in range(copies)]


def usable(rows, d):
    return [(k, np.array(v, np.float32).astype(float), x) for k, v, x in rows if v is not None and len(v) == d and None not in v and np.isfinite(v).all()]


@pytest.mark.parametrize("seed,rows,d,scale", [(1, 1, 3, 1), (2, 70, 5, 0.4), (3, 200, 9, 3e4), (4, 65, 2, 1e9), (5, 30, 3, 0)])
def test_bit_planes_give_exact_products(seed, rows, d, scale):
    z = levels(np.random.default_rng(seed).normal(size=(rows, d)) * scale)
    sums, products = scatter(z)
    exact = z.astype(object)
    assert (sums == exact.sum(axis=0)).all() and (products == np.triu(exact.T @ exact)).all()


def whitened(rows, d):
    """Covariance in fractions, its eigenvectors in doubles."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v, _ in usable(rows, d)]
    n, s = len(x), [sum(c) for c in zip(*x)]
    v = np.array([[float(Fraction(sum(n * a[i] * a[j] for a in x) - s[i] * s[j], n * n)) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    deviation = [sum((n * a[i] - s[i])**2 for i in range(d)) for a in x]
    z = np.array([[a[i] - s[i] / n for i in range(d)] for a in x]) @ vectors / np.sqrt(np.maximum(values, 1e-300))
    return n, deviation, z, values / values.sum()


@pytest.mark.parametrize("rows,d", [(some(300, 6, 4, 1, 40), 6), (some(200, 40, 3, 2) + [(1000 + i, [0.0] * 40, 0) for i in range(100)], 40), (ODD, 3)])
def test_whitening_is_that_of_the_definition(spark, rows, d):
    got = whiten(frame(spark, rows).repartition(3)).collect()
    kept, k = usable(rows, d), min(d, whitening.COMPONENTS)
    n, deviation, z, explained = whitened(rows, d)
    assert len(got) == len(kept) * k and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component, int(r.deviation)) for r in got) == sorted((i is None, i or 0, c + 1, x) for (i, _, _), x in zip(kept, deviation) for c in range(k))
    if rows is not ODD:
        assert got[0].identity_error < 1e-9
        by_id = {}
        for r in got:
            by_id.setdefault(r.vec_id, np.zeros(k))[r.component - 1] = r.whitened
            assert abs(r.explained - explained[r.component - 1]) <= 1e-9 * explained[r.component - 1]
        mine_ = np.array([by_id[i] for i, _, _ in kept])
        sign = np.sign((mine_ * z[:, :k]).sum(axis=0))
        assert np.abs(mine_ - z[:, :k] * sign).max() < 1e-6


def test_whitening_of_odd_tables(spark):
    assert whiten(frame(spark, [])).collect() == []
    assert whiten(frame(spark, [(1, None, 1), (2, [], 1), (3, [None], 1)])).collect() == []
    same = whiten(frame(spark, [(1, [0.5, 0.25], 1), (1, [0.5, 0.25], 1)])).collect()
    assert [(r.whitened, r.explained, r.identity_error, int(r.deviation)) for r in same] == [(0.0, 0.0, 0.0, 0)] * 4
    # One constant dimension: its component has no variance and stays out of the identity error.
    flat = whiten(frame(spark, [(i, [i / 8, 1.0], 1) for i in range(9)])).collect()
    assert {r.whitened for r in flat if r.component == 2} == {0.0} and flat[0].identity_error < 1e-12
    huge = [(i, [i * 1e12, -i * 1e12], 1) for i in range(5)]
    assert {(r.vec_id, int(r.deviation)) for r in whiten(frame(spark, huge)).collect()} == set(enumerate(whitened(huge, 2)[1]))
    with pytest.raises(ValueError):
        whiten(frame(spark, [(1, [1.0, 2.0, 3.0], 1)]), max_dimensions=2)


def test_whitening_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    d = max(len(r[1]) for r in rows if r[1])
    n, deviation, z, explained = whitened(rows, d)
    got = queries.QUERIES["op12_bit_sliced"](spark, sf)
    assert dict(got.dtypes)["deviation"] == "bigint"
    got = got.collect()
    kept = usable(rows, d)
    assert sorted((r.vec_id, r.component, r.deviation) for r in got) == sorted((i, c + 1, x) for (i, _, _), x in zip(kept, deviation) for c in range(32))
    assert {r.n for r in got} == {n} and got[0].identity_error <= 1e-4
    first = {r.vec_id: r.whitened for r in got if r.component == 1}
    mine_ = np.array([first[i] for i, _, _ in kept])
    assert min(np.abs(mine_ - z[:, 0]).max(), np.abs(mine_ + z[:, 0]).max()) < 1e-8


@pytest.mark.parametrize("low,high,d", [(-160, 160, 64), (0, 1, 3), (-3, -1, 5), (-10**6, 10**6, 8), (-2**30, 2**30, 4), (-2**31, 2**30, 3)])
def test_packed_products_are_exact(low, high, d):
    rng = np.random.default_rng(3)
    q, c = rng.integers(low, high, (7, d)), rng.integers(low, high, (23, d))
    c[0], q[0] = high, low
    assert (Anchors(q).products(slice(0, 7), c) == (q.astype(object) @ c.astype(object).T)).all()
    assert (Anchors(q).products(np.array([2, 5]), c[:1]) == (q[[2, 5]].astype(object) @ c[:1].astype(object).T)).all()


def test_first_rows_of_groups():
    first, rng, rows = First(3, 4), random.Random(1), []
    for _ in range(9):
        part = [(rng.randrange(3), rng.randrange(5), rng.randrange(9)) for _ in range(6)]
        rows += part
        group, score, ids = (np.array(x) for x in zip(*part))
        first.add(group, score, ids, np.zeros(6, np.int64))
    for g in range(3):
        assert list(zip(first.score[g], first.ids[g])) == [(s, i) for _, s, i in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))[:4]]


def mined(rows, d, positives=5, negatives=3):
    """(anchor, positive, rank, negative, scores) by comparing every row with every anchor."""
    kept = [(i, [math.floor(256 * c) for c in v], x) for i, v, x in usable(rows, d) if x is not None]
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for at, (anchor, q, label) in enumerate(kept):
        if anchor is None or anchor % 50:
            continue
        scored = [(sum(a * b for a, b in zip(q, v)), i, x, k) for k, (i, v, x) in enumerate(kept)]
        for score, positive, _, _ in sorted((r for r in scored if r[2] == label and r[3] != at), key=order)[:positives]:
            fits = sorted((r for r in scored if r[2] != label and 50 * score <= 100 * r[0] <= 95 * score), key=order)[:negatives]
            out += [(anchor, positive, k + 1, r[1], score, r[0]) for k, r in enumerate(fits)]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect()), key=repr)


@pytest.mark.parametrize("rows,d,anchor_bytes", [(some(400, 6, 5, 3, 120), 6, 1 << 20), (some(400, 6, 5, 3, 120), 6, 200), (some(200, 3, 2, 4) + ODD, 3, 1 << 20),
                                                 ([(i, [0.5, 0.5], i % 3) for i in range(200)], 2, 1 << 20), (ODD, 3, 1 << 20)])
def test_hard_negatives_are_those_of_all_pairs(spark, rows, d, anchor_bytes):
    got = mine(frame(spark, rows).repartition(3), "vec_id % 50 = 0", anchor_bytes=anchor_bytes)
    assert rows_of(got) == mined(rows, d)


def test_hard_negatives_with_wide_components(spark):
    rows = [(i, [v * 1e5 for v in vector], label) for i, vector, label in some(150, 4, 2, 6)]
    assert rows_of(mine(frame(spark, rows), "vec_id % 50 = 0")) == mined(rows, 4)


def test_hard_negatives_of_odd_tables(spark):
    for rows in ([], [(1, [1.0], 1)], [(50, None, 1)], [(50, [1.0], None)], [(50, [1.0], 1)]):
        assert rows_of(mine(frame(spark, rows), "vec_id % 50 = 0")) == []


def test_hard_negatives_query(spark, sf):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.label is not None and r.vec_id % 7 == 0 else r.label)
            for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert rows_of(queries.QUERIES["op13_packed_negatives"](spark, sf)) == mined(rows, max(len(r[1]) for r in rows if r[1]))
    assert hard_negatives.WIDE == 53
