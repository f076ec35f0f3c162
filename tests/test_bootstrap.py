"""Bootstrap replicates against weighted metrics by brute force; intervals; odd inputs."""

import hashlib
import random

import numpy as np
import pytest

from clinrisk.operators import bootstrap
from clinrisk.operators.bootstrap import PRIME, bootstrap_intervals, bootstrap_replicates

SCHEMA = "id long, score double, label int"


def h(text, at=0):
    return int(hashlib.md5(text.encode()).hexdigest()[at:at + 8], 16) % PRIME


def weight(key, replicate):
    text = f"42-{'' if key is None else key}"
    a, b, c = (h(f"42-{x}-{replicate}") for x in "abc")
    u = (h(text) * a % PRIME + h(text, 8) * b % PRIME + c) % PRIME
    return sum(u >= x for x in bootstrap.poisson_limits())


def brute(rows, replicate, threshold=0.5):
    rows = [(weight(k, replicate), s, y) for k, s, y in rows if s is not None and s == s and y is not None]
    pos, neg = [(w, s) for w, s, y in rows if y == 1], [(w, s) for w, s, y in rows if y != 1]
    p, n = sum(w for w, _ in pos), sum(w for w, _ in neg)
    auc = sum(w * v * ((s > t) + (s == t) / 2) for w, s in pos for v, t in neg) / (p * n) if p * n else None
    tp, fp = sum(w for w, s in pos if s >= threshold), sum(w for w, s in neg if s >= threshold)
    fn, tn = p - tp, n - fp
    div = lambda a, b: a / b if b else 0.0
    return [auc, div(tp + tn, p + n), div(tp, tp + fp), div(tp, p), div(2 * tp, 2 * tp + fp + fn), div(tn, n), div(tn, tn + fn)]


def sample(n, seed, digits=2, hot=0):
    rng = random.Random(seed)
    rows = [(i, round(rng.random(), digits), int(rng.random() < 0.4)) for i in range(n)]
    return rows + [(n + i, 0.37, i % 2) for i in range(hot)]


ODD = [(1, None, 1), (2, 0.5, None), (None, 0.6, 1), (None, 0.6, 0), (3, float("nan"), 1), (4, 0.2, 0), (4, 0.2, 0), (5, 0.5, 1), (6, 0.5, 0)]


@pytest.mark.parametrize("rows", [sample(120, 1), sample(90, 2, digits=9), sample(60, 3, digits=1, hot=90), sample(40, 4) + ODD, ODD])
def test_replicates_are_weighted_metrics(spark, rows):
    got = bootstrap_replicates(spark.createDataFrame(rows, SCHEMA).repartition(3), "score", "label", "id", 12).orderBy("replicate").collect()
    assert [r.replicate for r in got] == list(range(1, 13))
    for r in got:
        for value, expected in zip(list(r)[1:], brute(rows, r.replicate)):
            assert (value is None) == (expected is None) and (value is None or abs(value - expected) < 1e-12)


def test_batches_and_cells_cut_anywhere(spark, monkeypatch):
    rows = sample(300, 5, digits=1)
    before = bootstrap_replicates(spark.createDataFrame(rows, SCHEMA), "score", "label", "id", 5).orderBy("replicate").collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    monkeypatch.setattr(bootstrap, "CELLS", 15)
    try:
        assert bootstrap_replicates(spark.createDataFrame(rows, SCHEMA), "score", "label", "id", 5).orderBy("replicate").collect() == before
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_weights_are_poisson():
    limits = bootstrap.poisson_limits()
    u = np.random.default_rng(1).integers(0, PRIME, 200_000)
    w = np.searchsorted(np.array(limits), u, "right")
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02


def test_intervals_are_quantiles_and_hold_the_metric(spark):
    df = spark.createDataFrame(sample(400, 6), SCHEMA)
    table = np.array([list(r)[1:] for r in bootstrap_replicates(df, "score", "label", "id", 80).collect()], float)
    got = {r.metric: r for r in bootstrap_intervals(df, "score", "label", "id", 80, level=0.9).collect()}
    for i, name in enumerate(bootstrap.METRICS):
        assert got[name].replicates == 80 and abs(got[name].mean - table[:, i].mean()) < 1e-12 and abs(got[name].std_error - table[:, i].std(ddof=1)) < 1e-12
        assert np.allclose([got[name].lower, got[name].upper], np.quantile(table[:, i], [0.05, 0.95]), atol=1e-12)
    assert got["recall"].lower < got["recall"].mean < got["recall"].upper


def test_empty_and_one_class(spark):
    for rows in ([], [(1, None, 1), (2, 0.5, None)]):
        df = spark.createDataFrame(rows, SCHEMA)
        assert bootstrap_replicates(df, "score", "label", "id", 5).count() == 0
        assert {(r.replicates, r.lower) for r in bootstrap_intervals(df, "score", "label", "id", 5).collect()} == {(0, None)}
    one = bootstrap_intervals(spark.createDataFrame([(i, i / 10, 1) for i in range(9)], SCHEMA), "score", "label", "id", 20)
    assert {r.metric: r.replicates for r in one.collect()}["roc_auc"] == 0
    with pytest.raises(ValueError):
        bootstrap_intervals(one, "score", "label", "id", metrics=["lift"])
    with pytest.raises(ValueError):
        bootstrap_intervals(one, "score", "label", "id", level=1.0)
