from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from clinrisk.operators import ordered as O
from clinrisk.operators import split as SP


@pytest.mark.parametrize("limits", [{}, {"distinct_limit": 10}, {"distinct_limit": 10, "bracket_limit": 5}])
def test_quantiles_equal_numpy(spark, limits):
    rng = np.random.default_rng(1)
    wide = rng.lognormal(size=5000)
    hot = np.where(rng.random(5000) < 0.4, 7.0, rng.normal(size=5000))  # one value holds two fifths of the rows
    ints = rng.integers(0, 50, 5000)
    rows = [(float(a), float(b), int(c), None if i % 9 == 0 else float(a)) for i, (a, b, c) in enumerate(zip(wide, hot, ints))]
    df = spark.createDataFrame(rows, "wide double, hot double, ints int, holes double").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.613, 0.95, 1.0]
    got = O.exact_quantiles(df, ["wide", "hot", "ints", "holes"], probs, **limits)
    holes = [r[3] for r in rows if r[3] is not None]
    for name, values in {"wide": wide, "hot": hot, "ints": ints, "holes": holes}.items():
        np.testing.assert_allclose(got[name], np.quantile(values, probs), rtol=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert O.exact_quantiles(df, ["x"], [0.5]) == {"x": [None]}
    assert O.exact_quantiles(df, [], [0.5]) == {}


def brute_ranks(rows, seed=42):
    import hashlib

    out, seen = {}, {}
    for k, c in sorted(rows, key=lambda r: (hashlib.md5(f"{seed}-{r[0]}".encode()).hexdigest(), r[0])):
        seen[c] = seen.get(c, 0) + 1
        out[k] = (c, seen[c])
    return out


@pytest.mark.parametrize("group_limit", [100_000, 1])
def test_rank_cuts_equal_sorting(spark, group_limit):
    rows = [(k, int(k % 10 > 6)) for k in range(3000)]
    df = spark.createDataFrame(rows, "k bigint, y int").repartition(7)
    cuts = O.rank_cuts(df, "k", "y", 42, {0: [0, 1, 1050, 2100], 1: [450, 900]}, group_limit)
    ranks = {v: k for k, v in brute_ranks(rows).items()}
    assert [c and c[1] for c in cuts[0]] == [None, ranks[0, 1], ranks[0, 1050], ranks[0, 2100]]
    assert [c[1] for c in cuts[1]] == [ranks[1, 450], ranks[1, 900]]


def test_rank_cuts_refuse_duplicate_keys(spark):
    df = spark.createDataFrame([(1, 0)] * 4, "k bigint, y int")
    with pytest.raises(ValueError, match="not unique"):
        O.rank_cuts(df, "k", "y", 42, {0: [2]})


def prefix_brute(scores, labels):
    out = []
    for t in sorted(set(scores), reverse=True):
        out.append((t, sum(y for s, y in zip(scores, labels) if s == t), sum(1 - y for s, y in zip(scores, labels) if s == t),
                    sum(y for s, y in zip(scores, labels) if s >= t), sum(1 - y for s, y in zip(scores, labels) if s >= t)))
    return out


@pytest.mark.parametrize("buckets", [2, 7, 1024])
def test_score_prefix_equals_sorting(spark, buckets):
    rng = np.random.default_rng(2)
    # A third of the rows share one score and most of the others crowd just above it.
    scores = np.where(rng.random(900) < 0.34, 0.5, 0.5 + np.round(rng.random(900), 2) * 1e-9).tolist() + [0.1, 0.9]
    labels = rng.integers(0, 2, len(scores)).tolist()
    df = spark.createDataFrame(list(zip(scores, labels)), "s double, y int").repartition(6)
    rows = O.score_prefix(df, "s", "y", buckets=buckets).orderBy(F.desc("score")).collect()
    expected = prefix_brute(scores, labels)
    assert [(r["score"], r["pos"], r["neg"], r["cum_pos"], r["cum_neg"]) for r in rows] == expected
    following = [(e[1], e[2]) for e in expected[1:]] + [(None, None)]
    assert [(r["next_pos"], r["next_neg"]) for r in rows] == following
    assert {(r["total_pos"], r["total_neg"]) for r in rows} == {(sum(labels), len(labels) - sum(labels))}


def test_score_prefix_keeps_null_groups_and_reads_once(spark):
    rows = [(g, y, s / 10) for g in ("a", None) for y in (0, 1) for s in range(10)]
    df = spark.createDataFrame(rows, "g string, y int, s double")
    got = O.score_prefix(df, "s", "y", ["g"], buckets=4)
    assert {r["g"] for r in got.collect()} == {"a", None} and got.count() == 20
    plain = O.score_prefix(df, "s", "y", buckets=4)
    plain.collect()
    assert "ReusedExchange" in plain._jdf.queryExecution().executedPlan().toString()


def test_score_prefix_never_windows_over_everything_unbucketed(spark, sf):
    from clinrisk.sources import derived

    plan = O.score_prefix(derived.predictions(spark, sf), "probability", "y_true")._jdf.queryExecution().executedPlan().toString()
    # Unpartitioned windows may only see the bucket totals, which come from a second aggregation.
    assert plan.count("SinglePartition") <= 2 and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("n", [1, 10, 500])
def test_last_n_equals_sorting_with_a_hot_group(spark, n):
    t0 = datetime(2024, 1, 1)
    rows = []
    for i in range(2000):
        group = "hot" if i % 3 else f"g{i % 30}"
        # Most events of the hot group fall into one hour, many at the same instant.
        rows.append((i, group, t0 + timedelta(hours=i % 5 if i % 7 == 0 else 4, seconds=i % 11)))
    df = spark.createDataFrame(rows, "id bigint, g string, ts timestamp").repartition(5)
    got = {r["id"] for r in O.top_n_per_group(df, "g", "ts", "id", n).collect()}
    expected = set()
    for g in {r[1] for r in rows}:
        expected |= {r[0] for r in sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))[-n:]}
    assert got == expected


def test_last_n_filters_at_the_scan(spark, sf):
    from clinrisk.sources import derived

    plan = O.top_n_per_group(derived.predictions(spark, sf), "model", "ts", "request_id", 5)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "WindowGroupLimit" in plan


def test_last_n_has_one_plan_for_few_and_many_groups(spark):
    import re

    plans = []
    for groups in (10, 20_000):
        df = spark.range(40_000).selectExpr("id", f"id % {groups} AS g", "timestamp_seconds(1704067200 + id * 60) AS ts")
        df.write.mode("overwrite").parquet(path := group_path(spark, groups))
        plan = O.top_n_per_group(spark.read.parquet(path), "g", "ts", "id", 1)._jdf.queryExecution().optimizedPlan().toString()
        plans.append(re.sub(r"[0-9]+|#\w+", "", plan.replace(path, "")))
    assert plans[0] == plans[1] and "Join" in plans[0]


def group_path(spark, groups):
    from clinrisk.scratch import scratch_path

    return scratch_path(spark, f"groups-{groups}")


def test_last_n_keeps_rows_without_a_time_as_the_oldest(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(1, "a", None), (2, "a", t0), (3, "b", None), (4, "b", None), (5, None, t0), (6, "c", t0), (7, "c", t0 + timedelta(hours=9)), (8, "c", None)]
    df = spark.createDataFrame(rows, "id bigint, g string, ts timestamp")
    assert {r["id"] for r in O.top_n_per_group(df, "g", "ts", "id", 2).collect()} == {1, 2, 3, 4, 5, 6, 7}
    assert {r["id"] for r in O.top_n_per_group(df, "g", "ts", "id", 1).collect()} == {2, 4, 5, 7}


def test_last_n_of_many_groups(spark):
    t0 = datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, f"g{i % 8}", t0 + timedelta(minutes=i)) for i in range(200)], "id bigint, g string, ts timestamp")
    got = {r["id"] for r in O.top_n_per_group(df, "g", "ts", "id", 2).collect()}
    assert got == set(range(184, 200))


def test_split_sizes_and_quotas():
    assert SP.split_sizes(303, 0.15, 0.15) == (212, 45, 46)
    assert SP.split_quotas({0: 50, 1: 50}, 0.7, 0.15, 0.15) == {0: (35, 8, 7), 1: (35, 7, 8)}
    assert SP.largest_remainder({0: 1, 1: 1}, 1) == {0: 1, 1: 0}
    assert SP.fold_quotas({0: 7, 1: 4}, 3) == {0: [3, 2, 2], 1: [1, 2, 1]}


def test_split_is_exact_stratified_and_independent_of_partitions(spark):
    df = spark.createDataFrame([(i, i + 100, int(i >= 50)) for i in range(100)], "feature1 bigint, feature2 int, target int")
    runs = []
    for parts in (1, 37):
        out = SP.stratified_split(df.repartition(parts), "feature1")
        runs.append({r["feature1"]: r["split"] for r in out.collect()})
        assert "Exchange" not in SP.stratified_split(df, "feature1")._jdf.queryExecution().executedPlan().toString()
    assert runs[0] == runs[1]
    sizes = {s: list(runs[0].values()).count(s) for s in ("train", "val", "test")}
    assert sizes == {"train": 70, "val": 15, "test": 15}
    assert sum(1 for k, s in runs[0].items() if s == "train" and k < 50) == 35
    other = {r["feature1"]: r["split"] for r in SP.stratified_split(df, "feature1", seed=7).collect()}
    assert other != runs[0]
    shares = {r["split"]: r["positive_share"] for r in SP.split_balance(SP.stratified_split(df, "feature1")).collect()}
    assert shares["train"] == 0.5


def test_split_errors(spark):
    df = spark.createDataFrame([(i, 0) for i in range(10)] + [(10, 1)], "k bigint, target int")
    with pytest.raises(ValueError, match="sum to 1"):
        SP.stratified_split(df, "k", train_ratio=0.5, val_ratio=0.3, test_ratio=0.3)
    with pytest.raises(ValueError, match="fewer than 2"):
        SP.stratified_split(df, "k")
    nulls = spark.createDataFrame([(1, None), (2, 1), (3, 1)], "k bigint, target int")
    with pytest.raises(ValueError, match="NULL"):
        SP.stratified_split(nulls, "k")


def test_folds(spark):
    df = spark.createDataFrame([(i, int(i % 10 < 3)) for i in range(101)], "k bigint, target int")
    rows = SP.stratified_folds(df, "k", k=5).collect()
    sizes = [sum(r["fold"] == f for r in rows) for f in range(5)]
    positives = [sum(r["fold"] == f and r["target"] == 1 for r in rows) for f in range(5)]
    assert sorted(sizes) == [20, 20, 20, 20, 21] and max(positives) - min(positives) <= 1
    again = {r["k"]: r["fold"] for r in SP.stratified_folds(df.repartition(9), "k", k=5).collect()}
    assert again == {r["k"]: r["fold"] for r in rows}


def test_quantiles_do_not_depend_on_the_limits(spark):
    df = spark.range(9001).selectExpr("(id * 7919 % 9001) / 7.0 + 0.1 AS x")
    wanted = [0.1, 0.25, 1 / 3, 0.5, 0.75, 0.9]
    runs = [O.exact_quantiles(df, ["x"], wanted, **limits) for limits in ({}, {"distinct_limit": 10}, {"distinct_limit": 10, "bracket_limit": 5})]
    assert runs[0] == runs[1] == runs[2]


def test_class_limit_is_a_parameter(spark):
    df = spark.range(10).selectExpr("id % 4 AS c")
    assert len(O.class_counts(df, "c", max_classes=4)) == 4
    with pytest.raises(ValueError, match="More than 3 classes"):
        O.class_counts(df, "c", max_classes=3)
