"""Exact order statistics and ordered prefixes without a global sort or a one-task window.

Four building blocks, all deterministic under task retries (no ``rand``, no partition ids):

* ``exact_quantiles``: NumPy-style interpolated quantiles by narrowing brackets.
* ``rank_cuts``: the keys at given ranks of a hashed order, so that a split becomes a projection.
* ``score_prefix``: running class counts per distinct score over equal-depth buckets.
* ``top_n_per_group``: the latest N rows of each group, however large the group.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinrisk.functions.rows import computed_once

DISTINCT_LIMIT = 100_000
BRACKET_LIMIT = 200_000
APPROX_ACCURACY = 10_000


# --------------------------------------------------------------------------------------------- quantiles

def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    distinct_limit: int = DISTINCT_LIMIT,
    bracket_limit: int = BRACKET_LIMIT,
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of many columns, NULLs ignored; an empty column gives None.

    ``percentile`` keeps one counter per distinct value, so it serves the columns that are measured to have few; the others
    go through ``_select_quantiles``, whose memory does not grow with the data. Both find the same order statistics and
    interpolate by the same formula, so the limits decide on the work and never on a digit of the answer.
    """
    if not columns:
        return {}
    sizes = df.agg(*[a for c in columns for a in (
        F.count(c).alias(f"n_{c}"), F.approx_count_distinct(c).alias(f"d_{c}"))]).first()
    few = [c for c in columns if sizes[f"d_{c}"] <= distinct_limit]
    out: dict[str, list[float | None]] = {}
    if few:
        probs = F.array(*[F.lit(float(p)) for p in probabilities])
        row = df.agg(*[F.percentile(c, probs).alias(c) for c in few]).first()
        out.update({c: list(row[c]) if row[c] is not None else [None] * len(probabilities) for c in few})
    many = {c: sizes[f"n_{c}"] for c in columns if c not in few}
    if many:
        out.update(_select_quantiles(df, many, probabilities, bracket_limit))
    return {c: out[c] for c in columns}


def _select_quantiles(
    df: DataFrame, counts: Mapping[str, int], probabilities: Sequence[float], bracket_limit: int
) -> dict[str, list[float | None]]:
    targets = []
    for c, n in counts.items():
        for p in probabilities:
            position = p * (n - 1)
            targets.append({"col": c, "k0": math.floor(position), "k1": math.ceil(position),
                            "position": position, "lo": None, "hi": None, "below": 0, "inside": n})
    margin = 2.0 / APPROX_ACCURACY
    open_targets = list(range(len(targets)))
    while open_targets:
        # One pass proposes a bracket around each wanted rank, a second one counts exactly what it holds.
        proposals = []
        for i in open_targets:
            t = targets[i]
            low = max(0.0, (t["k0"] - t["below"]) / t["inside"] - margin)
            high = min(1.0, (t["k1"] - t["below"] + 1) / t["inside"] + margin)
            ends = F.array(F.lit(low), F.lit(high))
            proposals.append(F.percentile_approx(F.when(_within(t), F.col(t["col"])), ends, APPROX_ACCURACY).alias(f"q{i}"))
        proposed = df.agg(*proposals).first()
        checks = []
        for i in open_targets:
            lo, hi = proposed[f"q{i}"]
            x = F.col(targets[i]["col"])
            checks += [F.count_if(x < F.lit(lo)).alias(f"b{i}"), F.count_if(x.between(F.lit(lo), F.lit(hi))).alias(f"i{i}")]
        counted = df.agg(*checks).first()
        missed, still_open = False, []
        for i in open_targets:
            t, (lo, hi) = targets[i], proposed[f"q{i}"]
            below, inside = counted[f"b{i}"], counted[f"i{i}"]
            if not (below <= t["k0"] and t["k1"] < below + inside):
                missed = True
                still_open.append(i)
                continue
            shrunk = inside < t["inside"]
            t.update(lo=lo, hi=hi, below=below, inside=inside)
            if lo != hi and inside > bracket_limit and shrunk:
                still_open.append(i)
        margin = margin * 4 if missed else margin
        open_targets = still_open

    wide = [i for i, t in enumerate(targets) if t["lo"] != t["hi"]]
    for t in targets:
        if t["lo"] == t["hi"]:
            t["v0"] = t["v1"] = t["lo"]
    if wide:
        entries = [F.when(_within(targets[i]), F.struct(F.lit(i).alias("t"), F.col(targets[i]["col"]).cast("double").alias("x")))
                   for i in wide]
        values = df.select(F.inline(F.array_compact(F.array(*entries)))).groupBy("t", "x").agg(F.count(F.lit(1)).alias("n"))
        running = values.withColumn("upto", F.sum("n").over(Window.partitionBy("t").orderBy("x")))

        def rank(which: str) -> Column:
            pairs = [F.lit(v) for i in wide for v in (i, targets[i][which] - targets[i]["below"])]
            return F.element_at(F.create_map(*pairs), F.col("t"))

        found = running.groupBy("t").agg(
            F.min(F.when(F.col("upto") > rank("k0"), F.col("x"))).alias("v0"),
            F.min(F.when(F.col("upto") > rank("k1"), F.col("x"))).alias("v1"),
        )
        for row in found.collect():  # two numbers per target
            targets[row["t"]].update(v0=row["v0"], v1=row["v1"])
    out: dict[str, list[float | None]] = {c: [] for c in counts}
    for t in targets:
        v0, v1 = float(t["v0"]), float(t["v1"])
        out[t["col"]].append(v0 if v0 == v1 else (t["k1"] - t["position"]) * v0 + (t["position"] - t["k0"]) * v1)
    return out


def _within(t: Mapping) -> Column:
    x = F.col(t["col"])
    return x.isNotNull() if t["lo"] is None else x.between(F.lit(t["lo"]), F.lit(t["hi"]))


# --------------------------------------------------------------------------------------------- hashed ranks

MAX_CLASSES = 256
GROUP_LIMIT = 100_000


def key_hash(key: str, seed: int) -> Column:
    """A uniform, engine-independent order of the rows: md5 of ``seed-key`` as hex text."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")).cast("binary"))


def class_counts(df: DataFrame, label: str, max_classes: int = MAX_CLASSES) -> dict:
    """Rows per class, refusing NULL labels and label columns that are not categorical.

    Classes are kept on the driver and written into expressions, so more than ``max_classes`` raise; nothing is left out.
    """
    rows = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(max_classes + 1).collect()
    if len(rows) > max_classes:
        raise ValueError(f"More than {max_classes} classes in {label!r}")
    counts = {r[label]: r["n"] for r in rows}
    if None in counts:
        raise ValueError(f"NULL labels in {label!r}")
    return dict(sorted(counts.items()))


def rank_cuts(
    df: DataFrame, key: str, label: str, seed: int, ranks: Mapping[object, Sequence[int]], group_limit: int = GROUP_LIMIT
) -> dict[object, list[tuple[str, object] | None]]:
    """For each class, the ``(hash, key)`` of the row at each 1-based rank of the hashed order (None for rank 0).

    A distributed select: count rows by hash prefix, keep only the prefix groups that hold a wanted rank, lengthen the
    prefix until those groups are small, and rank only their rows. The table itself is never sorted or shuffled. ``key``
    must be unique.
    """
    hashed = computed_once(df, {"c": F.col(label), "h": key_hash(key, seed), "k": F.col(key)}, keep=[])
    wanted = [{"c": c, "rank": r, "prefix": "", "left": r, "size": None} for c, rs in ranks.items() for r in rs if r > 0]
    digits = 0
    while wanted and (digits == 0 or max(w["size"] for w in wanted) > group_limit) and digits < 30:
        digits += 3
        prefix = F.substring("h", 1, digits)
        groups = hashed.where(_in_groups(wanted)).groupBy("c", prefix.alias("p")).agg(F.count(F.lit(1)).alias("n"))
        sizes: dict = {}
        for r in groups.collect():  # at most 4096 prefixes per wanted group
            sizes.setdefault(r["c"], {})[r["p"]] = r["n"]
        for w in wanted:
            for p in sorted(p for p in sizes[w["c"]] if p.startswith(w["prefix"])):
                n = sizes[w["c"]][p]
                if w["left"] <= n:
                    w.update(prefix=p, size=n)
                    break
                w["left"] -= n
    found: dict = {}
    if wanted:
        order = Window.partitionBy("c", "p").orderBy("h", "k")
        rows = (hashed.where(_in_groups(wanted)).withColumn("p", F.substring("h", 1, digits))
                .withColumn("r", F.row_number().over(order))
                .withColumn("next", F.lead("k").over(order)))
        hit = F.lit(False)
        for w in wanted:
            hit = hit | ((F.col("c") == F.lit(w["c"])) & (F.col("p") == w["prefix"]) & (F.col("r") == w["left"]))
        for r in rows.where(hit).collect():  # one row per wanted rank
            if r["next"] == r["k"]:
                raise ValueError(f"Key column {key!r} is not unique")
            found[(r["c"], r["p"], r["r"])] = (r["h"], r["k"])
    lookup = {(w["c"], w["rank"]): found[(w["c"], w["prefix"], w["left"])] for w in wanted}
    return {c: [lookup.get((c, r)) for r in rs] for c, rs in ranks.items()}


def _in_groups(wanted: Sequence[Mapping]) -> Column:
    if not wanted[0]["prefix"]:
        return F.lit(True)
    out = F.lit(False)
    for c, p in {(w["c"], w["prefix"]) for w in wanted}:
        out = out | ((F.col("c") == F.lit(c)) & F.col("h").startswith(p))
    return out


def assign_by_cuts(
    df: DataFrame, out_column: str, key: str, label: str, seed: int, cuts: Mapping[object, Sequence[tuple | None]], names: Sequence
) -> DataFrame:
    """Append ``names[i]`` for the rows between cut i-1 and cut i of their class; row-local."""
    marked = computed_once(df, {"_hash": key_hash(key, seed), "_class": F.col(label)})
    h, k = F.col("_hash"), F.col(key)
    out = None
    for c, points in cuts.items():
        part = None
        for name, point in zip(names, points):
            inside = F.lit(False) if point is None else (h < point[0]) | ((h == point[0]) & (k <= F.lit(point[1])))
            part = F.when(inside, F.lit(name)) if part is None else part.when(inside, F.lit(name))
        part = part.otherwise(F.lit(names[-1]))
        mine = F.col("_class") == F.lit(c)
        out = F.when(mine, part) if out is None else out.when(mine, part)
    return computed_once(marked, {out_column: out}).drop("_hash", "_class")


# --------------------------------------------------------------------------------------------- score prefixes

# A table is cut into SCORE_BUCKETS buckets, or into as many of BUCKET_ROWS rows as it takes; bucket totals are broadcast, so
# there is an upper bound.
SCORE_BUCKETS, BUCKET_ROWS, MOST_BUCKETS = 1024, 1_000_000, 1 << 16


def quantile_splits(df: DataFrame, score: str, buckets: int | None = None) -> list[float]:
    """Equal-depth inner bucket edges, ascending and distinct: at most ``buckets - 1`` numbers on the driver.

    Without ``buckets`` their number follows from the rows, which the same aggregate counts; only a table of more rows than
    SCORE_BUCKETS buckets should hold is read a second time.
    """
    def cut(n: int) -> tuple:
        probs = F.array(*[F.lit(i / n) for i in range(1, n)])
        return tuple(df.agg(F.percentile_approx(F.col(score).cast("double"), probs, 10 * n), F.count(score)).first())

    edges, rows = cut(buckets or SCORE_BUCKETS)
    wanted = min(-(-rows // BUCKET_ROWS), MOST_BUCKETS)
    if buckets is None and wanted > SCORE_BUCKETS:
        edges, _ = cut(wanted)
    return sorted(set(edges or []))


def bucketed(df: DataFrame, score: str, edges: Sequence[float], out: str) -> DataFrame:
    """Append ``out`` = number of edges at or below the score (binary search)."""
    if len(edges) == 0:
        return df.withColumn(out, F.lit(0))
    search = Bucketizer(splits=[-math.inf, *edges, math.inf], inputCol=score, outputCol=out, handleInvalid="keep")
    return search.transform(df).withColumn(out, F.col(out).cast("int"))


def score_prefix(
    df: DataFrame, score: str, label: str, by: Sequence[str] = (), buckets: int | None = None
) -> DataFrame:
    """One row per distinct score: ``(*by, score, pos, neg, cum_pos, cum_neg, total_pos, total_neg, next_pos, next_neg)``.

    ``cum_*`` count the rows at or above the score, ``next_*`` are the counts of the next lower score (NULL at the last).
    Rows are counted per score before anything moves, so a hot score is one row; the running sum is computed inside
    equal-depth buckets, whose number follows from the rows, and bucket totals (one row per bucket and group) give the offsets.
    """
    # The group is one struct and the bucket is made non-nullable: rows of a NULL group stay, and no null filter makes the
    # two uses of the counts differ, so that Spark reads the shuffled counts twice instead of the table.
    keys = ["group"] if by else []
    group_column = [F.struct(*by).alias("group")] if by else []
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(
        *group_column, F.col(score).cast("double").alias("score"), F.col(label).alias("label"))
    edges = quantile_splits(rows, "score", buckets)
    marked = bucketed(rows, "score", edges, "bucket").withColumn("bucket", F.coalesce("bucket", F.lit(-1)))
    counts = marked.groupBy(*keys, "bucket", "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"))
    per_bucket = counts.groupBy(*keys, "bucket").agg(
        F.sum("pos").alias("b_pos"), F.sum("neg").alias("b_neg"),
        F.max_by(F.struct("pos", "neg"), "score").alias("top"))
    group = Window.partitionBy(*keys)
    descending = group.orderBy(F.desc("bucket"))
    before = descending.rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *keys, "bucket",
        F.coalesce(F.sum("b_pos").over(before), F.lit(0)).alias("o_pos"),
        F.coalesce(F.sum("b_neg").over(before), F.lit(0)).alias("o_neg"),
        F.sum("b_pos").over(group).alias("total_pos"), F.sum("b_neg").over(group).alias("total_neg"),
        F.lead("top").over(descending).alias("next_top"))
    # Without groups the offsets have at most MOST_BUCKETS rows; with groups their number is unknown, so nothing is hinted.
    offsets = offsets if by else F.broadcast(offsets)
    inside = Window.partitionBy(*keys, "bucket").orderBy(F.desc("score"))
    joined = counts.join(offsets, [*keys, "bucket"])
    return joined.select(
        *[F.col("group")[c].alias(c) for c in by], "score", "pos", "neg",
        (F.col("o_pos") + F.sum("pos").over(inside)).alias("cum_pos"),
        (F.col("o_neg") + F.sum("neg").over(inside)).alias("cum_neg"),
        "total_pos", "total_neg",
        F.coalesce(F.lead("pos").over(inside), F.col("next_top.pos")).alias("next_pos"),
        F.coalesce(F.lead("neg").over(inside), F.col("next_top.neg")).alias("next_neg"))


# --------------------------------------------------------------------------------------------- last N per group

SALTS = 32
# Where rows without a time stand: before all others.
BEFORE_ALL = "0001-01-01 00:00:00"


def top_n_per_group(df: DataFrame, group: str, ts: str, tie: str, n: int, step: str = "1 hour") -> DataFrame:
    """The ``n`` rows of each group with the greatest ``(ts, tie)``; rows with a NULL time count as the oldest.

    Row counts per group and time step tell from which step on the answer lies, so most rows are filtered at the scan. What
    remains of a group is ranked in ``SALTS`` slices first, and only the winners of the slices meet in one task.
    The plan is the same for any number of groups: the oldest step that any group needs is a constant that reaches the scan,
    the groups' own steps are joined, and how is left to Spark, which knows their size and splits a hot group.
    """
    zoneless = df.schema[ts].dataType.typeName() == "timestamp_ntz"
    first = F.lit(BEFORE_ALL).cast("timestamp_ntz" if zoneless else "timestamp")
    start = F.window(F.coalesce(F.col(ts), first), step)["start"]
    steps = df.groupBy(group, start.alias("step")).agg(F.count(F.lit(1)).alias("rows"))
    newest = Window.partitionBy(group).orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    needed = steps.withColumn("newer", F.coalesce(F.sum("rows").over(newest), F.lit(0))).where(F.col("newer") < n)
    since = needed.groupBy(group).agg(F.min("step").alias("since"))
    oldest = since.agg(F.min("since").cast("string"), F.min("since") > F.lit("1000-01-01").cast("timestamp")).first()
    if oldest[1]:
        df = df.where(F.col(ts) >= F.lit(oldest[0]).cast("timestamp_ntz" if zoneless else "timestamp"))
    recent = (df.join(since.withColumnRenamed(group, "_group"), F.col(group).eqNullSafe(F.col("_group")))
              .where(F.coalesce(F.col(ts), first) >= F.col("since")).drop("_group", "since"))
    latest = [F.desc_nulls_last(ts), F.desc(tie)]
    salted = recent.withColumn("_salt", F.pmod(F.xxhash64(tie), F.lit(SALTS)))
    sliced = salted.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_salt").orderBy(*latest)))
    winners = sliced.where(F.col("_r") <= n).drop("_r", "_salt")
    ranked = winners.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*latest)))
    return ranked.where(F.col("_r") <= n).drop("_r")
