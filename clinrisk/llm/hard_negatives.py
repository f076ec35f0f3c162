"""Hard negatives by exact inner products of packed integers.

Several candidates' components, made non-negative by a bias, are put side by side into fields of one wide integer. One
product with an anchor's component is then a product for all of them, and as a field is as wide as the largest possible sum, the
sum over components holds each candidate's inner product, exact and apart. Fields are taken out by shift and mask and the bias
by two sums. The wide integers have 53 bits, so that a matrix product of doubles adds them without rounding; where one inner
product can be wider than that they are Python integers, which have no limit.

Anchors go to the tasks in passes of bounded size and every pass reads all rows twice: for the positives, then for negatives
between the limits that a positive sets. A task keeps the first few of each anchor and Spark ranks what the tasks kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clinrisk.llm.common import landed, released, small_batches
from clinrisk.llm.vectors import complete, dimensions, matrix

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
# 100 * negative score lies between these multiples of the positive score.
LEAST, MOST = 50, 95
# Anchor components, as 64-bit numbers, that one pass sends to the tasks.
ANCHOR_BYTES = 16 << 20
# Anchors and candidates that are multiplied at once.
TILE = 512, 4096
WIDE, OBJECT_FIELDS = 53, 8
NONE = np.iinfo(np.int64).min
LAST = np.iinfo(np.int64).max


class Anchors:
    """Anchor rows, biased to be non-negative, ready to be multiplied with packed candidates."""

    def __init__(self, q: np.ndarray):
        self.bias = int(q.min(initial=0))
        self.v = q.astype(object) - self.bias if _large(q) else q - self.bias
        self.sums = self.v.sum(axis=1)
        self.top = int(self.v.max(initial=0))

    def products(self, at: np.ndarray | slice, candidates: np.ndarray) -> np.ndarray:
        """Inner products of the anchors ``at`` with the candidates, one multiplication for each group of packed candidates."""
        v, sums = self.v[at], self.sums[at]
        many, d = candidates.shape
        bias = int(candidates.min(initial=0))
        u = (candidates.astype(object) if _large(candidates) else candidates) - bias
        most = int(u.max(initial=0))
        width = max(1, (d * self.top * most).bit_length())
        packed_in_doubles = width <= WIDE and d * (self.top + abs(self.bias)) * (most + abs(bias)) < 1 << 62
        fields = WIDE // width if packed_in_doubles else OBJECT_FIELDS
        groups = -(-many // fields)
        kind = np.int64 if packed_in_doubles else object
        packed = np.zeros((groups, d), kind)
        for f in range(fields):
            part = u[f * groups:(f + 1) * groups].astype(kind)
            packed[:len(part)] += part << (width * f) if packed_in_doubles else part * (1 << (width * f))
        if packed_in_doubles:
            wide = (v.astype(np.float64) @ packed.astype(np.float64).T).astype(np.int64)
        else:
            wide = v.astype(object) @ packed.T
        out = np.empty((len(v), many), kind)
        mask = (1 << width) - 1
        for f in range(fields):
            low, high = f * groups, min((f + 1) * groups, many)
            if low < high:
                out[:, low:high] = (wide[:, :high - low] >> (width * f)) & mask
        own, sums = u.astype(kind).sum(axis=1), sums.astype(kind)
        out = out + sums[:, None] * bias + (own * self.bias + d * bias * self.bias)[None, :]
        return out if packed_in_doubles else _longs(out)


def _large(x: np.ndarray) -> bool:
    return x.dtype == object or bool(x.size) and max(int(x.max()), -int(x.min())) >= 1 << 61


def _longs(x: np.ndarray) -> np.ndarray:
    if x.size and max(int(x.max()), -int(x.min())) > LAST:
        raise ArithmeticError("a score is too large for a long")
    return x.astype(np.int64)


class First:
    """The first ``size`` rows of each group by falling score, then by id; ``floor`` is the score of the last that has to be matched."""

    def __init__(self, groups: int, size: int):
        self.score, self.ids, self.mark = np.full((groups, size), NONE), np.full((groups, size), LAST), np.zeros((groups, size), np.int64)
        self.size, self.floor = size, self.score[:, -1]

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray, mark: np.ndarray) -> None:
        """Only the groups that get a row are touched."""
        if not len(group):
            return
        known = np.unique(group)
        group = np.concatenate([np.repeat(known, self.size), group])
        score, ids, mark = (np.concatenate([old[known].ravel(), new]) for old, new in ((self.score, score), (self.ids, ids), (self.mark, mark)))
        order = np.lexsort((ids, ~score, group))
        new = np.diff(group[order], prepend=-1) != 0
        rank = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        order, rank = order[rank < self.size], rank[rank < self.size]
        for kept, values in ((self.score, score), (self.ids, ids), (self.mark, mark)):
            kept[group[order], rank] = values[order]

    def table(self, group: str) -> pa.RecordBatch:
        at, rank = np.nonzero(self.score != NONE)
        ids = self.ids[at, rank]
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(self.score[at, rank]), pa.array(ids, mask=ids == LAST), pa.array(self.mark[at, rank])], [group, "score", "id", "own"])


Scan = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(LAST).to_numpy(zero_copy_only=False)


def _tiles(n: int, size: int) -> Iterator[slice]:
    return (slice(low, min(low + size, n)) for low in range(0, n, size))


def _positives(ids: np.ndarray, labels: np.ndarray, q: np.ndarray, size: int) -> Scan:
    """The first ``size`` + 1 rows of each anchor's label, the anchor's own row among them, if it is so near, and marked."""
    anchors, d = Anchors(q), q.shape[1]

    def run(batches):
        first = First(len(ids), size + 1)
        for batch in batches:
            own_ids, own_labels, own = _ids(batch.column(0)), batch.column(1).to_numpy(), matrix(batch.column(2), d)
            for label in np.intersect1d(own_labels, labels):
                mine, theirs = np.flatnonzero(labels == label), np.flatnonzero(own_labels == label)
                for a in _tiles(len(mine), TILE[0]):
                    for c in _tiles(len(theirs), TILE[1]):
                        at, to = mine[a], theirs[c]
                        score = anchors.products(at, own[to])
                        least = first.floor[at]
                        if len(to) > first.size:
                            least = np.maximum(least, np.partition(score, len(to) - first.size, axis=1)[:, len(to) - first.size])
                        i, j = np.nonzero(score >= least[:, None])
                        same = own_ids[to[j]] == ids[at[i]]
                        same[same] = (own[to[j[same]]] == q[at[i[same]]]).all(axis=1)
                        first.add(at[i], score[i, j], own_ids[to[j]], same.astype(np.int64))
        yield first.table("anchor")

    return run


def _negatives(labels: np.ndarray, q: np.ndarray, positives: np.ndarray, size: int, least: int, most: int) -> Scan:
    """The first ``size`` rows of other labels for each anchor and positive; ``positives`` (anchors x number) holds scores, or NONE."""
    anchors, d, many = Anchors(q), q.shape[1], positives.shape[1]
    there = positives != NONE
    score = np.where(there, positives, 0).astype(object)
    low, high = np.where(there, -((-least * score) // 100), LAST).astype(np.int64), np.where(there, most * score // 100, NONE).astype(np.int64)
    low = np.where(low <= high, low, LAST)

    def run(batches):
        first = First(positives.size, size)
        for batch in batches:
            ids, own_labels, own = _ids(batch.column(0)), batch.column(1).to_numpy(), matrix(batch.column(2), d)
            for a in _tiles(len(labels), TILE[0]):
                for c in _tiles(len(ids), TILE[1]):
                    found = anchors.products(a, own[c])
                    need = np.maximum(low[a], first.floor.reshape(-1, many)[a])
                    i, j = np.nonzero((found >= need.min(axis=1)[:, None]) & (labels[a][:, None] != own_labels[c][None, :]))
                    hit = found[i, j]
                    at, p = np.nonzero((hit[:, None] >= need[i]) & (hit[:, None] <= high[a][i]))
                    first.add((a.start + i[at]) * many + p, hit[at], ids[c][j[at]], np.zeros(len(at), np.int64))
        yield first.table("pair")

    return run


def _ranked(df: DataFrame, group: str, size: int) -> DataFrame:
    order = Window.partitionBy(group).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def mine(rows: DataFrame, anchor: str, key: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES,
         least: int = LEAST, most: int = MOST, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of the rows for which the SQL condition ``anchor`` holds.

    A component x counts as floor(256 x); higher inner products come first, ties by smaller key. An anchor's positives are its
    first other rows of its label, and each positive's negatives the first rows of other labels whose score is from ``least`` to
    ``most`` hundredths of the positive's. Rows with a NULL label, a NULL vector or a NULL or non-finite component take no part, nor do
    vectors of another length than most have. Every row counts, repeated ones too: a copy of an anchor is another row, and is
    an anchor of its own, with the same results. Rows with a NULL key are no anchors and come last among ties. Keys and labels
    are whole numbers. An empty table, or one without anchors, gives an empty result. Scores that are no longs raise an arithmetic
    error. Other columns are not looked at.
    """
    spark = rows.sparkSession
    usable = rows.where(complete(vector) & F.col(label).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(F.expr(anchor), F.lit(False)).alias("anchor"))
    d = dimensions(usable, "v")
    usable = usable.where(F.size("v") == d).withColumn("q", F.transform("v", lambda x: F.floor(x * SCALE))).select("id", "label", "q", "anchor")
    every = usable.select("id", "label", "q")
    distinct = usable.where("anchor AND id IS NOT NULL").groupBy("id", "label", "q").agg(F.count("*").alias("copies"))
    passes = -(-distinct.count() * 8 * max(d, 1) // anchor_bytes)
    parts = []
    for i in range(passes):
        chosen = distinct.where(F.pmod(F.xxhash64("id", "label", "q"), F.lit(passes)) == i).orderBy("id", "label", "q").toArrow().combine_chunks()
        if chosen.num_rows:
            parts.append(landed(_one_pass(every, chosen, d, positives, negatives, least, most), "negatives"))
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _one_pass(every: DataFrame, chosen: pa.Table, d: int, positives: int, negatives: int, least: int, most: int) -> DataFrame:
    ids, labels = (chosen.column(c).to_numpy() for c in ("id", "label"))
    q = matrix(chosen.column("q").chunk(0), d)
    near = small_batches(every).mapInArrow(released(_positives(ids, labels, q, positives)), "anchor long, score long, id long, own long")
    score, other = np.full((len(ids), positives), NONE), np.full((len(ids), positives), LAST)
    taken, left_out = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
    # At most ``positives`` + 1 rows for each anchor of the pass.
    found = _ranked(near, "anchor", positives + 1).select("anchor", "rank", "score", "id", "own").orderBy("anchor", "rank").toArrow()
    for a, s, i, own in zip(*(found.column(c).to_pylist() for c in ("anchor", "score", "id", "own"))):
        if own and not left_out[a]:
            left_out[a] = True
        elif taken[a] < positives:
            score[a, taken[a]], other[a, taken[a]] = s, LAST if i is None else i
            taken[a] += 1
    far = small_batches(every).mapInArrow(released(_negatives(labels, q, score, negatives, least, most)), "pair long, score long, id long, own long")
    copies = chosen.column("copies").to_numpy()

    def named(batches):
        for batch in batches:
            pair = batch.column(0).to_numpy()
            a, p = np.divmod(pair, positives)
            again = np.repeat(np.arange(len(pair)), copies[a])
            a, p = a[again], p[again]
            positive = other[a, p]
            rest = batch.take(pa.array(again))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[a]), pa.array(positive, mask=positive == LAST), rest.column(1), rest.column(2), pa.array(score[a, p]), rest.column(3)],
                ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    ranked = _ranked(far, "pair", negatives).select("pair", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return small_batches(ranked).mapInArrow(named, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
