"""Pairs inside buckets and on full shingle sets, worked out in tasks, without a row for each pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinrisk.llm.common import mapped, pair_hash, released, small_batches

BLOCK = 256


def linked(percent: int, inside, n_a, n_b):
    return 100 * inside >= percent * (n_a + n_b - inside)


def in_blocks(members: DataFrame, work, schema: str, alone: bool = True) -> DataFrame:
    """``work(table)`` for all pairs of blocks of each bucket: a block is some BLOCK members, dealt by hash.

    Members are sorted to their block pairs; a task holds one at a time. Work that compares the members of two blocks also
    with those of their own needs no block ``alone``, unless it is the only one.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                         lambda i: F.struct(F.least(i, F.col("own")).alias("i"), F.greatest(i, F.col("own")).alias("j")))
    if not alone:
        others = F.filter(others, lambda pair: (F.col("blocks") == 1) | (pair["i"] < pair["j"]))
    placed = (members.withColumn("blocks", blocks).withColumn("own", own).withColumn("pair", F.explode(others))
              .repartition("key", "pair").sortWithinPartitions("key", "pair", "own", "node"))

    def run(batches):
        for whole in groups(batches):
            yield from work(whole)

    return small_batches(placed).mapInArrow(released(run), schema)


def groups(batches) -> Iterator[pa.Table]:
    """Tables of whole groups (key, pair) from sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = group_ids(batch)
        if held and ids[0] != group_ids(held[-1])[-1]:
            yield pa.Table.from_batches(held)
            held = []
        cut = int(np.flatnonzero(ids == ids[-1])[0])
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def group_ids(table: pa.RecordBatch | pa.Table) -> np.ndarray:
    """A number for each row's (key, pair); equal for equal groups."""
    pair = table.column("pair")
    pair = pair.combine_chunks() if isinstance(pair, pa.ChunkedArray) else pair
    i, j = (pair.field(f).to_numpy().astype(np.uint64) for f in ("i", "j"))
    return pair_hash(table.column("key").to_numpy().view(np.uint64), (i << np.uint64(32)) | j)


def pairs(table: pa.Table, piece: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of each group across components and without the bucket's centre; of two blocks, only pairs across them."""
    ids = group_ids(table)
    border = np.flatnonzero(np.diff(ids, prepend=~ids[:1]) != 0)
    end = np.repeat(np.append(border[1:], len(ids)), np.diff(np.append(border, len(ids))))
    label, own, central = (table.column(c).to_numpy() for c in ("label", "own", "central"))
    pair = table.column("pair").combine_chunks()
    two = pair.field("i").to_numpy() != pair.field("j").to_numpy()
    row, low = np.arange(len(ids)), 0
    counts = end - row - 1
    while low < len(ids):
        high = max(low + 1, int(np.searchsorted(np.cumsum(counts[low:]), piece)) + low)
        a = np.repeat(row[low:high], counts[low:high])
        offset = np.arange(len(a)) - np.repeat(np.cumsum(counts[low:high]) - counts[low:high], counts[low:high])
        b = a + 1 + offset
        ok = (label[a] != label[b]) & ~central[a] & ~central[b] & (~two[a] | (own[a] != own[b]))
        yield a[ok], b[ok]
        low = high


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets (node, set) are similar enough."""
    joined = (pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("s_a")), "a")
              .join(sets.select(F.col("node").alias("b"), F.col("set").alias("s_b")), "b").select("a", "b", "s_a", "s_b"))

    def each(batch: pa.RecordBatch):
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            both = np.sort(np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)]))
            keep.append(linked(percent, int((both[1:] == both[:-1]).sum()), len(x) // 8, len(y) // 8))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return mapped(joined, "a long, b long", each)


def exact_work(percent: int):
    """Links (a, b) between labels whose members are similar enough."""
    def work(table: pa.Table):
        ids, label = group_ids(table), table.column("label").to_numpy()
        sets = table.column("set").to_pylist()
        out = []
        border = [*np.flatnonzero(np.diff(ids, prepend=~ids[:1]) != 0), len(ids)]
        for low, high in zip(border, border[1:]):
            if (label[low:high] != label[low]).any():
                out += joining_links(label[low:high], [np.frombuffer(s, np.uint64) for s in sets[low:high]], percent)
        a = np.array(out, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])
    return work


def joining_links(label, sets, percent: int) -> list[tuple[int, int]]:
    """Links that join different labels of a block: one fewer than there are labels at most, all of a component to one of them."""
    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    _, shingle, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = df[shingle] > 1
    owner, shingle = owner[shared], shingle[shared]
    order = np.argsort(shingle, kind="stable")
    holders = owner[order]
    # Where each set's shingles stand among the holders, and how many holders come after it.
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    later = np.searchsorted(shingle[order], np.arange(len(df)), "right")[shingle] - place - 1
    own_start = np.searchsorted(owner, np.arange(len(sets) + 1))
    root = {x: x for x in label.tolist()}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(sets)):
        mine = slice(own_start[i], own_start[i + 1])
        many = later[mine]
        at = np.repeat(place[mine] + 1 - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        inside = np.bincount(holders[at], minlength=len(sets))
        near = np.flatnonzero(linked(percent, inside, n[i], n))
        for other in np.unique(label[near[near > i]]).tolist():
            if (x := find(int(label[i]))) != (y := find(other)):
                root[max(x, y)] = min(x, y)
    return [(x, find(x)) for x in root if find(x) != x]
