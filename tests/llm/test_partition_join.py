"""The partition join of shingle sets against all pairs."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clinrisk.llm import partition_join, queries
from clinrisk.llm.partition_join import DEAR, allotted, bands, difference, histograms, near, similar_sets

from .conftest import PROSE, frame

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingles(text, size):
    w = (text or "").encode().translate(LOWER).split()
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def by_all_pairs(rows, percent, size):
    """(doc_id, n_shingles, component_id) of each row; texts with equal sets are one, so that copies cost nothing."""
    sets = [shingles(t, size) for _, t in rows]
    distinct = sorted({s for s in sets if s}, key=len)
    root = {s: s for s in distinct}

    def find(x):
        while root[x] is not x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if 100 * len(a) < percent * len(b):
                break
            if 100 * len(a & b) >= percent * len(a | b):
                root[find(a)] = find(b)
    ids = collections.defaultdict(list)
    for (d, _), s in zip(rows, sets):
        if s and d is not None:
            ids[find(s)].append(d)
    out = [(d, len(s), min(ids[find(s)], default=None) if s else d) for (d, _), s in zip(rows, sets)]
    return collections.Counter((d, n, d if c is None else c) for d, n, c in out)


def outcome(df):
    return collections.Counter(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect())


@pytest.mark.parametrize("percent", [50, 80, 85, 95, 100])
def test_bands_hold_all_partners(percent):
    top = bands(percent)
    assert (np.diff(top) > 0).all()
    for small in range(1, 400):
        for large in range(small, 100 * small // percent + 1):
            assert np.searchsorted(top, large) - np.searchsorted(top, small) in (0, 1)


@pytest.mark.parametrize("percent,seed", [(85, 1), (85, 2), (80, 3), (60, 4), (95, 5)])
def test_similar_sets_meet_where_one_asks_and_one_is_indexed(percent, seed):
    """Pairs at the limit of similarity, with costs that make most segments dear for half of them."""
    rng = np.random.default_rng(seed)
    for _ in range(150):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = a.copy()
        # Take away and add until one more change would part the two.
        while True:
            c = np.delete(b, rng.integers(len(b))) if rng.random() < 0.5 and len(b) > 1 else np.append(b, rng.integers(0, 1 << 63, 1).astype(np.uint64))
            both = len(np.intersect1d(a, c))
            if 100 * both < percent * (len(a) + len(c) - both):
                break
            b = c
        assert len(a) + len(b) - 2 * len(np.intersect1d(a, b)) <= difference(np.array(len(a)), np.array(len(b)), percent)
        frequent = np.unique(rng.choice(a, int(len(a) * rng.random()))) if rng.random() < 0.5 else np.empty(0, np.uint64)
        tokens = np.concatenate([np.sort(a), np.sort(b)])
        x, y = (dict(s) for s in allotted(tokens, np.array([len(a), len(b)]), percent, frequent, np.full(len(frequent), 4 * DEAR)))
        assert any((x[k] & 1 and y[k] & 2) or (x[k] & 2 and y[k] & 1) for k in x.keys() & y.keys())
        h = histograms(tokens, np.array([len(a), len(b)]))
        assert near((h, h), (np.array([0]), np.array([1])), np.array([len(a)]), np.array([len(b)]), percent).all()


def test_unlike_sets_hardly_meet_and_histograms_part_them():
    rng = np.random.default_rng(9)
    tokens, sizes = rng.integers(0, 1 << 63, 200 * 120).astype(np.uint64), np.full(200, 120)
    keys = collections.Counter(k for s in allotted(tokens, sizes, 85) for k, role in s if role & 2)
    assert sum(c > 1 for c in keys.values()) < 20
    h = histograms(tokens, sizes)
    assert not near((h, h), (np.arange(199), np.arange(1, 200)), sizes[:-1], sizes[1:], 85).any()


def variants(seed, count, length=60, edits=8, words=500):
    """Texts that differ from one another by a few words, around the limit."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(words)}" for _ in range(length)]
    out = []
    for _ in range(count):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            at = rng.randrange(len(w))
            w[at:at + rng.randrange(2)] = [f"v{rng.randrange(words)}"]
        out.append(" ".join(w))
    return out


def rows_of_many_kinds():
    rng, texts = random.Random(3), []
    for seed in range(6):
        texts += variants(seed, 25, length=rng.choice([12, 40, 150]))
    texts += [" ".join(f"u{rng.randrange(9)}" for _ in range(rng.randrange(1, 12))) for _ in range(150)]
    shared = " ".join(f"common{i}" for i in range(40))
    texts += [shared + " " + " ".join(f"z{rng.randrange(10**6)}" for _ in range(rng.randrange(2, 60))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("percent,size", [(85, 4), (80, 5), (60, 2)])
def test_components_are_those_of_all_pairs(spark, percent, size):
    rows = rows_of_many_kinds()
    got = similar_sets(frame(spark, rows).repartition(5), percent, size)
    assert outcome(got) == by_all_pairs(rows, percent, size)


def test_a_third_of_all_rows_are_copies_and_many_are_near_copies(spark):
    near_copies = variants(4, 400, length=80, edits=5)
    rows = [(i, t) for i, t in enumerate(near_copies + [PROSE[0]] * 300 + [f"{PROSE[1]} {i}" for i in range(100)] + PROSE)]
    assert outcome(similar_sets(frame(spark, rows).repartition(3), 85, 4)) == by_all_pairs(rows, 85, 4)


def test_keys_of_one_stretch_meet_outside_through_a_leader(spark):
    """Equal keys of many sets of a task take one row among those of other tasks."""
    rows = [(i, t) for i, t in enumerate(variants(7, 300, length=70, edits=3))]
    docs = frame(spark, rows).repartition(3)
    keyed = partition_join.keyed(docs, 4, 85, np.empty(0, np.uint64), np.empty(0))
    largest = keyed.where("tag div 8 = 0").groupBy("key").count().agg(F.max("count")).first()[0]
    assert largest <= 3 * (partition_join.LOCAL - 1) and keyed.where("tag div 8 <> 0").count() > 0
    assert outcome(similar_sets(docs, 85, 4)) == by_all_pairs(rows, 85, 4)


def test_odd_documents(spark, odd, empty):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert outcome(similar_sets(odd, 85, 4)) == by_all_pairs(rows, 85, 4)
    assert similar_sets(empty, 85, 4).count() == 0
    assert similar_sets(odd.where("text IS NULL"), 85, 4).count() == 2


def test_query_on_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert outcome(queries.QUERIES["op11_partition_join"](spark, sf)) == by_all_pairs(rows, 85, 4)
