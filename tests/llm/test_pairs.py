"""Near-duplicates, benchmark passages and components against brute force."""

import collections
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clinrisk.llm import blocks, qgram_match, queries, setsketch
from clinrisk.llm import components as components_module
from clinrisk.llm.components import connected
from clinrisk.llm.qgram_match import Index, Offsets, plain

from .conftest import PROSE, frame

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingles(text):
    w = (text or "").encode().translate(LOWER).split()
    return frozenset(zip(w, w[1:], w[2:])) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


def components(rows, percent=85):
    """Component ids of (doc_id, text) rows by comparing all pairs."""
    sets, root = [(d, shingles(t)) for d, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(sets):
        if d is not None:
            ids[find(i)].append(d)
    return collections.Counter((d, len(s), min(ids[find(i)], default=None) if s else d) for i, (d, s) in enumerate(sets))


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def copies(spark):
    """Chains of edited copies: many near the limit, in one group and in small ones, with exact copies and equal beginnings."""
    rng, rows = random.Random(5), []
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows += [edited(rng, base, rng.randrange(1, 8)) for _ in range(320)] + [" ".join(base)] * 30
    for _ in range(25):
        words = [f"v{rng.randrange(3000)}" for _ in range(rng.choice((4, 30, 90)))]
        text = " ".join(words)
        for _ in range(4):
            text = edited(rng, text.split(), 1)
            rows += [text, text.upper()]
    rows += [" ".join(base[:60] + [f"u{i}{k}" for k in range(60)]) for i in range(40)]
    rng.shuffle(rows)
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def outcome(df):
    return collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_components_equal_all_pairs(spark, sf, copies):
    for docs in (copies, spark.read.parquet(f"{sf}/documents.parquet")):
        got = setsketch.near_duplicates(docs.select("doc_id", "text"))
        assert outcome(got) == components([(r.doc_id, r.text) for r in docs.collect()])
        assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())


def test_blocks_inside_large_buckets(copies, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 16)
    got = setsketch.near_duplicates(copies)
    assert outcome(got) == components([(r.doc_id, r.text) for r in copies.collect()])


def test_near_duplicates_odd_inputs(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert outcome(setsketch.near_duplicates(odd)) == components(rows)
    assert setsketch.near_duplicates(empty).count() == 0
    kept = setsketch.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = collections.Counter(r.doc_id for r in kept.select("doc_id").collect())
    # The copy without id goes, as a document with one stays; texts without words and the lonely one stay.
    assert ids[46] == 0 and ids[1] == 1 and ids[None] == 2 and ids[45] == 0 and all(ids[i] == 1 for i in (40, 41, 42, 43, 44))
    assert setsketch.one_of_each(empty).count() == 0


def test_estimate_follows_the_similarity():
    rng = np.random.default_rng(3)
    errors = []
    for wanted in (0.3, 0.6, 0.85, 0.95):
        for _ in range(20):
            n = 400
            both = int(2 * n * wanted / (1 + wanted))
            a, b, c = (rng.integers(0, 1 << 63, k).astype(np.uint64) for k in (both, n - both, n - both))
            r = setsketch.sketches(np.concatenate([a, b, a, c]), np.array([n, n])).astype(int)
            value = setsketch.estimate(np.array([(r[0] > r[1]).sum()]), np.array([(r[0] < r[1]).sum()]), np.array([n]), np.array([n]))[0]
            errors.append(value - both / (2 * n - both))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_registers_are_mergeable():
    rng = np.random.default_rng(4)
    a, b = (rng.integers(0, 1 << 63, 50).astype(np.uint64) for _ in range(2))
    one, two, both = (setsketch.sketches(x, np.array([len(x)]))[0] for x in (a, b, np.concatenate([a, b])))
    assert (np.maximum(one, two) == both).all()


def test_connected_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (30, 30)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 500 + i) for i in range(1, 60)]
    got = dict(connected(spark.createDataFrame(links, "a long, b long")).collect())
    assert {n: got[n] for n in (1, 2, 3, 7, 8, 9)} == dict.fromkeys((1, 2, 3, 7, 8, 9), 1) and got[21] == 20
    assert all(got[100 + i] == 100 for i in range(41)) and all(got[500 + i] == 500 for i in range(60))
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def tasks_of(spark, run):
    """How many tasks Spark's jobs for ``run`` take, without those of broadcasts."""
    group = f"counted-{random.random()}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    return sum(s.numCompletedTasks for s in stages if s)


def landings(monkeypatch, *modules):
    """The names of the tables that the modules land from now on."""
    names = []
    for module in modules:
        monkeypatch.setattr(module, "landed", lambda df, name, f=module.landed: (names.append(name), f(df, name))[1])
    return names


def test_links_that_are_stars_are_not_landed(spark, monkeypatch):
    names = landings(monkeypatch, components_module)
    links = spark.createDataFrame([(1, 500 + i) for i in range(30)] + [(500, 1), (7, 8), (8, 7), (9, 9)], "a long, b long")
    got = dict(connected(links).collect())
    assert got == {1: 1, 7: 7, 8: 7} | {500 + i: 1 for i in range(30)} and not names
    chain = spark.createDataFrame([(i, i + 1) for i in range(6)], "a long, b long")
    assert set(dict(connected(chain).collect()).values()) == {0} and len(names) % 2 == 0


def test_blocks_compare_what_their_work_leaves_out(spark):
    members = spark.createDataFrame([(5, n, 600, n) for n in range(600)] + [(6, n, 3, n) for n in range(3)], "key long, node long, size long, label long")
    schema = "key long, i int, j int, n long"

    def work(table):
        pair = table.column("pair").combine_chunks()
        t = pa.table({"key": table.column("key"), "i": pair.field("i"), "j": pair.field("j")}).group_by(["key", "i", "j"]).aggregate([([], "count_all")])
        yield from t.rename_columns(["key", "i", "j", "n"]).to_batches()

    def places(**options):
        return {(r.key, r.i, r.j) for r in blocks.in_blocks(members, work, schema, **options).groupBy("key", "i", "j").agg(F.sum("n")).collect()}

    assert places() == {(6, 0, 0)} | {(5, i, j) for j in range(3) for i in range(j + 1)}
    assert places(alone=False) == {(6, 0, 0), (5, 0, 1), (5, 0, 2), (5, 1, 2)}


def test_joining_links_tie_labels():
    a, b, c = (np.arange(s, s + 100, dtype=np.uint64) for s in (0, 5, 1000))
    d = np.append(c[:95], np.uint64(5000))
    assert sorted(blocks.joining_links(np.array([9, 4, 3, 3]), [a, b, c, d], 85)) == [(9, 4)]
    assert sorted(blocks.joining_links(np.array([9, 4, 3, 2, 1]), [a, b, c, d, c], 85)) == [(2, 1), (3, 1), (9, 4)]
    assert blocks.joining_links(np.array([1, 2]), [a, c], 85) == []


def test_near_duplicates_deal_few_tasks(spark, copies):
    """Every time rows are dealt anew costs a task for each partition, however few rows there are; 1 440 tasks once, now 844."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        assert 0 < tasks_of(spark, lambda: setsketch.near_duplicates(copies).collect()) < 1100
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


# ------------------------------------------------------------------------------------------------ passages

def distance(p, t):
    """Fewest edits between ``p`` and any part of ``t``."""
    previous = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        current = [i]
        for j, d in enumerate(t, 1):
            current.append(min(previous[j] + 1, current[-1] + 1, previous[j - 1] + (c != d)))
        previous = current
    return min(previous)


def test_passages_equal_edit_distances():
    rng = random.Random(3)
    letters = b"abcdefghij "
    text = lambda n: bytes(rng.choice(letters) for _ in range(n))
    items = [(i, text(rng.randint(30, 110))) for i in range(8)]
    index, docs = Index.of(items), []
    for _ in range(60):
        p = bytearray(rng.choice(items)[1])
        for _ in range(rng.randint(0, 13)):
            k = rng.randrange(len(p))
            (p.insert, p.__setitem__)[rng.random() < 0.5](k, rng.choice(letters))
            if rng.random() < 0.4:
                del p[k]
        docs.append(text(rng.randint(0, 150)) + bytes(p) + text(rng.randint(0, 150)))
    got = {(t, i): (s, e, k) for t, i, s, e, k in index.find(docs)}
    for t, doc in enumerate(docs):
        for n, (i, p) in enumerate(items):
            p = plain(p).strip()
            k = distance(p, plain(doc))
            assert ((t, i) in got) == (k <= index.edits[n])
            if (t, i) in got:
                s, e, edits = got[t, i]
                assert edits == k == distance(p, plain(doc)[s:e])


def test_items_of_all_lengths_are_found_whole_with_their_edits():
    rng = random.Random(8)
    for n in (8, 20, 24, 60, 111, 113, 400, 512, 513, 700, 2000):
        item = bytes(rng.choice(b"abcdefghijklmnop") for _ in range(n))
        index = Index.of([(1, item)])
        changed = bytearray(item)
        places = rng.sample(range(0, n, 11), min(int(index.edits[0]), len(range(0, n, 11))))
        for k in places:
            changed[k] = ord("z")
        doc = b"start " + bytes(changed) + b" end"
        ((t, i, s, e, edits),) = index.find([doc])
        assert (t, i, edits) == (0, 1, len(places)) and 6 - len(places) <= s <= 6 + len(places) and abs(e - 6 - n) <= len(places)


def test_stretches_that_repeat_themselves():
    item = b"Results follow here\n" + b"-" * 60 + b"\n| a | b |\n" + b"=-" * 30 + b"\nlast line of it all"
    index = Index.of([(1, item), (2, b"-" * 150), (3, b"0 " * 70), (4, b"no such thing anywhere in it")])
    start = time.perf_counter()
    long = [b"-" * 10**6, b"0 " * 10**5, b"ab" * 10**5 + item + b"-" * 10**5, b"Results follow here\n" + b"-" * 61 + b"\n| a | b |\n" + b"=-" * 500 + b"\nlast line of it all", (b"-" * 70 + b"\n") * 3000]
    got = {(t, i): k for t, i, _, _, k in index.find(long)}
    assert time.perf_counter() - start < 10
    assert got[0, 2] == 0 and got[1, 3] == 0 and got[2, 1] == 0 and got[3, 1] == 0 and got[4, 2] == 0 and not any(i == 4 for _, i in got)
    for text in (*long[:3], item, "Größe ".encode() + "ß".encode() * 50 + b" x"):
        at, shown = Offsets(text), plain(text)
        whole = text.decode()
        assert at.start(0) == 0 and at.end(len(shown)) == len(whole)
        assert all(plain(whole[at.start(i)].encode())[:1] in shown[max(i - 1, 0):i + 1] for i in range(0, len(shown), 7))


def test_rows_with_passages_go_by_key(spark):
    benchmark = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog again"), (2, None), (3, "tiny")], "item_id smallint, text string")
    rows = [(1, "x the QUICK brown fox jumps over the lazy dog again y"), (1, "another text of row one"), (None, "the quick brown fox jumps over the lazy dog again"), (None, None), (2, None), (3, ""), (4, "tiny")]
    docs = frame(spark, rows)
    left = qgram_match.without_passages(docs, benchmark)
    assert left.columns == docs.columns
    assert collections.Counter((r.doc_id, r.text) for r in left.collect()) == collections.Counter([rows[1], rows[3], rows[4], rows[5], rows[6]])
    found = qgram_match.passages(docs, benchmark)
    assert dict(found.dtypes)["item_id"] == "smallint" and {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 1), (None, 1)}


def test_exact_passages_of_the_table_are_found(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet").toPandas() for t in ("documents", "benchmark"))
    expected = {(d, i) for d, t in zip(docs.doc_id, docs.text) for i, p in zip(items.item_id, items.text) if p in t}
    got = queries.QUERIES["op4_qgram_match"](spark, sf).collect()
    assert expected and {(r.doc_id, r.item_id) for r in got if r.edits == 0} == expected
    by_id = dict(zip(docs.doc_id, docs.text)), dict(zip(items.item_id, items.text))
    assert all(by_id[0][r.doc_id][r.start:r.end] == by_id[1][r.item_id] for r in got if not r.edits)


def test_passages_odd_inputs(spark, odd, empty, monkeypatch):
    items = spark.createDataFrame([(1, PROSE[3][:90]), (2, None), (3, ""), (4, "short"), (None, PROSE[4][:80]), (5, "zero byte zero byte zero byte")],
                                  "item_id long, text string").withColumn("start", F.lit(0))
    long = "é " + " ".join(f"passage{i}" for i in range(300))
    docs = odd.unionByName(frame(odd.sparkSession, [(90, "x " * 50_000 + PROSE[3][:90].upper() + " y" * 50_000), (91, "before é " + long[400:1200])]))
    items = items.unionByName(spark.createDataFrame([(6, long)], "item_id long, text string").withColumn("start", F.lit(0)))
    whole = collections.Counter((r.doc_id, r.item_id) for r in qgram_match.passages(docs, items).collect())
    assert whole[3, 1] == whole[90, 1] == whole[91, 6] == 1 and (4, None) in whole and not any(i in (2, 3, 4) for _, i in whole)
    monkeypatch.setattr(qgram_match, "MAX_INDEX_BYTES", 100)
    parts = [make() for make in qgram_match.indexes(items, max_bytes=2000)]
    assert len(parts) > 1 and sum(len(p.patterns) for p in parts) == len(qgram_match.indexes(items)[0]().patterns)
    clean = qgram_match.without_passages(docs, items)
    assert clean.columns == docs.columns and clean.where("doc_id IN (3, 90, 91)").count() == 0 and clean.where("doc_id IS NULL").count() == 3
    assert qgram_match.passages(empty, items).count() == 0 and qgram_match.passages(odd, items.where("false")).count() == 0
    assert qgram_match.without_passages(odd, items.where("false")).count() == odd.count()


def test_passages_in_other_case_are_found_beyond_ascii(spark):
    texts = ["Les élèves préférés répètent très sérieusement là-bas où l'été dernier régnait, déjà, une fièvre générale et éphémère",
             "Съешь же ещё этих мягких французских булок, да выпей чаю", "Οδυσσέας και Πηνελόπη, ο νόστος της θάλασσας", "Die Straße ist größer, weißer und heißer als außen am Fluß"]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")
    docs = frame(spark, [(i, f"É ß {i} vor " + t.upper() + " NACH É", "xx") for i, t in enumerate(texts)] + [(9, "É ß nothing of these is in here, not in any case at all")])
    rows = {(r.doc_id, r.item_id): r for r in qgram_match.passages(docs, items).collect()}
    assert set(rows) == {(i, i) for i in range(4)} and not any(r.edits for r in rows.values())
    assert all(f"É ß {i} vor {t.upper()} NACH É"[rows[i, i].start:rows[i, i].end] == t.upper() for i, t in enumerate(texts))
    assert [r.doc_id for r in qgram_match.without_passages(docs, items).collect()] == [9]


def test_parts_of_items_and_short_items_are_found():
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)).encode()
    middle, long, short = words(70), words(300), b"Short item 42"
    assert 480 < len(middle) <= 512 < len(long)
    run = qgram_match.WINDOW_BYTES + qgram_match.STEP_BYTES - 1
    parts = [(1, middle[50:50 + 390]), *((1, middle[i:i + run]) for i in range(0, len(middle) - run, 13)), *((2, long[i:i + run]) for i in range(0, len(long) - run, 13)),
             (1, middle[-run:]), (3, b"a SHORT  item 42".replace(b"  ", b" ") + b"."), (3, short)]
    docs = [words(20) + b" " + p + b" " + words(20) for _, p in parts] + [words(30), b"a short item 41 shart item 42 " + words(5), words(3) + b" " + middle]
    got = {(t, i): (s, e, k) for t, i, s, e, k in Index.of([(1, middle), (2, long), (3, short)]).find(docs)}
    assert set(got) == {(t, i) for t, (i, _) in enumerate(parts)} | {(len(parts) + 2, 1)}
    assert got[len(parts) + 2, 1][2] == 0 and all(k > 0 for (t, i), (_, _, k) in got.items() if i == 1 and t < len(parts))
