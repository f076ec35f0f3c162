"""Operators that judge documents: counts by brute force, held-out accuracy, and odd inputs."""

import collections
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clinrisk.llm import boosted_rules, crf_language, interpolated_lm, preference, queries
from clinrisk.llm.common import Joined, fold, words
from clinrisk.llm.stats import FEATURES, statistics

from .conftest import PROSE, frame

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def test_words_are_found_and_told_apart():
    text = "ab ab\tba\n\x0bcafé caf\x1c é " .encode() + b"y" * 10_000 + b" ab"
    hashes, starts = words(text, chunk=64)
    expected = WORD.findall(text)
    assert [WORD.match(text, s).group() for s in starts] == expected
    assert len(set(hashes)) == len(set(expected)) and hashes[0] == hashes[1] == hashes[-1]
    joined = Joined([b"a b", b"", b"c"])
    assert joined.words_per_text().tolist() == [2, 0, 1]


def counts(text):
    w = [] if text is None else WORD.findall(text.encode())
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    again = set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i:i + 3])] > 1:
            again |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x.encode())]
    return (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again))


def test_rules_count_what_is_defined(spark, sf, odd, labels):
    for docs, known in ((table(spark, sf, "documents"), table(spark, sf, "labels")), (odd, labels)):
        got = boosted_rules.quality_rules(docs, known).collect()
        texts = docs.select("doc_id", "text").collect()
        expected = collections.Counter((d, *counts(t)) for d, t in texts)
        assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == expected
        for r in got:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)


def test_rules_keep_good_documents(spark, sf):
    got = queries.QUERIES["op3_boosted_rules"](spark, sf).join(table(spark, sf, "labels"), "doc_id")
    row = got.where("NOT base_failed").agg(F.avg(F.expr("cast(kept AS int) = quality").cast("int"))).first()
    assert row[0] > 0.97


def test_constraints_hold():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] + 0.3 * rng.normal(size=600) > 0) & (x[:, 1] < 1)).astype(int)
    forest = boosted_rules.fit_forest(x, y, np.array([1, -1, 0]), trees=20)
    assert ((forest.probability(x) > 0.5) == y).mean() > 0.85
    base = rng.normal(size=(50, 3))
    for f, sign in ((0, 1), (1, -1)):
        line = np.repeat(base, 30, axis=0)
        line[:, f] = np.tile(np.linspace(-3, 3, 30), 50)
        p = forest.probability(line).reshape(50, 30)
        assert (sign * np.diff(p, axis=1) >= -1e-12).all()


def test_flattened_trees_score_as_walked():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    forest = boosted_rules.fit_forest(x, (x[:, 0] * x[:, 1] > 0).astype(int), np.zeros(2, int), trees=5)

    def walk(row, node):
        while forest.left[node] != node:
            node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
        return forest.value[node]

    for row, p in zip(x[:40], forest.probability(x[:40])):
        z = forest.base + sum(walk(row, r) for r in forest.roots)
        assert math.isclose(p, 1 / (1 + math.exp(-z)))


def test_preference_ranks_held_out_documents(spark, sf):
    got = queries.QUERIES["op1_preference"](spark, sf).join(table(spark, sf, "labels"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in held.doc_id]).all()
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (good[:, None] > bad).mean() > 0.97 and ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_preference_fit_is_at_its_optimum():
    rng = np.random.default_rng(2)
    x = np.abs(rng.normal(size=(80, len(FEATURES))))
    y = (x[:, 2] < 0.8).astype(int)
    model = preference.fit_ranking(x, y)
    z = (preference.transformed(x) - model.mean) / model.scale
    winners, losers = preference.pairs_of(y, 8, 7)
    assert (y[winners] == 1).all() and (y[losers] == 0).all()
    difference = z[winners] - z[losers]
    # The gradient of the penalised logistic loss of the pairs is zero.
    assert np.abs(difference.T @ (1 / (1 + np.exp(difference @ model.weights))) - model.weights).max() < 1e-6
    strength = model.strength(x)
    assert (strength[y == 1][:, None] > strength[y == 0]).mean() > 0.95


def test_preference_threshold_is_a_quantile_of_all_labelled_rows(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    stats = preference.document_statistics(docs)
    for limit in (20_000, 40):  # the bound is on the fit only
        model = preference.ranking_of(stats, labels, F.lit(True), limit)
        rows = preference.labelled_rows(stats, labels, "quality", F.lit(True)).toPandas()
        strength = model.strength(rows[FEATURES].to_numpy())
        assert len(rows) > 40 and abs((strength < model.threshold).sum() - (rows._label == 0).sum()) <= (strength == np.median(strength)).sum() + 1


def test_preference_odd_inputs(spark, odd, empty, labels):
    scored = preference.quality_scores(odd, labels, fold("doc_id", 5) != 0)
    assert scored.columns == ["doc_id", "score", "predicted"]
    rows = scored.collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert preference.quality_scores(empty, labels, F.lit(True)).count() == 0
    none = preference.quality_scores(odd, labels.where("false"), F.lit(True)).collect()
    assert {(round(r.score, 9), r.predicted) for r in none} == {(0.3, 1)}
    assert boosted_rules.quality_rules(empty, labels).count() == 0
    assert preference.accepted(odd, labels).columns == odd.columns and preference.accepted(empty, labels).count() == 0


def test_empty_statistics():
    assert all(len(v) == 0 for v in statistics([]).values())
    assert all(v[0] == 0 for v in statistics([b""]).values())


# ------------------------------------------------------------------------------------------------ languages

def test_marginals_equal_enumeration(monkeypatch):
    monkeypatch.setattr(crf_language, "CHUNK", 3)
    rng = np.random.default_rng(0)
    tagger = crf_language.Tagger(["a", "b", "c"], np.zeros((2, 3)), rng.normal(size=(3, 3)))
    lengths = np.array([7, 0, 1, 3, 4, 0, 6])
    emissions = rng.normal(size=(lengths.sum(), 3))
    got, low = tagger.marginals(emissions, lengths), 0
    for n in lengths:
        own, want = emissions[low:low + n], np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)) if n else ():
            weight = np.exp(tagger.moves[:, path[0]]).sum() * np.exp(own[0, path[0]])
            for i in range(1, n):
                weight *= np.exp(tagger.moves[path[i - 1], path[i]] + own[i, path[i]])
            for i, k in enumerate(path):
                want[i, k] += weight
        assert np.allclose(got[low:low + n], want / want.sum(axis=1, keepdims=True))
        low += n


def test_languages_of_held_out_documents(spark, sf):
    got = queries.QUERIES["op9_crf_language"](spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95 and got.score.between(0, 1).all()


def test_code_switched_text_is_split_into_runs(spark, sf):
    docs = table(spark, sf, "documents").where("n_chars > 600")
    one, two = (docs.where(f"lang = '{x}'").orderBy("doc_id").first().text.split()[:60] for x in ("en", "fr"))
    mixed = spark.createDataFrame([(1, " ".join(one + two))], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    rows = crf_language.label_languages(docs.select("doc_id", "text", "lang").unionByName(mixed.withColumn("doc_id", F.lit(-1).cast("long"))), F.lit(True))
    runs = rows.where("doc_id = -1").first().runs
    assert [r.lang for r in runs] == ["en", "fr"] and abs(runs[0].words - 60) <= 3 and sum(r.words for r in runs) == 120


def test_languages_odd_inputs(spark, odd, empty):
    got = {r.doc_id: r for r in crf_language.label_languages(odd, F.lit(True)).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (40, 41, 42, 48)) and got[0].lang_pred == "en"
    marks = frame(spark, [(1, "\u00bd \u2461 \u2167 \u00b2"), (2, "\u0301 \u0308"), (3, "\u4e2d\u6587"), (4, "e\u0301te\u0301"), (5, "\u00bd a")])
    alone = {r.doc_id: r.lang_pred for r in crf_language.label_languages(marks.unionByName(frame(spark, [(9, PROSE[0], "fr")])), F.col("doc_id") == 9).collect()}
    assert alone == {1: "und", 2: "und", 3: "fr", 4: "fr", 5: "fr", 9: "fr"}
    assert crf_language.label_languages(empty, F.lit(True)).count() == 0
    assert {r.lang_pred for r in crf_language.label_languages(odd, F.lit(False)).collect()} == {"und"}


def test_language_sample_holds_rare_languages_and_no_copies(spark):
    rows = [(i, PROSE[0], "en") for i in range(300)] + [(400 + i, f"{PROSE[1]} {i}", "en") for i in range(60)] + [(500, PROSE[2], "xx"), (501, PROSE[3], "xx"), (502, PROSE[4], None)]
    got = crf_language.labelled_fragments(frame(spark, rows), F.lit(True), limit=10)
    # Two texts of the rare language and eight others, of four fragments each, copies of one text at most once.
    assert collections.Counter(lang for lang, _ in got) == {"xx": 8, "en": 32}
    copies = [words for lang, words in got if lang == "en" and words[-1] == PROSE[0].lower().encode().split()[-1]]
    assert len(copies) <= 1


# ------------------------------------------------------------------------------------------------ language model

def tokens(text):
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    return WORD.findall((text or "").encode().translate(lower)) + [b"\n"]


def held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def brute_force(rows):
    c = collections.Counter(t for d, x in rows if not held(d) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    return n, v, c


@pytest.mark.parametrize("which", ["table", "odd"])
def test_language_model_counts_and_probabilities(spark, sf, odd, which):
    docs = table(spark, sf, "documents") if which == "table" else odd
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    n, v, c = brute_force(rows)
    got = interpolated_lm.score_texts(docs, fold("doc_id", 7) == 2).collect()
    expected = sorted((str(d), held(d), len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(t)), 5))
                      for d, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == expected
    if which == "table":
        per = lambda k: sum(getattr(r, k) for r in got if r.held_out) / sum(r.n_tokens for r in got if r.held_out)
        assert per("base_score") < per("score") < 0


def test_language_model_by_brute_force(spark, sf, monkeypatch):
    """Bigram counts, mixtures and scores equal a direct computation with the learned weights; probabilities add up to one."""
    docs = table(spark, sf, "documents").where("doc_id < 60").select("doc_id", "text")
    learned = {}
    real = interpolated_lm.learn_mixtures
    monkeypatch.setattr(interpolated_lm, "learn_mixtures", lambda *a: learned.setdefault("m", real(*a)))
    got = {r.doc_id: r.score for r in interpolated_lm.score_texts(docs, fold("doc_id", 7) == 2).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    n, v, c = brute_force(rows)
    pairs, contexts = collections.Counter(), collections.Counter()
    for d, t in rows:
        if not held(d):
            for a, b in zip(["<s>", *tokens(t)], tokens(t)):
                pairs[a, b] += 1
                contexts[a] += 1

    def p(a, b):
        k = contexts[a]
        x, y, z = learned["m"][min(k.bit_length(), interpolated_lm.CONTEXTS - 1)]
        low = y * c[b] / n + z / (v + 1)
        return x * pairs[a, b] / k + low if k else low / (y + z)

    for d, t in rows:
        assert math.isclose(got[d], sum(math.log10(p(a, b)) for a, b in zip(["<s>", *tokens(t)], tokens(t))), rel_tol=1e-9)
    for a in ["<s>", b"the", b"never seen"]:
        assert math.isclose(sum(p(a, b) for b in c) + p(a, b"never seen"), 1, rel_tol=1e-9)


def test_mixtures_maximise_the_likelihood():
    cells = [(3, 100, 60, 50), (3, 0, 60, 30), (3, 0, 0, 5)]
    weights = interpolated_lm.learn_mixtures(cells, 1e-4, steps=500)[3]
    value = lambda w: sum(n * math.log(w @ [*interpolated_lm._value(np.array([a, b])), 1e-4]) for _, a, b, n in cells) + np.log(w).sum()
    rng = np.random.default_rng(0)
    assert weights.sum() == pytest.approx(1) and all(value(weights) >= value(w) - 1e-6 for w in rng.dirichlet(np.ones(3), 500))


def test_language_model_empty(empty, odd):
    assert interpolated_lm.score_texts(empty, F.lit(False)).count() == 0
    assert {r.score for r in interpolated_lm.score_texts(odd, F.lit(True)).collect()} == {0.0}
