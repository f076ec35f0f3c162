"""Secret scans: candidate strings, and a random forest that takes false findings out.

A candidate is a run of at least MIN_LENGTH characters without quotes, brackets and separators, with a digit, of a known key's form
or assigned to a secret's name; a word has as many as stand in it. The forest sees its length, its changes between kinds of characters, how much
of it is dictionary words, its path separators and its neighbouring words. All of it is SQL expressions and Spark ML.
"""

from __future__ import annotations

import json

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinrisk.llm.common import LOWER, UPPER, landed

MIN_LENGTH = 8
# Bounds of the fit: distinct labelled findings, taken by the order of a hash within each label; words of the dictionary and how often each must occur.
MAX_LABELLED, DICTIONARY_WORDS, MIN_COUNT = 20_000, 500, 5
SECRET_AT, MASK = 0.5, "[SECRET]"
TREES, DEPTH, SEED = 30, 6, 11
KEYWORD = "(?i)(token|secret|passw|pwd|api.?key|access.?key|auth|credential|private)"
FEATURES = ["length", "digits", "uppers", "lowers", "hex", "distinct", "transitions", "longest_run", "coverage", "slashes", "dots", "ats", "dashes",
            "keyword", "assigned", "after_words"]
KNOWN = "(?:AKIA|ASIA)[A-Z0-9]{16}"
# What a secret's name looks like, what may stand between a name and its value, and an assigned value. Repetitions are bounded or possessive,
# so that a long word takes time in proportion to its length.
_NAME = r"[A-Za-z0-9_.-]{0,40}?(?i:token|secret|passw|pwd|api.?key|access.?key|auth(?!ors?(?:[^a-z]|$))|credential|private)[A-Za-z0-9_.-]{0,40}"
_OPENING = r"[\"'`\\(\[]"
_TO_VALUE = rf"[\"'`\\]*+\]?[=:]++>?{_OPENING}*+"
_CLOSED = r"\s\"'`\\<>,;&(){}\[\]|#"
_VALUE = f"[^{_CLOSED}=:$][^{_CLOSED}]*+"
_ASSIGNED = f"{_NAME}{_TO_VALUE}{_VALUE}"
_PIECE = f"{KNOWN}|{_ASSIGNED}|(?:[A-Za-z][A-Za-z_.-]{{0,80}}+{_TO_VALUE})?[A-Za-z0-9+/_.@~%-][A-Za-z0-9+/=_.@:~%-]*+"
_NAMED = f"^({_NAME}|[A-Za-z][A-Za-z_.-]*+){_TO_VALUE}((?s:.+))$"
# Inside a run, a secret's name with a value or a known key begins a candidate of its own.
_BREAK = rf"(?<=[=:+/@~%(\[\"'`\\])(?={_NAME}{_TO_VALUE}[^{_CLOSED}]{{{MIN_LENGTH}}})|(?<=[+/@~%])(?={KNOWN}(?![A-Za-z0-9]))"
# The end of the two words before an assigned value.
_AWAITING = rf"{_NAME}[\"'`\\]*+\]? ?[=:]++>?{_OPENING}*+$"


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, position, word, name, value, before, after of every candidate.

    ``position`` is the number of the word that a candidate stands in, ``word`` the candidate with its name. ``name`` is what
    ``=`` or ``:`` assigns it to, also across quotes; ``before`` the two words before it, or the run before it in its word.
    Every word is looked at once, in its place in the array of the text's words, and the text itself is not carried along.
    """
    words = F.split(F.coalesce("text", F.lit("")), "[ \\t\\n\\x0B\\f\\r]+")

    def found(array: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            before = F.concat_ws(" ", F.get(array, i - 2), F.get(array, i - 1))
            awaited = F.coalesce(F.get(array, i - 1).rlike(f"[=:]>?{_OPENING}*+$") & before.rlike(_AWAITING), F.lit(False))
            parts = F.regexp_replace(w, _BREAK, " ")
            pieces = F.when(awaited, F.regexp_extract_all(parts, F.lit(f"^{_OPENING}*+{_VALUE}|{_PIECE}"), 0)).otherwise(
                F.regexp_extract_all(parts, F.lit(_PIECE), 0))
            assigned = w.rlike("[=:]") & w.rlike(_ASSIGNED)
            return F.when((F.length(w) >= MIN_LENGTH) & (w.rlike(f"[0-9]|{KNOWN}") | assigned | awaited),
                          F.struct(i.alias("position"), before.alias("before"), F.get(array, i + 1).alias("after"), awaited.alias("awaited"),
                                   pieces.alias("pieces")))
        return F.filter(F.transform(array, one), lambda x: x.isNotNull())

    def parted(c: Column) -> Column:
        def one(piece: Column, j: Column) -> Column:
            return F.struct(c["position"].alias("position"), piece.alias("word"),
                            F.when(j == 0, c["before"]).otherwise(F.get(c["pieces"], j - 1)).alias("before"),
                            F.coalesce(F.get(c["pieces"], j + 1), c["after"]).alias("after"), (c["awaited"] & (j == 0)).alias("awaited"))
        return F.filter(F.transform(c["pieces"], one), lambda x: F.length(x["word"]) >= MIN_LENGTH)

    parts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words.alias("_words"))
    rows = parts.select("doc_id", "text_hash", F.explode(found(F.col("_words"))).alias("c"))
    rows = rows.select("doc_id", "text_hash", F.explode(parted(F.col("c"))).alias("c")).select("doc_id", "text_hash", "c.*")
    core = F.regexp_replace(F.rtrim("word", F.lit(".:")), f"^{_OPENING}+", "")
    rows = rows.withColumn("core", core).withColumn("name", F.regexp_extract("core", _NAMED, 1))
    rows = rows.withColumn("value", F.when(F.col("name") != "", F.regexp_extract("core", _NAMED, 2)).otherwise(F.col("core")))
    wanted = F.col("value").rlike(f"[0-9]|{KNOWN}") | F.col("awaited") | F.col("name").rlike(f"^{_NAME}$")
    return (rows.where((F.length("value") >= MIN_LENGTH) & wanted)
            .select("doc_id", "text_hash", "position", "word", "name", "value", "before", "after"))


def dictionary(found: DataFrame, limit: int = DICTIONARY_WORDS) -> list[str]:
    """The most frequent runs of three or more letters in candidates and around them, over all of them."""
    text = F.lower(F.concat_ws(" ", "word", "before", "after"))
    return [r["w"] for r in
            found.select(F.explode(F.regexp_extract_all(text, F.lit("[a-z]{3,}"), 0)).alias("w")).groupBy("w").count()
            .where(F.col("count") >= MIN_COUNT).orderBy(F.desc("count"), "w").limit(limit).collect()]


def features(found: DataFrame, words: list[str]) -> DataFrame:
    """``found`` with FEATURES as doubles."""
    value, n = F.col("value"), F.length("value")
    count = lambda chars: n - F.length(F.translate(value, chars, ""))
    kinds = F.translate(F.translate(F.translate(value, LOWER, "a" * 26), UPPER, "A" * 26), "0123456789", "0" * 10)
    runs = F.length(F.regexp_replace(kinds, "(.)\\1*", "x"))
    letters = F.regexp_extract_all(F.lower(value), F.lit("[a-z]{3,}"), 0)
    known = F.from_json(F.lit(json.dumps(words)), "array<string>")
    covered = F.aggregate(F.filter(letters, lambda w: F.array_contains(known, w)), F.lit(0), lambda s, w: s + F.length(w))
    longest = F.array_max(F.transform(F.split(kinds, "(?<=(.))(?!\\1)"), F.length))
    near = F.concat_ws(" ", "before", "name")
    out = {
        "length": n, "digits": count("0123456789") / n, "uppers": count(UPPER) / n, "lowers": count(LOWER) / n,
        "hex": count("0123456789abcdef") / n, "distinct": F.size(F.array_distinct(F.split(value, ""))) / n, "transitions": (runs - 1) / n,
        "longest_run": F.coalesce(longest, F.lit(0)) / n, "coverage": covered / n, "slashes": count("/"), "dots": count("."), "ats": count("@"),
        "dashes": count("-_"), "keyword": near.rlike(KEYWORD).cast("int"),
        "assigned": ((F.col("name") != "") | F.col("before").rlike("[=:]$")).cast("int"), "after_words": F.coalesce(F.length("after"), F.lit(0)),
    }
    return found.withColumns({f"f_{c}": e.cast("double") for c, e in out.items()})


def label_rules() -> Column:
    """What is known about a candidate: 1 a finding, 0 a false one, NULL unknown.

    Findings: an access key of a known form, or letters and digits assigned to a secret's name. False ones: addresses,
    numbers, dates and versions, paths, and words with few digits that nothing assigns.
    """
    value, before = F.col("value"), F.col("before")
    mixed = value.rlike("[A-Za-z]") & value.rlike("[0-9]") & (F.length(value) >= 12) & ~value.rlike("[@/]")
    assigned = F.col("name").rlike(KEYWORD) | (before.rlike(KEYWORD) & before.rlike("[=:]$"))
    return (F.when(value.rlike(f"^{KNOWN}$"), 1)
            .when(assigned & mixed, 1)
            .when(value.rlike("^[^@]+@[^@]+\\.[a-z]+$"), 0)
            .when(value.rlike("^[0-9.,:/+_%=~-]+$"), 0)
            .when(value.rlike("^[a-z]+:?//|^/?([a-z0-9_-]+/)+") & ~assigned, 0)
            .when((F.length(F.regexp_replace(value, "[^0-9]", "")) * 5 <= F.length(value)) & ~assigned, 0))


def _sample(labelled: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` distinct labelled findings by the order of a hash: half of each label, or more of one if the other has fewer.

    Copies count once, however many there are.
    """
    key = ["name", "value", "before", "after"]
    distinct = labelled.where(F.col("label").isNotNull()).select(*key, F.col("label").cast("double").alias("label")).distinct()
    first = [distinct.where(F.col("label") == label).orderBy(F.xxhash64(*key), *key).limit(limit) for label in (0.0, 1.0)]
    both = landed(first[0].unionByName(first[1]), "labelled")
    counts = {r["label"]: r["count"] for r in both.groupBy("label").count().collect()}
    share = {label: max(limit // 2, limit - counts.get(1 - label, 0)) for label in (0.0, 1.0)}
    first = [both.where(F.col("label") == label).orderBy(F.xxhash64(*key), *key).limit(share[label]) for label in (0.0, 1.0)]
    return first[0].unionByName(first[1])


def find_secrets(docs: DataFrame, findings: DataFrame | None = None, limit: int = MAX_LABELLED) -> DataFrame:
    """All candidates of ``docs`` with the forest's score (0 to 1) and verdict ``secret``.

    ``findings``: labelled candidates (word, name, value, before, after, label 0 or 1); by default the corpus's own, labelled
    by ``label_rules``. What is learned depends on distinct findings, not on copies. Without findings of both labels there is
    no forest, and the verdict is that of the only label, or false. NULL and empty texts have no candidates; repeated rows have theirs each.
    """
    found = landed(candidates(docs), "candidates")
    words = dictionary(found)
    rows = features(found, words)
    labelled = found.withColumn("label", label_rules()) if findings is None else findings
    vector = VectorAssembler(inputCols=[f"f_{c}" for c in FEATURES], outputCol="features")
    names = [f"f_{c}" for c in FEATURES]
    chosen = _sample(labelled, limit)
    sample = landed(features(chosen, words).select(*names, "label"), "findings")
    seen = {r["label"] for r in sample.select("label").distinct().collect()}
    kept = ["doc_id", "text_hash", "position", "value"]
    if len(seen) < 2:
        score = F.lit(max(seen, default=0.0))
        return found.select(*kept, score.alias("score"), (score >= SECRET_AT).alias("secret"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label", featuresCol="features")
    model = forest.fit(vector.transform(sample))
    scored = model.transform(vector.transform(rows)).withColumn("score", vector_to_array("probability")[1])
    return scored.select(*kept, "score", (F.col("score") >= SECRET_AT).alias("secret"))


def masked(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mask`` and ``n_chars`` brought up to date; all other rows unchanged."""
    secrets = (find_secrets(docs).where("secret").groupBy(F.col("doc_id").alias("__secret_id"), F.col("text_hash").alias("__secret_hash"))
               .agg(F.collect_set("value").alias("__secret_values")))
    joined = docs.join(secrets, F.col("doc_id").eqNullSafe(F.col("__secret_id")) & (F.xxhash64("text") == F.col("__secret_hash")), "left")
    longest_first = F.transform(F.array_sort(F.transform("__secret_values", lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v")))), lambda s: s["v"])
    clean = F.aggregate(longest_first, F.col("text"), lambda text, v: F.replace(text, v, F.lit(mask)))
    text = F.when(F.col("__secret_values").isNull(), F.col("text")).otherwise(clean)
    out = {"text": text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("__secret_values").isNull(), F.col("n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    return joined.select(*[out[c].alias(c) if c in out else docs[c] for c in docs.columns])
