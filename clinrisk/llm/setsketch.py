"""Near-duplicates by SetSketch registers: banded, estimated jointly by likelihood, confirmed on full shingle sets.

1. Every document becomes its set of shingle hashes; equal sets are one class, whatever their number.
2. A class has a SetSketch: per register, the smallest of an exponential variate over its shingles, kept as a truncated
   logarithm. Sketches of unions are register-wise maxima. Bands of registers put similar classes into common buckets.
3. In each bucket all members are compared with one centre only, the member that meets most others. Pairs whose sketches make
   the wanted similarity plausible are confirmed on the full sets.
4. What the stars leave open: buckets whose members are still in different components. Their pairs across components are
   compared inside tasks, in blocks, and only links that join two components are given out. So no pair of a bucket goes
   unexamined and no row stands for a pair; but a member of an open bucket of n goes to n / 256 tasks, n * n / 256 rows in all.
"""

from __future__ import annotations

import math
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinrisk.llm.blocks import confirmed, exact_work, in_blocks, pairs
from clinrisk.llm.common import Joined, landed, mapped, mixed, pair_hash, slices, text_bytes
from clinrisk.llm.components import components_of, connected

# 20 bands of 5: a pair of similarity 0.85 shares no band with a chance of 1e-5, one of 0.9 of 1e-8, one of 0.8 of 4e-4. Bands of
# fewer registers would take that down, but their keys are so few that unlike sets meet ever more often as a corpus grows.
REGISTERS, ROWS, BASE, RATE, TOP, SLACK = 100, 5, 1.2, 20.0, 255, 0.17
_XOR, _ODD = (mixed(np.arange(s, s + REGISTERS, dtype=np.uint64)).astype(np.uint32) for s in (1001, 2001))
_ODD |= np.uint32(1)


def shingle_sets(texts: list[bytes], size: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the texts, one after another, and how many each has.

    A-Z is lower-cased. A text with fewer words than a shingle has its whole sequence as one shingle; one without words none.
    """
    j = Joined([t.lower() for t in texts])
    n = j.words_per_text()
    first = np.cumsum(n) - n
    keys, owners = [], []
    for length in range(1, size + 1):
        # Shingles of this many words: all of texts with enough words, or the one of a shorter text.
        fits = (n >= size) if length == size else (n == length)
        counts = np.where(fits, n - length + 1, 0)
        owner = np.repeat(np.arange(len(n)), counts)
        at = first[owner] + np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]
        key = mixed(j.hashes[at] + np.uint64(length))
        for i in range(1, length):
            key = pair_hash(key, j.hashes[at + i])
        keys.append(key)
        owners.append(owner)
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(key, kind="stable")
    order = order[np.argsort(owner[order].astype(np.uint16) if len(n) < 1 << 16 else owner[order], kind="stable")]
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return key[new], np.bincount(owner[new], minlength=len(n))


def sketches(keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Registers (texts x REGISTERS, bytes) of non-empty sets that stand one after another."""
    starts = np.cumsum(sizes) - sizes
    short = (keys >> np.uint64(32)).astype(np.uint32) ^ keys.astype(np.uint32)
    out = np.empty((len(sizes), REGISTERS), np.uint8)
    buffer = np.empty_like(short)
    for i in range(REGISTERS):
        np.bitwise_xor(short, _XOR[i], out=buffer)
        np.multiply(buffer, _ODD[i], out=buffer)
        smallest = np.minimum.reduceat(buffer, starts)
        variate = -np.log1p(-(smallest + 0.5) / 2.0**32) / RATE
        out[:, i] = np.clip(np.floor(1 - np.log(variate) / math.log(BASE)), 0, TOP)
    return out


def estimate(higher: np.ndarray, lower: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, steps: int = 25) -> np.ndarray:
    """The similarity of largest likelihood, given how many registers of a are higher and lower than those of b.

    With u and v the shares of the set sizes in their sum, P(higher) = p(u - v J), P(lower) = p(v - u J) and
    p(x) = -log_base(1 - x (base - 1) / base); the likelihood is concave in J.
    """
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)

    def loss(j):
        p = [-np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / math.log(BASE) for x in (u - v * j, v - u * j)]
        equal = np.maximum(1 - p[0] - p[1], 1e-12)
        return -(higher * np.log(np.maximum(p[0], 1e-12)) + lower * np.log(np.maximum(p[1], 1e-12)) + (REGISTERS - higher - lower) * np.log(equal))

    for _ in range(steps):
        a, b = low + (high - low) * 0.382, low + (high - low) * 0.618
        better = loss(a) < loss(b)
        low, high = np.where(better, low, a), np.where(better, b, high)
    return (low + high) / 2


def plausible(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int, piece: int = 100_000) -> np.ndarray:
    """Which pairs of register rows may have the wanted similarity: sizes allow it, and the estimate is less than SLACK below."""
    out = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    wanted = percent / 100 - SLACK
    for low in range(0, len(out), piece):
        at = low + np.flatnonzero(out[low:low + piece])
        x, y = a[at], b[at]
        higher, lower = (x > y).sum(axis=1), (x < y).sum(axis=1)
        # Equal registers are about as many as the similarity; far fewer need no estimate.
        near = REGISTERS - higher - lower >= REGISTERS * (wanted - 0.1)
        out[at] = near
        at = at[near]
        out[at] = estimate(higher[near], lower[near], n_a[at].astype(float), n_b[at].astype(float)) >= wanted
    return out


def registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, REGISTERS)


def sketched(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, text_hash, n_shingles, a 128-bit fingerprint of the set (high, low) and the registers (NULL for an empty set)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batch: pa.RecordBatch):
        texts = text_bytes(batch.column(1))
        for low, high in slices(texts):
            keys, sizes = shingle_sets(texts[low:high], size)
            some = sizes > 0
            a, b, r = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64), [None] * len(sizes)
            if some.any():
                starts = (np.cumsum(sizes) - sizes)[some]
                a[some] = np.add.reduceat(mixed(keys), starts)
                b[some] = np.bitwise_xor.reduceat(mixed(keys + np.uint64(77)), starts)
                for i, row in zip(np.flatnonzero(some), sketches(keys, sizes[some])):
                    r[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(low, high - low) for c in (0, 2)), pa.array(sizes.astype(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(r, pa.binary())],
                ["doc_id", "text_hash", "n_shingles", "high", "low", "registers"])

    return mapped(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), f"doc_id {kind}, text_hash long, n_shingles long, high long, low long, registers binary", each)


def node_id() -> Column:
    return F.xxhash64("n_shingles", "high", "low")


def sets_of(docs: DataFrame, ids: DataFrame, size: int = 3) -> DataFrame:
    """node and its packed shingle set, of every text with one of the ``ids`` (id), which are those of classes."""
    # The ids are what is hashed, so texts are never sorted; without the hint the plan changes with Spark's guess at their number.
    chosen = docs.select("doc_id", "text").join(ids.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("id"))).select("doc_id", "text")

    def each(batch: pa.RecordBatch):
        texts = text_bytes(batch.column(1))
        for low, high in slices(texts):
            keys, sizes = shingle_sets(texts[low:high], size)
            ends = np.cumsum(sizes)
            some = np.flatnonzero(sizes)
            if len(some):
                starts = (ends - sizes)[some]
                a, b = np.add.reduceat(mixed(keys), starts), np.bitwise_xor.reduceat(mixed(keys + np.uint64(77)), starts)
                packed = [keys[s:e].tobytes() for s, e in zip(starts, ends[some])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sizes[some].astype(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(packed, pa.binary())],
                    ["n_shingles", "high", "low", "set"])

    found = mapped(chosen, "n_shingles long, high long, low long, set binary", each)
    return found.select(node_id().alias("node"), "set")


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and text_hash (xxhash64) of every row of ``docs``.

    Documents are linked where 100 * intersection >= ``percent`` * union of their sets of ``size``-word shingles; component_id
    is the smallest doc_id reachable and kept says that it is the row's own. A text without words (or NULL) is linked with
    nothing. Repeated rows are equal documents and share the outcome; a NULL doc_id is never the smallest of a component
    that has another.
    """
    rows = landed(sketched(docs, size), "sketches")
    classes = landed(
        rows.where("n_shingles > 0").groupBy("n_shingles", "high", "low")
        .agg(F.min("doc_id").alias("id"), F.first("registers").alias("registers"), F.count("*").alias("copies"))
        .withColumn("node", node_id()), "classes")
    out = components_of(rows.drop("registers"), classes, *_links(docs, classes, percent, size))
    return out.select("doc_id", "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"), "text_hash")


def _links(docs: DataFrame, classes: DataFrame, percent: int, size: int) -> tuple[DataFrame, DataFrame]:
    """Labels (node, label) of the classes that the stars tie, and links (a, b) between labels that join up every component."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // ROWS - 1)),
                        lambda i: F.xxhash64(i, F.substring("registers", i * ROWS + 1, F.lit(ROWS))))
    banded = classes.select("node", F.explode(bands).alias("key"))
    sizes = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    banded = landed(banded.join(sizes, "key"), "buckets")
    met = banded.groupBy("node").agg(F.sum("size").alias("met"))
    centres = banded.join(met, "node").groupBy("key").agg(F.max(F.struct("met", "node"))["node"].alias("centre"))
    centred = landed(banded.join(centres, "key"), "centred")
    # A node has as many rows as bands at most, so dealing by it is even; neither distinct() nor the join with a's registers deals again.
    star = centred.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).repartition("a").distinct()
    brief = classes.select("node", "id", "n_shingles", "registers")
    likely = landed(_likely(star, brief, percent), "likely")
    ids = likely.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    sets = landed(sets_of(docs, ids, size).dropDuplicates(["node"]), "sets")
    stars = landed(confirmed(likely, sets, percent), "links")
    # Buckets that still hold several components, without the centre's pairs, which are settled.
    labels = landed(connected(stars), "labels")
    labelled = centred.where("size > 2").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("key")
    rest = labelled.join(open_keys, "key").select("key", "node", "label", "size", (F.col("node") == F.col("centre")).alias("central"))
    kind = classes.schema["id"].dataType.simpleString()
    near = landed(in_blocks(rest.join(brief, "node"), _near(percent), f"key long, node long, label long, size long, id {kind}"), "open").distinct()
    sets = landed(sets_of(docs, near.select("id").distinct(), size).dropDuplicates(["node"]), "sets")
    more = in_blocks(near.join(sets, "node"), exact_work(percent), "a long, b long", alone=False)
    return labels, landed(more, "links")


def _likely(pairs: DataFrame, brief: DataFrame, percent: int) -> DataFrame:
    sides = [brief.select(*(F.col(c).alias(f"{f}{s}") for c, f in (("node", ""), ("id", "id_"), ("n_shingles", "n_"), ("registers", "r_")))) for s in "ab"]
    joined = pairs.join(sides[0], "a").join(sides[1], "b").where(
        F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b")).select("a", "b", "n_a", "n_b", "r_a", "r_b", "id_a", "id_b")

    def each(batch: pa.RecordBatch):
        keep = plausible(registers(batch.column(4)), registers(batch.column(5)), batch.column(2).to_numpy(), batch.column(3).to_numpy(), percent)
        yield batch.select(["a", "b", "id_a", "id_b"]).filter(pa.array(keep))

    kind = brief.schema["id"].dataType.simpleString()
    return mapped(joined, f"a long, b long, id_a {kind}, id_b {kind}", each)


def _near(percent: int):
    def work(table: pa.Table):
        r, n = registers(table.column("registers")), table.column("n_shingles").to_numpy()
        hit = np.zeros(table.num_rows, bool)
        for a, b in pairs(table):
            found = plausible(r[a], r[b], n[a], n[b], percent)
            hit[a[found]] = hit[b[found]] = True
        yield from table.select(["key", "node", "label", "size", "id"]).filter(pa.array(hit)).to_batches()
    return work


def one_of_each(docs: DataFrame, percent: int = 85, size: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns, that near_duplicates keeps; of rows with one doc_id and one text, any one.

    Rows with NULL text are no copies of each other and stay.
    """
    text_hash = F.xxhash64("text")
    groups = near_duplicates(docs, percent, size)
    dropped = groups.where("NOT kept").select(F.col("doc_id").alias("__dup_id"), F.col("text_hash").alias("__dup_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__dup_id")) & (text_hash == F.col("__dup_hash"))
    kept = docs.join(dropped, same, "left_anti")
    repeated = (groups.where("kept AND n_shingles > 0").groupBy(F.col("doc_id").alias("__dup_id"), F.col("text_hash").alias("__dup_hash"))
                .count().where("count > 1").select("__dup_id", "__dup_hash"))
    once = kept.join(repeated, same, "left_anti")
    first = kept.join(repeated, same, "left_semi").withColumn("__dup_hash", text_hash).dropDuplicates(["doc_id", "__dup_hash"])
    return once.unionByName(first.drop("__dup_hash"))
