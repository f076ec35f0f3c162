"""Language-model scores by deleted interpolation of word bigrams, unigrams and a uniform distribution.

P(w | h) = a c(h w) / c(h) + b c(w) / N + c / (V + 1), with the mixture (a, b, c) chosen by how often the context h occurs.
The mixtures are learned by expectation-maximisation on deleted counts: every training token is predicted from the counts of
all other training tokens.

Counting moves no text and no token twice. Documents are taken in chunks; each chunk sends its distinct words and bigrams,
with its own counts, to hash buckets; a bucket adds them up over all chunks and returns, in the order it got them, the totals
to each chunk. There they meet the chunk's texts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinrisk.llm.common import Joined, landed, mapped, mixed, pair_hash, small_batches, text_bytes

# Text of a chunk, and distinct words and bigrams of a bucket over all chunks: what a task holds.
CHUNK_BYTES, BUCKET_BYTES = 4 << 20, 16 << 20
ROWS_AT_ONCE = 1000
START, END = mixed(np.array([11, 13], np.uint64))
# Cells of the histogram that EM runs on: context frequencies by powers of two, probabilities ten to a decade.
CONTEXTS, CELLS, DECADES = 40, 121, 12


class Chunk:
    """The tokens of some texts: ``words`` and ``grams`` are distinct and sorted by bucket, ``word`` and ``gram`` point there."""

    def __init__(self, texts: list[bytes], buckets: int):
        joined = Joined([t.lower() for t in texts])
        self.n_texts, n = len(texts), len(joined.hashes) + len(texts)
        self.text = np.repeat(np.arange(len(texts)), joined.words_per_text() + 1)
        tokens = np.full(n, END, np.uint64)
        tokens[np.arange(len(joined.hashes)) + joined.text] = joined.hashes
        before = np.concatenate([[START], tokens[:-1]]).astype(np.uint64)
        before[before == END] = START  # a text begins after the end of another
        self.words, self.word = np.unique(tokens, return_inverse=True)
        h = pair_hash(before, tokens)
        # A bigram is told from others of its bucket by 32 bits. Two of a bucket's few million merge with a chance of about
        # 1 in 1000, which shifts a count; words are told apart by 64 bits.
        self.grams, self.gram = np.unique((_bucket(h, buckets) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)), return_inverse=True)
        self.first = before == START
        self.previous = np.concatenate([[0], self.word[:-1]])
        self.buckets = buckets

    def parts(self, counted: np.ndarray):
        """(bucket, kind, keys, counts) of the distinct words (kind 0) and bigrams (kind 1); ``counted`` marks tokens."""
        for kind, keys, at in ((0, self.words, self.word), (1, self.grams, self.gram)):
            counts = np.bincount(at, counted, len(keys)).astype(np.uint32)
            bucket = _bucket(keys, self.buckets) if kind == 0 else keys >> np.uint64(32)
            borders = np.flatnonzero(np.diff(bucket, prepend=np.uint64(self.buckets)) != 0)
            for low, high in zip(borders, [*borders[1:], len(keys)]):
                packed = keys[low:high] if kind == 0 else keys[low:high].astype(np.uint32)
                yield int(bucket[low]), kind, planes(np.diff(packed, prepend=packed.dtype.type(0))), counts[low:high].tobytes()


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def planes(x: np.ndarray) -> bytes:
    """First all first bytes, then all second ones, and so on: sorted keys' differences then compress well."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def narrow(counts: np.ndarray) -> bytes:
    """Counts as planes of as many bytes as the largest needs, after one byte that says how many."""
    width = max(1, (int(counts.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + counts.astype("<u8").view(np.uint8).reshape(len(counts), 8)[:, :width].T.tobytes()


def widened(data: bytes) -> np.ndarray:
    width = data[0]
    out = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1).T
    return out.view("<u8").ravel()


def unplanes(data: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def _chunked(docs: DataFrame, schema: str, emit) -> DataFrame:
    """``emit(chunk name, keys, trained, texts)`` for each chunk of each partition of doc_id, text, trained.

    The name holds the partition, the place in it and a checksum of the texts, so that two passes agree or can tell.
    """
    def run(batches):
        part, seq, held = TaskContext.get().partitionId(), 0, ([], [], [])
        size = 0
        for batch in (b.slice(low, ROWS_AT_ONCE) for b in batches for low in range(0, b.num_rows, ROWS_AT_ONCE)):
            for key, text, trained in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist()):
                for column, value in zip(held, (key, trained, text)):
                    column.append(value)
                size += len(text) + 1
                if size >= CHUNK_BYTES:
                    yield from emit(_name(part, seq, held[2]), *held)
                    seq, size, held = seq + 1, 0, ([], [], [])
        if held[0]:
            yield from emit(_name(part, seq, held[2]), *held)

    return small_batches(docs).mapInArrow(run, schema)


def _name(part: int, seq: int, texts: list[bytes]) -> str:
    crc = 0
    for t in texts:
        crc = zlib.crc32(t, crc)
    return f"{part}-{seq}-{crc}-{len(texts)}"


def count_parts(docs: DataFrame, buckets: int) -> DataFrame:
    def emit(name, keys, trained, texts):
        chunk = Chunk(texts, buckets)
        rows = list(chunk.parts(np.array(trained)[chunk.text].astype(float)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(rows)), *[pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))]],
            ["chunk", "bucket", "kind", "keys", "counts"])

    return _chunked(docs, "chunk string, bucket long, kind int, keys binary, counts binary", emit)


def add_up(group: pa.Table) -> pa.Table:
    """Totals of one bucket and kind, given back to every chunk; a row without chunk has the distinct and all counted ones."""
    kind = group.column("kind")[0].as_py()
    dtype = np.uint64 if kind == 0 else np.uint32
    keys = [np.cumsum(unplanes(k, dtype), dtype=dtype) for k in group.column("keys").to_pylist()]
    counts = np.concatenate([np.frombuffer(c, np.uint32) for c in group.column("counts").to_pylist()])
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, counts, len(distinct)).astype(np.uint64)
    ends = np.cumsum([len(k) for k in keys])
    out = [narrow(total[at[e - len(k):e]]) for k, e in zip(keys, ends)]
    n = len(out) + 1
    return pa.table({
        "chunk": pa.array([*group.column("chunk").to_pylist(), None], pa.string()), "kind": pa.array([kind] * n, pa.int32()),
        "bucket": pa.array([group.column("bucket")[0].as_py()] * n, pa.int64()), "totals": pa.array([*out, None], pa.binary()),
        "n_distinct": pa.array([0] * (n - 1) + [int((total > 0).sum())], pa.int64()),
        "n_all": pa.array([0] * (n - 1) + [int(total.sum())], pa.int64())})


def learn_mixtures(cells: list[tuple[int, int, int, int]], uniform: float, steps: int = 60) -> np.ndarray:
    """Weights of bigram, unigram and uniform for each context frequency, from (context, bigram cell, unigram cell, count).

    Each component starts with one pseudo-count, so none is ever zero.
    """
    out = np.full((CONTEXTS, 3), 1 / 3)
    rows = np.array(cells, np.int64).reshape(-1, 4)
    for context in range(CONTEXTS):
        own = rows[rows[:, 0] == context]
        p = np.column_stack([_value(own[:, 1]), _value(own[:, 2]), np.full(len(own), uniform)])
        weight = out[context].copy()
        for _ in range(steps if len(own) else 0):
            share = p * weight
            share *= (own[:, 3] / np.maximum(share.sum(axis=1), 1e-300))[:, None]
            weight = (share.sum(axis=0) + 1) / (own[:, 3].sum() + 3)
        out[context] = weight
    return out


def _cell(p: np.ndarray) -> np.ndarray:
    """0 for zero, else ten cells to a decade."""
    return np.where(p > 0, CELLS - 1 + np.rint(10 * np.log10(np.maximum(p, 10.0**-DECADES))), 0).astype(np.int64).clip(0, CELLS - 1)


def _value(cell: np.ndarray) -> np.ndarray:
    return np.where(cell > 0, 10.0 ** ((cell - (CELLS - 1)) / 10), 0.0)


def _context(n: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2(n))."""
    return np.frexp(n)[1].clip(0, CONTEXTS - 1)


STREAM = "doc_id {}, trained boolean, n_tokens long, n_known long, base double, n_gram binary, n_word binary, n_context binary"


def score_texts(docs: DataFrame, held_out, key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities).

    Learns from rows for which ``held_out`` (an expression over doc_id) is false. Tokens are the words of the text, A-Z
    lower-cased, and one end; a NULL text has only the end. base_score is the add-one unigram score. Unknown words share one
    slot of the uniform part. Repeated rows are scored, and counted, one by one. Without training rows every score is 0.
    ``docs`` is read twice and has to give the same partitions each time, as a table does; otherwise an error is raised.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), "text", (~held_out).alias("trained"))
    size, n_train = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if("trained")).first()
    buckets = max(16, 2 * int(size) // BUCKET_BYTES)
    totals = landed(
        count_parts(rows, buckets).groupBy("bucket", "kind").applyInArrow(
            add_up, "chunk string, kind int, bucket long, totals binary, n_distinct long, n_all long"), "totals")
    v, n = totals.where("kind = 0 AND chunk IS NULL").agg(F.coalesce(F.sum("n_distinct"), F.lit(0)), F.coalesce(F.sum("n_all"), F.lit(0))).first()
    returned = totals.where("chunk IS NOT NULL").select("chunk", "kind", "bucket", "totals")

    def texts_of(name, keys, trained, texts):
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(keys)), pa.array(keys, key_type), pa.array(trained), pa.array(texts, pa.binary())],
            ["chunk", "doc_id", "trained", "text"])

    key_type = _arrow(docs.schema[key].dataType)
    sent = _chunked(rows, f"chunk string, doc_id {kind}, trained boolean, text binary", texts_of)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows or not left.num_rows:
            raise RuntimeError("the documents were not read in the same partitions twice")
        chunk = Chunk(left.column("text").to_pylist(), buckets)
        order = right.sort_by([("kind", "ascending"), ("bucket", "ascending")])
        total = [np.concatenate([widened(t) for t, k in zip(order.column("totals").to_pylist(), order.column("kind").to_pylist()) if k == want])
                 for want in (0, 1)]
        if len(total[0]) != len(chunk.words) or len(total[1]) != len(chunk.grams):
            raise RuntimeError("a chunk's counts do not fit its words")
        n_word, n_gram = total[0][chunk.word], total[1][chunk.gram]
        n_context = np.where(chunk.first, np.uint64(n_train), total[0][chunk.previous])
        base = np.log10((n_word + 1.0) / (n + v + 1.0))
        per = lambda weights: np.bincount(chunk.text, weights, chunk.n_texts)
        ends = np.cumsum(np.bincount(chunk.text, minlength=chunk.n_texts))[:-1]
        cut = lambda x: [narrow(p) for p in np.split(x.astype(np.uint64), ends)]
        return pa.table({
            "doc_id": left.column("doc_id"), "trained": left.column("trained"),
            "n_tokens": pa.array(per(None).astype(np.int64)), "n_known": pa.array(per((n_word > 0).astype(float)).astype(np.int64)),
            "base": pa.array(per(base)), "n_gram": pa.array(cut(n_gram), pa.binary()), "n_word": pa.array(cut(n_word), pa.binary()),
            "n_context": pa.array(cut(n_context), pa.binary())})

    counted = landed(sent.groupBy("chunk").cogroup(returned.groupBy("chunk")).applyInArrow(meet, STREAM.format(kind)), "counted")

    def cells(batch: pa.RecordBatch):
        for low in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield from some_cells(batch.slice(low, ROWS_AT_ONCE))

    def some_cells(batch: pa.RecordBatch):
        gram, word, context = (np.concatenate([widened(x) for x in batch.column(c).to_pylist()] or [np.empty(0, np.uint64)]).astype(float)
                               for c in ("n_gram", "n_word", "n_context"))
        # Each token is left out of the counts that predict it.
        rest = context - 1
        key = (_context(rest) * CELLS + _cell((gram - 1) / np.maximum(rest, 1))) * CELLS + _cell((word - 1) / max(n - 1, 1))
        found, count = np.unique(key, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(count)], ["cell", "n"])

    streams = ["n_gram", "n_word", "n_context"]
    found = mapped(counted.where("trained").select(*streams), "cell long, n long", cells).groupBy("cell").agg(F.sum("n").alias("n")).collect()
    mixtures = learn_mixtures([(r["cell"] // CELLS**2, r["cell"] // CELLS % CELLS, r["cell"] % CELLS, r["n"]) for r in found], 1 / (v + 1))

    def scored(batch: pa.RecordBatch):
        for low in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield some_scored(batch.slice(low, ROWS_AT_ONCE))

    def some_scored(batch: pa.RecordBatch):
        score = []
        for texts in zip(*(batch.column(c).to_pylist() for c in streams)):
            gram, word, context = (widened(x).astype(float) for x in texts)
            a, b, c = mixtures[_context(context)].T
            p = a * gram / np.maximum(context, 1) + b * word / max(n, 1) + c / (v + 1)
            # A context never seen has no bigram part: what that would get is shared by the others.
            p = np.where(context > 0, p, (b * word / max(n, 1) + c / (v + 1)) / (b + c)) if n else np.ones(len(p))
            score.append(float(np.log10(p).sum()))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "trained", "n_tokens", "n_known", "base")), pa.array(score, pa.float64())],
                                         ["doc_id", "trained", "n_tokens", "n_known", "base", "score"])

    out = mapped(counted, f"doc_id {kind}, trained boolean, n_tokens long, n_known long, base double, score double", scored)
    return out.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"),
                      F.col("base").alias("base_score"), "score")


def _arrow(kind: T.DataType) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]
