"""Packing token sequences by non-negative least squares over a histogram of piece lengths.

Documents are cut into whole windows and a rest. Lengths are counted in bins; every combination of up to three bins that
fills a window is a strategy, and how often each is repeated is the non-negative least-squares fit of their bin counts to the
histogram, rounded down. What is left is packed greedily, again as repeated patterns. Only the histogram and the plan are on
the driver; pieces are ranked within their bin and look their place up in the plan.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clinrisk.llm.common import landed, mapped, slices

WINDOW, BIN, END_ID = 1024, 4, 0
# Cached ids by word: about a hundred bytes each. Ranks are taken in groups of about so many pieces.
CACHED_WORDS, PIECES_PER_GROUP = 600_000, 200_000
SPECIAL = "<|endoftext|>"


def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write bytes: visible Latin-1 characters as they are, the others from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordEncoder:
    """Token ids of whole texts as little-endian 32-bit integers, equal to ``Tokenizer.encode`` of the text.

    The vocabulary's splitting pattern never joins characters before and after a single space, so a text falls into pieces
    that are encoded once and cached. Pieces of Latin-1 characters are split by the pattern and their parts are handed to the
    tokenizer's model, other pieces to the tokenizer. Texts in which white space meets white space there, or that hold the
    special token, are encoded as a whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.pattern, self.letters = regex.compile(public_tokenizers.PATTERN), byte_letters()
        self.model = self.tokenizer.model
        # By word, the ids of a space and the word (empty: encode the text as a whole); by other parts of the pattern, theirs.
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _model(self, part: str) -> bytes:
        written = part.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(written)]).tobytes()

    def _part(self, part: str) -> bytes:
        word = part[1:]
        known, key = (self.words, word) if part[0] == " " and word.isalpha() else (self.parts, part)
        if (ids := known.get(key)) is None:
            ids = known[key] = self._model(part)
        return ids

    def _add(self, new: set[str]) -> None:
        for w in new:
            if not w or w[0].isspace() or w[-1].isspace() or SPECIAL in w:
                self.words[w] = b""
            elif not (w.isascii() or max(w) <= "\xff"):
                self.words[w] = self._ids(" " + w)
            elif w.isalpha():
                self._part(" " + w)
            else:
                self.words[w] = b"".join([self._part(x) for x in self.pattern.findall(" " + w)])

    def encode(self, texts: list[str], group: int = 1 << 22) -> Iterator[bytes]:
        """The ids of each text, in order; about ``group`` characters are split at a time."""
        for low, high in slices(texts, group):
            if len(self.words) + len(self.parts) > CACHED_WORDS:
                self.words.clear()
                self.parts.clear()
            split = [text.split(" ") for text in texts[low:high]]
            self._add(set(chain.from_iterable(split)).difference(self.words))
            for text, (first, *rest) in zip(texts[low:high], split):
                found = list(map(self.words.__getitem__, rest))
                if b"" in found or first[-1:].isspace():
                    yield self._ids(text)
                else:
                    yield (self._ids(first) if first else b"") + b"".join(found)

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@cache
def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process; its cache outlives a task."""
    return WordEncoder(path)


def cut_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens of the pieces of every row: whole windows, then the rest.

    A document's ids are those of its text (NULL: empty) and one end id; so every row has at least one piece.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([END_ID], "<u4").tobytes()

    def each(batch: pa.RecordBatch):
        texts = [x or "" for x in batch.column(1).to_pylist()]
        row, start, length, crc, total = [], [], [], [], []
        for i, ids in enumerate(encoder(tokenizer).encode(texts)):
            ids = memoryview(ids + end)
            n = len(ids) // 4
            for low in range(0, n, window):
                high = min(low + window, n)
                row.append(i)
                start.append(low)
                length.append(high - low)
                crc.append(zlib.crc32(ids[4 * low:4 * high]))
                total.append(n)
        columns = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *columns],
                                         ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return mapped(docs.select("doc_id", "text"), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long", each)


def strategies(units: int) -> list[tuple[int, ...]]:
    """All ways to write ``units`` as up to three positive sizes, largest first."""
    pairs = [(units - b, b) for b in range(1, units // 2 + 1)]
    triples = [(units - b - c, b, c) for c in range(1, units // 3 + 1) for b in range(c, (units - c) // 2 + 1)]
    return [(units,), *pairs, *triples]


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-7) -> np.ndarray:
    """argmin |a x - b| over x >= 0 by active sets: at most as many entries as rows are positive."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    moment = a.T @ b
    scale = max(float(np.abs(moment).max(initial=0)), 1e-300)
    for _ in range(3 * len(b)):
        gradient = np.where(active, -np.inf, a.T @ (b - a @ x))
        new = int(gradient.argmax())
        if gradient[new] <= tolerance * scale:
            break
        active[new] = True
        while active.any():
            at = np.flatnonzero(active)
            s = np.linalg.solve(a[:, at].T @ a[:, at] + 1e-10 * np.eye(len(at)), moment[at])
            if (s > 0).all():
                x[at] = s
                break
            bad = s <= 0
            step = np.min(x[at][bad] / np.maximum(x[at][bad] - s[bad], 1e-300))
            x[at] += step * (s - x[at])
            active[at[bad & (x[at] <= 1e-12)]] = False
            x[~active] = 0
    return x


def make_plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(sizes of a sequence's pieces, repeats) so that every counted piece has one place; ``counts[i]`` pieces have size i."""
    units, left = len(counts) - 1, counts.astype(np.int64).copy()
    plan = []
    if total := int(left.sum()):
        ways = strategies(units)
        a = np.zeros((units, len(ways)))
        for j, way in enumerate(ways):
            for s in way:
                a[s - 1, j] += 1
        x = np.floor(nnls(a, left[1:] / total) * total + 1e-6).astype(np.int64)
        for j in np.argsort(-x, kind="stable"):
            need = Counter(ways[j])
            repeats = min(int(x[j]), *(int(left[s]) // m for s, m in need.items()))
            if repeats > 0:
                plan.append((ways[j], repeats))
                for s, m in need.items():
                    left[s] -= m * repeats
    while left.any():
        room, need, top = units, Counter(), units
        while room and (fit := np.flatnonzero(left[1:min(room, top) + 1])).size:
            size = int(fit[-1]) + 1
            take = min(room // size, int(left[size]))
            need[size] += take
            room -= take * size
            top = size - 1
        repeats = min(int(left[s]) // m for s, m in need.items())
        plan.append((tuple(s for s, m in need.items() for _ in range(m)), repeats))
        for s, m in need.items():
            left[s] -= m * repeats
    return plan


class Places:
    """Where the k-th piece of a size goes: the plan as sorted arrays, looked up for many pieces at once."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]], units: int):
        self.rows: dict[int, list[tuple[int, int, int, int]]] = {s: [] for s in range(1, units + 1)}
        taken, sequence = Counter(), 0
        for sizes, repeats in plan:
            slot = 0
            for s, m in Counter(sizes).items():
                self.rows[s].append((taken[s], sequence, slot, m))
                taken[s] += m * repeats
                slot += m
            sequence += repeats
        self.table = {s: np.array(r, np.int64).T for s, r in self.rows.items() if r}

    def find(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, slot = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for s in np.unique(size):
            at = np.flatnonzero(size == s)
            first, base, slot0, many = self.table[int(s)]
            i = np.searchsorted(first, rank[at], "right") - 1
            k = rank[at] - first[i]
            sequence[at], slot[at] = base[i] + k // many[i], slot0[i] + k % many[i]
        return sequence, slot


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, bin_width: int = BIN) -> DataFrame:
    """Every document's pieces with the sequence and offset at which they stand; a sequence holds at most ``window`` ids.

    Rows with a NULL doc_id, and repeated rows, are documents of their own. An empty table has no pieces.
    """
    pieces = landed(cut_documents(docs, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), window), "pieces")
    sized = pieces.withColumn("size", F.ceil(F.col("length") / bin_width).cast("int"))
    histogram = sized.groupBy("size").count().collect()
    counts = np.zeros(-(-window // bin_width) + 1, np.int64)
    for row in histogram:
        counts[row["size"]] = row["count"]
    places = Places(make_plan(counts), len(counts) - 1)
    groups = max(16, int(counts.sum()) // PIECES_PER_GROUP)
    sized = sized.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)).cast("int"))
    before = (sized.groupBy("size", "group").count()
              .withColumn("before", F.sum("count").over(
                  Window.partitionBy("size").orderBy("group").rowsBetween(Window.unboundedPreceding, -1))))
    in_group = Window.partitionBy("size", "group").orderBy("doc_id", "start", "ids_crc32")
    ranked = (sized.withColumn("_n", F.row_number().over(in_group))
              .join(before.select("size", "group", F.coalesce("before", F.lit(0)).alias("before")), ["size", "group"])
              .select(*pieces.columns, "size", (F.col("before") + F.col("_n") - 1).cast("long").alias("rank")))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)

    def each(batch: pa.RecordBatch):
        sequence, slot = places.find(batch.column("size").to_numpy(), batch.column("rank").to_numpy())
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in pieces_columns] + [pa.array(sequence), pa.array(slot)],
                                         [*pieces_columns, "sequence_id", "slot"])

    pieces_columns = pieces.columns
    placed = mapped(ranked, f"{schema}, sequence_id long, slot long", each)
    above = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(above), F.lit(0))).drop("slot")
