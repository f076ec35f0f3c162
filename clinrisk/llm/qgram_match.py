"""Benchmark passages in documents by q-gram lemma filtering and banded alignment.

A passage of m bytes that occurs with at most k edits keeps at least m + 1 - q (k + 1) of its q-grams, all on diagonals
(document position minus passage position) at most k apart from where it starts. Diagonals are divided into overlapping bands
so that these always lie in one; bands with that many of the passage's q-grams are aligned within the band.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from clinrisk.llm.common import SPACES, mapped, slices, text_bytes

Q, EDIT_RATE, MIN_BYTES = 8, 0.1, 24
# Items are looked for as a whole, those longer than a window in windows as well, so that a document holding a part of one is found:
# any run of WINDOW_BYTES + STEP_BYTES - 1 bytes. Items of Q to MIN_BYTES - 1 bytes are looked for exactly.
WINDOW_BYTES, STEP_BYTES = 112, 28
# A stretch that repeats itself every 1 to PERIODS bytes, as rulers and table borders do, counts as REPEATED bytes and a period.
PERIODS, REPEATED = 8, 16
# Texts that are worked through at once; some hundred bytes of memory go with each of theirs.
SLICE_BYTES = 1 << 19
# Benchmark text that goes to the tasks at once; a larger benchmark is looked for in as many passes as it takes.
MAX_INDEX_BYTES = 4 << 20
_PLAIN = bytes(32 if b in SPACES else b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def folded(text: bytes) -> bytes:
    """UTF-8 with its case folded and each white-space byte a space; zero bytes, which part documents, become spaces."""
    if not text.isascii():
        text = text.decode("utf-8", "replace").casefold().encode()
    return text.translate(_PLAIN).replace(b"\0", b" ")


def repeats(data: bytes) -> np.ndarray | None:
    """Which bytes of ``data`` count: in a stretch of one period, the first REPEATED and one period; whole periods are left out."""
    kept = None
    for period in range(1, min(PERIODS, len(data) - REPEATED) + 1):
        codes = np.frombuffer(data, np.uint8)
        same = codes[period:] == codes[:-period]
        if same.tobytes().find(b"\1" * (REPEATED + period)) < 0:
            continue
        edges = np.flatnonzero(np.diff(same.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        start, length = edges[::2], edges[1::2] - edges[::2]
        over = (length - REPEATED) // period * period
        long = over > 0
        kept = np.ones(len(data), bool) if kept is None else kept
        for low, n in zip((start[long] + period + REPEATED).tolist(), over[long].tolist()):
            kept[low:low + n] = False
    return kept


def plain(text: bytes) -> bytes:
    """The text as it is compared: folded, and without what only repeats a short stretch."""
    text = folded(text)
    kept = repeats(text)
    return text if kept is None else np.frombuffer(text, np.uint8)[kept].tobytes()


class Offsets:
    """From byte offsets in ``plain(text)`` to character offsets in ``text``, whose folded characters can be longer or several."""

    def __init__(self, text: bytes):
        kept = repeats(folded(text))
        self.kept = None if kept is None else np.append(np.flatnonzero(kept), len(kept))
        self.ends = None if text.isascii() else np.cumsum([len(c.casefold().encode()) for c in text.decode("utf-8", "replace")])

    def start(self, at: int) -> int:
        """The character that byte ``at`` belongs to."""
        at = at if self.kept is None else int(self.kept[at])
        return at if self.ends is None else int(np.searchsorted(self.ends, at, "right"))

    def end(self, at: int) -> int:
        """The first character that begins at byte ``at`` or later, after what is left out before it."""
        at = at if self.kept is None else int(self.kept[at])
        return at if self.ends is None else int(np.searchsorted(self.ends, at, "left")) + 1 if at else 0


def grams(data: bytes) -> np.ndarray:
    """All runs of Q = 8 bytes as 64-bit integers."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.empty(n, np.uint64)
    for i in range(min(Q, n)):
        out[i::Q] = np.frombuffer(data, "<u8", len(range(i, n, Q)), i)
    return out


def banded_distance(pattern: bytes, text: bytes, low: int, width: int) -> tuple[int, int, int]:
    """(edits, start, end) of the best occurrence of ``pattern`` in ``text`` on diagonals low to low + width - 1.

    Cell j of row i stands for the first i bytes of the pattern ending before text position i + low + j.
    """
    codes, far = np.frombuffer(text, np.uint8), 1 << 20
    at = low + np.arange(width)
    cost = np.where((at >= 0) & (at <= len(codes)), 0, far)
    start = at.copy()
    steps = np.arange(width)
    for i, c in enumerate(pattern):
        at = i + low + np.arange(width)  # the text position that a diagonal step from row i uses
        inside = (at >= 0) & (at < len(codes))
        same = cost + np.where(inside, codes[np.clip(at, 0, max(len(codes) - 1, 0))] != c if len(codes) else 1, far)
        skip = np.append(cost[1:] + 1, far)
        new = np.minimum(same, skip)
        origin = np.where(same <= skip, start, np.append(start[1:], 0))
        # An extra text byte moves one cell on and costs one.
        run = np.minimum.accumulate(new - steps)
        first = np.maximum.accumulate(np.where(new - steps == run, steps, 0))
        cost, start = run + steps, origin[first]
        cost = np.where((at + 1 >= 0) & (at + 1 <= len(codes)), cost, far)
    best = int(cost.argmin())
    return int(cost[best]), int(start[best]), len(pattern) + low + best


@dataclass
class Index:
    """Patterns (passages or windows of them) by q-gram."""

    patterns: list[bytes]
    items: list
    gram: np.ndarray
    first: np.ndarray
    pattern: np.ndarray
    position: np.ndarray
    bits: int
    present: np.ndarray
    edits: np.ndarray
    left_out: list[int]

    @classmethod
    def of(cls, items: list[tuple[object, bytes]], edit_rate: float = EDIT_RATE) -> Index:
        patterns, owner, left_out = [], [], []
        for item, text in items:
            text = plain(text).strip()
            n = len(text)
            parts = [text] if n >= Q else []
            if n > WINDOW_BYTES:
                parts += [text[i:i + WINDOW_BYTES] for i in [*range(0, n - WINDOW_BYTES, STEP_BYTES), n - WINDOW_BYTES]]
            patterns += parts
            owner += [item] * len(parts)
            # A window leaves the rest of its item out.
            left_out += [n - len(p) for p in parts]
        lengths = np.array([len(p) for p in patterns], np.int64)
        every = [grams(p) for p in patterns]
        pattern = np.repeat(np.arange(len(patterns), dtype=np.int32), [len(g) for g in every])
        position = np.concatenate([np.arange(len(g), dtype=np.int32) for g in every]) if every else np.empty(0, np.int32)
        gram = np.concatenate(every) if every else np.empty(0, np.uint64)
        order = np.argsort(gram, kind="stable")
        distinct, first = np.unique(gram[order], return_index=True)
        bits = max(10, int(16 * max(len(distinct), 1)).bit_length())
        present = np.zeros(1 << bits, bool)
        present[(distinct * _ODD) >> np.uint64(64 - bits)] = True
        # As many edits as the rate allows, but so few that the lemma still asks for a q-gram.
        edits = np.minimum((edit_rate * lengths).astype(np.int64), np.maximum((lengths - Q) // Q, 0))
        edits[lengths < MIN_BYTES] = 0
        return cls(patterns, owner, distinct, np.append(first, len(gram)), pattern[order], position[order], bits, present, edits, left_out)

    def find(self, texts: list[bytes]) -> list[tuple[int, object, int, int, int]]:
        """(text, item, start, end, edits) in bytes of the plain texts: for each text and item the occurrence with fewest edits, the first of equals."""
        out: dict[tuple[int, object], tuple[int, int, int]] = {}
        for low, high in slices(texts, SLICE_BYTES):
            for text, pattern, start, end, edits in self._find([plain(t) for t in texts[low:high]]):
                key, found = (low + text, self.items[pattern]), (edits, start, end)
                out[key] = min(out.get(key, found), found)
        return [(text, item, start, end, edits) for (text, item), (edits, start, end) in out.items()]

    def _find(self, texts: list[bytes]):
        if not self.patterns:
            return
        joined = b"\0".join(texts) + b"\0"
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        g = grams(joined)
        at = np.flatnonzero(self.present[(g * _ODD) >> np.uint64(64 - self.bits)])
        i = np.searchsorted(self.gram, g[at])
        i = np.minimum(i, len(self.gram) - 1)
        hit = self.gram[i] == g[at]
        at, i = at[hit], i[hit]
        many = self.first[i + 1] - self.first[i]
        at = np.repeat(at, many)
        posting = np.repeat(self.first[i] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        pattern, position = self.pattern[posting], self.position[posting]
        text = np.searchsorted(ends, at, "right")
        starts = np.concatenate([[0], ends[:-1]])
        step = 2 * self.edits[pattern] + 1
        shift = max(map(len, self.patterns))  # keeps diagonals before a document's first byte positive
        band = (at - starts[text] - position + shift) // step
        need = np.array([len(p) for p in self.patterns])[pattern] + 1 - Q * (self.edits[pattern] + 1)
        seen: set[tuple[int, int]] = set()
        whole: set[tuple[int, object]] = set()
        for t, p, b in self._bands(text, pattern, position, band, need):
            if (t, p) in seen or (self.left_out[p] and (t, self.items[p]) in whole):
                continue
            k = int(self.edits[p])
            found = self._verify(texts[t], p, b * (2 * k + 1) - shift, k)
            if found:
                if not found[2]:
                    seen.add((t, p))
                if not self.left_out[p]:
                    whole.add((t, self.items[p]))
                yield t, p, found[0], found[1], found[2] + self.left_out[p]

    @staticmethod
    def _bands(text, pattern, position, band, need):
        """(text, pattern, band) with enough distinct q-grams in band and the next one."""
        key = (text.astype(np.uint64) << np.uint64(48)) | (pattern.astype(np.uint64) << np.uint64(28))
        both = np.concatenate([key | band.astype(np.uint64), key | np.maximum(band - 1, 0).astype(np.uint64)])
        position, need = np.tile(position, 2), np.tile(need, 2)
        distinct, inverse, count = np.unique(both, return_inverse=True, return_counts=True)
        enough = count[inverse] >= need
        both, position, need = both[enough], position[enough], need[enough]
        order = np.lexsort((position, both))
        both, position, need = both[order], position[order], need[order]
        new = np.ones(len(both), bool)
        new[1:] = (both[1:] != both[:-1]) | (position[1:] != position[:-1])
        distinct, first, count = np.unique(both[new], return_index=True, return_counts=True)
        for k in distinct[count >= need[new][first]].tolist():
            yield k >> 48, (k >> 28) & 0xFFFFF, k & 0xFFFFFFF

    def _verify(self, text: bytes, p: int, low: int, k: int) -> tuple[int, int, int] | None:
        pattern, width = self.patterns[p], 2 * (2 * k + 1)
        begin = max(low - k, 0)
        exact = text.find(pattern, begin, low + width + len(pattern) + k)
        if exact >= 0:
            return exact, exact + len(pattern), 0
        edits, start, end = banded_distance(pattern, text[begin:low + width + len(pattern) + k], low - begin, width)
        return (begin + start, begin + end, edits) if edits <= k else None


def indexes(benchmark: DataFrame, edit_rate: float = EDIT_RATE, max_bytes: int = MAX_INDEX_BYTES) -> list[Callable[[], Index]]:
    """One index for each pass: the benchmark's items (item_id, text), dealt by hash so that none is larger than about ``max_bytes``.

    Each is collected only when its pass is set up. NULL texts and items of under Q bytes are no passages.
    """
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", F.encode("text", "UTF-8").alias("text"))
    size, most = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    passes = max(1, -(-int(size) // max_bytes), -(-int(most) // 200_000))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))

    def one(i: int) -> Index:
        rows = items.where(part == i).orderBy("item_id", "text").collect()
        return Index.of([(r["item_id"], bytes(r["text"])) for r in rows], edit_rate)

    return [lambda i=i: one(i) for i in range(passes)]


def passages(docs: DataFrame, benchmark: DataFrame, edit_rate: float = EDIT_RATE) -> DataFrame:
    """doc_id, item_id, start, end, edits of every row of ``docs`` and benchmark item that occurs in it.

    Case is that of Unicode's folding. Start and end are character offsets of the best occurrence. Rows without a passage, empty and NULL texts among them, are
    not returned; repeated rows are each looked at. At most one edit in ten bytes is tolerated. Where only
    a window of an item occurs, each byte of the item outside it counts as an edit. Stretches that only repeat up to PERIODS
    bytes count as short ones, whatever their length, in documents and items alike.
    """
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType
    item_kind = to_arrow_type(kinds[1])
    out = None
    for make in indexes(benchmark, edit_rate):
        index = make()

        def each(batch: pa.RecordBatch, index: Index = index):
            texts = text_bytes(batch.column(1))
            hits = index.find(texts)
            offsets = {t: Offsets(texts[t]) for t in {h[0] for h in hits}}
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([h[0] for h in hits], pa.int64())), pa.array([h[1] for h in hits], item_kind),
                 pa.array([offsets[h[0]].start(h[2]) for h in hits], pa.int64()), pa.array([offsets[h[0]].end(h[3]) for h in hits], pa.int64()),
                 pa.array([h[4] for h in hits], pa.int32())],
                ["doc_id", "item_id", "start", "end", "edits"])

        found = mapped(docs.select("doc_id", "text"), f"doc_id {kinds[0]}, item_id {kinds[1].simpleString()}, start long, end long, edits int", each)
        out = found if out is None else out.unionByName(found)
    return out


def without_passages(docs: DataFrame, benchmark: DataFrame, edit_rate: float = EDIT_RATE) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no benchmark item and no window of one.

    Only the doc_id and a hash of the texts that hold one come out of the search; rows of one doc_id and text share the outcome.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    searched, found = docs.where(F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("hash")), None
    for make in indexes(benchmark, edit_rate):
        index = make()

        def each(batch: pa.RecordBatch, index: Index = index):
            hits = sorted({h[0] for h in index.find(text_bytes(batch.column(1)))})
            yield batch.select([0, 2]).take(pa.array(hits, pa.int64()))

        part = mapped(searched, f"doc_id {kind}, hash long", each)
        found = part if found is None else found.unionByName(part)
    found = found.distinct().select(F.col("doc_id").alias("__hit_id"), F.col("hash").alias("__hit_hash"))
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("__hit_id")) & (F.xxhash64("text") == F.col("__hit_hash")), "left_anti")
