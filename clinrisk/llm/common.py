"""Small helpers shared by the text operators: reading tables, landing results, folds, words and packed arrays."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clinrisk.scratch import scratch_path

# What separates words: space and \x09-\x0D. ``bytes.split()`` splits at exactly these.
SPACES = b" \t\n\x0b\x0c\r"
BATCH_BYTES = 2 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def landed(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, and a lost executor takes nothing with it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(key: str | Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; a NULL key counts as the empty text."""
    text = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))
    return (F.crc32(text) % n).cast("int")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in whose session Arrow batches hold at most BATCH_BYTES: they stand several times in memory, in Spark and in Python."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which free memory goes back to the system: workers are kept for later tasks, and with them what they hold."""
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()
    return wrapped


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def mapped(df: DataFrame, schema: str | StructType, each: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``each`` over Arrow batches, which are bounded in bytes, so long texts do not add up."""
    def run(batches):
        for batch in batches:
            yield from each(batch)
    return small_batches(df).mapInArrow(released(run), schema)


def binaries(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def text_bytes(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; NULL is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def words(text: bytes, chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash and the first byte of each word of ``text``, in order, without a Python step per word.

    Bytes are mapped to fixed random numbers, multiplied by powers of an odd constant that restart at each word, summed
    per word and mixed. The text is worked through in pieces of about ``chunk`` bytes that end between words, so memory is
    eight bytes per word and some hundred MB at most besides.
    """
    hashes, starts, low = [], [], 0
    while low < len(text):
        high = len(text)
        if high - low > chunk:
            cut = max(text.rfind(bytes([s]), low, low + chunk) for s in SPACES)
            if cut < 0:  # a word longer than a piece
                found = [x for s in SPACES if (x := text.find(bytes([s]), low + chunk)) >= 0]
                cut = min(found, default=high - 1)
            high = cut + 1
        h, s = _words(np.frombuffer(text, np.uint8, high - low, low))
        hashes.append(h)
        starts.append(s + low)
        low = high
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def _words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = _INSIDE[codes]
    edges = np.flatnonzero(np.diff(inside, prepend=np.int8(0)) == 1)
    if not len(edges):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    ends = np.flatnonzero(np.diff(inside, append=np.int8(0)) == -1) + 1
    # How far each byte is into its word; beyond the table of powers another factor joins in.
    first = np.zeros(len(codes), np.int32)
    first[edges] = np.diff(edges, prepend=0)
    position = np.arange(len(codes), dtype=np.int32) - np.cumsum(first, dtype=np.int32)
    terms = _BYTE[codes]
    if (ends - edges).max() > len(_POWER):
        terms *= _POWER[position % len(_POWER)] + (position // len(_POWER)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C16)
    else:
        terms *= _POWER[position * inside]
    terms *= inside.view(np.uint8)
    return mixed(np.add.reduceat(terms, edges) + (ends - edges).astype(np.uint64)), edges


def slices(texts: Sequence[bytes | str], size: int = 1 << 21, many: int = 60_000) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``size`` bytes or characters, of one to ``many`` texts."""
    low = total = 0
    for i, text in enumerate(texts):
        total += len(text) + 1
        if total >= size or i + 1 - low >= many:
            yield low, i + 1
            low, total = i + 1, 0
    if low < len(texts):
        yield low, len(texts)


class Joined:
    """Texts put together with a line feed after each: their words' hashes, and the text that each word is in."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts) + b"\n"
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.codes = np.frombuffer(self.data, np.uint8)
        self.n = len(texts)
        self.hashes, self.at = words(self.data)
        self.text = np.searchsorted(self.ends, self.at, "right")

    def per_text(self, marked: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked."""
        return np.add.reduceat(marked.astype(np.int64), self.starts)

    def words_per_text(self, marked: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.text if marked is None else self.text[marked], minlength=self.n)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(0x9E3779B97F4A7C15)
    return np.cumprod(out)


_INSIDE = np.array([i not in SPACES for i in range(256)], np.int8)
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
_POWER = _powers(4096)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An ordered hash of two hash arrays."""
    return mixed(a * np.uint64(0x9FB21C651E98DF25) + (b ^ (b >> np.uint64(17))) * np.uint64(0xD6E8FEB86659FD93))
