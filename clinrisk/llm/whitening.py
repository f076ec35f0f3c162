"""Whitened embeddings from exact cross-products of bit planes.

Each entry c becomes the integer x = floor(64 c) + 1000000. For a block of rows, every dimension is shifted by its smallest
value and cut into bit planes, and a plane's bits of 64 rows are packed into one word. The popcount of the AND of two planes,
weighted by both planes' powers of two, is their part of a cross-product, so sums of products are integers without rounding.
Spark adds the tasks' sums; the covariance is centred as integers, divided once, and its eigenvectors give the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinrisk.llm.common import released, small_batches
from clinrisk.llm.vectors import complete, dimensions, matrix

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
# Rows whose planes are combined at once: the packed words of some hundred planes stay in the processor's cache.
BLOCK = 8192
# The driver gets d (d + 1) / 2 sums for vectors of d entries, however many rows there are.
MAX_DIMENSIONS = 1024


def levels(values: np.ndarray) -> np.ndarray:
    """floor(64 c) of each entry, which is exact; entries whose level is no long raise."""
    out = np.floor(values.astype(np.float64) * SCALE)
    if out.size and np.abs(out).max() >= 2.0**62:
        raise ArithmeticError("an entry is too large to be a long after scaling")
    return out.astype(np.int64)


def planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed bit planes (planes x words) of a non-negative matrix, with each plane's dimension and bit; empty planes are left out."""
    rows, d = y.shape
    wide = np.zeros((d, -(-rows // 64) * 8), np.uint8)
    packed, owner, bit = [], [], []
    for b in range(int(y.max(initial=0)).bit_length()):
        bits = np.packbits(((y >> b) & 1).astype(np.uint8).T, axis=1)
        wide[:, :bits.shape[1]] = bits
        some = np.flatnonzero(bits.any(axis=1))
        packed.append(wide[some].view(np.uint64))
        owner.append(some)
        bit.append(np.full(len(some), b))
    if not packed:
        return np.empty((0, wide.shape[1] // 8), np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    owner, bit = np.concatenate(owner), np.concatenate(bit)
    order = np.lexsort((bit, owner))
    return np.concatenate(packed)[order], owner[order], bit[order]


def scatter(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of entries (d) and of products of entries (d x d, upper triangle) of integer rows, as Python integers."""
    rows, d = z.shape
    low = z.min(axis=0)
    span = z.max(axis=0).astype(object) - low.astype(object)
    if max(span, default=0) >= 1 << 62:
        raise ArithmeticError("entries of one dimension lie too far apart")
    packed, owner, bit = planes(z - low)
    # Weighted counts fit 64 bits unless entries span more than some 20 bits.
    kind = np.int64 if 2 * int(max(span, default=0)).bit_length() + rows.bit_length() < 60 else object
    products, sums = np.zeros((d, d), object), np.zeros(d, object)
    border = np.flatnonzero(np.diff(owner, prepend=-1))
    for p in range(len(owner)):
        i = int(owner[p])
        count = np.bitwise_count(packed[p] & packed[p:]).sum(axis=1, dtype=np.int64)
        part = count.astype(kind) * (np.left_shift(1, bit[p:] + bit[p]) if kind is np.int64 else np.array([1 << int(b + bit[p]) for b in bit[p:]], object))
        part[1:][owner[p + 1:] == i] *= 2  # both orders of two planes of one dimension
        cut = np.unique(np.concatenate([[0], border[border > p] - p]))
        products[i, owner[p + cut]] += np.add.reduceat(part, cut)
        sums[i] += int(count[0]) << int(bit[p])
    low = low.astype(object)
    products = products + np.outer(low, sums) + np.outer(sums, low) + rows * np.outer(low, low)
    return sums + rows * low, np.triu(products)


@dataclass(frozen=True)
class Whitening:
    """n and per-dimension sums of floor(64 c); components as rows, already divided by the root of their eigenvalue."""

    n: int
    sums: list[int]
    components: np.ndarray
    explained: np.ndarray
    proper: np.ndarray
    error: float = 0.0

    def centred(self, z: np.ndarray) -> np.ndarray:
        """n x - S, exactly: 64-bit integers where they suffice, else Python's."""
        most = max([abs(int(z.max(initial=0))), abs(int(z.min(initial=0))), 1])
        if self.n * most + max(map(abs, self.sums), default=0) < 1 << 62:
            return self.n * z - np.array(self.sums, np.int64)
        return self.n * z.astype(object) - np.array(self.sums, object)

    def deviation(self, centred: np.ndarray) -> np.ndarray:
        if centred.dtype != object and (centred.astype(float)**2).sum(axis=1).max(initial=0) < 2.0**62:
            return (centred * centred).sum(axis=1)
        return (centred.astype(object)**2).sum(axis=1)

    def project(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(float) @ self.components.T


def whitening_of(n: int, sums: list[int], products: np.ndarray, components: int = COMPONENTS) -> Whitening:
    """Components of the covariance (divisor n) by falling eigenvalue.

    One whose eigenvalue is no larger than rounding leaves of zero has no variance: it projects to 0 and explains 0.
    """
    d = len(sums)
    covariance = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            covariance[i, j] = covariance[j, i] = (n * int(products[i, j]) - sums[i] * sums[j]) / (n * n)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    trace = float(np.trace(covariance))
    proper = values > max(float(values[0]), 0.0) * d * np.finfo(float).eps
    scaled = np.where(proper, vectors / np.sqrt(np.where(proper, values, 1.0)), 0.0).T
    return Whitening(n, sums, np.ascontiguousarray(scaled), np.where(proper, values / trace if trace else 0.0, 0.0), proper)


def _sums(vectors: DataFrame, vector: str, d: int) -> tuple[int, list[int], np.ndarray]:
    """Rows, sums and sums of products: one set of rows (i, j, value) from each task, added up by Spark."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            z = levels(matrix(batch.column(0), d))
            for low in range(0, len(z), BLOCK):
                s, p = scatter(z[low:low + BLOCK])
                sums, products = sums + s, products + p
            n += len(z)
        i, j = np.triu_indices(d)
        values = [*products[i, j], *sums, n]
        first, second = [*i.tolist(), *range(d), -1], [*j.tolist(), *[-1] * d, -1]
        yield pa.RecordBatch.from_arrays([pa.array(first, pa.int32()), pa.array(second, pa.int32()), pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))], ["i", "j", "value"])

    parts = small_batches(vectors.select(vector)).mapInArrow(released(run), "i int, j int, value decimal(38,0)")
    products, sums, n = np.zeros((d, d), object), [0] * d, 0
    for i, j, value in parts.groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        if i < 0:
            n = int(value)
        elif j < 0:
            sums[i] = int(value)
        else:
            products[i, j] = int(value)
    return n, sums, products


def _identity_error(vectors: DataFrame, vector: str, d: int, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over components that have variance."""
    k = len(model.components)

    def run(batches):
        total, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = model.project(model.centred(levels(matrix(batch.column(0), d))))
            total, products = total + w.sum(axis=0), products + w.T @ w
        i, j = np.indices((k, k))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i.ravel(), np.arange(k)).astype(np.int32)), pa.array(np.append(j.ravel(), np.full(k, -1)).astype(np.int32)), pa.array(np.append(products.ravel(), total))], ["i", "j", "value"])

    parts = small_batches(vectors.select(vector)).mapInArrow(released(run), "i int, j int, value double")
    products, means = np.zeros((k, k)), np.zeros(k)
    for i, j, value in parts.groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        if j < 0:
            means[i] = value / model.n
        else:
            products[i, j] = value / model.n
    # Rows are centred before they are projected; what is left of a mean is rounding.
    difference = products - np.outer(means, means) - np.eye(k)
    return float(np.abs(difference[np.ix_(model.proper, model.proper)]).max(initial=0.0))


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, max_dimensions: int = MAX_DIMENSIONS) -> DataFrame:
    """key, component (from 1), n, deviation (decimal), whitened, explained and identity_error of every row that has a vector.

    Rows whose vector is NULL or holds NULL or non-finite entries are left out, as are vectors of another length than most
    have, and empty ones. Repeated rows, ties and NULL keys count as rows of their own. An empty table gives an empty result.
    Components without variance are 0 in every row. Other columns are not looked at. Vectors of more than ``max_dimensions``
    entries raise ValueError, and levels that are no long, or sums of more than 38 digits, an arithmetic error.
    """
    kind = rows.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    vectors = rows.where(complete(vector)).select(F.col(key), F.col(vector).cast("array<double>").alias(vector))
    d = dimensions(vectors, vector)
    if d > max_dimensions:
        raise ValueError(f"vectors of {d} entries; the driver holds the sums of at most {max_dimensions}")
    vectors = vectors.where(F.size(vector) == d)
    if not d:
        return rows.sparkSession.createDataFrame([], schema)
    n, sums, products = _sums(vectors, vector, d)
    model = whitening_of(n, sums, products, components)
    error, k = _identity_error(vectors, vector, d, model), len(model.components)

    def each(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                part = batch.slice(low, BLOCK)
                centred = model.centred(levels(matrix(part.column(1), d)))
                deviation = pa.array([Decimal(int(v)) for v in model.deviation(centred)], pa.decimal128(38, 0))
                row, component = np.divmod(np.arange(part.num_rows * k), k)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array((component + 1).astype(np.int32)), pa.array(np.full(len(row), n)), deviation.take(pa.array(row)),
                     pa.array(model.project(centred).ravel()), pa.array(model.explained[component]), pa.array(np.full(len(row), error))],
                    [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return small_batches(vectors).mapInArrow(released(each), schema)
