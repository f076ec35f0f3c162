"""Quality rules as gradient-boosted trees with monotonic constraints, flattened into arrays for scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinrisk.llm.common import landed, mapped
from clinrisk.llm.preference import MAX_LABELLED, labelled_sample
from clinrisk.llm.stats import COUNTS, FEATURES, document_statistics

# More of these never raises a document's score; more distinct words never lowers it.
MONOTONE = {"symbols": -1, "bangs": -1, "pipes": -1, "dup_lines": -1, "repeats": -1, "upper": -1, "distinct": 1}
MIN_WORDS, MAX_REPEAT_PERCENT, KEEP_AT = 50, 50, 0.5


@dataclass(frozen=True)
class Forest:
    """All trees in one set of node arrays. A leaf is its own child, so every row takes ``depth`` steps."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def probability(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


class _Grower:
    def __init__(self, x: np.ndarray, monotone: np.ndarray, bins: int, depth: int, l2: float, min_curvature: float, rate: float):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        self.bin = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)])
        self.monotone, self.bins, self.depth, self.l2, self.least, self.rate = monotone, bins, depth, l2, min_curvature, rate
        self.nodes: list[list[float]] = []

    def tree(self, g: np.ndarray, h: np.ndarray) -> int:
        return self._node(np.arange(len(g)), g, h, -np.inf, np.inf, self.depth)

    def _node(self, rows, g, h, low, high, depth) -> int:
        at = len(self.nodes)
        value = float(np.clip(g[rows].sum() / (h[rows].sum() + self.l2), low, high))
        self.nodes.append([0, np.inf, at, at, self.rate * value])
        split = self._split(rows, g, h, low, high) if depth else None
        if split is None:
            return at
        f, b, left_value, right_value = split
        goes_left = self.bin[rows, f] <= b
        middle, sign = (left_value + right_value) / 2, self.monotone[f]
        left_range = (low, middle) if sign > 0 else (middle, high) if sign < 0 else (low, high)
        right_range = (middle, high) if sign > 0 else (low, middle) if sign < 0 else (low, high)
        left = self._node(rows[goes_left], g, h, *left_range, depth - 1)
        right = self._node(rows[~goes_left], g, h, *right_range, depth - 1)
        self.nodes[at] = [f, self.edges[f][b], left, right, 0.0]
        return at

    def _split(self, rows, g, h, low, high):
        best, out = 1e-6, None
        for f, edges in enumerate(self.edges):
            if not len(edges):
                continue
            b = self.bin[rows, f]
            gl = np.cumsum(np.bincount(b, g[rows], len(edges) + 1))
            hl = np.cumsum(np.bincount(b, h[rows], len(edges) + 1))
            gr, hr = gl[-1] - gl[:-1], hl[-1] - hl[:-1]
            g0, h0, gl, hl = gl[-1], hl[-1], gl[:-1], hl[:-1]
            left, right = np.clip(gl / (hl + self.l2), low, high), np.clip(gr / (hr + self.l2), low, high)
            # What the loss falls by with these (clipped) values, to second order.
            gain = sum(v * s - 0.5 * v * v * (c + self.l2) for v, s, c in ((left, gl, hl), (right, gr, hr))) - 0.5 * g0 * g0 / (h0 + self.l2)
            gain = np.where((hl < self.least) | (hr < self.least) | (self.monotone[f] * (right - left) < 0), -np.inf, gain)
            if gain.max() > best:
                i = int(gain.argmax())
                best, out = gain[i], (f, i, left[i], right[i])
        return out


def fit_forest(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3,
               bins: int = 64, l2: float = 1.0, min_curvature: float = 1.0) -> Forest:
    """Logistic loss, second-order splits on quantile bins. With fewer than two classes there are no trees.

    A split on a constrained feature must order its sides; both then stay on their side of the middle, all the way down.
    """
    share = y.mean() if len(y) else 0.5
    base = float(np.log(np.clip(share, 1e-6, 1 - 1e-6) / (1 - np.clip(share, 1e-6, 1 - 1e-6))))
    roots, nodes = [], [[0, np.inf, 0, 0, 0.0]]
    if len(y) and 0 < share < 1:
        grower = _Grower(x, monotone, bins, depth, l2, min_curvature, rate)
        margin = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            start = len(grower.nodes)
            roots.append(grower.tree(y - p, p * (1 - p)))
            one = _flat(grower.nodes[start:], [0], 0.0, depth, start)
            margin = margin + np.log((q := np.clip(one.probability(x), 1e-12, 1 - 1e-12)) / (1 - q))
        nodes = grower.nodes
    return _flat(nodes, roots or [0], base, depth, 0)


def _flat(nodes, roots, base, depth, start) -> Forest:
    a = np.array(nodes, float)
    return Forest(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int) - start, a[:, 3].astype(int) - start, a[:, 4],
                  np.array(roots), base, depth)


def quality_rules(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT, limit: int = MAX_LABELLED) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the forest's score of every row of ``docs``.

    base_failed: fewer than 50 words, or over half of the words in repeated three-word windows. kept: not base_failed, and
    the forest gives at least ``keep_at``. NULL and empty texts have no words and so fail; repeated rows are judged one by
    one. Without labels, or with one label only, the forest keeps what that label says (none: everything).
    """
    stats = landed(document_statistics(docs), "rules")
    x, y = labelled_sample(stats, labels, "quality", F.lit(True), limit)
    model = fit_forest(x, y, np.array([MONOTONE.get(c, 0) for c in FEATURES]))
    kind = stats.schema["doc_id"].dataType.simpleString()

    def each(batch: pa.RecordBatch):
        count = {c: batch.column(c).to_numpy() for c in COUNTS}
        score = model.probability(np.column_stack([batch.column(c).to_numpy() for c in FEATURES]))
        failed = (count["n_words"] < MIN_WORDS) | (100 * count["n_repeat_words"] > MAX_REPEAT_PERCENT * count["n_words"])
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("doc_id", *COUNTS)] + [pa.array(failed), pa.array(~failed & (score >= keep_at)), pa.array(score)],
            ["doc_id", *COUNTS, "base_failed", "kept", "score"])

    counts = ", ".join(f"{c} long" for c in COUNTS)
    return mapped(stats, f"doc_id {kind}, {counts}, base_failed boolean, kept boolean, score double", each)
