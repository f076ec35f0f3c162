"""Statistics of documents, worked out for many texts at once: counts by definition, and ratios for learned scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from clinrisk.llm.common import SPACES, Joined, mapped, pair_hash, slices, text_bytes

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "word_length", "symbols", "bangs", "pipes", "stops", "upper", "digits", "dup_lines", "repeats", "distinct"]
SCHEMA = ", ".join([f"{c} long" for c in COUNTS] + [f"{c} double" for c in FEATURES])


def _class(chars: bytes) -> np.ndarray:
    return np.array([i in chars for i in range(256)])


_SYMBOL, _BANG, _PIPE, _STOP = _class(b"#*$%&|<>"), _class(b"!"), _class(b"|"), _class(b".,;:?")
_UPPER, _DIGIT = _class(bytes(range(65, 91))), _class(bytes(range(48, 58)))
# First bytes of code points that are not white space: continuation bytes start with the bits 10.
_CHAR = np.array([i not in SPACES and i & 0xC0 != 0x80 for i in range(256)])


def duplicate_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier one."""
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    return len(lines), len(lines) - len(set(lines))


def statistics(texts: list[bytes]) -> dict[str, np.ndarray]:
    """COUNTS and FEATURES of each text; all are zero for a text without words."""
    parts = [_statistics(texts[low:high]) for low, high in slices(texts)]
    names = COUNTS + FEATURES
    return {c: np.concatenate([p[c] for p in parts]) if parts else np.empty(0) for c in names}


def _statistics(texts: list[bytes]) -> dict[str, np.ndarray]:
    j = Joined(texts)
    n_words = j.words_per_text()
    repeated = np.zeros(len(j.hashes), bool)
    if len(j.hashes) >= 3:
        h, doc = j.hashes, j.text
        whole = np.flatnonzero(doc[:-2] == doc[2:])
        key = pair_hash(pair_hash(pair_hash(h[whole], h[whole + 1]), h[whole + 2]), doc[whole].astype(np.uint64))
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        again = whole[count[inverse] >= 2]
        for i in range(3):
            repeated[again + i] = True
    distinct = np.unique(pair_hash(j.hashes, j.text.astype(np.uint64)), return_index=True)[1]
    lines = np.array([duplicate_lines(t) for t in texts], np.int64).reshape(-1, 2)
    out = {
        "n_words": n_words, "word_chars": j.per_text(_CHAR[j.codes]), "n_symbols": j.per_text(_SYMBOL[j.codes]),
        "n_dup_lines": lines[:, 1], "n_repeat_words": j.words_per_text(repeated),
    }
    per_word, chars = np.maximum(n_words, 1), np.maximum(out["word_chars"], 1)
    return out | {
        "log_words": np.log1p(n_words), "word_length": out["word_chars"] / per_word, "symbols": out["n_symbols"] / per_word,
        "bangs": j.per_text(_BANG[j.codes]) / per_word, "pipes": j.per_text(_PIPE[j.codes]) / per_word,
        "stops": j.per_text(_STOP[j.codes]) / per_word, "upper": j.per_text(_UPPER[j.codes]) / chars,
        "digits": j.per_text(_DIGIT[j.codes]) / chars, "dup_lines": lines[:, 1] / np.maximum(lines[:, 0], 1),
        "repeats": out["n_repeat_words"] / per_word, "distinct": np.bincount(j.text[distinct], minlength=j.n) / per_word,
    }


def document_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` with COUNTS and FEATURES of each row's whole text; a NULL text has none of anything."""
    kind = docs.schema[key].dataType.simpleString()

    def each(batch: pa.RecordBatch):
        stats = statistics(text_bytes(batch.column(1)))
        columns = [batch.column(0)]
        columns += [pa.array(stats[c].astype(np.int64)) for c in COUNTS] + [pa.array(stats[c].astype(float)) for c in FEATURES]
        yield pa.RecordBatch.from_arrays(columns, [key, *COUNTS, *FEATURES])

    return mapped(docs.select(key, text), f"{key} {kind}, {SCHEMA}", each)
