"""Language of words in code-switched text by a linear-chain conditional random field.

A word's emission is the sum of learned weights of its character n-grams, of its affixes (n-grams that touch the word's
border) and of the word itself (the lexicon), all hashed into one table. Transitions between the labels of neighbouring words
are learned with them. Marginals of all words come from forward-backward, worked out for many texts at once: chunks of words
are turned into transfer matrices in parallel, vectors are passed from chunk to chunk, and every chunk is then filled in.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinrisk.llm.common import mapped, released, slices, small_batches

# Bounds of the fit: documents, and fragments of each, spread evenly over its whole text.
MAX_LABELLED, FRAGMENTS, FRAGMENT_WORDS = 2000, 4, 40
TABLE_BITS, SIZES, CHUNK, CACHED_WORDS = 17, (2, 3, 4, 5), 256, 300_000
# Letters, and the marks that go with them; other numbers than digits are neither.
NOT_LETTERS, LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")
UNKNOWN = "und"


def letters_of(word: str) -> str:
    """The letters of a word with their marks; empty if it has no letter."""
    if word.isalpha():
        return word
    kept = NOT_LETTERS.sub("", word)
    return kept if LETTER.search(kept) else ""


def split_words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").split()


@dataclass
class Features:
    """Hashed features of words: ``index[k]`` is one of word ``word[k]``. Words without letters have none."""

    index: np.ndarray
    word: np.ndarray
    n: int

    @classmethod
    def of(cls, words: list[bytes]) -> Features:
        letters = [letters_of(w.decode("utf-8", "replace")).encode() for w in words]
        joined = b"".join(b"^" + w + b"$" if w else b"" for w in letters)
        lengths = np.array([len(w) + 2 if w else 0 for w in letters], np.int64)
        codes = np.frombuffer(joined, np.uint8).astype(np.uint64)
        word = np.repeat(np.arange(len(words)), lengths)
        end = np.cumsum(lengths)[word] if len(words) else np.empty(0, np.int64)
        at, h, index, owner = np.arange(len(codes)), codes.copy(), [], []
        for n in range(2, max(SIZES) + 1):
            h[:len(codes) - n + 1] = h[:len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1:] if len(codes) >= n else 0
            inside = np.flatnonzero(at + n <= end)
            index.append(_slot(h[inside] + np.uint64(n)))
            owner.append(word[inside])
        whole = np.array([i for i, w in enumerate(letters) if w], np.int64)
        if len(whole):
            terms = codes * (np.uint64(0x9E3779B97F4A7C15) + ((at - (end - lengths[word])).astype(np.uint64) << np.uint64(17)) * codes)
            index.append(_slot(np.add.reduceat(terms, (np.cumsum(lengths) - lengths)[whole]) + np.uint64(99)))
            owner.append(whole)
        return cls(np.concatenate(index).astype(np.int64), np.concatenate(owner).astype(np.int64), len(words))

    def sums(self, weights: np.ndarray) -> np.ndarray:
        return np.column_stack([np.bincount(self.word, w, self.n) for w in weights[self.index].T]) if self.n else np.empty((0, weights.shape[1]))

    def scattered(self, gradient: np.ndarray) -> np.ndarray:
        return np.column_stack([np.bincount(self.index, g, 1 << TABLE_BITS) for g in gradient[self.word].T])


def _slot(h: np.ndarray) -> np.ndarray:
    return (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - TABLE_BITS)


def forward(e: np.ndarray, moves: np.ndarray, into: np.ndarray) -> np.ndarray:
    """Normalised forward vectors of chunks: ``e`` is chunks x words x labels, ``into`` the vector before each chunk."""
    out, a = np.empty_like(e), into
    for t in range(e.shape[1]):
        a = (a @ moves) * e[:, t]
        a = a / a.sum(axis=1, keepdims=True)
        out[:, t] = a
    return out


def backward(e: np.ndarray, moves: np.ndarray, after: np.ndarray) -> np.ndarray:
    out, b = np.empty_like(e), after
    for t in reversed(range(e.shape[1])):
        out[:, t] = b
        b = (e[:, t] * b) @ moves.T
        b = b / b.sum(axis=1, keepdims=True)
    return out


@dataclass(frozen=True)
class Tagger:
    """Learned labels, hashed weights (slots x labels) and log transitions (from x to)."""

    labels: list[str]
    weights: np.ndarray
    moves: np.ndarray

    def marginals(self, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """P(label of word | text) for texts of ``lengths`` words whose emissions stand one after another."""
        n_labels, moves = len(self.labels), np.exp(self.moves - self.moves.max())
        e = np.exp(emissions - emissions.max(axis=1, keepdims=True))
        chunks = -(-lengths // CHUNK)
        last = np.cumsum(chunks)
        text = np.repeat(np.arange(len(lengths)), lengths)
        inside = np.arange(len(text)) - (np.cumsum(lengths) - lengths)[text]
        chunk, step = (last - chunks)[text] + inside // CHUNK, inside % CHUNK
        width = int(min(CHUNK, lengths.max(initial=0)))
        padded = np.ones((int(chunks.sum()), width, n_labels))
        padded[chunk, step] = e
        # Only a text's last chunk is padded, so what its padding does to the vectors passed on never counts.
        through = np.broadcast_to(np.eye(n_labels), (len(padded), n_labels, n_labels)).copy()
        if chunks.max(initial=0) > 1:
            for t in range(width):
                through = (through @ moves) * padded[:, t, None, :]
                through /= through.max(axis=(1, 2), keepdims=True)
        into, after = np.ones((len(padded), n_labels)), np.ones((len(padded), n_labels))
        for k in range(1, int(chunks.max(initial=0))):
            at = (last - chunks)[chunks > k] + k
            v = np.einsum("ci,cij->cj", into[at - 1], through[at - 1])
            into[at] = v / v.sum(axis=1, keepdims=True)
        a = forward(padded, moves, into)
        # Backwards the padding stands first; words after the end get the neutral vector instead.
        ends = np.zeros(padded.shape[:2], bool)
        ends[last[chunks > 0] - 1, (lengths[chunks > 0] - 1) % CHUNK] = True
        b = np.empty_like(padded)
        for k in reversed(range(int(chunks.max(initial=0)))):
            at = (last - chunks)[chunks > k] + k
            b[at] = self._back(padded[at], moves, after[at], ends[at])
            if k:
                v = (padded[at, 0] * b[at, 0]) @ moves.T
                after[at - 1] = v / v.sum(axis=1, keepdims=True)
        out = (a * b)[chunk, step]
        return out / out.sum(axis=1, keepdims=True)

    @staticmethod
    def _back(e, moves, after, ends):
        out, b = np.empty_like(e), after
        for t in reversed(range(e.shape[1])):
            b = np.where(ends[:, t, None], 1.0, b)
            out[:, t] = b
            b = (e[:, t] * b) @ moves.T
            b = b / b.sum(axis=1, keepdims=True)
        return out


def fit(fragments: list[tuple[str, list[bytes]]], steps: int = 40, rate: float = 0.3, l2: float = 1e-6, seed: int = 3) -> Tagger:
    """Maximum likelihood by Adam over code-switched sequences: labelled fragments in random order, four to a sequence."""
    labels = sorted({lang for lang, _ in fragments})
    known: dict[bytes, int] = {}
    order = np.random.default_rng(seed).permutation(len(fragments))
    per, width = 4, 4 * FRAGMENT_WORDS
    rows = -(-len(order) // per)
    x, y, used = np.zeros((rows, width), int), np.zeros((rows, width), int), np.zeros((rows, width), bool)
    fill = np.zeros(rows, int)
    for i, k in enumerate(order):
        lang, words = fragments[k]
        r, words = i % rows, words[:width - fill[i % rows]]
        span = slice(fill[r], fill[r] + len(words))
        x[r, span] = [known.setdefault(w, len(known)) for w in words]
        y[r, span], used[r, span] = labels.index(lang), True
        fill[r] += len(words)
    n = len(labels)
    features = Features.of(list(known))
    w, m = np.zeros((1 << TABLE_BITS, n)), np.zeros((n, n))
    truth = np.eye(n)[y] * used[..., None]
    both = used[:, 1:] & used[:, :-1]
    pairs = np.zeros((n, n))
    np.add.at(pairs, (y[:, :-1][both], y[:, 1:][both]), 1)
    state = [np.zeros_like(v) for v in (w, w, m, m)]
    total = max(int(used.sum()), 1)
    for step in range(1, steps + 1 if n > 1 else 1):
        e = features.sums(w)[x]
        e = np.where(used[..., None], np.exp(e - e.max(axis=2, keepdims=True)), 1.0)
        moves = np.exp(m - m.max())
        # Padding stands last in a row; its words are left out of both sums below, and a neutral vector enters before it.
        a, end = forward(e, moves, np.ones((rows, n))), used & ~np.roll(used, -1, axis=1)
        end[:, -1] = used[:, -1]
        b = Tagger._back(e, moves, np.ones((rows, n)), end)
        unary = a * b
        unary = unary / unary.sum(axis=2, keepdims=True) * used[..., None]
        joint = a[:, :-1, :, None] * moves * (e * b)[:, 1:, None, :]
        joint = joint / joint.sum(axis=(2, 3), keepdims=True) * both[..., None, None]
        by_word = np.column_stack([np.bincount(x.ravel(), g, len(known)) for g in (truth - unary).reshape(-1, n).T])
        for j, (value, gradient) in enumerate(((w, features.scattered(by_word) / total - l2 * w), (m, (pairs - joint.sum(axis=(0, 1))) / total - l2 * m))):
            first, second = state[2 * j], state[2 * j + 1]
            first += 0.1 * (gradient - first)
            second += 0.01 * (gradient**2 - second)
            value += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8) * min(1.0, 10 / step)
    return Tagger(labels, w.astype(np.float32), m)


def labelled_fragments(docs: DataFrame, train: Column, limit: int = MAX_LABELLED) -> list[tuple[str, list[bytes]]]:
    """Fragments of at most ``limit`` labelled documents, drawn from distinct texts, as many of each language as there are or as fit.

    Of every language the texts are taken by the order of a hash, in turn with those of the others, so that a rare language is
    learned and copies count once.
    """
    usable = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    texts = usable.select("lang", F.xxhash64("text").alias("hash"), "doc_id").groupBy("lang", "hash").agg(F.min("doc_id").alias("id"))
    ranked = texts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("hash"))).where(F.col("rank") <= limit)
    chosen = ranked.orderBy("rank", "hash", "lang").limit(limit).select(F.col("lang").alias("_lang"), F.col("hash").alias("_hash"), F.col("id").alias("_id"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang")) & (F.xxhash64("text") == F.col("_hash"))
    chosen = usable.select("doc_id", "lang", "text").join(F.broadcast(chosen), same, "left_semi").dropDuplicates(["lang", "text"]).orderBy("doc_id", "lang").select("lang", "text")

    def each(batch: pa.RecordBatch):
        langs, parts = [], []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = split_words(text)
            span = max(len(words) - FRAGMENT_WORDS, 0)
            starts = sorted({span * i // max(FRAGMENTS - 1, 1) for i in range(FRAGMENTS)})
            for s in starts:
                langs.append(lang)
                parts.append(b" ".join(w[:100] for w in words[s:s + FRAGMENT_WORDS]))
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.binary())], ["lang", "words"])

    rows = mapped(chosen, "lang string, words binary", each).toArrow()
    return [(lang, words.split()) for lang, words in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()) if words]


class Emissions:
    """Emissions by word, kept for words seen before."""

    def __init__(self, tagger: Tagger):
        self.tagger, self.rows, self.table = tagger, {}, np.empty((0, len(tagger.labels)), np.float32)
        self.letters = np.empty(0, bool)

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Emissions, and whether the word has a letter."""
        if len(self.rows) > CACHED_WORDS:
            self.__init__(self.tagger)
        new = list({w for w in words if w not in self.rows})
        if new:
            f = Features.of(new)
            self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.table = np.concatenate([self.table, f.sums(self.tagger.weights).astype(np.float32)])
            self.letters = np.concatenate([self.letters, np.bincount(f.word, minlength=f.n) > 0])
        at = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        return self.table[at].astype(float), self.letters[at]


def label_languages(docs: DataFrame, train: Column, limit: int = MAX_LABELLED) -> DataFrame:
    """doc_id, lang_pred, score and runs of every row of ``docs``.

    ``runs``: the text's words as array<struct<lang, words>>, neighbouring words of one language together; words without a
    letter go with the language around them. lang_pred is the language with the highest mean marginal over words with a
    letter, and score that mean. ``und`` with score 0 where text is NULL or has no letter, or where nothing could be learned
    (no labelled text). Repeated rows are labelled one by one; only text is looked at.
    """
    fragments = labelled_fragments(docs, train, limit)
    tagger = fit(fragments) if fragments else None
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        emissions = Emissions(tagger) if tagger else None
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for low, high in slices(texts):
                yield labelled(batch.column(0).slice(low, high - low), texts[low:high], emissions)

    def labelled(keys, texts, emissions):
        langs, scores, runs = [UNKNOWN] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
        split = [split_words(t) for t in texts]
        lengths = np.array([len(s) for s in split], np.int64)
        if tagger and lengths.sum():
            e, letters = emissions.of([w for s in split for w in s])
            p = tagger.marginals(e, lengths)
            text = np.repeat(np.arange(len(texts)), lengths)
            counted = np.column_stack([np.bincount(text, q * letters, len(texts)) for q in p.T])
            n = np.bincount(text, letters, len(texts))
            best, label = counted.argmax(axis=1), p.argmax(axis=1)
            border = np.flatnonzero(np.diff(label, prepend=-1) | np.diff(text, prepend=-1))
            for i, size in zip(border, np.diff(border, append=len(label))):
                runs[text[i]].append({"lang": tagger.labels[label[i]], "words": int(size)})
            for i in np.flatnonzero(n):
                langs[i], scores[i] = tagger.labels[best[i]], min(1.0, counted[i, best[i]] / n[i])
            for i in np.flatnonzero(n == 0):
                runs[i] = []
        return pa.RecordBatch.from_arrays(
            [keys, pa.array(langs), pa.array(scores), pa.array(runs, pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())])))],
            ["doc_id", "lang_pred", "score", "runs"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(
        released(run), f"doc_id {kind}, lang_pred string, score double, runs array<struct<lang: string, words: bigint>>")
