"""Toxic documents by a convolutional text classifier in numpy (op 10).

A word's embedding is the sum of the rows that hashes of it and of its beginnings point to, so words of
one stem share a part. Filters of several widths run over the words; of each filter a document keeps
its few largest responses (k-max pooling, so that a second and a third hit count), and a dense layer
weighs them.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_map, col, kept
from .chunked import Chunks, ValueTable
from .labelled import held_out, platt, sampled, sigmoid

THRESHOLD = 0.3
BUCKETS = 1 << 19
WIDTHS = (1, 2, 3)
FILTERS, DIMENSIONS, LARGEST = 8, 8, 3
#: Characters of the beginnings of a word that are hashed beside all of it.
BEGINNINGS = (3, 5, 7)
_ROWS = 1 + len(BEGINNINGS)
#: Rows without a word between documents: no window spans two, and each document has windows enough.
_GAP = max(*WIDTHS, LARGEST)


def rows_of(chunk: str) -> bytes:
    """Embedding rows of a word and of its beginnings, as 32-bit integers; 0 where there is none, nothing for a word without letters and digits.

    Case doesn't count, nor do marks and white space around a word.
    """
    word = chunk.strip().lower()
    if not word.isalnum():
        start, end = 0, len(word)
        while start < end and not word[start].isalnum():
            start += 1
        while end > start and not word[end - 1].isalnum():
            end -= 1
        word = word[start:end]
        if not word:
            return b""
    hashed = [zlib.crc32(word.encode("utf-8", "surrogatepass")), *(zlib.crc32((word[:k] + "*").encode("utf-8", "surrogatepass")) if len(word) >= k else None for k in BEGINNINGS)]
    return np.array([0 if h is None else h % (BUCKETS - 1) + 1 for h in hashed], "<i4").tobytes()


def _white() -> np.ndarray:
    pairs = np.zeros((256, 256), bool)
    pairs[:, [*range(9, 14), 32]] = True
    return pairs.ravel()


_WHITE = _white()


class Words:
    """Turns texts into rows of their different words, each word's place among them, and where each text's words begin (and the end)."""

    def __init__(self):
        self.table = ValueTable(lambda new: list(map(rows_of, new)), most_bytes=24_000_000)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = Chunks(texts, _WHITE)
        values = self.table.values(found.keys)
        word = np.fromiter(map(len, values), np.int64, len(values)) > 0
        place = np.cumsum(word) - 1
        rows = np.frombuffer(b"".join(values), "<i4").reshape(-1, _ROWS)
        own = word[found.index]
        cuts = np.concatenate([np.zeros(1, np.int64), np.cumsum(own)])[found.first]
        return rows, place[found.index[own]], cuts


def apart(index: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words (counted from 1) with blank ones (0) between and around documents, and where each document begins (and the end)."""
    n = np.arange(len(cuts))
    starts = cuts + _GAP * (n + 1)
    out = np.zeros(len(index) + _GAP * (len(cuts) + 1), np.int64)
    out[np.arange(len(index)) + np.repeat(starts[:-1] - cuts[:-1], np.diff(cuts))] = index + 1
    return out, starts


def responses(words: np.ndarray, embedded: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """A filter bank's response to every window: for each of its taps what the word there gives."""
    n = len(words) - len(taps) + 1
    out = (embedded @ taps[0])[words[:n]]
    for k in range(1, len(taps)):
        out += (embedded @ taps[k])[words[k : n + k]]
    return out


def pooled(words: np.ndarray, starts: np.ndarray, embedded: np.ndarray, filters: list[np.ndarray], biases: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The LARGEST responses of each filter in each document, and for each width the windows they are from."""
    h = np.zeros((len(starts) - 1, len(filters), LARGEST, FILTERS), np.float32)
    chosen = []
    for w, (taps, bias) in enumerate(zip(filters, biases, strict=True)):
        response, back = responses(words, embedded, taps), len(taps) - 1
        top = np.zeros((len(starts) - 1, LARGEST, FILTERS), np.int64)
        for d, (a, b) in enumerate(pairwise((starts - back).tolist())):
            own = response[a:b]
            at = np.argpartition(own, len(own) - LARGEST, axis=0)[-LARGEST:]
            value = np.take_along_axis(own, at, axis=0)
            order = np.argsort(-value, axis=0, kind="stable")
            h[d, w], top[d] = np.take_along_axis(value, order, axis=0), np.take_along_axis(at, order, axis=0) + a
        h[:, w] += bias
        chosen.append(top)
    return h, chosen


@dataclass
class ToxicModel:
    """Embedding rows, filters of each width and their biases, a dense layer, the score's curve and thresholds by language."""

    table: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    dense: np.ndarray
    bias: float
    slope: float = 1.0
    intercept: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    base: float | None = None

    def logits(self, rows: np.ndarray, index: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """The network's output for documents of words (see Words), some 200,000 words at once, or one longer document."""
        embedded = embed(self.table, rows)
        out, at, n = np.zeros(len(cuts) - 1), 0, len(cuts) - 1
        while at < n:
            end = max(at + 1, int(np.searchsorted(cuts, cuts[at] + 200_000, "right")) - 1)
            words, starts = apart(index[cuts[at] : cuts[end]], cuts[at : end + 1] - cuts[at])
            h, _ = pooled(words, starts, embedded, self.filters, self.biases)
            out[at:end] = np.maximum(h, 0).reshape(end - at, -1) @ self.dense.ravel() + self.bias
            at = end
        return out

    def score(self, texts: list[str | None] | pa.Array, words: Words | None = None) -> np.ndarray:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if self.base is not None or not len(texts):
            return np.full(len(texts), self.base or 0.0)
        return sigmoid(self.slope * self.logits(*(words or Words())(texts)) + self.intercept)


def embed(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Embeddings of words, after that of the blank word."""
    out = np.zeros((len(rows) + 1, table.shape[1]), np.float32)
    for k in range(rows.shape[1]):
        out[1:] += table[rows[:, k]]
    return out


class Sample:
    """Labelled documents as words: their different words' rows, the words in turn, where each document begins, and labels."""

    def __init__(self, rows: np.ndarray, index: np.ndarray, cuts: np.ndarray, y: np.ndarray):
        self.rows, self.index, self.cuts, self.y = rows, index.astype(np.int32), cuts, y

    def batch(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of some documents the rows of their different words, the words with blank ones between documents, and where each begins."""
        index = np.concatenate([self.index[self.cuts[d] : self.cuts[d + 1]] for d in own])
        cuts = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.cuts[own + 1] - self.cuts[own])])
        used, place = np.unique(index, return_inverse=True)
        return self.rows[used], *apart(place, cuts)

    def first_step(self, docs: np.ndarray) -> np.ndarray:
        """For each embedding row how far one step of Adagrad from zero takes it, if documents' different words are summed instead of pooled.

        That is the sum of its documents' gradients over the root of their squares' sum, and one.
        """
        y = self.y[docs] - self.y[docs].mean()
        total, square = np.zeros(BUCKETS), np.ones(BUCKETS)
        for d, g in zip(docs, y, strict=True):
            own = np.unique(self.rows[np.unique(self.index[self.cuts[d] : self.cuts[d + 1]])])
            total[own] += g
            square[own] += g * g
        total[0] = 0
        return total / np.sqrt(square)


def train(sample: Sample, docs: np.ndarray, epochs: int = 4, batch: int = 32, rate: float = 0.01, seed: int = 7) -> ToxicModel:
    """Fit the network to some of the sample's documents: a first step from zero embeddings, then Adam on the log loss of the pooled network."""
    rng = np.random.default_rng(seed)
    share = min(max(float(sample.y[docs].mean()), 1e-3), 1 - 1e-3)
    filters = [rng.normal(0, 0.3, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
    biases = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    dense = np.full((len(WIDTHS), LARGEST, FILTERS), 0.1, np.float32)
    bias = np.array([np.log(share / (1 - share))], np.float32)
    # The gradient of a word's embedding has one direction before the first step: that of all filters' taps, weighed by the dense layer.
    way = sum(taps.sum(axis=(0, 2)) for taps in filters)
    step = sample.first_step(docs)
    table = (0.1 * step[:, None] * (way / np.linalg.norm(way))).astype(np.float32)
    values = [*filters, *biases, dense, bias]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    m_table, s_table = np.zeros_like(table), np.zeros(BUCKETS, np.float32)
    at = 0
    for _ in range(epochs):
        order = rng.permutation(docs)
        for k in range(0, len(order), batch):
            own = order[k : k + batch]
            rows, words, starts = sample.batch(own)
            grads, at_rows, d_rows = gradients(words, starts, rows, sample.y[own], table, filters, biases, dense, bias)
            at += 1
            for v, (m, s), d in zip(values, moments, grads, strict=True):
                m += 0.1 * (d - m)
                s += 0.01 * (d * d - s)
                v -= rate * (m / (1 - 0.9**at)) / (np.sqrt(s / (1 - 0.99**at)) + 1e-6)
            # Rows that a batch doesn't touch stay as they are; a row's rate falls with all its gradients so far.
            s_table[at_rows] += (d_rows * d_rows).sum(axis=1)
            m_table[at_rows] = 0.5 * m_table[at_rows] + d_rows
            table[at_rows] -= 5 * rate * m_table[at_rows] / np.sqrt(s_table[at_rows] + 1e-4)[:, None]
    return ToxicModel(table, filters, biases, dense, float(bias[0]))


def gradients(words: np.ndarray, starts: np.ndarray, rows: np.ndarray, y: np.ndarray, table: np.ndarray, filters: list[np.ndarray], biases: list[np.ndarray], dense: np.ndarray, bias: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Gradients of the mean log loss (of filters, biases, dense layer and its bias; then of the embedding rows that have one); the chosen windows alone pass it back."""
    embedded = embed(table, rows)
    h, chosen = pooled(words, starts, embedded, filters, biases)
    live = np.maximum(h, 0)
    p = sigmoid(live.reshape(len(y), -1) @ dense.ravel() + bias[0])
    d = ((p - y) / len(y)).astype(np.float32)
    d_dense = np.tensordot(d, live, axes=1) + 1e-4 * dense
    d_h = d[:, None, None, None] * dense * (h > 0)
    d_filters, d_biases = [], []
    d_words = np.zeros_like(embedded)
    for w, (taps, top) in enumerate(zip(filters, chosen, strict=True)):
        g = d_h[:, w]
        d_taps = 1e-4 * taps
        for k in range(len(taps)):
            own = words[top + k]
            d_taps[k] += np.einsum("dlf,dlfe->ef", g, embedded[own])
            np.add.at(d_words, own.ravel(), (g[..., None] * taps[k].T).reshape(-1, DIMENSIONS))
        d_filters.append(d_taps)
        d_biases.append(g.sum(axis=(0, 1)))
    used = np.flatnonzero((d_words[1:] != 0).any(axis=1))
    at_rows, place = np.unique(rows[used], return_inverse=True)
    d_rows = np.zeros((len(at_rows), DIMENSIONS), np.float32)
    np.add.at(d_rows, place.reshape(len(used), -1), d_words[1 + used][:, None])
    if len(at_rows) and at_rows[0] == 0:
        at_rows, d_rows = at_rows[1:], d_rows[1:]
    return [*d_filters, *d_biases, d_dense, np.array([d.sum()], np.float32)], at_rows, d_rows


def calibrated(scores: np.ndarray, y: np.ndarray, languages: list[str | None], least: int = 20) -> dict[str, float]:
    """For each language with ``least`` documents of either class the threshold of the best F1 on them, the one nearest to THRESHOLD of equals; THRESHOLD else."""
    out: dict[str, float] = {}
    names = np.array([x or "" for x in languages])
    for name in np.unique(names).tolist():
        own = names == name
        if min(y[own].sum(), (1 - y[own]).sum()) < least:
            continue
        best = max(((2 * ((s := scores[own] >= t) & (y[own] == 1)).sum() / max(s.sum() + y[own].sum(), 1), -abs(t - THRESHOLD), t) for t in np.arange(0.05, 0.96, 0.05)))
        out[name] = float(best[2])
    return out


def fit_network(sample: Sample, languages: list[str | None], folds: int = 3, epochs: int = 4) -> ToxicModel:
    """A network on all documents, with its curve and thresholds from what networks on the other folds say of each fold."""
    y, n = sample.y, np.arange(len(sample.y))
    if len(y) == 0 or min(y.sum(), (1 - y).sum()) < 2 * folds:
        return ToxicModel(np.zeros((1, DIMENSIONS)), [], [], np.zeros(0), 0.0, base=float((y.sum() + 1) / (len(y) + 2)))
    out = np.zeros(len(y))
    for k in range(folds):
        part, left = train(sample, n[n % folds != k], epochs), n[n % folds == k]
        for own in np.array_split(left, max(1, len(left) // 500)):
            index = np.concatenate([sample.index[sample.cuts[d] : sample.cuts[d + 1]] for d in own])
            cuts = np.concatenate([np.zeros(1, np.int64), np.cumsum(sample.cuts[own + 1] - sample.cuts[own])])
            used, place = np.unique(index, return_inverse=True)
            out[own] = part.logits(sample.rows[used], place, cuts)
    model = train(sample, n, epochs)
    model.slope, model.intercept = platt(out, y)
    model.thresholds = calibrated(sigmoid(model.slope * out + model.intercept), y, languages)
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 4_000, most_words: int = 2_000_000, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> ToxicModel:
    """Fit on at most ``most`` labelled documents that aren't held out, with ``most_words`` words in all (documents are taken whole).

    Only hashes of words reach the driver, 4 bytes a word and 16 for each different one. Languages are
    used for thresholds only.
    """
    language = col(lang) if lang in docs.columns else F.lit(None).cast("string")
    chosen = sampled(docs, labels, label, most, most_words, doc_id, text)
    rows = docs.select(col(doc_id).alias("_id"), col(text).alias("_text"), language.alias("_lang")).join(F.broadcast(chosen), "_id")

    def setup():
        words = Words()

        def work(texts: pa.Array) -> dict:
            rows, index, cuts = words(texts)
            values = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * _ROWS), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())
            used = pa.DictionaryArray.from_arrays(pa.array(index, pa.int32()), values).dictionary_decode() if len(rows) else pa.array([], pa.binary())
            return {"x": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), used)}

        return work

    made = arrow_map(rows, "_text", ["_id", "y", "_lang"], None, "x array<binary>", setup, arrow=True)
    found = made.groupBy("_id").agg(F.max("y").alias("y"), F.min(F.struct("_lang", "x")).alias("v")).select("_id", "y", "v.*").toArrow().sort_by("_id")
    words = found["x"].combine_chunks()
    encoded = words.flatten().dictionary_encode()
    table = np.frombuffer(b"".join(encoded.dictionary.to_pylist()), "<i4").reshape(-1, _ROWS)
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    return fit_network(Sample(table, encoded.indices.to_numpy(zero_copy_only=False), ends, found["y"].to_numpy().astype(np.int64)), found["_lang"].to_pylist())


def score_toxicity(docs: DataFrame, model: ToxicModel, text: str = "text", columns: list[str] | None = None, threshold: float = THRESHOLD, lang: str = "lang") -> DataFrame:
    """``columns`` of ``docs`` (all, if not given) with score (0 to 1), predicted (1 from ``threshold`` on) and rejected (1 from the language's threshold on).

    Only the text is scored; ``lang``, where it is among the columns, picks the threshold for
    rejected. Null and empty texts are texts without words. Rows are kept one for one; columns of the
    new names are replaced.
    """
    names = [c for c in (columns or docs.columns) if c not in ("score", "predicted", "rejected")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def setup():
        words = kept(("words",), Words)
        return lambda texts: {"score": pa.array(shared.value.score(texts, words))}

    scored = arrow_map(docs, text, names, None, "score double", setup, arrow=True)
    limit = F.lit(threshold)
    if lang in names and model.thresholds:
        for name, value in model.thresholds.items():
            limit = F.when(F.coalesce(col(lang), F.lit("")) == name, value).otherwise(limit)
    return scored.select(*(col(c) for c in names), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), (F.col("score") >= limit).cast("int").alias("rejected"))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and rejected of every document."""
    scored = score_toxicity(docs, fit_toxicity(docs, labels), columns=["doc_id", "lang"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "rejected")
