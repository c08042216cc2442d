"""Document quality by a regularised quadratic discriminant (op 7)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_map, col
from .labelled import held_out, platt, sampled, sigmoid

THRESHOLD = 0.7
#: Kinds of bytes that are counted: each row's characters are one kind; the rest of ASCII and other bytes are two more.
KINDS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!?", "|", "#$%&*+=@^~<>_\\/", "'\"()-:;"]
_OTHER, _WIDE = len(KINDS), len(KINDS) + 1
_KIND_OF = bytes(next((k for k, held in enumerate(KINDS) if chr(b) in held), _OTHER if b < 128 else _WIDE) for b in range(256))
SHARE_FLOOR = 1e-3


def statistics_of(texts: list[str | None]) -> np.ndarray:
    """Transformed statistics of each text: log sizes, logs of shares (from a floor) of bytes, words, lines and repeats."""
    out = np.zeros((len(texts), len(KINDS) + 2 + 11))
    for row, text in zip(out, texts, strict=True):
        data = (text or "").encode("utf-8", "surrogatepass")
        words = data.split()
        lines = [x for x in data.split(b"\n") if x.strip()]
        n, m = max(len(data), 1), max(len(words), 1)
        row[: len(KINDS) + 2] = np.log(np.bincount(np.frombuffer(data.translate(_KIND_OF), np.uint8), minlength=len(KINDS) + 2) / n + SHARE_FLOOR)
        size = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
        known = len(set(words)) / m
        pairs = len(set(zip(words, words[1:]))) / max(len(words) - 1, 1) if len(words) > 1 else 1.0
        mean_line = len(data) / max(len(lines), 1)
        row[len(KINDS) + 2 :] = (
            np.log1p(len(data)), np.log1p(len(words)), np.log1p(size.mean()), np.log1p(size.std()), np.log((size <= 3).mean() + SHARE_FLOOR), np.log((size >= 12).mean() + SHARE_FLOOR),
            np.log(known + SHARE_FLOOR), np.log(pairs + SHARE_FLOOR), np.log(len(set(lines)) / max(len(lines), 1) + SHARE_FLOOR), np.log1p(mean_line), np.log1p(len(lines)),
        )
    return out


@dataclass
class QualityModel:
    """Class means and shrunken covariances over standardised statistics; ``base`` is the score where there was nothing to learn."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    prior: float
    slope: float = 1.0
    intercept: float = 0.0
    base: float | None = None

    @cached_property
    def factors(self) -> list[tuple[np.ndarray, float]]:
        """For each class the inverse of its covariance's Cholesky factor and half its log determinant, made once."""
        lower = [np.linalg.cholesky(c) for c in self.covariances]
        return [(np.linalg.inv(f), float(np.log(np.diag(f)).sum())) for f in lower]

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0 plus the log prior odds, compressed: sign(d) log(1 + |d|)."""
        z = (x - self.centre) / self.scale
        density = [-0.5 * (((z - mean) @ inverse.T) ** 2).sum(axis=1) - half for mean, (inverse, half) in zip(self.means, self.factors, strict=True)]
        d = density[1] - density[0] + self.prior
        return np.sign(d) * np.log1p(np.abs(d))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.base is not None:
            return np.full(len(x), self.base)
        return sigmoid(self.slope * self.margin(x) + self.intercept)


def _fit(x: np.ndarray, y: np.ndarray, towards_pool: float, towards_ball: float) -> QualityModel:
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale < 1e-9, 1.0, scale)
    z = (x - centre) / scale
    means = np.stack([z[y == c].mean(axis=0) for c in (0, 1)])
    own = [np.cov(z[y == c].T, bias=True) if (y == c).sum() > 1 else np.eye(x.shape[1]) for c in (0, 1)]
    pool = (own[0] * (y == 0).sum() + own[1] * (y == 1).sum()) / len(y)
    mixed = [(1 - towards_pool) * c + towards_pool * pool for c in own]
    ball = np.eye(x.shape[1])
    shrunk = np.stack([(1 - towards_ball) * c + towards_ball * (np.trace(c) / len(c) + 1e-3) * ball for c in mixed])
    return QualityModel(centre, scale, means, shrunk, float(np.log((y == 1).sum() / (y == 0).sum())))


def fit_discriminant(x: np.ndarray, y: np.ndarray, folds: int = 4) -> QualityModel:
    """The shrinkages with the least log loss over folds; the score's curve is fitted to what the folds left out. Rows come in a fixed order."""
    if len(y) == 0 or min((y == 0).sum(), (y == 1).sum()) < 2 * folds:
        flat = np.zeros((2, x.shape[1]))
        return QualityModel(flat[0], flat[0] + 1, flat, np.stack([np.eye(x.shape[1])] * 2), 0.0, base=float((y.sum() + 1) / (len(y) + 2)))
    fold, best = np.arange(len(y)) % folds, None
    for pool in (0.0, 0.1, 0.4):
        for ball in (0.02, 0.1, 0.3):
            out = np.zeros(len(y))
            for k in range(folds):
                out[fold == k] = _fit(x[fold != k], y[fold != k], pool, ball).margin(x[fold == k])
            slope, intercept = platt(out, y)
            p = np.clip(sigmoid(slope * out + intercept), 1e-6, 1 - 1e-6)
            loss = -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
            if best is None or loss < best[0] - 1e-9:
                best = loss, pool, ball, slope, intercept
    model = _fit(x, y, best[1], best[2])
    model.slope, model.intercept = best[3], best[4]
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 20_000, doc_id: str = "doc_id", text: str = "text") -> QualityModel:
    """Fit on the statistics of at most ``most`` labelled documents that aren't held out; only statistics reach the driver."""
    rows = docs.select(col(doc_id).alias("_id"), col(text).alias("_text")).join(F.broadcast(sampled(docs, labels, label, most, None, doc_id, text)), "_id")
    made = arrow_map(rows, "_text", ["_id", "y"], lambda texts: {"x": pa.array(list(statistics_of(texts)), pa.list_(pa.float64()))}, "x array<double>")
    found = made.groupBy("_id").agg(F.max("y").alias("y"), F.min("x").alias("x")).toPandas().sort_values("_id")
    width = statistics_of([""]).shape[1]
    return fit_discriminant(np.stack(found["x"].to_list()) if len(found) else np.zeros((0, width)), found["y"].to_numpy(np.int64))


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", columns: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``columns`` of ``docs`` (all, if not given) with score (0 to 1) and predicted (1 from ``threshold`` on).

    Only the text is scored. Null and empty texts have the statistics of an empty text. Rows are kept
    one for one; columns named score or predicted are replaced.
    """
    kept = [c for c in (columns or docs.columns) if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: list) -> dict:
        score = shared.value.score(statistics_of(texts))
        return {"score": pa.array(score), "predicted": pa.array((score >= threshold).astype(np.int32))}

    return arrow_map(docs, text, kept, work, "score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score_quality(docs, fit_quality(docs, labels), columns=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
