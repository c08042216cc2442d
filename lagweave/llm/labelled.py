"""Labelled samples for fitting: which rows may be learnt from, and a bounded choice of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import col, staged

FOLDS, HELD_OUT = 4, 2


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels are never learnt: crc32 of the id as text leaves 2 when divided by 4. A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def sampled(docs: DataFrame, labels: DataFrame, label: str, most: int, most_words: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Up to ``most`` ids of ``docs`` that may be learnt from, with y: those of the smallest hashes, so the choice is the same in every run.

    If ``most_words`` is given, they stop before the id with which their texts have more words than
    that together (the first one stays). Null labels are left out; an id with both labels counts as 1.
    """
    rows = labels.filter(F.col(label).isin(0, 1) & ~held_out(col("doc_id"))).groupBy(col("doc_id").alias("_id")).agg(F.max(label).cast("int").alias("y"))
    known = rows.join(docs.select(col(doc_id).alias("_id")), "_id", "left_semi")
    chosen = staged(known.orderBy(F.xxhash64("_id"), "_id").limit(most), "sample")
    if most_words is None:
        return chosen
    words = docs.select(col(doc_id).alias("_id"), col(text).alias("_text")).join(F.broadcast(chosen), "_id").groupBy("_id", "y").agg(F.max(F.coalesce(F.regexp_count("_text", F.lit(r"\S+")), F.lit(0))).alias("n"))
    order = Window.orderBy(F.xxhash64("_id"), "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return staged(words.withColumn("run", F.sum("n").over(order)).filter((F.col("run") <= most_words) | (F.col("run") == F.col("n"))).select("_id", "y"), "sample-words")


def platt(values: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope (not negative) and intercept of a logistic curve through ``values``, by Newton steps with a weak prior on the slope."""
    def loss(at: np.ndarray) -> float:
        t = at[0] * values + at[1]
        return float((np.logaddexp(0, t) - y * t).sum() + 0.005 * (at[0] - 1) ** 2)

    at = np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(at[0] * values + at[1])
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * values).sum() + 0.01 * (at[0] - 1), (p - y).sum()])
        h = np.array([[(w * values * values).sum() + 0.01, (w * values).sum()], [(w * values).sum(), w.sum() + 1e-6]])
        step, now = np.linalg.solve(h, g), loss(at)
        while loss(at - step) > now and np.abs(step).max() > 1e-9:
            step /= 2
        at = at - step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(at[0]), 0.0), float(at[1])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))
