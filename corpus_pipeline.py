"""A training corpus from raw documents: filters, near-dedup, mixing and encoding, one stage after another.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each to the shared
folder and reads it again for the next. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lagweave.llm import mixing, quality, sentencepieces, shingles, toxicity
from lagweave.llm.base import col, drop_staged, release, staged

#: The corpus keeps 90 of 100 tokens, in one epoch; web weighs half as much again as books and code.
MIX = mixing.Mix(weights={"domain": {"web": 3, "books": 2, "code": 2, "other": 2}, "lang": {"en": 6, "de": 2, "fr": 2}, "source": {"src0": 8}}, hundredths=90, epochs=1, seed=17)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quadratic discriminant scores 0.7 or more, in all their columns; all, if there were too few labels to fit one. A null text is scored as an empty one."""
    model = quality.fit_quality(docs, _labels(spark, sf_dir))
    release()  # the driver's memory that fitting took, too
    return docs if model.base is not None else _kept(docs, quality.score_quality(_apart(docs), model, text="_text"), "predicted = 1")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the convolutional classifier doesn't reject at their language's threshold, in all their columns; all, if there were too few labels to fit one."""
    model = toxicity.fit_toxicity(docs, _labels(spark, sf_dir))
    release()
    return docs if model.base is not None else _kept(docs, toxicity.score_toxicity(_apart(docs), model, text="_text", lang="_in_lang"), "rejected = 0")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each component of documents whose five-word shingles are 0.8 alike or more."""
    release()
    return shingles.deduplicated(docs, words=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, whole, each once: a leaf's last document isn't cut."""
    return mixing.mixed(docs, MIX, marks=False)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and digests of each document's pieces, decoded text and spans."""
    return sentencepieces.piece_digests(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"))


def _apart(docs: DataFrame) -> DataFrame:
    """The columns under names of their own, so that none clashes with a score's: _in_ before each, and _text."""
    return docs.select(*(col(c).alias(f"_in_{c}") for c in docs.columns), col("text").alias("_text"))


def _kept(docs: DataFrame, scored: DataFrame, condition: str) -> DataFrame:
    return scored.filter(condition).select(*(col(f"_in_{c}").alias(c) for c in docs.columns))


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near-dedup", dedup_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: The classifiers are trained: no SQL makes these rows. tests/llm checks every stage's rows against loops over its documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, in order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = staged(docs, f"stage-{at}")
            if before is not None:
                drop_staged(before)
            before = docs
    return docs
