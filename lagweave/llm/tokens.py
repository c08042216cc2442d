"""Token counts (op 8) and token files (op 9) over byte-level BPE."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import arrow_map, col, kept, partitions, release, slices, staged
from .bytepairs import IdEncoder, TokenCounter, read_blob
from .dac import read_file, write_file


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """``docs`` (without ``text``) with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Tokens are the initial symbols of each pre-token less the merges that a heap over a linked list
    makes; no identifiers are made. Null and empty texts have 0 bytes and 0 tokens. Every row is
    kept, repeated ones too; columns of the same names are replaced.
    """
    blob = docs.sparkSession.sparkContext.broadcast(read_blob(tokenizer))
    names = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit", text)]

    def setup():
        counter = kept(("token counter", zlib.crc32(blob.value)), lambda: TokenCounter(blob.value))

        def work(texts: pa.Array) -> dict:
            n = counter.counts(texts)
            return {"n_bytes": pc.binary_length(texts).fill_null(0).cast(pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array(n > limit)}

        return work

    return arrow_map(docs, text, names, None, "n_bytes long, n_tokens long, over_limit boolean", setup, arrow=True)


def with_end(ids: np.ndarray, cuts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """``ids`` with ``end_id`` after each document's, and where each document's begin (and the end)."""
    ends = cuts[1:] + np.arange(1, len(cuts))
    out = np.full(len(ids) + len(ends), end_id, "<u4")
    own = np.ones(len(out), bool)
    own[ends - 1] = False
    out[own] = ids
    return out, np.concatenate([np.zeros(1, np.int64), ends])


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", ids_a_file: int = 2_000_000) -> DataFrame:
    """Token files of all documents, in ascending document id, as a table in the shared folder: file_no, n_ids, payload.

    Each document's ids (by the tokenizers library, no special tokens added) are followed by
    ``end_id``. Files follow one another by ``file_no``; one holds ``ids_a_file`` ids, or one longer
    document. Null texts are empty; null ids come first; rows of one id come in the order of their
    texts' hashes, so results don't depend on the partitions.
    """
    blob = docs.sparkSession.sparkContext.broadcast(read_blob(tokenizer))
    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(partitions(docs), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(("id encoder", zlib.crc32(blob.value)), lambda: IdEncoder(blob.value))
        file_no = TaskContext.get().partitionId() << 32
        names, lengths, data, total = [], [], [], 0

        def file() -> pa.RecordBatch:
            payload = write_file([n for part in names for n in part], np.concatenate(lengths), np.concatenate(data))
            return pa.RecordBatch.from_arrays([pa.array([file_no], pa.int64()), pa.array([total], pa.int64()), pa.array([payload], pa.binary())], names=["file_no", "n_ids", "payload"])

        for part, texts in slices(batches, "text", arrow=True):
            ids, cuts = with_end(*encoder.ids(texts), end_id)
            own, at = part.column(0).to_pylist(), 0
            while at < len(own):
                # The first document with which the file is full, or the slice's last.
                stop = min(int(np.searchsorted(cuts, cuts[at] + ids_a_file - total)), len(own))
                names.append(own[at:stop])
                lengths.append(np.diff(cuts[at : stop + 1]))
                data.append(ids[cuts[at] : cuts[stop]])
                total += int(cuts[stop] - cuts[at])
                at = stop
                if total >= ids_a_file:
                    yield file()
                    file_no += 1
                    names, lengths, data, total = [], [], [], 0
        if total:
            yield file()
        del names, lengths, data
        release()

    return staged(rows.mapInArrow(run, "file_no long, n_ids long, payload binary"), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document in token files.

    The running total is over files, one narrow row each; documents only add their place in the file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(no, name, place, len(ids), zlib.crc32(ids.tobytes())) for name, place, ids in read_file(payload.as_buffer())]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["file_no", "doc_id", "place", "n_tokens", "ids_crc32"])
        release()

    docs = files.select("file_no", "payload").mapInArrow(run, "file_no long, doc_id long, place long, n_tokens long, ids_crc32 long")
    before = F.sum("n_ids").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1))
    starts = files.select("file_no", F.coalesce(before, F.lit(0)).alias("base"))
    return docs.join(starts, "file_no").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
