"""SentencePiece encoding and decoding of documents (op 3)."""

from __future__ import annotations

import hashlib
import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import arrow_map, kept
from .bytepairs import read_blob
from .pieces import Encoded, PieceEncoder


def encode_pieces(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``docs`` (without ``text``) with ids (begin and end included), starts and stops (byte spans of the text for the ids between), decoded.

    Null texts are empty: begin and end only, no spans, decoded "". Rows are kept one for one,
    repeated ones too; columns of the same names are replaced. A span runs from a piece's first byte
    in the original UTF-8 text to the byte after its last; pieces of one character share its bytes.
    """
    return _mapped(docs, model, text, "ids array<int>, starts array<int>, stops array<int>, decoded string", _lists)


def piece_digests(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``docs`` (without ``text``) with n_tokens, ids_sha256, decoded_sha256 and spans_crc32, made from what encode_pieces makes, without moving it."""
    return _mapped(docs, model, text, "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long", _digests)


def _listed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values.astype(np.int32)))


def _inner(cuts: np.ndarray) -> np.ndarray:
    """Cuts of the ids without begin and end."""
    return cuts - 2 * np.arange(len(cuts))


def _lists(e: Encoded) -> dict:
    spans = _inner(e.cuts)
    decoded = pa.StringArray.from_buffers(len(e.cuts) - 1, pa.py_buffer(e.decoded_cuts.astype(np.int32)), pa.py_buffer(e.decoded))
    return {"ids": _listed(e.ids, e.cuts), "starts": _listed(e.starts, spans), "stops": _listed(e.stops, spans), "decoded": decoded}


def _digests(e: Encoded) -> dict:
    ids, decoded, spans = memoryview(e.ids.tobytes()), memoryview(e.decoded.tobytes()), memoryview(np.stack([e.starts, e.stops], axis=1).astype("<i8").tobytes())
    return {
        "n_tokens": pa.array(np.diff(e.cuts), pa.int64()),
        "ids_sha256": pa.array([hashlib.sha256(ids[4 * a : 4 * b]).hexdigest() for a, b in pairwise(e.cuts.tolist())], pa.string()),
        "decoded_sha256": pa.array([hashlib.sha256(decoded[a:b]).hexdigest() for a, b in pairwise(e.decoded_cuts.tolist())], pa.string()),
        "spans_crc32": pa.array([zlib.crc32(spans[16 * a : 16 * b]) for a, b in pairwise(_inner(e.cuts).tolist())], pa.int64()),
    }


def _mapped(docs: DataFrame, model: str, text: str, schema: str, made) -> DataFrame:
    blob = docs.sparkSession.sparkContext.broadcast(read_blob(model))
    new = {c.split()[0] for c in schema.split(", ")}

    def setup():
        encoder = kept(("piece encoder", zlib.crc32(blob.value)), lambda: PieceEncoder(blob.value))
        return lambda texts: made(encoder.encode(texts))

    return arrow_map(docs, text, [c for c in docs.columns if c not in new | {text}], None, schema, setup, arrow=True)
