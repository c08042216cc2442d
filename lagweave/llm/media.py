"""Media columns: documents' bytes as PNG images in a binary column, read back and described (op 4)."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_map, staged
from .png import cosine_hash, read_png, write_png

#: Payloads are padded to a positive multiple of this many bytes.
ROW = 576
PAD = 255


#: Divisors of a row that images are wide: the largest that is at most twice the root of the payload.
WIDTHS = (576, 288, 192, 144, 96, 72, 48)


def to_image(data: bytes) -> np.ndarray:
    """The bytes and bytes of 255 up to a positive multiple of 576, as rows of a width that makes a not too flat image of it."""
    size = max(1, -(-len(data) // ROW)) * ROW
    out = np.full(size, PAD, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(-1, next(w for w in WIDTHS if w * w <= 4 * size))


def store_images(docs: DataFrame, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all but the text, if not given) with n_bytes and media, a PNG of the text's UTF-8 bytes.

    Null texts are empty: 576 bytes of padding. Rows are kept one for one; columns of the new names
    are replaced.
    """
    kept = [c for c in (columns or docs.columns) if c not in ("n_bytes", "media") and (columns or c != text)]

    def work(texts: list) -> dict:
        data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        return {"n_bytes": pa.array([len(d) for d in data], pa.int64()), "media": pa.array([write_png(to_image(d)) for d in data], pa.binary())}

    return arrow_map(docs, text, kept, work, "n_bytes long, media binary")


def describe_images(images: DataFrame, media: str = "media") -> DataFrame:
    """``images`` without ``media``, with payload_bytes, payload_sha256, tail_crc32 (last 32 bytes), media_bytes, media_sha256 and feature.

    Images are decoded with every checksum tested; a broken one ends the job with a PngError. A null
    image gives nulls. feature is the cosine hash in hex.
    """
    new = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [c.split()[0] for c in new.split(", ")]

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * len(names)
        image = read_png(data)
        payload = image.tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(image).hex()

    def work(column: list) -> dict:
        rows = list(zip(*map(one, column), strict=True)) or [()] * len(names)
        return {n: pa.array(r, pa.string() if n in ("payload_sha256", "media_sha256", "feature") else pa.int64()) for n, r in zip(names, rows, strict=True)}

    return arrow_map(images, media, [c for c in images.columns if c not in (*names, media)], work, new)


def media_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the description of every document's stored image."""
    stored = staged(store_images(docs, columns=["doc_id"]), "media")
    return describe_images(stored).select("doc_id", F.col("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
