"""WAV files as DataFrames: RIFF, RF64/BW64 and Wave64, read from the store by Spark and parsed in Arrow batches; and written."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the formats: tags of sample kinds, and the identifiers of Wave64 chunks, which continue their four letters.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
_RIFF64 = bytes.fromhex("2e91cf11a5d628db04c10000")
_REST64 = bytes.fromhex("f3acd3118cd100c04f8edb8a")
UNKNOWN = 0xFFFFFFFF


class WavError(ValueError):
    """Not a WAV file of a kind that can be read."""


def _chunks(data: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, size) of each chunk; sizes that are unknown or reach past the end are cut to it."""
    if data[:4] == b"riff" and data[4:16] == _RIFF64:
        at = 40
        while at + 24 <= len(data):
            (size,) = struct.unpack_from("<Q", data, at + 16)
            yield data[at : at + 4], at + 24, min(max(size - 24, 0), len(data) - at - 24)
            at += max(24, size + 7 & ~7)
        return
    if data[:4] not in (b"RIFF", b"RF64", b"BW64") or data[8:12] != b"WAVE":
        raise WavError("no RIFF, RF64, BW64 or Wave64 header")
    at, wide = 12, None
    while at + 8 <= len(data):
        kind, (size,) = data[at : at + 4], struct.unpack_from("<I", data, at + 4)
        if kind == b"ds64":
            (wide,) = struct.unpack_from("<Q", data, at + 16)
        if kind == b"data":
            if size == UNKNOWN and wide is not None:
                size = wide
            if size in (0, UNKNOWN) or at + 8 + size > len(data):
                size = len(data) - at - 8
        yield kind, at + 8, min(size, len(data) - at - 8)
        at += 8 + size + (size & 1)


def parse(data: bytes) -> dict:
    """rate, bits, exact and samples (n, channels): integers as they are, floats scaled to 24 bits if they are on that grid (else exact is false)."""
    form, body = None, None
    for kind, at, size in _chunks(data):
        if kind == b"fmt ":
            form = (*struct.unpack_from("<HHIIHH", data, at), struct.unpack_from("<H", data, at + 24)[0] if size >= 26 else 0)
        elif kind == b"data" and body is None:
            body = data[at : at + size]
    if form is None or body is None:
        raise WavError("no format or no data")
    tag, channels, rate, _, _, bits, sub = form
    tag = sub if tag == EXTENSIBLE else tag
    if not 1 <= channels <= 32 or (tag, bits) not in {(PCM, 8), (PCM, 16), (PCM, 24), (PCM, 32), (FLOAT, 32)}:
        raise WavError(f"format {tag} of {bits} bits and {channels} channels")
    body = body[: len(body) // (bits // 8 * channels) * (bits // 8 * channels)]
    exact = True
    if tag == FLOAT:
        f = np.frombuffer(body, "<f4").astype(float) * (1 << 23)
        x = np.floor(f + 0.5).astype(np.int64)
        exact, bits = bool((x == f).all()), 24
    elif bits == 8:
        x = np.frombuffer(body, np.uint8).astype(np.int64) - 128
    elif bits == 24:
        b = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int64)
        x = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
        x = np.where(x >= 1 << 23, x - (1 << 24), x)
    else:
        x = np.frombuffer(body, "<i2" if bits == 16 else "<i4").astype(np.int64)
    return {"rate": rate, "bits": bits, "exact": exact, "samples": x.reshape(-1, channels)}


def build(samples: np.ndarray, rate: int, bits: int = 16) -> bytes:
    """A RIFF file of integer samples (n, channels), clamped to 16, 24 or 32 bits."""
    if bits not in (16, 24, 32):
        raise WavError(f"{bits} bits can't be written")
    x = np.clip(samples, -(1 << bits - 1), (1 << bits - 1) - 1).astype("<i4")
    body = x.astype("<i2").tobytes() if bits == 16 else x.tobytes() if bits == 32 else np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()
    width = bits // 8 * samples.shape[1]
    head = struct.pack("<HHIIHH", PCM, samples.shape[1], rate, rate * width, width, bits)
    return b"RIFF" + struct.pack("<I", 36 + len(body) + (len(body) & 1)) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def read(spark: SparkSession, path: str, chunk: int = 65_536) -> DataFrame:
    """path, ch, start, rate, bits, exact, x: the samples of WAV files in chunks, through the store's own reader."""
    schema = "path string, ch int, start long, rate int, bits int, exact boolean, x array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                w = parse(data.as_py())
                for at in range(0, len(w["samples"]), chunk):
                    part = w["samples"][at : at + chunk]
                    n = part.shape[1]
                    columns = [[name] * n, range(n), [at] * n, [w["rate"]] * n, [w["bits"]] * n, [w["exact"]] * n]
                    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
                    yield pa.RecordBatch.from_arrays([*(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)), pa.array(list(part.T), pa.list_(pa.int64()))], names=[c.split()[0] for c in schema.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)
