"""Lossless coding of integer signals: prediction, residuals and independent segments.

A segment is decoded from a fresh state, so segments are the unit of parallel work: one group each.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import reflection_lattice
from ..functions.rangecoder import Decoder, Encoder, Signed
from .signals import div

#: Samples of a segment; nothing is carried from one to the next.
SEGMENT = 4096
ORDERS = 4
TAPS = 8
SHIFT = 12


def fixed_residual(x: np.ndarray, order: int) -> np.ndarray:
    """Differences of the given order, history before the first sample being zero."""
    return np.diff(x, n=order, prepend=np.zeros(order, np.int64)) if order else x.copy()


def undo_fixed(r: np.ndarray, order: int) -> np.ndarray:
    for _ in range(order):
        r = np.cumsum(r)
    return r


def bits_of(r: np.ndarray) -> float:
    return float(np.log2(1 + np.abs(r)).sum())


def linear_coefficients(x: np.ndarray, taps: int = TAPS) -> np.ndarray:
    """Predictor weights in units of 2**-SHIFT, from the tapered signal's autocorrelation."""
    w = x * np.hanning(len(x) + 2)[1:-1]
    a, _, _ = reflection_lattice(w.astype(float), taps)
    return np.clip(np.round(a * (1 << SHIFT)), -(1 << 15), (1 << 15) - 1).astype(np.int64)


def predict_linear(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Integer predictions of each sample from those before it, zeros before the first."""
    padded = np.concatenate([np.zeros(len(weights), np.int64), x])
    total = np.zeros(len(x), np.int64)
    for k, w in enumerate(weights.tolist(), 1):
        total += w * padded[len(weights) - k : len(padded) - k]
    return total + (1 << SHIFT - 1) >> SHIFT


def undo_linear(r: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out, taps = [0] * len(weights), weights.tolist()
    for v in r.tolist():
        out.append(v + (sum(w * out[-k] for k, w in enumerate(taps, 1)) + (1 << SHIFT - 1) >> SHIFT))
    return np.array(out[len(taps) :], np.int64)


class SignStage:
    """A sign-sign least-mean-squares predictor over the residual of the stage before: weights move by the signs of error and history."""

    def __init__(self, taps: int = 16, shift: int = 14):
        self.weights, self.history, self.shift = [0] * taps, [0] * taps, shift

    def predict(self) -> int:
        return sum(w * h for w, h in zip(self.weights, self.history, strict=True)) + (1 << self.shift - 1) >> self.shift

    def update(self, value: int, error: int) -> None:
        if error:
            step = 8 if error > 0 else -8
            self.weights = [max(-32768, min(32767, w + (step if h > 0 else -step if h < 0 else 0))) for w, h in zip(self.weights, self.history, strict=True)]
        self.history = [value, *self.history[:-1]]


def encode_segment(x: np.ndarray) -> bytes:
    """Fixed order or linear predictor, whichever leaves less, then a sign stage; residuals by running magnitude. Plain 64-bit samples where those are shorter."""
    fixed = [fixed_residual(x, k) for k in range(ORDERS)]
    costs = [bits_of(r) for r in fixed]
    order, weights, base = int(np.argmin(costs)), None, None
    base = fixed[order]
    if len(x) > 4 * TAPS and np.abs(x).max() < 1 << 40:
        candidate = linear_coefficients(x)
        r = x - predict_linear(x, candidate)
        if bits_of(r) + 16 * TAPS < costs[order]:
            order, weights, base = ORDERS, candidate, r
    head = struct.pack("<IB", len(x), order) + (weights.astype("<i2").tobytes() if weights is not None else b"")
    coder, model, stage, mean = Encoder(), Signed(48), SignStage(), 0
    for v in base.tolist():
        e = v - stage.predict()
        model.encode(coder, min(mean.bit_length(), 47), e)
        mean += abs(e) * 16 - mean >> 4
        stage.update(v, e)
    body = coder.finish()
    if len(head) + len(body) > 5 + 8 * len(x):
        return struct.pack("<IB", len(x), 255) + x.astype("<i8").tobytes()
    return head + body


def decode_segment(data: bytes) -> np.ndarray:
    n, order = struct.unpack_from("<IB", data)
    if order == 255:
        return np.frombuffer(data, "<i8", n, 5).astype(np.int64)
    weights = np.frombuffer(data, "<i2", TAPS, 5).astype(np.int64) if order == ORDERS else None
    coder, model, stage, mean = Decoder(data[5 + (2 * TAPS if order == ORDERS else 0) :]), Signed(48), SignStage(), 0
    out = []
    for _ in range(n):
        e = model.decode(coder, min(mean.bit_length(), 47))
        v = e + stage.predict()
        mean += abs(e) * 16 - mean >> 4
        stage.update(v, e)
        out.append(v)
    r = np.array(out, np.int64)
    return undo_linear(r, weights) if weights is not None else undo_fixed(r, order)


def encode(signal: DataFrame, by: tuple[str, ...] = (), segment: int = SEGMENT) -> DataFrame:
    """``by``, seg, start, count, payload, crc32: each segment of a dense integer signal (n, x) coded on its own."""
    rows = signal.withColumn("seg", div("n", segment)).groupBy(*by, "seg").agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("v"))
    rows = rows.select(*by, "seg", F.element_at("v", 1)["n"].alias("start"), F.size("v").cast("long").alias("count"), F.transform("v", lambda p: p["x"]).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [encode_segment(np.asarray(x.as_py(), np.int64)) for x in b.column("x")]
            kept = [b.column(k) for k in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(data, pa.binary())], names=[*b.schema.names[:-1], "payload"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{head}, payload binary").withColumn("crc32", F.crc32("payload"))


def decode(blocks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, n, x of all segments, each decoded on its own; a block whose checksum differs ends the job."""
    wanted = blocks.select(*by, "start", "payload", "crc32")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                data, crc = b.column("payload")[k].as_py(), b.column("crc32")[k].as_py()
                if zlib.crc32(data) != crc:
                    raise ValueError("a block's checksum differs")
                x = decode_segment(data)
                start = b.column("start")[k].as_py()
                names = [pa.array([b.column(c)[k].as_py()] * len(x), b.schema.field(c).type) for c in by]
                yield pa.RecordBatch.from_arrays([*names, pa.array(start + np.arange(len(x))), pa.array(x)], names=[*by, "n", "x"])

    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in wanted.select(*by).schema)
    return wanted.mapInArrow(run, f"{head}n long, x long")


def describe(blocks: DataFrame) -> str:
    """A summary of coded blocks as one line of JSON."""
    r = blocks.agg(F.count("*"), F.sum("count"), F.sum(F.octet_length("payload"))).first()
    return json.dumps({"blocks": r[0], "samples": r[1], "bytes": r[2]})
