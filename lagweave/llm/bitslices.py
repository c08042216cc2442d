"""Exact top-k inner products over a bit-sliced index (op 6).

A block of rows keeps each quantised attribute as bitmaps, one for each binary digit. A query's scores
are made by bitmap arithmetic alone: shifted slices, added by carry-save adders into the slices of
the sum. The top rows are selected from the sum's most significant slice downward; rows equal at the
boundary are resolved by their ids.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import col, release, staged

SCALE = 64
#: Rows of an index block and queries of a query block: the bounds of a task's group.
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 1_024
#: Quantised components are held within this, so that sums of 2^25 products fit in 38 digits.
LARGEST = 1 << 50


class BitSlices:
    """The index of one block: its rows' ids in order, for each attribute its smallest value and the slices of what is above it."""

    def __init__(self, ids: np.ndarray, base: np.ndarray, slices: list[list[np.ndarray]]):
        self.ids, self.base, self.slices = ids, base, slices
        self.words = -(-len(ids) // 64)
        self.top = [(1 << len(s)) - 1 for s in slices]

    @classmethod
    def of(cls, ids: np.ndarray, values: np.ndarray) -> BitSlices:
        order = np.argsort(ids, kind="stable")
        ids, values = ids[order], values[order]
        base = values.min(axis=0) if len(ids) else np.zeros(values.shape[1], np.int64)
        padded = np.zeros((values.shape[1], -(-len(ids) // 64) * 64), np.int64)
        padded[:, : len(ids)] = (values - base).T
        depth = [int(m).bit_length() for m in padded.max(axis=1)] if len(ids) else [0] * values.shape[1]
        return cls(ids, base, [[np.packbits((a >> k & 1).astype(np.uint8), bitorder="little").view(np.uint64) for k in range(n)] for a, n in zip(padded, depth, strict=True)])

    def pack(self) -> bytes:
        """Number of rows and attributes, ids, smallest values, numbers of slices, slices."""
        sizes = np.array([len(s) for s in self.slices], "<i4")
        return struct.pack("<QQ", len(self.ids), len(self.slices)) + self.ids.astype("<i8").tobytes() + self.base.astype("<i8").tobytes() + sizes.tobytes() + b"".join(s.tobytes() for own in self.slices for s in own)

    @classmethod
    def unpack(cls, data: bytes) -> BitSlices:
        rows, width = struct.unpack_from("<QQ", data)
        ids = np.frombuffer(data, "<i8", rows, 16)
        base = np.frombuffer(data, "<i8", width, 16 + 8 * rows)
        sizes = np.frombuffer(data, "<i4", width, 16 + 8 * (rows + width)).tolist()
        words, at, slices = -(-rows // 64), 16 + 8 * (rows + width) + 4 * width, []
        for n in sizes:
            slices.append(list(np.frombuffer(data[at : at + 8 * words * n], "<u8").reshape(n, words)))
            at += 8 * words * n
        return cls(ids, base, slices)

    def sums(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the non-negative sums, least significant first, and what to add for scores; as many as the sums have bits.

        A negative factor takes an attribute's complement within its slices, so all terms are
        non-negative.
        """
        columns: list[list[np.ndarray]] = []
        offset = 0
        for q, base, slices, top in zip(query.tolist(), self.base.tolist(), self.slices, self.top, strict=True):
            offset += q * base
            if q == 0 or not slices:
                continue
            if q < 0:
                slices, q, offset = [~s for s in slices], -q, offset + q * top
            while len(columns) < q.bit_length() + len(slices):
                columns.append([])
            for shift in range(q.bit_length()):
                if q >> shift & 1:
                    for k, s in enumerate(slices):
                        columns[shift + k].append(s)
        out, k = [], 0
        while k < len(columns):
            column = columns[k]
            if len(column) > 1 and k + 1 == len(columns):
                columns.append([])
            while len(column) > 2:
                a, b, c = column.pop(), column.pop(), column.pop()
                half = a ^ b
                column.append(half ^ c)
                columns[k + 1].append((a & b) | (half & c))
            if len(column) == 2:
                a, b = column
                column[:] = [a ^ b]
                columns[k + 1].append(a & b)
            out.append(column[0] if column else np.zeros(self.words, np.uint64))
            k += 1
        return out, offset

    def top_rows(self, slices: list[np.ndarray], k: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bitmaps of rows surely among the top k and of rows equal at the boundary."""
        sure, open_rows = np.zeros(self.words, np.uint64), allowed.copy()
        held = 0
        for s in reversed(slices):
            ones = open_rows & s
            n = int(np.bitwise_count(ones).sum())
            if held + n > k:
                open_rows = ones
            else:
                sure, held = sure | ones, held + n
                open_rows = open_rows & ~s
                if held == k:
                    open_rows = np.zeros_like(open_rows)
                    break
        return sure, open_rows

    def values_at(self, slices: list[np.ndarray], rows: np.ndarray, offset: int) -> list[int]:
        """Scores of some rows, from the bits of their sums."""
        low, high = np.zeros(len(rows), np.int64), [0] * len(rows)
        for k, s in enumerate(slices):
            bit = (s[rows >> 6] >> (rows & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            if k < 62:
                low |= bit << k
            elif bit.any():
                high = [h + (int(b) << k) for h, b in zip(high, bit, strict=True)]
        return [h + v + offset for h, v in zip(high, low.tolist(), strict=True)]

    def best(self, name: int, query: np.ndarray, k: int) -> tuple[np.ndarray, list[int]]:
        """Ids and scores of the top k rows of other ids, ties to the smaller."""
        slices, offset = self.sums(query)
        allowed = np.packbits(np.arange(self.words * 64) < len(self.ids), bitorder="little").view(np.uint64)
        for r in range(*np.searchsorted(self.ids, [name, name + 1])):
            allowed[r >> 6] &= ~np.uint64(1 << (r & 63))
        sure, equal = self.top_rows(slices, k, allowed)
        rows = _rows_of(sure)
        rows = np.concatenate([rows, _rows_of(equal)[: k - len(rows)]])  # rows are in the order of ids
        return self.ids[rows], self.values_at(slices, rows, offset)


def _rows_of(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def build_index(rows: DataFrame, blocks: int) -> DataFrame:
    """length, block, bits: one packed BitSlices for each block and length of vectors of ``rows`` (id, v), staged.

    Rows are dealt by a hash of all that is theirs and of their place, so that a repeated row fills no block.
    """
    block = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            key = held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py()
            bits = BitSlices.of(np.concatenate([b.column(2).to_numpy() for b in held]), np.concatenate([_vectors(b.column(3)) for b in held])).pack()
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([bits], pa.binary())], names=["length", "block", "bits"])

        for batch in batches:
            key = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and (held[0].column(0)[0].as_py() << 32 | held[0].column(1)[0].as_py()) != key[a]:
                    yield packed()
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield packed()
        release()

    dealt = rows.select(F.size("v").alias("length"), block.alias("block"), "id", "v").repartition(blocks, "length", "block").sortWithinPartitions("length", "block")
    return staged(dealt.mapInArrow(build, "length int, block int, bits binary"), "bit-slices")


def top_inner_products(vectors: DataFrame, every: int = 20, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's ``k`` highest integer inner products, ties to the smaller id.

    Components become floor(scale * x), x as double, held within 2^50 either way; sums are exact, and a
    score beyond a long is ranked as it is and given as the nearest long. Queries are the rows whose
    id is divisible by ``every``; candidates are all rows of other ids and the same length. Rows that
    are null, hold null or non-finite components, have none or have a null id take no part. A repeated
    row is a candidate as often as it occurs; a repeated query id queries once a length, with its
    greatest vector. An empty table gives no rows.

    Rows are dealt into blocks, whose index is built once and kept as a binary row; each block of
    queries is read past each block's index, and a block's top k are all that leaves it.
    """
    x = col(embedding).cast("array<double>")
    fine = vectors.filter(col(vec_id).isNotNull() & col(embedding).isNotNull() & (F.size(col(embedding)) > 0) & F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False))))
    held = lambda v: F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), F.floor(v * scale).cast("double"))).cast("long")
    fine = staged(fine.select(col(vec_id).cast("long").alias("id"), F.transform(x, held).alias("v")), "quantised")
    asked = F.col("id") % every == 0
    rows, queries_in = fine.agg(F.count("*"), F.count(F.when(asked, 1))).first()
    row_blocks, query_blocks = max(1, -(-rows // BLOCK_ROWS)), max(1, -(-queries_in // BLOCK_QUERIES))
    index = build_index(fine, row_blocks)
    queries = fine.filter(asked).groupBy("id", F.size("v").alias("length")).agg(F.max("v").alias("v"))
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    none = lambda kind: F.lit(None).cast(kind)
    left = index.select("length", "block", each(query_blocks, "part"), "bits", none("long").alias("id"), none("array<bigint>").alias("v"))
    right = queries.select("length", each(row_blocks, "block"), F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int").alias("part"), none("binary").alias("bits"), "id", "v")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, key = None, None
        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
            made: list[tuple] = []
            for at, name in enumerate(names):
                if name != key:
                    blocks, key = None, name
                bits = batch.column(3)[at]
                if bits.is_valid:
                    blocks = BitSlices.unpack(bits.as_py())
                elif blocks is not None:  # a block may have no rows of that length
                    query = batch.column(4)[at].as_py()
                    made += ((query, i, s) for i, s in zip(*blocks.best(query, batch.column(5)[at].values.to_numpy(), k), strict=True))
            found = list(zip(*made, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(np.array(found[1], np.int64)), pa.array(list(map(Decimal, found[2])), pa.decimal128(38, 0))], names=["query_id", "vec_id", "score"])
        release()

    # As many partitions as pairs of blocks, so that they rarely share a task; the index comes before its queries.
    both = left.union(right.select(*left.columns)).repartition(row_blocks * query_blocks, "length", "block", "part").sortWithinPartitions("length", "block", "part", F.col("bits").isNull())
    found = both.mapInArrow(search, "query_id long, vec_id long, score decimal(38,0)")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    limits = F.lit(-(1 << 63)).cast("decimal(38,0)"), F.lit((1 << 63) - 1).cast("decimal(38,0)")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", F.greatest(limits[0], F.least(limits[1], F.col("score"))).cast("long").alias("score"))
