"""Directly addressable codes: integers cut into 8-bit levels, with continuation bitmaps and rank directories.

Level k holds one byte of each id that has more than k bytes; a bitmap beside it tells which of its
entries go on to level k+1, and a directory holds the number of set bits before every 512th bit.
So the id at any place is read with one byte, one bit and one rank a level; no block is decoded.

A token file is: magic, number of documents, number of ids, document ids, lengths, then the levels.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

MAGIC = b"LWDAC1\0\0"
RANK_STEP = 512
LEVELS = 4


def encode_levels(ids: np.ndarray) -> bytes:
    """The levels of unsigned 32-bit ids."""
    out, rest = [], ids.astype("<u4")
    for _ in range(LEVELS):
        goes_on = rest > 255
        bits = np.packbits(goes_on, bitorder="little")
        ones = np.add.reduceat(goes_on, np.arange(0, len(rest), RANK_STEP), dtype="<u4") if len(rest) else np.zeros(0, "<u4")
        ranks = np.concatenate([np.zeros(1, "<u4"), np.cumsum(ones, dtype="<u4")])[:-1] if len(rest) else ones
        out.append(struct.pack("<Q", len(rest)) + (rest & 255).astype(np.uint8).tobytes() + bits.tobytes() + ranks.astype("<u4").tobytes())
        rest = rest[goes_on] >> 8
        if not len(rest):
            break
    return struct.pack("<B", len(out)) + b"".join(out)


class Levels:
    """Random access to the ids of ``encode_levels``."""

    def __init__(self, data: memoryview | bytes, at: int = 0):
        self.levels = []
        (n,) = struct.unpack_from("<B", data, at)
        at += 1
        for _ in range(n):
            (size,) = struct.unpack_from("<Q", data, at)
            at += 8
            low = np.frombuffer(data, np.uint8, size, at)
            bits = np.frombuffer(data, np.uint8, (size + 7) // 8, at + size)
            at += size + len(bits)
            ranks = np.frombuffer(data, "<u4", -(-size // RANK_STEP), at)
            at += ranks.nbytes
            self.levels.append((low, bits, ranks))
        self.end = at

    def __len__(self) -> int:
        return len(self.levels[0][0])

    @staticmethod
    def rank(level: tuple, at: int) -> int:
        """Set bits before bit ``at``."""
        _, bits, ranks = level
        block = at // RANK_STEP
        first = block * RANK_STEP // 8
        head = int(np.bitwise_count(bits[first : at // 8]).sum())
        tail = int(bits[at // 8] & ((1 << at % 8) - 1)).bit_count() if at % 8 else 0
        return int(ranks[block]) + head + tail

    def __getitem__(self, at: int) -> int:
        value = 0
        for k, level in enumerate(self.levels):
            low, bits, _ = level
            value |= int(low[at]) << 8 * k
            if not bits[at // 8] >> at % 8 & 1:
                return value
            at = self.rank(level, at)
        return value

    def span(self, start: int, stop: int) -> np.ndarray:
        """The ids of places ``start`` to ``stop``, level by level, without those before them."""
        if stop <= start:
            return np.zeros(0, "<u4")
        levels, first, size = [], start, stop - start
        for level in self.levels:
            low, bits, _ = level
            on = np.unpackbits(bits[first // 8 : (first + size + 7) // 8], bitorder="little")[first % 8 :][:size].astype(bool)
            levels.append((low[first : first + size].astype("<u4"), on))
            size = int(on.sum())
            if not size:
                break
            first = self.rank(level, first)
        values = levels[-1][0]
        for low, on in reversed(levels[:-1]):
            whole = low.copy()
            whole[on] |= values << 8
            values = whole
        return values


def write_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """One token file. A null document id is kept by a flag."""
    known = np.array([d is not None for d in doc_ids], bool)
    head = MAGIC + struct.pack("<QQ", len(doc_ids), len(ids))
    names = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.packbits(known).tobytes()
    return head + names + np.array(lengths, "<u4").tobytes() + encode_levels(ids)


def read_file(data: bytes) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(document id, place of its first id in the file, its ids) in the file's order."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, n_ids = struct.unpack_from("<QQ", data, 8)
    at = 24
    names = np.frombuffer(data, "<i8", docs, at)
    at += names.nbytes
    known = np.unpackbits(np.frombuffer(data, np.uint8, (docs + 7) // 8, at))[:docs].astype(bool)
    at += (docs + 7) // 8
    lengths = np.frombuffer(data, "<u4", docs, at)
    levels = Levels(data, at + lengths.nbytes)
    if len(levels) != n_ids or int(lengths.sum()) != n_ids:
        raise ValueError("a token file's lengths disagree")
    place = 0
    for name, ok, size in zip(names.tolist(), known.tolist(), lengths.tolist(), strict=True):
        yield name if ok else None, place, levels.span(place, place + size)
        place += size
