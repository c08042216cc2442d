"""Texts cut into chunks that tokenize alike wherever they stand, and bounded tables of what chunks are worth.

A slice of texts is cut on its UTF-8 bytes as one Arrow buffer, without copying it; equal chunks are
found by Arrow's dictionary encoding, so Python sees each different chunk of a slice once. Values of
the chunks are gathered back in numpy.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice

import numpy as np
import pyarrow as pa

#: ASCII characters that are neither white space or controls nor letters or digits.
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


class Chunks:
    """Chunks of some texts: ``keys`` are the different ones, ``index`` tells each chunk's key, ``first`` each text's first chunk (and the end)."""

    def __init__(self, texts: pa.Array, pairs: np.ndarray, space_before: np.ndarray | None = None):
        """Cut between two bytes of a text where ``pairs`` (by 256 * the first + the second) says so, and before a space if ``space_before`` has the byte after it."""
        data, ends = buffer_of(texts)
        start = np.zeros(len(data) + 1, bool)
        if len(data) > 1:
            start[1:-1] = pairs[(data[:-1].astype(np.uint16) << 8) | data[1:]]
        if space_before is not None and len(data) > 1:
            cut = (data[:-1] == 32) & space_before[data[1:]]
            last = ends[1:] - 1
            cut[last[(last >= 0) & (last < len(cut))]] = False  # what follows a text's last byte is another text
            start[:-2] |= cut
        start[ends] = True
        start[-1] = False
        at = np.flatnonzero(start).astype(np.int32)
        offsets = np.concatenate([at, np.array([len(data)], np.int32)])
        encoded = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        self.index = encoded.indices.to_numpy(zero_copy_only=False)
        self.keys: list[str] = encoded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.first = np.searchsorted(at, ends)

    def totals(self, values: list[int]) -> np.ndarray:
        """For each text the sum of its chunks' values."""
        run = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.array(values, np.int64)[self.index])])
        return run[self.first[1:]] - run[self.first[:-1]]

    def joined(self, values: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray]:
        """All chunks' values (items of the numpy type ``kind``) one after another, and where each text's begin (and the end)."""
        flat = np.frombuffer(b"".join(values), kind)
        size = np.fromiter(map(len, values), np.int64, len(values)) // flat.itemsize
        ends = np.cumsum(size[self.index])
        run = np.concatenate([np.zeros(1, np.int64), ends])
        if len(flat) < 1 << 31 > run[-1]:  # so it is for slices of usual sizes; half the memory
            size, ends = size.astype(np.int32), ends.astype(np.int32)
        n = size[self.index]
        place = np.repeat((np.cumsum(size, dtype=size.dtype) - size)[self.index] - ends + n, n)
        place += np.arange(len(place), dtype=place.dtype)
        return flat[place], run[self.first]


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow array of strings, nulls empty, and where each begins (and the end)."""
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return held, ends - ends[0]


class ValueTable:
    """Values of chunks, in a table of at most ``most_bytes`` that a worker keeps from task to task of a stage.

    ``compute`` gets a list of new chunks and returns their values. Chunks of over ``longest``
    characters are computed anew each time. A table that is full goes on with its older half:
    frequent chunks come early.
    """

    def __init__(self, compute: Callable[[list[str]], list], most_bytes: int = 48_000_000, longest: int = 64):
        self.known: dict[str, object] = {}
        self.compute, self.most_bytes, self.longest, self.bytes = compute, most_bytes, longest, 0

    def values(self, keys: list[str]) -> list:
        out = list(map(self.known.get, keys))
        missing = [k for k, v in enumerate(out) if v is None]
        new = [keys[k] for k in missing]
        made = self.compute(new)
        for k, value in zip(missing, made, strict=True):
            out[k] = value
        fresh = {k: v for k, v in zip(new, made, strict=True) if len(k) <= self.longest}
        self.known.update(fresh)
        self.bytes += _cost(fresh)
        if self.bytes > self.most_bytes:
            self.known = dict(islice(self.known.items(), len(self.known) // 2))
            self.bytes = _cost(self.known)
            if self.bytes > self.most_bytes:
                self.known, self.bytes = {}, 0
        return out


def _cost(held: dict) -> int:
    """About what entries take: objects and slots, characters, and values' bytes."""
    least = 160 * len(held) + 2 * sum(map(len, held))
    first = next(iter(held.values()), 0)
    if isinstance(first, int):
        return least
    return least + (sum(map(len, held.values())) if isinstance(first, bytes) else sum(len(x) + 40 for v in held.values() for x in v))
