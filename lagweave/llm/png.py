"""PNG of 8-bit samples: chunks with checksums, zlib streams, and all five row filters undone in numpy."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Fixed values of the format: samples a pixel by colour type.
SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}


class PngError(ValueError):
    """A file that isn't a whole, intact PNG of 8-bit samples without interlacing."""


#: What a filtered byte counts for in the choice of a filter: its distance from zero as a signed byte.
_MAGNITUDE = np.abs(np.arange(256).astype(np.uint8).view(np.int8).astype(np.int16)).astype(np.uint8)


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(image: np.ndarray, level: int = 1, filters: tuple[int, ...] = (0, 1, 2)) -> bytes:
    """A PNG of an array (height, width) or (height, width, samples) of bytes.

    Each row has that of ``filters`` with the least sum of absolute values, the usual heuristic. None,
    left and up are undone by running sums; the other two (3 mean, 4 Paeth) take longer to undo.
    """
    rows = image.reshape(image.shape[0], -1)
    samples = image.shape[2] if image.ndim == 3 else 1
    kind = next(k for k, n in SAMPLES.items() if n == samples)
    out = np.zeros((rows.shape[0], rows.shape[1] + 1), np.uint8)
    tried = [_filtered(rows, f, samples) for f in filters]
    cost = np.stack([_MAGNITUDE[t].sum(axis=1, dtype=np.int64) for t in tried])
    best = cost.argmin(axis=0)
    out[:, 0] = np.array(filters, np.uint8)[best]
    for k, t in enumerate(tried):
        own = best == k
        out[own, 1:] = t[own]
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, kind, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(out.tobytes(), level)) + chunk(b"IEND", b"")


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    a, b, c = a.astype(np.int64), b.astype(np.int64), c.astype(np.int64)
    p = a + b - c
    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c)).astype(np.uint8)


def _filtered(rows: np.ndarray, kind: int, samples: int) -> np.ndarray:
    if kind == 0:
        return rows
    out = rows.copy()
    if kind == 1:
        out[:, samples:] -= rows[:, :-samples]
        return out
    if kind == 2:
        out[1:] -= rows[:-1]
        return out
    left, up, corner = np.zeros_like(rows), np.zeros_like(rows), np.zeros_like(rows)
    left[:, samples:], up[1:], corner[1:, samples:] = rows[:, :-samples], rows[:-1], rows[:-1, :-samples]
    return rows - (((left.astype(np.int64) + up) // 2).astype(np.uint8) if kind == 3 else _paeth(left, up, corner))


def _unfilter(filters: np.ndarray, rows: np.ndarray, samples: int) -> np.ndarray:
    """Undo the filters, run by run of rows of one filter: running sums for left and up, diagonal by diagonal for mean and Paeth."""
    out = np.empty_like(rows)
    before = np.zeros(rows.shape[1], np.uint8)
    cuts = [0, *(np.flatnonzero(np.diff(filters)) + 1).tolist(), len(rows)]
    for at, end in zip(cuts[:-1], cuts[1:], strict=True):
        kind, part = filters[at], rows[at:end]
        if kind == 0:
            out[at:end] = part
        elif kind == 1:
            out[at:end] = np.cumsum(part.reshape(len(part), -1, samples), axis=1, dtype=np.uint8).reshape(part.shape)
        elif kind == 2:
            np.cumsum(part, axis=0, dtype=np.uint8, out=out[at:end])
            out[at:end] += before
        elif kind in (3, 4):
            out[at:end] = _along_diagonals(part, before, kind, samples)
        else:
            raise PngError(f"filter {kind}")
        before = out[end - 1]
    return out


def _along_diagonals(coded: np.ndarray, above: np.ndarray, kind: int, samples: int) -> np.ndarray:
    """Undo mean or Paeth: pixels of one diagonal need only those of the two before it, so all rows go at once."""
    height, width = len(coded), coded.shape[1] // samples
    out = np.zeros((height + 1, width + 1, samples), np.uint8)
    out[0, 1:] = above.reshape(width, samples)
    deltas = coded.reshape(height, width, samples)
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x = d - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        guess = ((left.astype(np.int64) + up) // 2).astype(np.uint8) if kind == 3 else _paeth(left, up, corner)
        out[y + 1, x + 1] = deltas[y, x] + guess
    return out[1:, 1:].reshape(coded.shape)


def read_png(data: bytes) -> np.ndarray:
    """The samples of a PNG: (height, width), or (height, width, samples) if there are several. Every chunk's checksum is tested."""
    if data[:8] != SIGNATURE:
        raise PngError("signature")
    at, head, stream, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise PngError("truncated")
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(body) != size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise PngError("checksum")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            stream.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise PngError(f"chunk {kind!r}")
        at += 12 + size
    if head is None or not ended:
        raise PngError("truncated")
    width, height, depth, colour, packing, filtering, interlaced = head
    if depth != 8 or colour not in SAMPLES or packing or filtering or interlaced:
        raise PngError("only 8-bit samples without palette or interlacing are supported")
    samples = SAMPLES[colour]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(stream)), np.uint8)
    except zlib.error as e:
        raise PngError(str(e)) from e
    if len(raw) != height * (width * samples + 1):
        raise PngError("size")
    rows = raw.reshape(height, width * samples + 1)
    out = _unfilter(rows[:, 0], rows[:, 1:], samples)
    return out.reshape(height, width) if samples == 1 else out.reshape(height, width, samples)


_LOW = 8
_GRID = 32
_COSINES = np.cos(np.pi * (2 * np.arange(_GRID) + 1) * np.arange(_LOW)[:, None] / (2 * _GRID))


def _to_grid(size: int) -> tuple[np.ndarray, np.ndarray]:
    """For an axis of ``size``: the first sample of each of the grid's cells, and how many each has (one at least)."""
    first = np.minimum(np.arange(_GRID) * size // _GRID, size - 1)
    last = np.maximum((np.arange(_GRID) + 1) * size // _GRID, first + 1)
    return first, last


def cosine_hash(image: np.ndarray) -> bytes:
    """8 bytes: the image averaged to 32 by 32 cells, the 8 by 8 lowest cosine coefficients, a bit for each but the mean that is above the others' median."""
    grey = image if image.ndim == 2 else image.mean(axis=2)
    total = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    total[1:, 1:] = np.cumsum(np.cumsum(grey, axis=0, dtype=np.float64), axis=1)
    (r0, r1), (c0, c1) = _to_grid(grey.shape[0]), _to_grid(grey.shape[1])
    cells = (total[np.ix_(r1, c1)] - total[np.ix_(r0, c1)] - total[np.ix_(r1, c0)] + total[np.ix_(r0, c0)]) / np.outer(r1 - r0, c1 - c0)
    low = np.round(_COSINES @ cells @ _COSINES.T, 6).ravel()
    above = low > np.median(low[1:])
    above[0] = False
    return np.packbits(above).tobytes()
