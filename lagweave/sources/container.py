"""A container of coded blocks: header, metadata, block table and payloads, with checksums."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

MAGIC, VERSION = b"LWVC", 1
_HEAD = "<4sHHIHHQQIII"
_BLOCK = "<qqQII"


class ContainerError(ValueError):
    """A container that is truncated, of another version, or whose checksums differ."""


@dataclass
class Block:
    start: int
    count: int
    payload: bytes
    sources: int = 0


@dataclass
class Container:
    rate: int
    channels: int
    bits: int
    samples: int
    metadata: dict[str, str] = field(default_factory=dict)
    cover: bytes = b""
    blocks: list[Block] = field(default_factory=list)


def write(c: Container) -> bytes:
    meta = "".join(f"{k}={v}\n" for k, v in c.metadata.items()).encode()
    table, payloads = bytearray(), bytearray()
    for b in c.blocks:
        table += struct.pack(_BLOCK, b.start, b.count, len(payloads), len(b.payload), b.sources) + struct.pack("<I", zlib.crc32(b.payload))
        payloads += b.payload
    head = struct.pack(_HEAD, MAGIC, VERSION, c.channels, c.rate, c.bits, 0, c.samples, len(c.blocks), len(meta), len(c.cover), zlib.crc32(meta + c.cover + table))
    return head + meta + c.cover + bytes(table) + bytes(payloads)


def read(data: bytes, payloads: bool = True) -> Container:
    """The container; without ``payloads`` blocks are empty and payload checksums aren't tested."""
    size = struct.calcsize(_HEAD)
    if len(data) < size:
        raise ContainerError("truncated")
    magic, version, channels, rate, bits, _, samples, n, meta_n, cover_n, crc = struct.unpack_from(_HEAD, data)
    if magic != MAGIC or version != VERSION:
        raise ContainerError("not a container of this version")
    step = struct.calcsize(_BLOCK) + 4
    end = size + meta_n + cover_n + n * step
    if len(data) < end or zlib.crc32(data[size:end]) != crc:
        raise ContainerError("the head is truncated or broken")
    lines = data[size : size + meta_n].decode().split("\n")
    out = Container(rate, channels, bits, samples, dict(reversed([x.split("=", 1) for x in lines if "=" in x])), data[size + meta_n : size + meta_n + cover_n])
    for k in range(n):
        at = size + meta_n + cover_n + k * step
        start, count, place, length, sources = struct.unpack_from(_BLOCK, data, at)
        body = data[end + place : end + place + length] if payloads else b""
        if payloads and (len(body) != length or zlib.crc32(body) != struct.unpack_from("<I", data, at + step - 4)[0]):
            raise ContainerError("a payload is truncated or broken")
        out.blocks.append(Block(start, count, body, sources))
    return out


def retag(data: bytes, changes: dict[str, str]) -> bytes:
    """The container with metadata keys replaced or added; payloads are copied."""
    c = read(data)
    c.metadata |= changes
    return write(c)
