"""ZIP-packaged web archives: stored members, WARC records and their index, read by ranges.

Nothing is extracted: the end record (ZIP64 where there is one) leads to the central directory, that
to a member's local header, the index to a record's range within the member.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
_32, _16 = 0xFFFFFFFF, 0xFFFF


class ArchiveError(ValueError):
    """An archive that is truncated, inconsistent or packed in a way that can't be read by ranges."""


class BytesSource:
    """Range reads from bytes."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def read_at(self, at: int, n: int) -> bytes:
        if at < 0 or at + n > self.size:
            raise ArchiveError("a range is outside the archive")
        return self.data[at : at + n]


class FileSource(BytesSource):
    """Range reads from a local file."""

    def __init__(self, path: str):
        self.file, self.size = os.open(path, os.O_RDONLY), os.path.getsize(path)

    def read_at(self, at: int, n: int) -> bytes:
        if at < 0 or at + n > self.size:
            raise ArchiveError("a range is outside the archive")
        return os.pread(self.file, n, at)

    def close(self) -> None:
        os.close(self.file)


@dataclass
class Member:
    name: str
    method: int
    crc: int
    packed: int
    size: int
    header: int


def write_zip(members: list[tuple[str, bytes]], zip64: bool | None = None) -> bytes:
    """A ZIP of stored members; ``zip64`` forces 64-bit fields, which otherwise come where they must."""
    out, central = bytearray(), bytearray()
    for name, data in members:
        at, label, crc = len(out), name.encode(), zlib.crc32(data)
        wide = zip64 or max(len(data), at) >= _32
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if wide else b""
        size = _32 if wide else len(data)
        version = 45 if wide else 20
        out += LOCAL + struct.pack("<HHHHHIIIHH", version, 0x800, 0, 0, 33, crc, size, size, len(label), len(extra)) + label + extra + data
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if wide else b""
        central += CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", version, version, 0x800, 0, 0, 33, crc, size, size, len(label), len(extra), 0, 0, 0, 0, _32 if wide else at) + label + extra
    start, n = len(out), len(members)
    out += central
    if zip64 or start >= _32 or n >= _16:
        at = len(out)
        out += END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, len(central), start)
        out += LOCATOR64 + struct.pack("<IQI", 0, at, 1)
        out += END + struct.pack("<HHHHIIH", 0, 0, _16, _16, _32, _32, 0)
    else:
        out += END + struct.pack("<HHHHIIH", 0, 0, n, n, len(central), start, 0)
    return bytes(out)


class ZipDirectory:
    """The members of a ZIP, from its central directory; stored ones can be read by ranges."""

    def __init__(self, source: BytesSource):
        self.source = source
        tail_at = max(0, source.size - 22 - _16)
        tail = source.read_at(tail_at, source.size - tail_at)
        at = tail.rfind(END)
        while at >= 0 and (len(tail) < at + 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(END, 0, at)
        if at < 0:
            raise ArchiveError("no end of central directory")
        *_, n, size, start, _ = struct.unpack_from("<HHHHIIH", tail, at + 4)
        end_at = tail_at + at
        if (n == _16 or size == _32 or start == _32) and end_at >= 20 and (found := source.read_at(end_at - 20, 20))[:4] == LOCATOR64:
            (at64,) = struct.unpack_from("<Q", found, 8)
            end64 = source.read_at(at64, 56)
            if end64[:4] != END64:
                raise ArchiveError("the ZIP64 locator leads nowhere")
            n, size, start = struct.unpack_from("<QQQ", end64, 32)
        self.members: dict[str, Member] = {}
        data, at = source.read_at(start, size), 0
        for _ in range(n):
            if data[at : at + 4] != CENTRAL or at + 46 > len(data):
                raise ArchiveError("the central directory is broken")
            method, _, _, crc, packed, plain, a, b, c, _, _, _, header = struct.unpack_from("<HHHIIIHHHHHII", data, at + 10)
            name = data[at + 46 : at + 46 + a].decode("utf-8", "replace")
            packed, plain, header = _wide(data[at + 46 + a : at + 46 + a + b], packed, plain, header)
            self.members[name] = Member(name, method, crc, packed, plain, header)
            at += 46 + a + b + c

    def start_of(self, name: str) -> int:
        """Where a stored member's data begins: past its local header, whose lengths may differ from the directory's."""
        member = self.members[name]
        if member.method != 0:
            raise ArchiveError(f"{name} is packed, not stored")
        head = self.source.read_at(member.header, 30)
        if head[:4] != LOCAL:
            raise ArchiveError(f"{name} has no local header")
        a, b = struct.unpack_from("<HH", head, 26)
        return member.header + 30 + a + b

    def read(self, name: str, at: int = 0, n: int | None = None) -> bytes:
        """A range of a stored member; a whole one's checksum is tested."""
        member = self.members[name]
        n = member.size - at if n is None else n
        if at < 0 or at + n > member.size:
            raise ArchiveError(f"a range is outside {name}")
        data = self.source.read_at(self.start_of(name) + at, n)
        if n == member.size and zlib.crc32(data) != member.crc:
            raise ArchiveError(f"{name}: checksum")
        return data


def _wide(extra: bytes, packed: int, plain: int, header: int) -> tuple[int, int, int]:
    """Sizes and offset with those that are in the ZIP64 field, which holds only what doesn't fit."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            values = list(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
            plain = values.pop(0) if plain == _32 else plain
            packed = values.pop(0) if packed == _32 else packed
            header = values.pop(0) if header == _32 else header
        at += 4 + size
    return packed, plain, header


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, level: int = 1) -> bytes:
    """A gzip member with one WARC record: a response with its payload, or a revisit with the response's headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {json.dumps(url or '')[1:-1]}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@dataclass
class Record:
    page_id: int | None
    url: str
    kind: str
    payload_bytes: int
    payload_digest: str
    refers_to: int | None
    payload: bytes | None


def parse_record(packed: bytes) -> Record:
    """The record in a gzip member. A response's digest and lengths are tested against its payload."""
    try:
        data = zlib.decompress(packed, 31)
    except zlib.error as e:
        raise ArchiveError(str(e)) from e
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    named = lambda x: int(x) if (x := x[len("<urn:page:") : -1]) else None
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ArchiveError("a payload differs from its digest or length")
    return Record(named(fields["WARC-Record-ID"]), json.loads(f'"{fields["WARC-Target-URI"]}"'), fields["WARC-Type"], size, digest, named(fields["WARC-Refers-To"]) if revisit else None, None if revisit else payload)


def pack(records: list[bytes], names: list[int | None], zip64: bool | None = None) -> bytes:
    """An archive of packed records: archive/data.warc.gz, and indexes/index.cdxj with a line for each record."""
    lines, at = [], 0
    for name, record in zip(names, records, strict=True):
        lines.append(json.dumps({"page": name, "filename": "archive/data.warc.gz", "offset": at, "length": len(record)}))
        at += len(record)
    return write_zip([("archive/data.warc.gz", b"".join(records)), ("indexes/index.cdxj", "\n".join(lines).encode())], zip64)


def records_of(source: BytesSource) -> Iterator[Record]:
    """The records of an archive, each by its range in the indexes; without one, from the members' starts on."""
    directory = ZipDirectory(source)
    indexes = [n for n in directory.members if n.startswith("indexes/") and n.endswith(".cdxj")]
    for name in indexes:
        for line in directory.read(name).decode().splitlines():
            at = json.loads(line)
            yield parse_record(directory.read(at["filename"], at["offset"], at["length"]))
    if indexes:
        return
    for name in directory.members:
        if name.startswith("archive/") and name.endswith(".warc.gz"):
            data = directory.read(name)
            while data:
                one = zlib.decompressobj(31)
                one.decompress(data)
                yield parse_record(data[: len(data) - len(one.unused_data)])
                data = one.unused_data
