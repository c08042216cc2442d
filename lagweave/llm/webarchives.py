"""Web archives of pages: written with repeated payloads as revisits, and read back by ranges (op 1).

Executors reach the shared folder only through Spark, so an archive is a table of blocks: rows of
archive, size, block (its number) and data. A range read is a join with the blocks that the range is
in. First the ends of archives are read, for their directories; then the members' headers and the
indexes; then each record by its own range.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import col, release, slices, staged
from .wacz import ArchiveError, BytesSource, ZipDirectory, pack, parse_record, record_bytes

LEAST_REVISIT = 1000
#: Bytes of a block, and of an archive's end that must hold its central directory.
BLOCK, TAIL = 256 * 1024, 1024 * 1024
#: Bytes of an archive's beginning that are read with its end, for the first member's header.
HEAD = 64
#: Bits of the map of repeated digests, by a digest's first six hex digits.
SLOTS = 1 << 24
_RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def write_archives(pages: DataFrame, least: int = LEAST_REVISIT, archive_bytes: int = 16_000_000) -> DataFrame:
    """Archives as a table of blocks in the shared folder, one WARC record for each row of page_id, url, html.

    Of records with equal payloads of ``least`` bytes or more, that with the largest page_id is the
    response and the others revisit it; a row that repeats the largest id is a response too. Null
    html is an empty payload; null ids are allowed, and are responses only if their group has no
    other. Repeated digests are counted from digests alone and marked in a bitmap of fixed size; only
    pages whose mark is set are shuffled to find their partner, the others are packed where they are.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").withColumn("digest", F.sha1(body))
    rows = rows.withColumn("size", F.octet_length(body))
    repeated = rows.filter(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).filter("n > 1").drop("n")
    repeated = staged(repeated, "repeated")
    marks = np.zeros(SLOTS >> 6, np.int64)
    words = repeated.select(F.conv(F.substring("digest", 1, 6), 16, 10).cast("long").alias("h")).groupBy(F.expr("h >> 6").alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(h & 63 AS INT)))").alias("bits")).toArrow()
    marks[words["w"].to_numpy()] = words["bits"].to_numpy()
    shared = pages.sparkSession.sparkContext.broadcast(marks)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packs pages whose digest's mark isn't set: they have no partner. The others go on as they are."""
        out = _Packer(TaskContext.get().partitionId() << 32, archive_bytes)
        for part, texts in slices(batches, "html"):
            ids, urls, digests, sizes = (part.column(k).to_pylist() for k in range(4))
            slot = np.array([int(d[:6], 16) for d in digests], np.int64)
            maybe = (shared.value[slot >> 6] >> (slot & 63) & 1).astype(bool) & (np.array(sizes) >= least)
            for page, url, digest, again, text in zip(ids, urls, digests, maybe.tolist(), texts, strict=True):
                if not again:
                    yield from out.add(page, url, text, digest, None, False)
            later = part.filter(pa.array(maybe))
            if later.num_rows:
                yield _row_batch(page_id=later.column(0), url=later.column(1), digest=later.column(2), html=later.column(4))
        yield from out.rest()
        release()

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Packer(1 << 62 | TaskContext.get().partitionId() << 32, archive_bytes)
        for part, texts in slices(batches, "html"):
            for page, url, digest, response, again, text in zip(*(part.column(k).to_pylist() for k in range(5)), texts, strict=True):
                yield from out.add(page, url, text, digest, response, again)
        yield from out.rest()
        release()

    made = staged(rows.select("page_id", "url", "digest", "size", "html").mapInArrow(first, _BOTH), "archives")
    marked = made.filter("archive IS NULL").select("page_id", "url", "digest", "html").join(repeated, "digest", "left")
    revisit = F.col("response").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("response")))
    paired = staged(marked.select("page_id", "url", "digest", "response", revisit.alias("revisit"), "html").mapInArrow(second, _BOTH), "archives-of-copies")
    return made.filter("archive IS NOT NULL").union(paired).select("archive", "size", "block", "data")


_BLOCKS = "archive long, size long, block long, data binary"
_BOTH = _BLOCKS + ", page_id long, url string, digest string, html string"


def _row_batch(**known: pa.Array) -> pa.RecordBatch:
    """Rows of blocks, or of pages that wait for their partners; what isn't known is null."""
    fields = [c.split() for c in _BOTH.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    n = len(next(iter(known.values())))
    return pa.RecordBatch.from_arrays([known[name].cast(kinds[kind]) if name in known else pa.nulls(n, kinds[kind]) for name, kind in fields], names=[name for name, _ in fields])


class _Packer:
    """Collects records into archives of about ``most`` bytes, which come out as blocks."""

    def __init__(self, archive: int, most: int):
        self.archive, self.most = archive, most
        self.records, self.names, self.size = [], [], 0

    def add(self, page: int | None, url: str | None, text: str | None, digest: str, response: int | None, again: bool) -> Iterator[pa.RecordBatch]:
        self.records.append(record_bytes(page, url, (text or "").encode("utf-8", "surrogatepass"), digest, response, again))
        self.names.append(page)
        self.size += len(self.records[-1])
        if self.size >= self.most:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.records:
            data = pack(self.records, self.names)
            cut = [data[at : at + BLOCK] for at in range(0, len(data), BLOCK)]
            yield _row_batch(archive=pa.array([self.archive] * len(cut)), size=pa.array([len(data)] * len(cut)), block=pa.array(range(len(cut))), data=pa.array(cut, pa.binary()))
            self.archive, self.records, self.names, self.size = self.archive + 1, [], [], 0


def block_table(archives: DataFrame, archive: str = "archive") -> DataFrame:
    """Whole archives, one a row of a binary column, as a table of blocks; null ones have none."""
    rows = archives.select(col(archive).alias("data")).filter("data IS NOT NULL").withColumn("archive", F.monotonically_increasing_id())
    size = F.octet_length("data").cast("long")
    last = F.floor((F.greatest(size, F.lit(1)) - 1) / BLOCK)
    cut = rows.select("archive", size.alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"), "data")
    return cut.withColumn("data", F.expr(f"substring(data, CAST(block * {BLOCK} + 1 AS INT), {BLOCK})"))


def read_ranges(blocks: DataFrame, ranges: DataFrame) -> DataFrame:
    """``ranges`` (archive, at, n, and more columns; n above 0) with their bytes, from the blocks that they are in and no others."""
    first, last = F.floor(F.col("at") / BLOCK), F.floor((F.col("at") + F.col("n") - 1) / BLOCK)
    start = F.greatest(F.col("at") - F.col("block") * BLOCK, F.lit(0))
    stop = F.least(F.col("at") + F.col("n") - F.col("block") * BLOCK, F.lit(BLOCK))
    piece: Column = F.substring("data", (start + 1).cast("int"), (stop - start).cast("int"))
    held = blocks.select("archive", "block", "data")
    inside = ranges.filter(first == last).withColumn("block", first).join(held, ["archive", "block"]).select(*ranges.columns, piece.alias("bytes"))
    over = ranges.filter(first < last).withColumn("block", F.explode(F.sequence(first, last))).join(held, ["archive", "block"])
    over = over.groupBy(*ranges.columns).agg(F.sort_array(F.collect_list(F.struct("block", piece.alias("piece")))).alias("pieces"))
    whole = F.aggregate("pieces", F.lit(bytearray()), lambda a, x: F.concat(a, x["piece"]))
    return inside.union(over.select(*ranges.columns, whole.alias("bytes")))


class _Parts(BytesSource):
    """The parts of an archive that are held, by where they begin."""

    def __init__(self, size: int, parts: list[tuple[int, bytes]]):
        self.size, self.parts = size, parts

    def has(self, at: int, n: int) -> bool:
        return any(start <= at and at + n <= start + len(data) for start, data in self.parts)

    def read_at(self, at: int, n: int) -> bytes:
        for start, data in self.parts:
            if start <= at and at + n <= start + len(data):
                return data[at - start : at - start + n]
        raise ArchiveError("a range is outside the archive or the part of it that was read")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From archives' beginnings and ends (archive, at, n, name, size, indexed): every record, named null, where they hold the index and the members' headers; else members to be read."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    for batch in batches:
        for archive, size, head, tail in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            held = _Parts(size, [(0, head or b""), (size - len(tail), tail)])
            directory = ZipDirectory(held)
            members = directory.members.values()
            index = [m for m in members if m.name.startswith("indexes/") and m.name.endswith(".cdxj")]
            data = [m for m in members if m.name.startswith("archive/") and m.name.endswith(".warc.gz")]
            if any(m.method for m in index + data):
                raise ArchiveError("a member is packed, not stored")
            # A local header's name and extra field can be longer than the directory's: room for both is read before an index.
            rows = [(archive, m.header, min(30, size - m.header), m.name, m.size, bool(index)) for m in data]
            rows += [(archive, m.header, min(30 + 2 * 65_535 + m.size, size - m.header), m.name, m.size, True) for m in index]
            if all(held.has(at, n) for _, at, n, *_ in rows):
                parts = [{"at": at, "name": name, "size": own, "indexed": indexed, "bytes": held.read_at(at, n)} for _, at, n, name, own, indexed in rows]
                rows = [(archive, at, n, None, None, None) for at, n in _ranges_of(parts)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 6, kinds, strict=True)], names=["archive", "at", "n", "name", "size", "indexed"])


def _ranges_of(parts: list[dict]) -> Iterator[tuple[int, int]]:
    """(at, n) of every record of an archive from its members' headers and indexes; of whole members where there is no index."""
    starts = {}
    for part in parts:
        head = part["bytes"]
        if head[:4] != b"PK\3\4" or len(head) < 30:
            raise ArchiveError(f"{part['name']} has no local header")
        part["skip"] = 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
        starts[part["name"]] = part["at"] + part["skip"], part["size"]
        if not part["indexed"] and part["size"]:
            yield part["at"] + part["skip"], part["size"]
    for part in parts:
        if part["name"].startswith("indexes/"):
            for line in part["bytes"][part["skip"] : part["skip"] + part["size"]].decode().splitlines():
                entry = json.loads(line)
                start, size = starts[entry["filename"]]
                if entry["length"] < 1 or entry["offset"] + entry["length"] > size:
                    raise ArchiveError("an index leads outside its member")
                yield start + entry["offset"], entry["length"]


def _record_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From an archive's headers and indexes (one row each): (archive, at, n) of every record."""
    for batch in batches:
        for archive, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = [(archive, *r) for r in _ranges_of(found)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * 3)], names=["archive", "at", "n"])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    for batch in batches:
        rows = []
        for data in batch.column(0).to_pylist():
            while data:  # one record, or all of a member
                one = zlib.decompressobj(31)
                try:
                    one.decompress(data)
                except zlib.error as e:
                    raise ArchiveError(str(e)) from e
                r = parse_record(data[: len(data) - len(one.unused_data)] if one.unused_data else data)
                rows.append((r.page_id, r.url, r.kind, r.payload_bytes, r.payload_digest, r.refers_to))
                data = one.unused_data
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)], names=[c.split()[0] for c in _RECORDS.split(", ")])
    release()


def record_index(blocks: DataFrame) -> DataFrame:
    """archive, at, n of every record of archives that are tables of blocks, from their directories and indexes alone. A broken archive ends the job with an ArchiveError."""
    near_end = F.col("block") * BLOCK + F.octet_length("data") > F.col("size") - TAIL
    joined = F.aggregate(F.sort_array(F.collect_list(F.when(near_end, F.struct("block", "data")))), F.lit(bytearray()), lambda a, x: F.concat(a, x["data"]))
    head = F.max(F.when(F.col("block") == 0, F.substring("data", 1, HEAD)))
    ends = blocks.filter(near_end | (F.col("block") == 0)).select("archive", "size", "block", F.when(near_end, F.col("data")).otherwise(F.substring("data", 1, HEAD)).alias("data"))
    found = staged(ends.groupBy("archive", "size").agg(head.alias("head"), joined.alias("tail")).mapInArrow(_ends, "archive long, at long, n long, name string, size long, indexed boolean"), "ends")
    known, members = found.filter("name IS NULL").select("archive", "at", "n"), found.filter("name IS NOT NULL")
    if members.isEmpty():
        return known
    # The few archives whose index is longer than the end that was read.
    parts = read_ranges(blocks, members).groupBy("archive").agg(F.collect_list(F.struct("at", "name", "size", "indexed", "bytes")).alias("parts"))
    return known.union(staged(parts.mapInArrow(_record_ranges, "archive long, at long, n long"), "record-index"))


def read_archives(blocks: DataFrame) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to of every record, read by its range from archives that are a table of blocks.

    A revisit's length and digest are those its headers keep of the full payload. A broken archive
    ends the job with an ArchiveError.
    """
    return read_ranges(blocks, record_index(blocks)).select("bytes").mapInArrow(_records, _RECORDS)
