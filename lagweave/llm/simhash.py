"""SimHash near-duplicates by a byte-position inverted index with count filtering (op 5).

Fingerprints of 64 bits are 8 positional bytes. Two that differ in at most 4 bits differ in at most 4
bytes, so they share at least 4 of 8. The index has a posting for every three of the first 7
positions with their bytes: of 7 positions such a pair shares at least 3, so it meets in one of the 35
postings. There its shared positional bytes are tallied, pairs with fewer than 4 are discarded, and
the differing bits of the rest are counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_map, col, join_spread, partitions, release, runs_by_key, staged
from .graph import components

SEED = 42
BYTES = 8
#: Rows of a posting that one task takes; longer postings are dealt out as pairs of such blocks.
TILE = 4096
_EACH = 0x0101010101010101
#: Wide fingerprints: words, positions that are in pairs with each other, positional bytes that linked ones share, and the most bits in which they differ.
WIDE, GROUP, WIDE_SHARED, WIDE_BITS = 4, 4, 3, 64
#: Postings of wide fingerprints up to so many rows give all their links.
WIDE_SMALL = 32


def least_matches(bits: int) -> int:
    """The bytes that fingerprints differing in ``bits`` bits share at least."""
    return BYTES - bits


def fingerprints_of(texts: list[str | None], words: int = 4) -> np.ndarray:
    """SimHash of each text's word shingles (XXH64, seed 42), repeats included; no words: zero."""
    hashes, sizes, held = [], [], 0
    digest = xxhash.xxh64_intdigest
    for text in texts:
        tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if len(tokens) > words:
            own = np.fromiter((digest(s, SEED) for s in map(b" ".join, zip(*(tokens[k:] for k in range(words))))), np.uint64, len(tokens) - words + 1)
        else:
            own = np.array([digest(b" ".join(tokens), SEED)] if tokens else [], np.uint64)
        hashes.append(own)
        held += len(own)
        sizes.append(held)
    return _majority(np.concatenate([*hashes, np.zeros(0, np.uint64)]), np.array(sizes, np.int64))


def _majority(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each run of hashes that ends at ``ends`` the word of the bits that over half of them have; none: zero."""
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
    out = np.zeros(len(ends), np.uint64)
    filled = np.flatnonzero(ends > starts)
    if not len(filled):
        return out
    # Bits are summed in the 8 bytes of a word, which hold runs of 255 hashes, and then over a text's runs.
    per = -(-(ends - starts)[filled] // 255)
    first_run = np.concatenate([np.zeros(1, np.int64), np.cumsum(per)[:-1]])
    runs = np.repeat(starts[filled] - 255 * first_run, per) + 255 * np.arange(per.sum())
    majority = np.zeros((len(filled), 64), bool)
    twice = 2
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & np.uint64(_EACH), runs)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first_run, axis=0)
        majority[:, bit::8] = counts * twice > (ends - starts)[filled][:, None]
    out[filled] = np.packbits(majority, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def wide_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """A row of WIDE words for each set of hashes: SimHashes of it under as many mixes of each hash."""
    h = np.concatenate([*sets, np.zeros(0, np.uint64)])
    ends = np.cumsum([len(s) for s in sets], dtype=np.int64)
    out = np.zeros((len(sets), WIDE), np.uint64)
    for w in range(WIDE):
        z = h + np.uint64((w + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, w] = _majority(z ^ (z >> np.uint64(31)), ends)
    return out


def fingerprints(docs: DataFrame, columns: list[str], text: str = "text", words: int = 4) -> DataFrame:
    """``columns`` of ``docs`` with fp, the text's fingerprint as a signed long."""
    return arrow_map(docs, text, columns, lambda texts: {"fp": pa.array(fingerprints_of(texts, words).view(np.int64))}, "fp long")


def _linked(x: np.ndarray, bits: int) -> np.ndarray:
    """Which differences belong to linked pairs: tally the shared bytes, filter by count, verify the rest."""
    shared = (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1) >= least_matches(bits)
    shared[shared] = np.bitwise_count(x[shared]) <= bits
    return shared


def _forest(f: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what links among ``f`` connect: a spanning forest, found breadth first."""
    rest = f.copy()
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            seed = queue.pop()
            hit = _linked(rest ^ seed, bits)
            if hit.any():
                near = rest[hit]
                yield np.full(len(near), seed, np.uint64), near
                queue += near.tolist() if len(near) < 2 else list(near)
                rest = rest[~hit]


class _Postings:
    """Links within the postings of a sorted stream."""

    def __init__(self, positions: int, bits: int):
        take = least_matches(bits) - (BYTES - positions)
        self.sets, self.bits = list(combinations(range(positions), take)), bits
        first = np.full(1 << positions, -1, np.int64)
        for mask in range(1 << positions):
            held = [p for p in range(positions) if mask >> p & 1]
            if len(held) >= take:
                first[mask] = self.sets.index(tuple(held[:take]))
        self.first, self.positions, self.take = first, positions, take

    def small(self, key: np.ndarray, f: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All links of postings of up to ``most`` rows, each from the first posting that its pair shares."""
        for gap in range(1, most):
            at = np.flatnonzero(key[gap:] == key[:-gap])
            if not len(at):
                return
            a, b = f[at], f[at + gap]
            x = a ^ b
            hit = _linked(x, self.bits)
            a, b, x, k = a[hit], b[hit], x[hit], key[at][hit]
            same = (x.view(np.uint8).reshape(-1, BYTES)[:, : self.positions] == 0) @ (1 << np.arange(self.positions))
            own = self.first[same] == k >> 8 * self.take
            yield a[own], b[own]


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), none, none], names=["a", "b", "key", "block"])


def _later(key: int, f: np.ndarray, at: int, tile: int) -> pa.RecordBatch:
    keys = pa.array(np.full(len(f), key, np.int64))
    return pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.nulls(len(f), pa.int64()), keys, pa.array((at + np.arange(len(f))) // tile)], names=["a", "b", "key", "block"])


_SCHEMA = "a long, b long, key long, block long"


def _groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(keys, fingerprints, 0) of whole groups of a stream that is sorted by key; groups over ``most`` rows come in parts: (keys, part, rows before it + 1)."""
    key, f, before = np.zeros(0, np.int64), np.zeros(0, np.uint64), 0
    for batch in batches:
        key = np.concatenate([key, batch.column(0).to_numpy()])
        f = np.concatenate([f, batch.column(1).to_numpy().view(np.uint64)])
        if not len(key):
            continue
        if before:
            same = int(np.searchsorted(key, key[0], "right"))
            if same == len(key) and same < most:
                continue
            yield key[:same], f[:same], before
            before = before + same if same == len(key) else 0
            key, f = key[same:], f[same:]
            if not len(key):
                continue
        cut = int(np.searchsorted(key, key[-1], "left"))
        if cut:
            yield key[:cut], f[:cut], 0
            key, f = key[cut:], f[cut:]
        if len(key) > most:
            yield key, f, 1
            before, held = 1 + len(key), key[-1:]
            key, f = held[:0], f[:0]
            before_key = held[0]
            rest = _follow(batches, before_key, before, most)
            key, f = yield from rest
            before = 0
    if len(key):
        yield key, f, before


def _follow(batches: Iterator[pa.RecordBatch], own: int, before: int, most: int):
    """The remaining parts of a group that is over the limit; returns what follows it in its last batch."""
    for batch in batches:
        key, f = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        same = int(np.searchsorted(key, own, "right"))
        if same:
            yield key[:same], f[:same], before
            before += same
        if same < len(key):
            cut = int(np.searchsorted(key, key[-1], "left"))
            if cut > same:
                yield key[same:cut], f[same:cut], 0
            return key[max(cut, same) :], f[max(cut, same) :]
    return np.zeros(0, np.int64), np.zeros(0, np.uint64)


def links(nodes: DataFrame, bits: int = 4, tile: int = TILE) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp`` that connect all that differ in ``bits`` bits or fewer.

    Postings of up to 32 rows give all their links, longer ones a spanning forest of theirs; one over
    ``tile`` rows is cut into blocks, and every two blocks are a task's group.
    """
    if not 0 <= bits < BYTES - 1:
        raise ValueError("bits must be from 0 to 6")
    positions = min(7, BYTES)
    index = _Postings(positions, bits)
    byte = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(255) for p in range(positions)]
    keys = []
    for k, chosen in enumerate(index.sets):
        key = F.lit(k).cast("long")
        for p in chosen:
            key = key * 256 + byte[p]
        keys.append(key)
    rows = nodes.select(F.explode(F.array(*keys)).alias("key"), "fp")
    n = partitions(nodes, growth=2 * len(keys))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, f, part in _groups(batches, tile):
            if part:
                yield _later(int(key[0]), f, part - 1, tile)
                continue
            change = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[change, len(key)])
            each = np.repeat(size, size)
            few = (each > 1) & (each <= 32)
            for a, b in index.small(key[few], f[few], 32):
                yield _edges(a, b)
            for at, n_rows in zip(change[size > 32], size[size > 32], strict=True):
                group = f[at : at + n_rows]
                if n_rows > tile:
                    yield _later(int(key[at]), group, 0, tile)
                else:
                    for a, b in _forest(group, bits):
                        yield _edges(a, b)

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, f, part in _groups(batches, 2 * tile):
            if part:
                raise ValueError("a pair of blocks has more rows than two blocks")
            change = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            for at, end in zip(change, np.r_[change[1:], len(key)], strict=True):
                for a, b in _forest(f[at:end], bits):
                    yield _edges(a, b)

    found = staged(rows.repartition(n, "key").sortWithinPartitions("key").mapInArrow(find, _SCHEMA), "postings")
    later = found.filter("key IS NOT NULL")
    blocks = later.groupBy("key").agg((F.max("block") + 1).alias("blocks"))
    pairs = later.join(blocks, "key").select("key", F.col("a").alias("fp"), "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")).filter("other <> block")
    # A pair of blocks is a group of its own: its name mixes the posting and both numbers.
    named = pairs.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "fp").distinct()
    dealt = named.repartition(n, "key").sortWithinPartitions("key").mapInArrow(tiles, _SCHEMA)
    return found.filter("key IS NULL").select("a", "b").union(dealt.select("a", "b"))


def _wide_linked(x: np.ndarray) -> np.ndarray:
    """_linked for rows of differences of wide fingerprints."""
    shared = (np.ascontiguousarray(x).view(np.uint8).reshape(len(x), WIDE * BYTES) == 0).sum(axis=1) >= WIDE_SHARED
    shared[shared] = np.bitwise_count(x[shared]).sum(axis=1) <= WIDE_BITS
    return shared


_WIDE_PAIRS = list(combinations(range(GROUP), 2))
#: Of each mask of a group's shared positions, the first pair in it.
_FIRST = np.array([next((k for k, (i, j) in enumerate(_WIDE_PAIRS) if mask >> i & mask >> j & 1), len(_WIDE_PAIRS)) for mask in range(1 << GROUP)])


def _first_posting(x: np.ndarray) -> np.ndarray:
    """The number of the first posting in which fingerprints of such differences meet, if they meet in any."""
    masks = (np.ascontiguousarray(x).view(np.uint8).reshape(len(x), WIDE * BYTES // GROUP, GROUP) == 0) @ (1 << np.arange(GROUP))
    first = _FIRST[masks]
    at = np.argmax(first < len(_WIDE_PAIRS), axis=1)
    return at * len(_WIDE_PAIRS) + first[np.arange(len(x)), at]


def _wide_forest(f: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (numbers) of a posting whose links connect what links in it connect: found breadth first."""
    if len(f) <= 512:  # most postings have no link at all
        hit = np.zeros(len(f), bool)
        for k in range(len(f) - 1):
            near = np.flatnonzero(_wide_linked(f[k + 1 :] ^ f[k]))
            hit[near + k + 1] = True
            hit[k] |= len(near) > 0
        rest = np.flatnonzero(hit)
    else:
        rest = np.arange(len(f))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            seed = queue.pop()
            hit = _wide_linked(f[rest] ^ f[seed])
            if hit.any():
                near = rest[hit]
                yield np.full(len(near), seed), near
                queue += near.tolist()
                rest = rest[~hit]


def wide_links(nodes: DataFrame, n_parts: int) -> DataFrame:
    """Links (a, b) that connect the nodes (columns node, f0, f1, ...) whose wide fingerprints meet in a posting and are alike.

    The index has a posting for every two positions of a group with their bytes. There shared positional bytes
    are tallied, pairs with fewer than WIDE_SHARED are discarded, and the differing bits of the rest counted.
    A link comes from the first posting that its pair shares; long postings give spanning forests.
    """
    words = [f"f{w}" for w in range(WIDE)]
    byte = [F.shiftrightunsigned(words[p // BYTES], 8 * (p % BYTES)).bitwiseAND(255) for p in range(WIDE * BYTES)]
    pairs = [(g + i, g + j) for g in range(0, WIDE * BYTES, GROUP) for i, j in _WIDE_PAIRS]
    keys = F.array(*((F.lit(k) * 65536 + byte[i] * 256 + byte[j]).cast("long") for k, (i, j) in enumerate(pairs)))
    rows = nodes.select(F.explode(keys).alias("key"), "node", *words)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, *f in runs_by_key(batches):
            f = np.stack(f, axis=1).view(np.uint64)
            at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[at, len(key)])
            few = np.flatnonzero(np.repeat(size, size) <= WIDE_SMALL)
            own, found = key[few], []
            for gap in range(1, WIDE_SMALL):
                i = np.flatnonzero(own[gap:] == own[:-gap])
                if not len(i):
                    break
                i, j = few[i], few[i + gap]
                hit = _wide_linked(f[i] ^ f[j])
                found.append((i[hit], j[hit]))
            for start, rows_of in zip(at[size > WIDE_SMALL], size[size > WIDE_SMALL], strict=True):
                found += [(i + start, j + start) for i, j in _wide_forest(f[start : start + rows_of])]
            if found:
                i, j = (np.concatenate(x) for x in zip(*found, strict=True))
                first = _first_posting(f[i] ^ f[j]) == key[i] >> 16
                a, b = node[i[first]], node[j[first]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
        release()

    return rows.repartition(n_parts, "key").sortWithinPartitions("key", "node").mapInArrow(find, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest document id reachable over links), group (its smallest fingerprint) and text_hash.

    One row for each row of ``docs``. Null and empty texts have fingerprint zero and are linked like
    others; null ids stay, and component_id is null only where every id of a component is. Equal
    fingerprints are one node; exact copies cost no links. Texts of fewer than ``words`` words are
    one shingle.
    """
    own = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    rows = staged(fingerprints(own.withColumn("text_hash", F.xxhash64("text")), ["doc_id", "text_hash"], words=words), "fingerprints")
    nodes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "nodes")
    found = components(links(nodes, bits))
    linked = nodes.join(found.withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("label").agg(F.min("rep").alias("component_id"))
    known = linked.join(least, "label").select("fp", "label", "component_id")
    of_node = nodes.join(known, "fp", "left").select("fp", "n", F.coalesce("label", "fp").alias("label"), F.when(F.col("label").isNull(), F.col("rep")).otherwise(F.col("component_id")).alias("component_id"))
    of_node, total = staged(of_node, "of-node"), rows.count()
    digits = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return join_spread(rows, of_node, "fp", "n", total).select("doc_id", digits(F.col("fp")).alias("fingerprint"), "component_id", digits(F.col("label")).alias("group"), "text_hash")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest document id; of repeated rows, one."""
    return one_of_each(docs, near_duplicates(docs, doc_id, text, words, bits), doc_id, text)


def one_of_each(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of ``found`` (doc_id, text_hash, component_id, group): that of the component's id.

    Only the chosen rows' keys (id and text hash) are joined to the documents; rows whose key occurs
    more than once, as repeated rows do, are told apart by all that a component can hold of them.
    """
    chosen = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("group").agg(F.min("text_hash").alias("_hash"), F.min("doc_id").alias("_id"))
    twice = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.count("*").alias("_rows"))
    keys = chosen.join(twice, chosen["_hash"].eqNullSafe(twice["_hash"]) & chosen["_id"].eqNullSafe(twice["_id"])).select(chosen["_id"], chosen["_hash"], "_rows")
    keys = staged(keys, "kept")
    # A row goes through as one struct, so that no name of its columns can clash.
    marked = docs.select(F.struct(*(col(c) for c in docs.columns)).alias("row"), col(doc_id).alias("own_id"), F.xxhash64(col(text)).alias("own_hash"))
    joined = marked.join(keys, marked["own_id"].eqNullSafe(keys["_id"]) & (marked["own_hash"] == keys["_hash"]))
    once = joined.filter("_rows = 1").select("row")
    again = joined.filter("_rows > 1").dropDuplicates(["_id", "_hash"]).select("row")
    return once.union(again).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
