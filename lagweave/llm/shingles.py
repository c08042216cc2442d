"""Near-duplicates by the Jaccard similarity of word shingles, exactly: a prefix-filtered join and its components.

Two sets of similarity s or more share at least s times the greater set. So if every set lists its
members in one common order, and posts the first ``n - ceil(s n) + 1`` of its n members, such a pair
meets in a posting. The order puts shingles that a sample finds in many documents last, so that common
lines seldom have postings; any order finds all pairs. Those that meet are first compared by a bit for
each bucket of their members, odd or even, which bound how far the sets are apart from below, and the rest
verified by whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import col, drop_staged, forget, join_spread, partitions, release, runs_by_key, slices, staged
from .graph import components
from .simhash import SEED, WIDE, one_of_each, wide_fingerprints, wide_links

#: Postings of up to so many sets give all their pairs; of longer ones the pairs with their first LEADS sets come first.
SMALL, LEADS = 32, 4
#: One of so many texts is in the sample for the order; shingles of COMMON of them or more, and the MOST commonest such, go last.
SAMPLE, COMMON, MOST = 8, 8, 65_536
#: Pairs of a long posting that are tried at a time.
MOST_PAIRS = 250_000
#: Slots (a power of two) of the map of sets that take part in a pair.
SLOTS = 1 << 26


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct word shingles of a text (XXH64, seed 42), sorted. Fewer than ``words`` words are one shingle, none are no shingle."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    if len(tokens) > words:
        return np.unique(np.fromiter((digest(s, SEED) for s in map(b" ".join, zip(*(tokens[k:] for k in range(words))))), np.uint64, len(tokens) - words + 1))
    return np.array([digest(b" ".join(tokens), SEED)] if tokens else [], np.uint64)


def node_of(members: np.ndarray) -> int:
    """A signed number that names a set."""
    return int(np.uint64(xxhash.xxh64_intdigest(members.tobytes(), SEED)).view(np.int64))


def prefix(members: np.ndarray, percent: int, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The members that a set posts: the first in the order by count in the sample, then by hash."""
    take = len(members) - -(-percent * len(members) // 100) + 1 if len(members) else 0
    if len(common) and take:
        at = np.minimum(np.searchsorted(common, members), len(common) - 1)
        members = members[np.argsort(np.where(common[at] == members, counts[at], 0), kind="stable")]
    return members[:take]


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets' Jaccard similarity is ``percent`` of 100 or more, in whole numbers."""
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def sketch_of(members: np.ndarray) -> bytes:
    """A bit for each of a power of two of buckets, 4 to 8 a member and at least 64: whether the members in it are odd in number."""
    buckets = max(64, 1 << (4 * len(members) - 1).bit_length())
    odd = np.bincount((members & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def may_be_alike(x: bytes, y: bytes, n: int, m: int, percent: int) -> bool:
    """False only for sets of ``n`` and ``m`` members that are less alike: their sketches differ in no more bits than they do in members."""
    return bool(_may_be_alike(*(np.frombuffer(v, np.uint64)[None] for v in (x, y)), np.array([n]), np.array([m]), percent)[0])


def _may_be_alike(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """may_be_alike for rows of sketches' words, each side of one length."""
    if a.shape[1] > b.shape[1]:
        a, b = b, a
    if a.shape[1] < b.shape[1]:  # a bucket of the shorter sketch is several of the longer one
        b = np.bitwise_xor.reduce(b.reshape(len(b), -1, a.shape[1]), axis=1)
    apart = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return (100 - percent) * (n + m) >= (100 + percent) * apart


def _words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a column of sketches, where each sketch begins, and its length in words."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) >> 3
    return np.frombuffer(column.buffers()[2], np.uint64, int(ends[-1])), ends[:-1], np.diff(ends)


def sketches_meet(x: pa.Array, y: pa.Array, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """may_be_alike for columns of sketches."""
    return _meet(_words_of(x), _words_of(y), n, m, percent)


def _meet(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...], n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """may_be_alike for rows of (words, where each sketch begins, its length), taken together by their lengths, some MB at a time."""
    (data_x, at_x, size_x), (data_y, at_y, size_y) = x, y
    ok = np.zeros(len(n), bool)
    kind = size_x << 32 | size_y
    for k in np.unique(kind):
        own = np.flatnonzero(kind == k)
        for part in np.array_split(own, -(-len(own) * int((k >> 32) + (k & 0xFFFFFFFF)) // 500_000)):
            a, b = (data[at[part][:, None] + np.arange(size)] for data, at, size in ((data_x, at_x, int(k >> 32)), (data_y, at_y, int(k & 0xFFFFFFFF))))
            ok[part] = _may_be_alike(a, b, n[part], m[part], percent)
    return ok


def _sets(docs: DataFrame, columns: list[str], words: int, schema: str, rows_of) -> DataFrame:
    """Rows that ``rows_of(batch slice, sets)`` makes of slices of ``docs`` (``columns`` and text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for part, texts in slices(batches, "text"):
            yield rows_of(part, [shingle_set(t, words) for t in texts])
        release()

    return docs.select(*columns, "text").mapInArrow(run, schema)


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def _nodes(part: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
    keep = {n: part.column(part.schema.get_field_index(n)) for n in part.schema.names if n != "text"}
    words = {f"f{w}": np.ascontiguousarray(v).view(np.int64) for w, v in enumerate(wide_fingerprints(sets).T)}
    return _batch(**keep, **words, node=pa.array([node_of(s) for s in sets], pa.int64()), n=pa.array([len(s) for s in sets], pa.int64()), sketch=pa.array([sketch_of(s) for s in sets], pa.binary()))


def common_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many documents of the sample have, sorted, and in how many."""
    sample = docs.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").distinct()
    members = _sets(sample, [], words, "shingle long", lambda part, sets: _batch(shingle=np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)))
    rows = members.groupBy("shingle").count().filter(F.col("count") >= COMMON).orderBy(F.desc("count"), "shingle").limit(MOST).toArrow()
    shingle = rows["shingle"].to_numpy().view(np.uint64)
    order = np.argsort(shingle)
    return shingle[order], rows["count"].to_numpy()[order]


def _near_in_size(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    none = pa.nulls(len(pair), pa.int64())
    return _batch(a=np.ascontiguousarray(pair[:, 0]), b=np.ascontiguousarray(pair[:, 1]), key=none, n=none)


def _candidates(postings: DataFrame, percent: int, n_parts: int) -> DataFrame:
    """Pairs (a, b) of postings; rows of long postings as (a, key, n) too, b null."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, n in runs_by_key(batches):
            first = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
            key, node, n = key[first], node[first], n[first]
            at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[at, len(key)])
            lead, each = np.repeat(at, size), np.repeat(size, size)
            found = []
            for gap in range(1, min(SMALL, int(size.max()))):
                i = np.flatnonzero((key[gap:] == key[:-gap]) & (each[gap:] <= SMALL))
                found.append((i, i + gap))
            for k in range(LEADS):
                i = np.flatnonzero((each > SMALL) & (lead + k < np.arange(len(key))))
                found.append((lead[i] + k, i))
            i, j = (np.concatenate(x) for x in zip(*found, strict=True))
            ok = _near_in_size(n[i], n[j], percent)
            yield _pairs(node[i[ok]], node[j[ok]])
            long = each > SMALL
            if long.any():
                yield _batch(a=node[long], b=pa.nulls(int(long.sum()), pa.int64()), key=key[long], n=n[long])
        release()

    dealt = postings.repartition(n_parts, "key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(find, "a long, b long, key long, n long")


def _apart(rows: DataFrame, percent: int, n_parts: int) -> DataFrame:
    """Pairs of long postings (key, label, node, n, sketch) whose sets aren't in one component yet, are near in size and not kept apart by their sketches."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, label, node, n, sketch in runs_by_key(batches):
            at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            for start, end in zip(at, np.r_[at[1:], len(key)], strict=True):
                data, begin, size = _words_of(pa.array(sketch[start:end], pa.binary()))
                after = np.searchsorted(n[start:end], 100 * n[start:end] // percent, "right")  # of a row, those that follow it and are near in size end there
                each = after - np.arange(end - start) - 1
                of = (np.cumsum(each) - each) // MOST_PAIRS
                for rows_of in np.split(np.arange(end - start), np.flatnonzero(np.diff(of)) + 1):
                    i = np.repeat(rows_of, each[rows_of])
                    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(each[rows_of]) - each[rows_of], each[rows_of])
                    other = label[start + i] != label[start + j]
                    i, j = i[other], j[other]
                    ok = _meet((data, begin[i], size[i]), (data, begin[j], size[j]), n[start + i], n[start + j], percent)
                    if ok.any():
                        yield _pairs(node[start + i[ok]], node[start + j[ok]])
        release()

    return rows.repartition(n_parts, "key").sortWithinPartitions("key", "n").mapInArrow(find, "a long, b long, key long, n long").select("a", "b")


def _hopeful(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches don't keep them apart, with the hashes of a text of each."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = sketches_meet(batch.column(4), batch.column(5), batch.column(6).to_numpy(), batch.column(7).to_numpy(), percent)
                yield batch.select(["a", "b", "text_a", "text_b"]).filter(pa.array(ok))

    of = lambda c: nodes.select(F.col("node").alias(c), F.col("text_hash").alias(f"text_{c}"), F.col("sketch").alias(f"sketch_{c}"), F.col("n").alias(f"n_{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b", "sketch_a", "sketch_b", "n_a", "n_b")
    return staged(both.mapInArrow(check, "a long, b long, text_a long, text_b long"), "hopeful")


def _verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose whole sets are alike. Sets are made again, only of texts that the map of hopeful pairs has."""
    pairs = _hopeful(pairs, nodes, percent)
    used = pairs.select(F.col("text_a").alias("h")).union(pairs.select("text_b"))
    slot = f"(h & {SLOTS - 1})"
    words_of = used.groupBy(F.expr(f"{slot} >> 6").alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, CAST({slot} & 63 AS INT)))").alias("bits")).toArrow()
    bitmap = np.zeros(SLOTS >> 6, np.int64)
    bitmap[words_of["w"].to_numpy()] = words_of["bits"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy() & (SLOTS - 1)
            held = pa.array((shared.value[at >> 6] >> (at & 63) & 1).astype(bool))
            for _, texts in slices([batch.filter(held)], "text"):
                sets = [shingle_set(t, words) for t in texts]
                yield _batch(node=pa.array([node_of(s) for s in sets], pa.int64()), members=pa.array([s.tobytes() for s in sets], pa.binary()))
        release()

    made = docs.select(F.xxhash64("text").alias("h"), "text").mapInArrow(make, "node long, members binary")
    sets = staged(made.groupBy("node").agg(F.first("members").alias("members")), "sets")
    shared.destroy()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(k) for k in (2, 3))
            ok = [alike(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64), percent) for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))
        release()

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b")
    found = staged(both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), "alike")
    drop_staged(sets)
    return found


def _star(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("node").alias("a"), F.col("label").alias("b"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_hash, component_id (smallest document id reachable over pairs of that similarity) and group.

    One row for each row of ``docs``. Equal sets are one node, those of null and empty texts too. The index of
    wide SimHashes gives the first links, verified by whole sets; the prefix-filtered join adds those between what
    they leave in different components, so that none is missed. A long posting of the join is first tried against
    its first LEADS sets; what that leaves in different components is tried pair by pair.
    """
    own = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    wide = [f"f{w}" for w in range(WIDE)]
    id_type = own.schema["doc_id"].dataType.simpleString()
    rows = staged(_sets(own.withColumn("text_hash", F.xxhash64("text")), ["doc_id", "text_hash"], words, f"doc_id {id_type}, text_hash long, {', '.join(f'{f} long' for f in wide)}, node long, n long, sketch binary", _nodes), "rows")
    nodes = staged(rows.groupBy("node").agg(F.min("text_hash").alias("text_hash"), *(F.first(f).alias(f) for f in ("n", "sketch", *wide))), "nodes")
    near = staged(wide_links(nodes.select("node", *wide), partitions(own)), "simhash-links")
    labels = components(_verified(own, near, nodes, words, percent), "simhash-components")
    common, counts = common_shingles(own, words)

    def posted(part: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
        del part
        first = {node_of(s): s for s in sets}
        keys = [prefix(s, percent, common, counts) for s in first.values()]
        each = [len(k) for k in keys]
        key = np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64)
        return _batch(key=key, node=np.repeat(np.array(list(first), np.int64), each), n=np.repeat(np.array([len(s) for s in first.values()], np.int64), each))

    postings = _sets(own, [], words, "key long, node long, n long", posted)
    found = staged(_candidates(postings, percent, partitions(own)), "candidates")
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
    met = found.filter("b IS NOT NULL").select("a", "b").distinct().join(of("a"), "a", "left").join(of("b"), "b", "left")
    pairs = staged(met.filter("NOT coalesce(label_a, a) <=> coalesce(label_b, b)").select("a", "b"), "pairs")
    labels = components(_star(labels).union(_verified(own, pairs, nodes, words, percent)))
    long = found.filter("b IS NULL").select("key", F.col("a").alias("node"), "n")
    named = long.join(labels, "node", "left").select("key", F.coalesce("label", "node").alias("label"), "node", "n")
    mixed = named.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least < most").select("key")
    tried = named.join(mixed, "key").join(nodes.select("node", "sketch"), "node").select("key", "label", "node", "n", "sketch")
    rest = staged(_apart(tried, percent, partitions(own)).distinct().join(pairs, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        labels = components(_star(labels).union(_verified(own, rest, nodes, words, percent)), "components-again")
    of_row = rows.join(labels, "node", "left").select("doc_id", "text_hash", F.coalesce("label", "node").alias("group"))
    of_row = staged(of_row, "groups")
    least = staged(of_row.groupBy("group").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")), "least")
    return join_spread(of_row, least, "group", "n", of_row.count()).select("doc_id", "text_hash", "component_id", "group")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest document id; of repeated rows, one."""
    return one_of_each(docs, near_duplicates(docs, doc_id, text, words, percent), doc_id, text)
