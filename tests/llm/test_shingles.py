"""The near-dedup stage against brute force over whole shingle sets."""

import random

import numpy as np
import pytest

import corpus_pipeline
from lagweave.llm import queries, shingles, simhash

DATA = "/root/testdata/sf0.001"


def brute(rows, words=5):
    """{id: smallest id of its component} by every pair's Jaccard similarity."""
    sets = {}
    for name, text in rows:
        w = (text or "").encode().lower().split()
        sets[name] = frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) or (frozenset([tuple(w)]) if w else frozenset())
    root = {}
    for name in sorted(sets):
        x = sets[name]
        near = {root[o] for o in root if x == sets[o] or 5 * min(len(x), len(sets[o])) >= 4 * max(len(x), len(sets[o])) and 5 * len(x & sets[o]) >= 4 * len(x | sets[o])}
        least = min([name, *near])
        root = {o: least if r in near else r for o, r in root.items()} | {name: least}
    return root


def found(docs):
    return {r["doc_id"]: r["component_id"] for r in shingles.near_duplicates(docs).collect()}


def test_stage_takes_small_edits(spark):
    """One word of 60 changed: similarity 51/61; at four words and 4 bits such copies stayed."""
    rng = random.Random(4)
    rows = []
    for k in range(20):
        text = [f"w{rng.randrange(10_000)}" for _ in range(60)]
        edited = [*text[:30], "changed", *text[31:]]
        rows += [(2 * k, " ".join(text), "en", "src1"), (2 * k + 1, " ".join(edited), "en", "src1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in corpus_pipeline.dedup_stage(spark, docs, DATA).collect()}
    assert kept == set(range(0, 40, 2)) == set(brute([r[:2] for r in rows]).values())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_tables(spark, sf):
    docs = queries.table(spark, f"/root/testdata/{sf}", "documents")
    assert found(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("small", [2, 32])
def test_long_postings_chains_and_common_lines(spark, monkeypatch, small):
    monkeypatch.setattr(shingles, "SMALL", small)
    monkeypatch.setattr(shingles, "COMMON", 30)
    rng = random.Random(small)
    base, line = [f"b{k}" for k in range(80)], [f"c{k}" for k in range(20)]
    texts = []
    for k in range(60):  # near copies that drift away from the first
        base = [*base]
        base[rng.randrange(80)] = f"e{k}"
        texts.append(" ".join(base))
    texts += [" ".join([*line, *(f"u{rng.randrange(9999)}" for _ in range(rng.randrange(2, 30)))]) for _ in range(80)]
    texts += [" ".join([*line, f"z{k}"]) for k in range(40)] + ["", "one", "one two", "one"]
    rows = list(enumerate(texts))
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)


def test_sketches_keep_no_similar_sets_apart():
    rng = np.random.default_rng(6)
    kept = 0
    for k in range(600):
        n = int(rng.choice([1, 5, 40, 127, 128, 300, 2049, 6000]))
        x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64) & ~np.uint64(63 if k % 9 == 0 else 0))
        y = np.unique(np.r_[x[int(len(x) * rng.random() * 0.3) :], rng.integers(0, 2**64, int(n * rng.random() * 0.2), dtype=np.uint64)])
        maybe = shingles.may_be_alike(shingles.sketch_of(x), shingles.sketch_of(y), len(x), len(y), 80)
        assert maybe or not shingles.alike(x, y, 80)
        kept += shingles.alike(x, y, 80)
        other = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        if 40 <= n and k % 9:
            assert not shingles.may_be_alike(shingles.sketch_of(x), shingles.sketch_of(other), len(x), len(other), 80)
    assert kept > 100


def edited_texts(rng, n, words, edits):
    for _ in range(n):
        text = [f"w{rng.randrange(10_000)}" for _ in range(words)]
        other = [*text]
        for _ in range(edits):
            other[rng.randrange(words)] = "changed"
        yield " ".join(text), " ".join(other)


def test_wide_simhash_index_finds_similar_sets(spark):
    """The index alone, against brute force: of pairs that are 0.8 alike or more it connects at least 0.9."""
    rng = random.Random(9)
    sets = [shingles.shingle_set(t) for n, e in ((60, 1), (200, 3), (400, 8), (1000, 20)) for pair in edited_texts(rng, 60, n, e) for t in pair]
    alike = [(2 * k, 2 * k + 1) for k in range(len(sets) // 2) if shingles.alike(sets[2 * k], sets[2 * k + 1], 80)]
    assert len(alike) > 100
    wide = simhash.wide_fingerprints(sets).view(np.int64)
    nodes = spark.createDataFrame([(k, *map(int, f)) for k, f in enumerate(wide)], "node long, f0 long, f1 long, f2 long, f3 long")
    links = [tuple(r) for r in simhash.wide_links(nodes, 3).collect()]
    assert len(links) == len(set(links)) and all(a < b for a, b in links)
    assert sum(p in set(links) for p in alike) >= 0.9 * len(alike)
    assert all(a // 2 == b // 2 for a, b in links)


def test_stage_links_by_the_wide_simhash_index(spark, monkeypatch):
    """Without the join that completes them, the index's links are still those of nearly all near copies."""
    docs = spark.createDataFrame([(2 * k + i, t, "en", "src1") for k, pair in enumerate(edited_texts(random.Random(5), 80, 300, 3)) for i, t in enumerate(pair)], "doc_id long, text string, lang string, source string")
    monkeypatch.setattr(shingles, "_candidates", lambda postings, percent, n_parts: spark.createDataFrame([], "a long, b long, key long, n long"))
    kept = {r["doc_id"] for r in corpus_pipeline.dedup_stage(spark, docs, DATA).collect()}
    assert {2 * k for k in range(80)} <= kept and len(kept) <= 84


@pytest.mark.parametrize("small", [4, 32])
def test_long_postings_of_wide_fingerprints(spark, monkeypatch, small):
    """Postings give forests that connect what all their pairs connect, and no link twice."""
    monkeypatch.setattr(simhash, "WIDE_SMALL", small)
    rng = np.random.default_rng(small)
    base = rng.integers(0, 2**63, (3, 4), dtype=np.uint64)
    f = np.concatenate([base[k] ^ np.where(rng.random((250, 4)) < 0.6, np.uint64(1) << rng.integers(0, 64, (250, 4)).astype(np.uint64), np.uint64(0)) for k in range(3)])
    f = np.unique(f, axis=0)
    links = [tuple(r) for r in simhash.wide_links(spark.createDataFrame([(k, *map(int, v)) for k, v in enumerate(f.view(np.int64))], "node long, f0 long, f1 long, f2 long, f3 long"), 3).collect()]
    root = list(range(len(f)))
    for a, b in links:
        root = [root[b] if r == root[a] else r for r in root]
    of = [int(np.argmin(np.bitwise_count(base ^ v).sum(axis=1))) for v in f]
    assert len(links) == len(set(links)) and len(set(root)) == 3 == len(set(zip(root, of, strict=True)))


def test_long_postings_give_only_pairs_that_may_be_alike(spark):
    """1,200 different sets that share a few shingles are no pairs; 10 that are alike to one each are."""
    rng = np.random.default_rng(3)
    common = rng.integers(0, 2**64, 10, dtype=np.uint64)
    sets = [np.unique(np.r_[common, rng.integers(0, 2**64, int(rng.integers(300, 500)), dtype=np.uint64)]) for _ in range(1200)]
    sets += [np.unique(np.r_[s[:-9], rng.integers(0, 2**64, 9, dtype=np.uint64)]) for s in sets[:10]]
    rows = [(key, k if k < 1200 else 5000 + k, k, len(s), bytearray(shingles.sketch_of(s))) for key in (7, 8) for k, s in enumerate(sets)]
    found = shingles._apart(spark.createDataFrame(rows, "key long, label long, node long, n long, sketch binary"), 80, 3)
    pairs = [tuple(r) for r in found.collect()]
    assert {(k, 1200 + k) for k in range(10)} <= set(pairs) and len(pairs) <= 100
    same = spark.createDataFrame([(k, 0, *r) for k, _, *r in rows], "key long, label long, node long, n long, sketch binary")
    assert shingles._apart(same, 80, 3).isEmpty()


def test_postings_without_links(spark):
    rng = np.random.default_rng(8)
    f = rng.integers(0, 2**63, (50, 4), dtype=np.int64) & ~0xFFFF
    rows = lambda n: spark.createDataFrame([(k, *map(int, v)) for k, v in enumerate(f[:n])], "node long, f0 long, f1 long, f2 long, f3 long")
    assert simhash.wide_links(rows(5), 2).isEmpty() and simhash.wide_links(rows(50), 2).isEmpty() and simhash.wide_links(rows(5).limit(0), 2).isEmpty()


def test_long_postings_of_sets_just_below_the_similarity(spark):
    """Copies of one text that are 0.6 to 0.75 alike with each other are no pairs, though nearly all were by coarser sketches; 12 that are alike to one each are."""
    rng = np.random.default_rng(11)
    base = rng.integers(0, 2**64, 200, dtype=np.uint64)
    sets = [np.unique(np.r_[rng.choice(base, 182, replace=False), rng.integers(0, 2**64, 18, dtype=np.uint64)]) for _ in range(300)]
    sets += [np.unique(np.r_[s[:-8], rng.integers(0, 2**64, 8, dtype=np.uint64)]) for s in sets[:12]]
    alike = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if shingles.alike(sets[i], sets[j], 80)}
    rows = [(7, k, k, len(s), bytearray(shingles.sketch_of(s))) for k, s in enumerate(sets)]
    pairs = {tuple(r) for r in shingles._apart(spark.createDataFrame(rows, "key long, label long, node long, n long, sketch binary"), 80, 2).collect()}
    assert len(alike) >= 12 and alike <= pairs and len(pairs) <= len(alike) + 450


def test_sketches_of_other_lengths():
    """A sketch that is folded to a shorter one's length keeps no similar sets apart."""
    rng = np.random.default_rng(12)
    for n in (14, 15, 16, 120, 127, 128, 1020, 1024):
        x = rng.integers(0, 2**64, n, dtype=np.uint64)
        y = np.r_[x, rng.integers(0, 2**64, n // 5, dtype=np.uint64)]
        a, b = shingles.sketch_of(x), shingles.sketch_of(y)
        assert shingles.alike(np.sort(x), np.sort(y), 80) and shingles.may_be_alike(a, b, len(x), len(y), 80) and shingles.may_be_alike(b, a, len(y), len(x), 80)
