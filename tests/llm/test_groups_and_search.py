"""Ops 2, 5 and 6 against brute force and SQL."""

import math

import duckdb
import numpy as np
import pytest
import xxhash

from lagweave.llm import bitslices, graph, mixing, queries, simhash

DATA = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages".split()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = con.from_arrow(queries.QUERIES[name](spark, DATA).toArrow())
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(repr, got.select(*columns).fetchall())) == sorted(map(repr, want.select(*columns).fetchall()))


def brute_fingerprint(text, words=4):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([b" ".join(w)] if w else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles)) if shingles else 0


def brute_components(rows, bits=4):
    """(id, fingerprint, smallest id) for (id, fingerprint) rows."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        k = find(i)
        least[k] = min((x for x in (least.get(k), name) if x is not None), default=None)
    return sorted(repr((name, f"{f:016x}", least[find(i)])) for i, (name, f) in enumerate(rows))


def found(docs):
    return sorted(repr((r["doc_id"], r["fingerprint"], r["component_id"])) for r in simhash.near_duplicates(docs).collect())


def test_op5_rows(spark, odd, none):
    for docs in (odd, queries.table(spark, DATA, "documents")):
        assert found(docs) == brute_components([(r["doc_id"], brute_fingerprint(r["text"])) for r in docs.collect()])
    assert found(none) == []
    one_of_each = simhash.deduplicated(odd)
    assert one_of_each.columns == odd.columns
    kept = [r["doc_id"] for r in one_of_each.collect()]
    assert sorted(k for k in kept if k is not None) == [1, 3, 5, 7, 8, 9, 10, 11] and kept.count(None) == 1
    assert simhash.deduplicated(none).count() == 0


@pytest.mark.parametrize("tile", [8, 64, 4096])
def test_links_connect_what_brute_force_connects(spark, tile):
    """Random fingerprints, close groups, and one posting far over the tile."""
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 2**63, 40, dtype=np.int64).tolist()
    values = {*seeds, 0, 2**63 - 1}
    for s in seeds[:15]:
        for _ in range(12):
            for b in rng.choice(63, rng.integers(1, 6), replace=False):
                s ^= 1 << int(b)
            values.add(s)
    hot = seeds[20]
    values |= {hot ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (150, 2)) if a != b}
    nodes = spark.createDataFrame([(v,) for v in sorted(values)], "fp long")
    labels = {r["node"]: r["label"] for r in graph.components(simhash.links(nodes, tile=tile)).collect()}
    rows = sorted(values)
    groups: dict = {}
    for v in rows:
        groups.setdefault(labels.get(v, v), set()).add(v)
    want: list[set] = []
    for v in rows:
        near = [g for g in want if any((v ^ u).bit_count() <= 4 for u in g)]
        want = [g for g in want if g not in near] + [{v}.union(*near)]
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want))


def test_components_of_chains_and_loops(spark):
    edges = [(k, k + 1) for k in range(100)] + [(200, 201), (201, 200), (300, 300), (400, 401), (401, 402), (402, 400)]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(101), 0), 200: 200, 201: 200, 400: 400, 401: 400, 402: 400}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_top(rows, k, every):
    fine = [(i, tuple(max(-(2**50), min(2**50, math.floor(64 * x))) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, n in {(i, len(v)) for i, v in fine if i % every == 0}:
        own = max(v for i, v in fine if i == q and len(v) == n)
        scores = [(-sum(a * b for a, b in zip(own, v)), i) for i, v in fine if i != q and len(v) == n]
        out += [(q, s, i) for s, i in sorted(scores)[:k]]
    ranked = []
    for q in {q for q, _, _ in out}:
        ranked += [(q, r + 1, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(sorted((s, i) for p, s, i in out if p == q)[:k])]
    return sorted(ranked)


def test_op6_rows(spark, monkeypatch):
    monkeypatch.setattr(bitslices, "BLOCK_ROWS", 64)
    monkeypatch.setattr(bitslices, "BLOCK_QUERIES", 4)
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in np.round(rng.normal(0, 0.4, 4), 1)]) for i in range(300)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(300, 420)] + [(500, None), (None, [0.1] * 4), (520, [None, 0.1, 0.1, 0.1]), (540, [float("nan")] * 4), (560, [float("inf"), 0.0, 0.0, 0.0]), (7, [0.9] * 4), (20, [-0.7] * 4), (600, [0.0] * 4)]
    rows += [(580, [0.1, 0.2]), (581, [0.3, 0.1]), (582, [0.3, 0.1]), (620, []), (640, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS v", "3 AS score", "4 AS rank", "5 AS `a.b`")
    got = bitslices.top_inner_products(v.repartition(5), k=7)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute_top(rows, 7, 20)
    few = v.filter("vec_id IN (20, 3)")
    assert [tuple(r) for r in bitslices.top_inner_products(few).select("query_id", "rank", "vec_id").orderBy("rank").collect()] == [(20, 1, 3)]
    assert bitslices.top_inner_products(v.filter("false")).count() == 0


def test_op6_takes_large_components(spark):
    """Sums beyond 64 bits are ranked exactly; scores beyond a long are the nearest long."""
    rng = np.random.default_rng(10)
    rows = [(i, [float(x) for x in rng.choice([-1, 1], 5) * 2.0 ** rng.integers(-8, 60, 5)]) for i in range(90)] + [(100, [1e300, -1e300, 0.0, 1e-300, 5.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = bitslices.top_inner_products(v, k=9)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute_top(rows, 9, 20)
    small = [(i, [float(x) for x in 2.0 ** rng.integers(25, 33, 3)]) for i in range(50)]
    got = bitslices.top_inner_products(spark.createDataFrame(small, "vec_id long, embedding array<double>"), k=9)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute_top(small, 9, 20)


def test_slices_add_up():
    rng = np.random.default_rng(3)
    values = rng.integers(-64, 65, (130, 9))
    index = bitslices.BitSlices.unpack(bitslices.BitSlices.of(np.arange(130), values).pack())
    for query in [*rng.integers(-64, 65, (20, 9)), np.zeros(9, np.int64)]:
        slices, offset = index.sums(query)
        assert index.values_at(slices, np.arange(130), offset) == (values @ query).tolist()


def plain_mix(rows, mix):
    """Budgets by filling a tree top down, and each leaf's prefix of its epochs, in plain loops."""
    import hashlib
    import re

    leaves: dict = {}
    for name, text, lang, source in rows:
        number = re.search(r"([0-9]{1,9})$", source or "")
        domain = ["web", "books", "code"][int(number[1]) % 3] if number else "other"
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        leaves.setdefault((domain, lang or "", source or ""), []).append((name, n, hashlib.md5((text or "").encode()).hexdigest()))
    weight = lambda depth, x: mix.weights.get(mixing.LEVELS[depth], {}).get(x, 1)
    capacity = {k: sum(n for _, n, _ in v) * mix.epochs for k, v in leaves.items()}
    live = {k for k in leaves if all(weight(d, k[d]) for d in range(3))}
    budgets: dict = {}

    def fill(path, budget):
        depth = len(path)
        if depth == 3:
            budgets[path] = budget
            return
        kids = sorted({k[depth] for k in live if k[:depth] == path})
        cap = {x: sum(capacity[k] for k in live if k[: depth + 1] == (*path, x)) for x in kids}
        order = sorted(kids, key=lambda x: (cap[x] / weight(depth, x), x))
        left, rest = budget, sum(weight(depth, x) for x in kids)
        while order and cap[order[0]] * rest <= weight(depth, order[0]) * left:
            x = order.pop(0)
            fill((*path, x), cap[x])
            left, rest = left - cap[x], rest - weight(depth, x)
        done = 0
        for x in order:
            w = weight(depth, x)
            fill((*path, x), (done + w) * left // rest - done * left // rest)
            done += w

    fill((), sum(sum(n for _, n, _ in v) for v in leaves.values()) * mix.hundredths // 100)
    out = []
    for leaf, docs in leaves.items():
        tokens, budget = sum(n for _, n, _ in docs), budgets.get(leaf, 0)
        whole, part = (budget // tokens, budget % tokens) if tokens else (0, 0)
        start = 0
        for name, n, m in sorted(docs, key=lambda x: (hashlib.md5(f"{mix.seed}:{whole}:{'' if x[0] is None else x[0]}:{x[2]}".encode()).hexdigest(), x[1])):
            taken = max(0, min(n, part - start))
            start += n
            if n and (whole or taken):
                out.append((name, leaf[0], n, whole, taken))
    return sorted(map(repr, out))


@pytest.mark.parametrize("hundredths", [0, 7, 150, 500])
def test_op2_rows(spark, odd, hundredths):
    mix = mixing.Mix(weights={"domain": {"web": 3}, "lang": {"en": 5, "fr": 0}, "source": {"src1": 4}}, hundredths=hundredths, epochs=2)
    for docs in (odd, queries.table(spark, DATA, "documents")):
        want = plain_mix([tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()], mix)
        assert sorted(repr(tuple(r)) for r in mixing.mix_table(docs, mix).collect()) == want


def test_op2_empty(spark, none):
    assert mixing.mix_table(none, mixing.Mix()).count() == 0
