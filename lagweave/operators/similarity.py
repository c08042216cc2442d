"""Earlier material that a frame resembles: nearest earlier frames, alignment by lag, sections and lineages."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nearest import nearest
from .signals import CHUNK, div, halo

#: Fingerprints that meet in one group: a block of targets with a block of sources.
BLOCK = 2048


def squared_distance(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def meet(rows: DataFrame, best: Callable[[pa.Table], pa.Table], schema: str, back: int = 0, fewest: int = 1024, most: int = 1 << 16) -> DataFrame:
    """What ``best`` makes of each pair of a block of targets and one of no later sources.

    Blocks are of about as many rows, in the order of f: 8, or less so that one has ``fewest``, or more
    so that none has over ``most``. A pair of them is a group and a partition of its own, whose table
    has tb, sb, target (the side that a row is on), own (not of the ``back`` places before a block) and
    the rows' columns.
    """
    grid = 1024
    n, marks = rows.agg(F.count("*"), F.percentile_approx("f", [i / grid for i in range(1, grid)], 16 * grid)).first()
    blocks = 1
    while blocks < grid and (n > blocks * most or blocks < 8 and n >= 2 * blocks * fewest):
        blocks *= 2
    ends = sorted(set((marks or [])[grid // blocks - 1 :: grid // blocks]))
    cuts, top = F.lit(ends).cast("array<bigint>"), len(ends)
    dealt = rows.withColumn("b", F.size(F.filter(cuts, lambda c: c < F.col("f")))).withColumn("own", F.lit(True))
    if back:
        copy = F.when(F.col("f") > F.get(cuts, F.col("b")) - back, F.struct((F.col("b") + 1).alias("b"), F.lit(False).alias("own")))
        dealt = dealt.select(*rows.columns, F.inline(F.array_compact(F.array(F.struct("b", "own"), copy))))
    pair = lambda t, s, target: F.struct(t.alias("tb"), s.alias("sb"), F.lit(target).alias("target"))
    places = F.concat(F.transform(F.sequence(F.lit(0), F.col("b")), lambda o: pair(F.col("b"), o, True)), F.transform(F.sequence(F.col("b"), F.lit(top)), lambda o: pair(o, F.col("b"), False)))
    return dealt.select(F.inline(places), "own", *rows.columns).repartition((top + 1) * (top + 2) // 2, "tb", "sb").groupBy("tb", "sb").applyInArrow(best, schema)


def sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The places of targets and of sources in a table of ``meet``, in the order of f."""
    target, f = table["target"].to_numpy(zero_copy_only=False).astype(bool), table["f"].to_numpy()
    targets, sources = (at[np.argsort(f[at], kind="stable")] for at in (np.flatnonzero(target), np.flatnonzero(~target)))
    return targets, sources


def nearest_earlier(prints: DataFrame, k: int, gap: int = 2, keep: Column | None = None, **blocks: int) -> DataFrame:
    """t, s, d, rk: for each frame t the ``k`` nearest frames s with s + ``gap`` < t by squared distance, ties to the earlier.

    Blocks of frames ``meet`` in pairs; there ``nearest`` compares matrices, and ``k`` rows a target
    leave it. ``keep`` restricts both sides, as the onset pool does.
    """
    rows = (prints if keep is None else prints.filter(keep)).select("f", "v")

    def best(table: pa.Table) -> pa.Table:
        f, v = table["f"].to_numpy(), table["v"].combine_chunks()
        x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(f), -1) if len(f) else np.zeros((0, 1))
        targets, sources = sides(table)
        tf, sf, tv, sv = f[targets], f[sources], x[targets], x[sources]
        ta, sa = np.ascontiguousarray(tv.T), np.ascontiguousarray(sv.T)

        def exact(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            # Terms are added one attribute after another, as SQL does, so that equal distances are equal everywhere.
            d = np.zeros(len(i))
            with np.errstate(all="ignore"):
                for a, b in zip(ta, sa, strict=True):
                    d += (a[i] - b[j]) ** 2
            return i, j, d

        i, j, d = nearest(tv, sv, k, np.zeros(len(tf), np.int64), np.searchsorted(sf, tf - gap), exact)
        return pa.table({"t": pa.array(tf[i], pa.int64()), "s": pa.array(sf[j], pa.int64()), "d": pa.array(d, pa.float64())})

    found = meet(rows, best, "t long, s long, d double", **blocks)
    rank = F.row_number().over(Window.partitionBy("t").orderBy("d", "s"))
    return found.withColumn("rk", rank).filter(F.col("rk") <= k)


def sections(prints: DataFrame, length: int = 32, step: int = 16) -> DataFrame:
    """f, v: mean fingerprints of sections of ``length`` frames every ``step``, whole ones only."""
    reach = length // step
    last = F.floor(F.col("f") / step).cast("long")
    dealt = prints.withColumn("w", F.explode(F.sequence(last - (reach - 1), last))).filter("w >= 0")
    flat = dealt.select("w", "f", F.posexplode("v").alias("a", "x"))
    means = flat.groupBy("w", "a").agg(F.round(F.avg("x"), 9).alias("m"), F.count("*").alias("c")).filter(F.col("c") == length)
    return means.groupBy(F.col("w").alias("f")).agg(F.transform(F.array_sort(F.collect_list(F.struct("a", "m"))), lambda p: p["m"]).alias("v"))


def frame_match(signal: DataFrame, size: int, gap: int = 2) -> DataFrame:
    """t, s, ncc: for each whole frame the earlier one of the highest normalised correlation, ties to the earlier.

    Frames are arrays of samples in blocks; a pair of blocks is one matrix product of integers.
    """
    rows = signal.groupBy(div("n", size).alias("f")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda p: p["x"].cast("double")).alias("v")).filter(F.size("v") == size)
    block = BLOCK
    rows = rows.withColumn("b", div("f", block))
    top = rows.agg(F.max("b").cast("int")).first()[0]
    if top is None:
        return rows.select(F.col("f").alias("t"), F.col("f").alias("s"), F.lit(0.0).alias("ncc"))
    targets = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("b").cast("int")))).select(F.col("b").alias("tb"), F.col("o").cast("long").alias("sb"), F.lit(True).alias("target"), "f", "v")
    sources = rows.withColumn("o", F.explode(F.sequence(F.col("b").cast("int"), F.lit(top)))).select(F.col("o").cast("long").alias("tb"), F.col("b").alias("sb"), F.lit(False).alias("target"), "f", "v")

    def best(table: pa.Table) -> pa.Table:
        side = table["target"].to_numpy(zero_copy_only=False).astype(bool)
        f = table["f"].to_numpy()
        v = np.stack(table["v"].to_numpy(zero_copy_only=False))
        order = np.argsort(f[~side], kind="stable")
        sf, sv = f[~side][order], v[~side][order]
        tf, tv = f[side], v[side]
        if not len(tf) or not len(sf):
            return pa.table({"t": pa.array([], pa.int64()), "s": pa.array([], pa.int64()), "ncc": pa.array([], pa.float64())})
        norm = np.sqrt((tv * tv).sum(axis=1))[:, None] * np.sqrt((sv * sv).sum(axis=1))[None]
        with np.errstate(all="ignore"):
            ncc = np.where((norm > 0) & (sf[None] + gap <= tf[:, None]), np.round((tv @ sv.T) / norm, 6), -np.inf)
        at = ncc.argmax(axis=1)
        ok = np.isfinite(ncc[np.arange(len(tf)), at])
        return pa.table({"t": pa.array(tf[ok]), "s": pa.array(sf[at][ok]), "ncc": pa.array(ncc[np.arange(len(tf)), at][ok])})

    found = targets.unionByName(sources).groupBy("tb", "sb").applyInArrow(best, "t long, s long, ncc double")
    return found.groupBy("t").agg(F.max_by(F.struct("s", "ncc"), F.struct("ncc", -F.col("s"))).alias("b")).select("t", "b.s", "b.ncc")


def align(signal: DataFrame, guesses: DataFrame, size: int, reach: int) -> DataFrame:
    """t, offset, ncc, guess: for each guess (t: frame, guess: sample; one a frame) the place within ``reach`` of the guess that matches frame t best.

    Frames are arrays of samples; they and the guesses, with the samples of their frames, meet in the
    chunk that the guess is in. Sums are exact integers there; lags that are clearly worse than another
    stay, the few others are rounded and compared. The smaller offset wins ties. Windows end before the
    frame begins.
    """
    frames = signal.groupBy(div("n", size).alias("f")).agg(F.collect_list(F.struct("n", "x")).alias("v")).select("f", F.col("v.n").alias("n"), F.col("v.x").alias("x"))
    chunk = max(CHUNK // size, reach // size + 2)
    sources = halo(frames, -(-reach // size), reach // size + 2, chunk, "f").select("chunk", F.col("n").alias("sn"), F.col("x").alias("sx"))
    targets = guesses.join(frames.withColumnRenamed("f", "t"), "t").select(div("guess", chunk * size).alias("chunk"), "t", "guess", "n", "x")

    def sums(n: np.ndarray, x: np.ndarray, length: int) -> list[np.ndarray]:
        """How many samples each place has, their sum and that of their squares."""
        out = [np.zeros(length, np.int64) for _ in range(3)]
        for total, term in zip(out, (np.ones_like(x), x, x * x), strict=True):
            np.add.at(total, n, term)
        return out

    def flat(*columns: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The row, number and value of all samples."""
        n, x = (c.combine_chunks() for c in columns)
        rows = np.repeat(np.arange(len(n)), n.value_lengths().to_numpy(zero_copy_only=False))
        return rows, n.flatten().to_numpy(zero_copy_only=False), pc.fill_null(x.flatten(), 0).to_numpy(zero_copy_only=False)

    def best(targets: pa.Table, sources: pa.Table) -> pa.Table:
        t, guess = (targets[c].to_numpy() for c in ("t", "guess"))
        out: list[np.ndarray] = []
        if len(t) and len(sources):
            low, places = int(guess.min()) - reach, int(guess.max() - guess.min()) + 2 * reach + size
            _, n, x = flat(sources["sn"], sources["sx"])
            near = (n >= low) & (n < low + places)
            row, tn, tx = flat(targets["n"], targets["x"])
            tc, t1, t2 = (m.reshape(len(t), size) for m in sums(row * size + tn - t[row] * size, tx, len(t) * size))
            sc, s1, s2 = (m[(guess - reach - low)[:, None] + np.arange(2 * reach + size)] for m in sums(n[near] - low, x[near], places))
            lags = np.arange(2 * reach + 1)
            xy, xx, yy = (np.stack([np.einsum("gi,gi->g", a, b[:, k : k + size]) for k in lags], axis=1) for a, b in ((t1, s1), (t2, sc), (tc, s2)))
            offset = guess[:, None] - reach + lags
            ok = (offset >= 0) & (offset + size <= t[:, None] * size) & (xx > 0) & (yy > 0)
            ncc = np.where(ok, xy / np.sqrt(np.maximum(xx, 1).astype(float) * np.maximum(yy, 1)), -np.inf)
            g, k = np.nonzero(ok & (ncc >= ncc.max(axis=1, keepdims=True) - 3e-6))
            out = [t[g], guess[g], offset[g, k], xy[g, k], xx[g, k], yy[g, k]]
        names = ["t", "guess", "offset", "xy", "xx", "yy"]
        return pa.table({c: pa.array(m, pa.int64()) for c, m in zip(names, out or [[]] * 6, strict=True)})

    found = targets.groupBy("chunk").cogroup(sources.groupBy("chunk")).applyInArrow(best, "t long, guess long, offset long, xy long, xx long, yy long")
    ncc = F.round(F.col("xy") / F.sqrt(F.col("xx").cast("double") * F.col("yy")), 6)
    return found.withColumn("ncc", ncc).groupBy("t").agg(F.max_by(F.struct("offset", "ncc", "guess"), F.struct("ncc", -F.col("offset"))).alias("b")).select("t", "b.offset", "b.ncc", "b.guess")


def align_far(signal: DataFrame, guesses: DataFrame, size: int, reach: int, step: int) -> DataFrame:
    """``align`` over a wide reach: all lags of the signal summed by ``step`` samples (guesses are in such steps), then ``step`` samples either way of the best."""
    low = signal.groupBy(div("n", step).alias("n")).agg(F.sum("x").alias("x"))
    coarse = align(low, guesses, size // step, reach // step)
    return align(signal, coarse.select("t", (F.col("offset") * step).alias("guess")), size, step)


def lag_map(levels: DataFrame, floors: tuple[int, ...], length: int = 32, least: int = 16, **blocks: int) -> DataFrame:
    """f, least, lag, d: for each frame and each of ``floors`` the lag from that on at which the last ``length`` frames' levels (f, e) differ least.

    d is the root of the mean square difference, to six places, over at least ``least`` frames that
    are there; ties go to the shorter lag. Blocks of frames, each with the ``length`` - 1 places before
    it, ``meet`` in pairs; the last levels of a frame are a row of a matrix for ``nearest``, and no more
    than one row a frame and floor leaves it. The whole is quadratic in frames, as all lags are.
    """

    def windows(f: np.ndarray, e: np.ndarray, own: np.ndarray) -> np.ndarray:
        """A row for each place back from the own frames, NaN where no frame is."""
        out = np.full((length, int(own.sum())), np.nan)
        for k in range(length):
            at = np.minimum(np.searchsorted(f, f[own] - k), len(f) - 1)
            out[k] = np.where(f[at] == f[own] - k, e[at], np.nan)
        return out

    def best(table: pa.Table) -> pa.Table:
        f, e, own = (table[c].to_numpy(zero_copy_only=False) for c in ("f", "e", "own"))
        own, (targets, sources) = own.astype(bool), sides(table)
        tw, sw = (windows(f[at], e[at], own[at]) if len(at) else np.zeros((length, 0)) for at in (targets, sources))
        # Of equals the latest source, so sources are gone through backwards.
        tf, sf, sw = f[targets][own[targets]], f[sources][own[sources]][::-1], np.ascontiguousarray(sw[:, ::-1])

        def exact(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            total, n = np.zeros(len(i)), np.zeros(len(i), np.int16)
            for a, b in zip(tw, sw, strict=True):
                square = (a[i] - b[j]) ** 2
                there = ~np.isnan(square)
                total += np.where(there, square, 0)
                n += there
            ok = (n >= least) & ~np.isnan(tw[0][i] - sw[0][j])
            return i[ok], j[ok], np.round(np.sqrt(total[ok] / n[ok]), 6)

        found, before = set(), None
        for floor in floors if len(tf) and len(sf) else ():
            lo = np.searchsorted(-sf, floor - tf)
            if before is None or (lo != before).any():
                i, j, d = nearest(tw.T, sw.T, 1, lo, np.full(len(tf), len(sf)), exact, root=length, slack=1e-6)
                found |= set(zip(tf[i].tolist(), (tf[i] - sf[j]).tolist(), d.tolist(), strict=True))
            before = lo
        f, lag, d = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"f": pa.array(f, pa.int64()), "lag": pa.array(lag, pa.int64()), "d": pa.array(d, pa.float64())})

    found = meet(levels.select("f", F.col("e").cast("double").alias("e")), best, "f long, lag long, d double", back=length - 1, **blocks)
    each = found.groupBy("f").agg(*(F.min(F.when(F.col("lag") >= floor, F.struct("d", "lag"))).alias(f"_{floor}") for floor in floors))
    rows = F.array(*(F.struct(F.lit(floor).cast("long").alias("least"), F.col(f"_{floor}.lag").alias("lag"), F.col(f"_{floor}.d").alias("d")) for floor in floors))
    return each.select("f", F.inline(rows)).filter("lag IS NOT NULL")


def roots(links: DataFrame, rounds: int = 64) -> DataFrame:
    """t, root: each target's source replaced by its own source until it has none (links: t, s with s < t).

    Pointers jump: a round halves the way that is left, and rounds end when nothing changes.
    """
    now = links.select("t", F.col("s").alias("root"))
    for _ in range(rounds):
        onward = now.select(F.col("t").alias("root"), F.col("root").alias("next"))
        moved = now.join(onward, "root", "left")
        after = moved.select("t", F.coalesce("next", "root").alias("root"))
        if not moved.filter("next IS NOT NULL").limit(1).count():
            return now
        after = after.checkpoint()
        now = after
    return now


def depths(links: DataFrame) -> DataFrame:
    """t, depth: how many links each target's chain of sources has (links: t, s with s < t, one a target).

    Pointers jump as in ``roots``, and carry how far they have come.
    """
    now = links.select("t", F.col("s").alias("root"), F.lit(1).cast("long").alias("depth")).checkpoint()
    while True:
        onward = now.select(F.col("t").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        moved = now.join(onward, "root", "left").select("t", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), "next").checkpoint()
        if moved.filter("next IS NOT NULL").isEmpty():
            return now.select("t", "depth")
        now = moved.drop("next")
