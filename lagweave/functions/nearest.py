"""Nearest rows of matrices: matrix products of bounded error choose, exact arithmetic decides."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: A tile of targets and the widest tile of sources that meet in one product.
ROWS, COLUMNS = 512, 4096
#: Pairs that are computed exactly at once.
PAIRS = 1 << 18

Exact = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def nearest(x: np.ndarray, y: np.ndarray, k: int, lo: np.ndarray, hi: np.ndarray, exact: Exact, root: int = 0, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j, value: for each row x[i] the ``k`` of y[lo[i]:hi[i]] of least value, ties to the lesser j; in the order of i, value and j.

    ``exact`` is given i and j and returns those that have a value, with their values: the squared
    distance of x[i] and y[j], or with ``root`` the root of that by ``root``, rounded by less than ``slack``. Distances come from matrix products of 32 bits first (64 where those leave too
    many), whose rounding is bounded; each pair that may be among the best by them is given to
    ``exact``. Rows with NaN are given to it with all others.
    """
    best, at = np.full((len(x), k), np.inf), np.full((len(x), k), -1)
    with np.errstate(all="ignore"):
        whole = np.isfinite(y).all(axis=1)
        middle = y[whole].mean(axis=0) if whole.any() else np.zeros(y.shape[1])
        u, v = x - middle, y - middle
        far = max((float(np.abs(m[np.isfinite(m)]).max(initial=0)) for m in (u, v)), default=0) * np.sqrt(x.shape[1]) or 1.0
        u, v = u / far, v / far
        uu, vv = (u * u).sum(axis=1), (v * v).sum(axis=1)
        un, vn = (np.where(np.isfinite(m), np.sqrt(m), np.nan) for m in (uu, vv))
        # What moving to the middle and scaling round off, in squared distances that are at most four.
        moved = 2.0**-46 * (float(np.abs(middle).max(initial=0)) * np.sqrt(x.shape[1]) / far + 1) if 1e-140 < far < 1e150 else np.inf
        left, right = {}, {}
        for kind in (np.float32, np.float64):
            left[kind] = np.hstack([u, np.ones((len(u), 1))]).astype(kind)
            right[kind] = np.hstack([v, -vv[:, None] / 2]).T.astype(kind, order="C")
        room = {kind: np.empty(ROWS * COLUMNS, kind) for kind in (np.float32, np.float64, bool)}
        for t in range(0, len(x), ROWS):
            own = slice(t, t + ROWS)
            low, high = lo[own], hi[own]
            a, end, width = int(low.min()), int(high.max()), 256
            while a < end:
                b, width = min(a + width, end), min(2 * width, COLUMNS)
                columns = np.arange(a, b)
                allowed = None if low.max() <= a and b <= high.min() else (columns >= low[:, None]) & (columns < high[:, None])
                least = best[own, k - 1]
                open_ = at[own, k - 1] < 0
                # Of equals the lesser j wins, so nothing further on is better than zero.
                done = ~open_ & (least <= 0)
                if done.all():
                    break
                for kind in (np.float32, np.float64):
                    score, maybe = (room[r][: len(low) * (b - a)].reshape(len(low), b - a) for r in (kind, bool))
                    np.matmul(left[kind][own], right[kind][:, a:b], out=score)  # what they share, less half of the source's square
                    if allowed is not None:
                        score[~allowed] = -np.inf
                    off = (2 * x.shape[1] + 16) * np.finfo(kind).eps * (un[own] + np.fmax.reduce(vn[a:b])) ** 2 + moved
                    reach = (least * np.sqrt(root) if root else np.sqrt(least)) / far
                    if open_.any():
                        kth = np.partition(np.fmax(score[open_], -np.inf), b - a - k, axis=1)[:, b - a - k] if b - a >= k else -np.inf
                        reach[open_] = np.sqrt(np.maximum(uu[own][open_] - 2 * kth, 0) + off[open_])
                    need = (uu[own] - (reach + slack * np.sqrt(root) / far) ** 2 - off) / 2
                    need[done] = np.inf
                    np.less(score, need.astype(kind)[:, None], out=maybe)
                    np.logical_not(maybe, out=maybe)
                    if allowed is not None:
                        maybe &= allowed
                    if done.any():
                        maybe[done] = False
                    flat = _places(room[bool], maybe.size)
                    if 8 * len(flat) < maybe.size:
                        break
                for p in range(0, len(flat), PAIRS):
                    i, j = np.divmod(flat[p : p + PAIRS], b - a)
                    _merge(best, at, *exact(i + t, j + a))
                a = b
    i, rank = np.nonzero(at >= 0)
    return i, at[i, rank], best[i, rank]


def _places(marks: np.ndarray, n: int) -> np.ndarray:
    """Where the first ``n`` marks are set, eight looked at together; the marks past them up to eight are cleared."""
    words = -(-n // 8)
    marks[n : 8 * words] = False
    some = np.flatnonzero(marks[: 8 * words].view(np.uint64))
    places = (some[:, None] * 8 + np.arange(8)).ravel()
    return places[marks[places]]


def _merge(best: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray, value: np.ndarray) -> None:
    """Put pairs among the best of their targets."""
    k = best.shape[1]
    seen = np.unique(i)
    i, j, value = np.concatenate([np.repeat(seen, k), i]), np.concatenate([at[seen].ravel(), j]), np.concatenate([best[seen].ravel(), value])
    held = j >= 0
    i, j, value = i[held], j[held], value[held]
    order = np.lexsort((j, value, i))
    i, j, value = i[order], j[order], value[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    first = rank < k
    best[i[first], rank[first]], at[i[first], rank[first]] = value[first], j[first]
