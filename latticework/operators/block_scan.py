"""Exact k nearest references of a task's queries, which references pass in blocks.

A block of references meets the queries in tiles.  One matrix product gives a lower bound of each squared distance less
the query's bound (the k-th distance so far), in single precision with room for its rounding, or in double precision where
that room lets too many pairs through.  Only pairs that may be among the k have their distance taken, from the differences.
So the work is the product over all pairs, and memory is that of the queries, a block and a tile.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

from .metric_index import CELLS, MARGIN, nearer

#: Kinds of numbers of a tile, each with its room for rounding (for a dimension, as a share of the squared lengths, and for
#: what is too small for the kind) and the largest square it is used for.
KINDS = (np.float32, 2.0**-21, 1e-35, 1e30), (np.float64, 2.0**-50, 1e-290, 1e300)
#: Pairs whose vectors are held at once, and found pairs that are held before they are merged.
PAIRS, FOUND = 1 << 16, 1 << 20
_LAST = np.iinfo(np.int64).max


class _Best:
    """The k nearest so far of each query, and their bound: the square of the k-th distance, with a margin."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.d, self.ids = k, np.full((n, k), np.nan), np.full((n, k), _LAST)
        self.filled, self.bound = np.zeros(n, np.int64), np.full(n, np.inf)

    def merge(self, q: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
        u, at = np.unique(q, return_inverse=True)
        got = nearer(*(np.concatenate(x) for x in ((np.repeat(u, self.k), q), (self.ids[u].ravel(), ids), (self.d[u].ravel(), d))), self.k)
        self.ids[u], self.d[u] = got[1].reshape(-1, self.k), got[2].reshape(-1, self.k)
        self.filled[u] = np.minimum(self.k, self.filled[u] + np.bincount(at, minlength=len(u)))
        last = self.d[u, -1] ** 2 * (1 + MARGIN)
        self.bound[u] = np.where((self.filled[u] >= self.k) & ~np.isnan(last), last, np.inf)


def _largest(a: np.ndarray) -> float:
    return np.max(a, where=np.isfinite(a), initial=0.0)


def scan(ids: np.ndarray, v: np.ndarray, above: np.ndarray | None, k: int, leave_self: bool, blocks: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, reference, distance), by query, distance and reference.  blocks: ids and vectors; ``leave_self``
    leaves out references with the query's id; with ``above`` only references farther than it count."""
    v = v.astype(float)
    held = _Best(len(ids), k)
    centre = v.mean(axis=0) if len(v) else 0.0
    centre = centre if np.isfinite(centre).all() else 0.0
    floor = None if above is None else np.where(above >= 0, above**2, np.where(np.isnan(above), np.nan, -np.inf))
    with np.errstate(all="ignore"):
        x = v - centre
        own = x, (x**2).sum(axis=1), x.astype(KINDS[0][0])
        for rid, rv in blocks:
            if not len(ids) or not len(rid):
                continue
            rv = rv.astype(float)
            y = rv - centre
            other = y, (y**2).sum(axis=1), {}
            found: list[tuple[np.ndarray, ...]] = []
            step = max(1, CELLS // len(rid))
            for lo in range(0, len(ids), step):
                q, r = _tile(slice(lo, lo + step), ids, own, floor, held, rid, other, leave_self)
                for s in range(0, len(q), PAIRS):
                    i, j = q[s : s + PAIRS], r[s : s + PAIRS]
                    d = np.sqrt(((rv[j] - v[i]) ** 2).sum(axis=1))
                    if above is not None:
                        i, j, d = (a[d > above[i]] for a in (i, j, d))
                    found.append((i, rid[j], d))
                if sum(len(f[0]) for f in found) >= FOUND or lo + step >= len(ids):
                    if any(len(f[0]) for f in found):
                        held.merge(*(np.concatenate(c) for c in zip(*found, strict=True)))
                    found = []
    at = np.arange(k)[None] < held.filled[:, None]
    return np.nonzero(at)[0], held.ids[at], held.d[at]


def _tile(part: slice, ids: np.ndarray, own: tuple, floor: np.ndarray | None, held: _Best, rid: np.ndarray, other: tuple, leave_self: bool) -> tuple[np.ndarray, np.ndarray]:
    """(query's place, reference's place) of the pairs that may be among the k nearest."""
    (x, xs, x32), (y, ys, lifted), k = own, other, held.k
    qs, width = xs[part], y.shape[1]
    q = r = np.zeros(0, np.int64)
    for kind, share, tiny, most in KINDS:
        fits = max(map(_largest, (qs, ys, held.bound[part]))) < most
        if not fits and kind is np.float32:
            continue
        c = share * (width + 16)
        if kind not in lifted:
            lifted[kind] = np.concatenate([y.T, (1 - c) * ys[None], np.ones((1, len(y)))]).astype(kind)
        limit = np.where(np.isinf(held.bound[part]), 0.0, held.bound[part])
        room = 2 * c * (qs + ys.max()) + 2 * tiny
        left = np.empty((len(qs), width + 2), kind)
        left[:, :width] = (x32 if kind is np.float32 else x)[part]
        left[:, :width] *= -2
        left[:, width], left[:, width + 1] = 1, (1 - c) * qs - limit - tiny
        low = left @ lifted[kind]
        wide = np.zeros(0, np.int64)
        if (new := np.flatnonzero(np.isinf(held.bound[part]))).size:  # no bound yet: the k-th in this block
            up = low[new] + room[new, None]
            if leave_self:
                up[ids[part][new][:, None] == rid[None]] = np.inf
            if floor is not None:
                up[~(low[new] > floor[part][new, None])] = np.inf
            kth = np.partition(up, k - 1, axis=1)[:, k - 1] if len(y) >= k else np.full(len(new), np.inf)
            wide = new[~np.isfinite(kth)]
            limit[new] = np.where(np.isfinite(kth), kth, 0.0)
            low[new] -= limit[new, None].astype(kind)
        may = ~(low > 0) if fits else np.ones(low.shape, bool)
        may[wide] = True
        if floor is not None:
            may &= ~(low <= (floor[part] - limit - room)[:, None])
        at = np.flatnonzero(may)
        q, r = at // len(y) + part.start, at % len(y)
        if len(at) <= 8 * k * len(qs) + may.size // 64:
            break
    if leave_self:
        q, r = (a[ids[q] != rid[r]] for a in (q, r))
    return q, r
