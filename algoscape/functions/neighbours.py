"""Nearest points by leaves of a k-d order, on numpy alone."""

from __future__ import annotations

import numpy as np

LEAF = 256


def leaves(x: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Row numbers in groups of at most ``leaf``, halved along the widest column."""
    out, todo = [], [np.arange(len(x))] if len(x) else []
    while todo:
        at = todo.pop()
        if len(at) <= leaf:
            out.append(at)
            continue
        own = x[at]
        c, half = int(np.argmax(np.ptp(own, axis=0))), len(at) // 2
        order = np.argpartition(own[:, c], half)
        todo += [at[order[half:]], at[order[:half]]]
    return out


class Leaves:
    """Points with whole-number ids, in leaves with boxes."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        groups = leaves(x)
        order = np.concatenate(groups) if groups else np.zeros(0, dtype=int)
        self.x, self.ids = np.ascontiguousarray(x[order]), ids[order]
        self.first = np.cumsum([0, *(len(g) for g in groups)])
        self.low = np.array([x[g].min(axis=0) for g in groups])
        self.high = np.array([x[g].max(axis=0) for g in groups])
        self.norm = (self.x**2).sum(axis=1)

    def nearest(self, q: np.ndarray, k: int, had_d: np.ndarray, had_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids of the k nearest points of every row of q among these and those had so far (rows of k, open
        places infinite with id -1), ties by id. Products only choose what is measured column by column."""
        out_d, out_id = had_d.copy(), had_id.copy()
        for at in leaves(q):
            out_d[at], out_id[at] = self._block(q[at], k, had_d[at], had_id[at])
        return out_d, out_id

    def _block(self, q, k, d, ids):
        if not len(self.x):
            return d, ids
        qlow, qhigh = q.min(axis=0), q.max(axis=0)
        gap = np.maximum(np.maximum(self.low - qhigh, qlow - self.high), 0.0)
        gap = (gap**2).sum(axis=1)
        norm = (q**2).sum(axis=1)
        # far beyond what rounding can do to products and boxes
        slack = 1e-10 * (norm + self.norm.max())
        for leaf in np.argsort(gap, kind="stable"):
            limit = d[:, -1] ** 2 * (1 + 1e-9) + slack
            if gap[leaf] > limit.max():
                break
            off = np.maximum(np.maximum(self.low[leaf] - q, q - self.high[leaf]), 0.0)
            near = np.flatnonzero((off**2).sum(axis=1) <= limit)
            if not len(near):
                continue
            a, b = self.first[leaf], self.first[leaf + 1]
            d2 = norm[near, None] + self.norm[None, a:b] - 2.0 * (q[near] @ self.x[a:b].T)
            most = limit[near]
            if b - a > k:
                # the k-th of this leaf bounds what can count
                most = np.minimum(most, np.partition(d2, k - 1, axis=1)[:, k - 1] + 2 * slack[near]) if not np.isfinite(most).all() else most
            i, j = np.nonzero(d2 <= most[:, None])
            if not len(i):
                continue
            i, j = near[i], j + a
            exact = np.zeros(len(i))
            for c in range(q.shape[1]):
                exact += (q[i, c] - self.x[j, c]) ** 2
            some = np.unique(i)
            i = np.concatenate([np.repeat(some, k), i])
            dist, who = np.concatenate([d[some].ravel(), np.sqrt(exact)]), np.concatenate([ids[some].ravel(), self.ids[j]])
            order = np.lexsort([who, dist, i])
            start = np.searchsorted(i[order], some)
            pick = order[start[:, None] + np.arange(k)]
            d[some], ids[some] = dist[pick], who[pick]
        return d, ids


def places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of every distinct place, and the place of every row."""
    order = np.lexsort(x.T[::-1])
    new = np.ones(len(x), dtype=bool)
    new[1:] = (x[order[1:]] != x[order[:-1]]).any(axis=1)
    own = np.empty(len(x), dtype=np.int64)
    own[order] = np.cumsum(new) - 1
    return order[new], own


class Voters:
    """Rows with flags and folds, which vote on places: the k nearest rows of other folds, ties by row number.

    ``folds`` has a column for each flag, or one for all. A place keeps the first ``most`` (the largest k) rows of each
    fold: those after them are never among the nearest.
    """

    def __init__(self, x: np.ndarray, flags: np.ndarray, folds: np.ndarray, most: int):
        own, kept = places(x)[1], np.ones(len(x), dtype=bool)
        if len(x) and np.bincount(own).max() > most:
            kept[:] = False
            for f in folds.T:
                order = np.lexsort([f, own])
                first = np.flatnonzero(np.r_[True, (np.diff(own[order]) != 0) | (np.diff(f[order]) != 0)])
                rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
                kept[order[rank < most]] = True
        self.flags, self.folds, self.most = flags[kept], folds[kept], most
        self.index = Leaves(x[kept], np.arange(int(kept.sum())))

    def shares(self, q: np.ndarray, folds: np.ndarray, ks: list[list[int]]) -> list[np.ndarray]:
        """For each flag the shares of true ones among the k nearest rows that are not in a query's fold, a column for each
        of the flag's ks (a fold under 0 holds no row); where fewer rows vote their share counts, and without any it is 0."""
        out, rows = [np.zeros((len(q), len(k))) for k in ks], len(self.flags)
        if not rows:
            return out
        first, own = places(q)
        todo, n = np.argsort(own, kind="stable"), min(rows, 2 * self.most + 4 if (folds >= 0).any() else self.most)
        # rows that lack voters among the n nearest look again, further
        while len(todo):
            missing = []
            some, start = np.unique(own[todo], return_index=True)
            start, block = np.append(start, len(todo)), max(1, 2_000_000 // n)
            for a in range(0, len(some), block):
                b = min(a + block, len(some))
                shape = (b - a, n)
                near = self.index.nearest(q[first[some[a:b]]], n, np.full(shape, np.inf), np.full(shape, -1))[1]
                for at in range(start[a], start[b], max(1, 400_000 // n)):
                    i = todo[at : min(at + max(1, 400_000 // n), start[b])]
                    missing.append(i[~self._vote(near[np.searchsorted(some, own[i]) - a], folds[i], ks, i, out)])
            if n == rows:
                break
            todo, n = np.concatenate(missing), min(4 * n, rows)
        return out

    def _vote(self, near, folds, ks, at, out) -> np.ndarray:
        """Fill the shares of some rows from their nearest; whether each had as many voters as it needs."""
        done = np.ones(len(at), dtype=bool)
        for g in range(folds.shape[1]):
            other = self.folds[near, g] != folds[:, g, None]
            seen = np.cumsum(other, axis=1)
            done &= seen[:, -1] >= self.most
            for j in range(len(ks)) if folds.shape[1] == 1 else [g]:
                yes = self.flags[near, j] & other
                for c, k in enumerate(ks[j]):
                    out[j][at, c] = (yes & (seen <= k)).sum(axis=1) / np.clip(seen[:, -1], 1, k)
        return done
