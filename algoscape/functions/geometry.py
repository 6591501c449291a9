"""Planar regions as sets of disjoint convex pieces, on numpy alone."""

from __future__ import annotations

from fractions import Fraction

import numpy as np

_EPS = 1e-12


def cross(o, a, b) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def convex_hull(points: np.ndarray, keep_degenerate: bool = False) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise (monotone chain); fewer than three if there is no area."""
    pts = np.unique(np.asarray(points, dtype=float).reshape(-1, 2), axis=0)
    if len(pts) < 3:
        return pts if keep_degenerate else np.zeros((0, 2))

    def chain(seq):
        out: list = []
        for p in seq:
            while len(out) > 1 and cross(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    hull = np.array(chain(pts) + chain(pts[::-1]))
    return hull if len(hull) >= 3 or keep_degenerate else np.zeros((0, 2))


def area(piece: np.ndarray) -> float:
    """Area of a counter-clockwise polygon."""
    x, y = piece[:, 0], piece[:, 1]
    return float(x[:-1] @ y[1:] - y[:-1] @ x[1:] + x[-1] * y[0] - y[-1] * x[0]) / 2


def pack(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Corners of all pieces as one array, shorter pieces padded by their last corner, and the numbers of corners."""
    n = np.array([len(p) for p in pieces], dtype=np.int64)
    out = np.zeros((len(pieces), int(n.max(initial=3)), 2))
    for k in np.unique(n).tolist():
        at = np.flatnonzero(n == k)
        own = np.array([pieces[i] for i in at.tolist()], dtype=float)
        out[at, :k] = own
        out[at, k:] = own[:, -1:]
    return out, n


def unpack(corners: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    return [c[:k] for c, k in zip(corners, n.tolist(), strict=True)]


def _areas(corners: np.ndarray) -> np.ndarray:
    """Areas of padded pieces; repeated corners add nothing."""
    if not len(corners):
        return np.zeros(0)
    d = corners - corners[:, :1]
    x, y = d[:, :, 0], d[:, :, 1]
    return (x[:, :-1] * y[:, 1:] - y[:, :-1] * x[:, 1:]).sum(axis=1) / 2


def _trim(corners: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Without corners that no piece has, padded by the last ones."""
    most = int(n.max(initial=3))
    corners = corners[:, :most]
    at = np.minimum(np.arange(most)[None, :], np.maximum(n, 1)[:, None] - 1)
    return np.take_along_axis(corners, at[:, :, None], axis=1)


def _clip_all(corners: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """The part of each convex piece on the left of its line a-b (inside), or on its right; no corners if there is none."""
    k, m = corners.shape[:2]
    d = (b[:, 0] - a[:, 0])[:, None] * (corners[:, :, 1] - a[:, 1:]) - (b[:, 1] - a[:, 1])[:, None] * (corners[:, :, 0] - a[:, :1])
    if not inside:
        d = -d
    place = np.arange(m)[None, :]
    real = place < n[:, None]
    nxt = np.where(place + 1 < n[:, None], place + 1, 0)
    e = np.take_along_axis(d, nxt, axis=1)
    to = np.take_along_axis(corners, nxt[:, :, None], axis=1)
    cut = real & (((d > 0) & (e < 0)) | ((d < 0) & (e > 0)))
    share = np.divide(d, d - e, out=np.zeros_like(d), where=cut)
    both = np.empty((k, m, 2, 2))
    both[:, :, 0], both[:, :, 1] = corners, corners + (to - corners) * share[:, :, None]
    kept = np.stack([real & (d >= 0), cut], axis=2).reshape(k, 2 * m)
    n = kept.sum(axis=1)
    out = np.zeros((k, int(n.max(initial=3)), 2))
    i, j = np.nonzero(kept)
    out[i, (np.cumsum(kept, axis=1) - 1)[i, j]] = both.reshape(k, 2 * m, 2)[i, j]
    n = np.where(n >= 3, n, 0)
    return _trim(out, n), n


def box_pairs(low: np.ndarray, high: np.ndarray, low2: np.ndarray, high2: np.ndarray, gap: float = 0.0, most: int = 4_000_000):
    """Numbers (i, j) of boxes of two sets that meet, by i, then j.

    Boxes have the level of their size; boxes of two levels meet in cells of the coarser one's width, where each covers
    four cells at most.
    """
    found = []
    if len(low) and len(low2):
        low, high = low - gap / 2, high + gap / 2
        low2, high2 = low2 - gap / 2, high2 + gap / 2
        size = [np.maximum((h - w).max(axis=1), 1e-9) for w, h in ((low, high), (low2, high2))]
        level = [np.ceil(np.log2(x)).astype(int) for x in size]
        for p in np.unique(level[0]).tolist():
            for q in np.unique(level[1]).tolist():
                width = 2.0 ** max(p, q)
                sets = []
                for w, h, lev, at in ((low, high, level[0], p), (low2, high2, level[1], q)):
                    own = np.flatnonzero(lev == at)
                    first, last = np.floor(w[own] / width).astype(np.int64), np.floor(h[own] / width).astype(np.int64)
                    cells = [(own, first[:, 0] + x, first[:, 1] + y, (first[:, 0] + x <= last[:, 0]) & (first[:, 1] + y <= last[:, 1])) for x in (0, 1, 2) for y in (0, 1, 2)]
                    sets.append([np.concatenate([c[k][c[3]] for c in cells]) for k in range(3)])
                (i, ix, iy), (j, jx, jy) = sets
                base = min(iy.min(), jy.min())
                tall = int(max(iy.max(), jy.max()) - base + 1)
                ki, kj = ix * tall + iy - base, jx * tall + jy - base
                order = np.argsort(kj, kind="stable")
                j, kj = j[order], kj[order]
                begin, end = np.searchsorted(kj, ki, "left"), np.searchsorted(kj, ki, "right")
                total = np.cumsum(end - begin)
                start = 0
                while start < len(i):
                    stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + most, "right")))
                    n = (end - begin)[start:stop]
                    own = np.repeat(i[start:stop], n)
                    other = j[np.repeat(begin[start:stop] - np.cumsum(n) + n, n) + np.arange(len(own))]
                    ok = ((low[own] <= high2[other]) & (high[own] >= low2[other])).all(axis=1)
                    found.append(np.unique(own[ok] * len(low2) + other[ok]))
                    start = stop
    code = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
    return np.divmod(code, max(len(low2), 1))


def connected(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least member of each of n members' connected component, given links."""
    label = np.arange(n)
    while len(i):
        low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
        open_ = low < high
        if not open_.any():
            break
        i, j = i[open_], j[open_]
        np.minimum.at(label, high[open_], low[open_])
        while True:
            nxt = label[label]
            if (nxt == label).all():
                break
            label = nxt
    return label


class Region:
    """Disjoint convex counter-clockwise pieces; closed under union, intersection and difference."""

    def __init__(self, pieces: list[np.ndarray] | None = None):
        some = [p for p in pieces or [] if len(p) >= 3]
        real = _areas(pack(some)[0]) > _EPS
        self.pieces = some if real.all() else [p for p, r in zip(some, real.tolist(), strict=True) if r]

    def __bool__(self) -> bool:
        return bool(self.pieces)

    def area(self) -> float:
        return float(_areas(pack(self.pieces)[0]).sum())

    def contains(self, points: np.ndarray) -> np.ndarray:
        """Whether points lie in the region, its border included."""
        pts = np.asarray(points, dtype=float).reshape(-1, 2)
        out = np.zeros(len(pts), dtype=bool)
        for at, _ in Pieces(self.pieces).holding(pts):
            out[at] = True
        return out

    def intersect(self, other: Region) -> Region:
        if not self or not other:
            return Region()
        (p, n), (q, m) = pack(self.pieces), pack(other.pieces)
        out = []
        i, j = box_pairs(p.min(axis=1), p.max(axis=1), q.min(axis=1), q.max(axis=1))
        for at in range(0, len(i), 200_000):
            k, own = j[at : at + 200_000], i[at : at + 200_000]
            part, size = p[own], n[own]
            for e in range(q.shape[1]):
                on = np.flatnonzero((e < m[k]) & (size >= 3))
                if len(on) < len(k):
                    k, part, size = k[size >= 3], part[size >= 3], size[size >= 3]
                    on = np.flatnonzero(e < m[k])
                cut, left = _clip_all(part[on], size[on], q[k[on], e], q[k[on], (e + 1) % m[k[on]]], True)
                part, size = _put(part, size, on, cut, left)
            real = (size >= 3) & (_areas(part) > _EPS)
            out += unpack(part[real], size[real])
        return Region(out)

    def overlaps(self, other: Region, least: float = 1e-12) -> bool:
        """Whether the common area is over ``least``; looks no further than it must."""
        for at in range(0, len(self.pieces), 2_000):
            part = Region(self.pieces[at : at + 2_000]).intersect(other).area()
            if part > least:
                return True
            least -= part
        return False

    def subtract(self, other: Region) -> Region:
        """Pieces are cut by the pieces that meet them one after another, all pieces at once."""
        if not self or not other:
            return Region(self.pieces)
        (p, n), (q, m) = pack(self.pieces), pack(other.pieces)
        qlow, qhigh = q.min(axis=1), q.max(axis=1)
        i, j = box_pairs(p.min(axis=1), p.max(axis=1), qlow, qhigh)
        first, last = np.searchsorted(i, np.arange(len(p)), "left"), np.searchsorted(i, np.arange(len(p)), "right")
        out = [self.pieces[k] for k in np.flatnonzero(first == last).tolist()]
        own = np.flatnonzero(first < last)
        part, size, at = p[own], n[own], first[own]
        while len(own):
            k = j[at]
            apart = (part.max(axis=1) < qlow[k]).any(axis=1) | (qhigh[k] < part.min(axis=1)).any(axis=1)
            sets = [(part[apart], size[apart], own[apart], at[apart])]
            rest, left, mine, to = part[~apart], size[~apart], own[~apart], at[~apart]
            for e in range(q.shape[1]):
                use = left >= 3
                rest, left, mine, to = rest[use], left[use], mine[use], to[use]
                on = np.flatnonzero(e < m[j[to]])
                if not len(on):
                    break
                a, b = q[j[to[on]], e], q[j[to[on]], (e + 1) % m[j[to[on]]]]
                cut, got = _clip_all(rest[on], left[on], a, b, False)
                real = (got >= 3) & (_areas(cut) > _EPS)
                sets.append((cut[real], got[real], mine[on][real], to[on][real]))
                cut, got = _clip_all(rest[on], left[on], a, b, True)
                rest, left = _put(rest, left, on, cut, got)
            wide = max(x[0].shape[1] for x in sets)
            part = np.concatenate([np.concatenate([x[0], np.repeat(x[0][:, -1:], wide - x[0].shape[1], axis=1)], axis=1) for x in sets])
            size, own, at = (np.concatenate([x[c] for x in sets]) for c in (1, 2, 3))
            at = at + 1
            done = at >= last[own]
            out += unpack(part[done], size[done])
            part, size, own, at = part[~done], size[~done], own[~done], at[~done]
            part = _trim(part, size)
        return Region(out)

    def union(self, other: Region) -> Region:
        if not self or not other or _apart(np.vstack(self.pieces), np.vstack(other.pieces)):
            return Region(self.pieces + other.pieces)
        return Region(self.pieces + other.subtract(self).pieces)

    def triangles(self) -> list[np.ndarray]:
        return [p if len(p) == 3 else np.array([p[0], p[i], p[i + 1]]) for p in self.pieces for i in range(1, len(p) - 1)]

    def without_slivers(self, width: float) -> Region:
        """Pieces that are nowhere wider than ``width`` are dropped: twice the area over the longest side."""
        corners, _ = pack(self.pieces)
        longest = np.sqrt(((corners - np.roll(corners, -1, axis=1)) ** 2).sum(axis=2)).max(axis=1, initial=_EPS)
        wide = 2 * _areas(corners) / longest >= width
        return Region([p for p, w in zip(self.pieces, wide.tolist(), strict=True) if w])

    def parts(self, gap: float = 1e-9) -> list[Region]:
        """Connected parts: pieces that share a stretch of border belong together."""
        if not self:
            return []
        corners, n = pack(self.pieces)
        low, high = corners.min(axis=1), corners.max(axis=1)
        i, j = box_pairs(low, high, low, high, gap)
        i, j = i[i < j], j[i < j]
        touch = np.concatenate([_touch(corners[i[k : k + 200_000]], corners[j[k : k + 200_000]], gap) for k in range(0, len(i), 200_000)] or [np.zeros(0, dtype=bool)])
        label = connected(len(n), i[touch], j[touch])
        groups: dict[int, list[np.ndarray]] = {}
        for p, g in zip(self.pieces, label.tolist(), strict=True):
            groups.setdefault(g, []).append(p)
        return [Region(g) for g in groups.values()]

    def to_lists(self) -> list[list[list[float]]]:
        return [p.tolist() for p in self.pieces]

    @staticmethod
    def from_lists(pieces) -> Region:
        return Region([np.array([[float(x), float(y)] for x, y in p]) for p in pieces or []])


class Pieces:
    """Convex pieces in a grid of cells, so that a point is tested against the pieces around it alone."""

    def __init__(self, pieces: list[np.ndarray]):
        self.most = max((len(p) for p in pieces), default=0)
        if not pieces:
            return
        self.corners, _ = pack(pieces)
        self.slack = np.maximum(1.0, np.abs(self.corners).max(axis=(1, 2)))
        low, high = (f(axis=1) + sign * 1e-7 * self.slack[:, None] for f, sign in ((self.corners.min, -1), (self.corners.max, 1)))
        self.low, self.side = low.min(axis=0), int(np.clip(np.sqrt(len(pieces)), 1, 512))
        self.step = np.maximum((high.max(axis=0) - self.low) / self.side, _EPS)
        first, last = self._cell(low), self._cell(high)
        wide, tall = (last - first + 1).T
        own = np.repeat(np.arange(len(pieces)), wide * tall)
        k = np.arange(len(own)) - np.repeat(np.cumsum(wide * tall) - wide * tall, wide * tall)
        cell = (first[own, 0] + k % wide[own]) * self.side + first[own, 1] + k // wide[own]
        order = np.argsort(cell, kind="stable")
        self.cell, self.own = cell[order], own[order]

    def _cell(self, pts: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((pts - self.low) / self.step), 0, self.side - 1).astype(np.int64)

    def holding(self, pts: np.ndarray, most: int = 1_000_000):
        """Pairs of a point's and a piece's number where the piece holds the point, border included, in slices."""
        if not self.most or not len(pts):
            return
        at = self._cell(pts)
        at = at[:, 0] * self.side + at[:, 1]
        first, last = np.searchsorted(self.cell, at, "left"), np.searchsorted(self.cell, at, "right")
        total = np.cumsum(last - first)
        begin = 0
        while begin < len(pts):
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + most, "right")))
            n = (last - first)[begin:end]
            i = np.repeat(np.arange(begin, end), n)
            j = self.own[np.repeat(first[begin:end] - np.cumsum(n) + n, n) + np.arange(len(i))]
            ok = np.ones(len(i), dtype=bool)
            for c in range(self.most):
                a, b = self.corners[j, c], self.corners[j, (c + 1) % self.most]
                ok &= (b[:, 0] - a[:, 0]) * (pts[i, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (pts[i, 0] - a[:, 0]) >= -1e-12 * self.slack[j] ** 2
            yield i[ok], j[ok]
            begin = end


def _put(part: np.ndarray, size: np.ndarray, on: np.ndarray, cut: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """part and size with the pieces ``on`` replaced."""
    if len(on) == len(part):
        return cut, left
    wide = max(part.shape[1], cut.shape[1])
    out = np.concatenate([part, np.repeat(part[:, -1:], wide - part.shape[1], axis=1)], axis=1)
    out[on] = np.concatenate([cut, np.repeat(cut[:, -1:], wide - cut.shape[1], axis=1)], axis=1)
    size = size.copy()
    size[on] = left
    return out, size


def _apart(p: np.ndarray, q: np.ndarray, gap: float = 0.0) -> bool:
    return bool((p.max(0) + gap < q.min(0)).any() or (q.max(0) + gap < p.min(0)).any())


def _touch(p: np.ndarray, q: np.ndarray, gap: float) -> np.ndarray:
    """Whether padded pieces p and q, pair by pair, share a stretch of border."""
    out = np.zeros(len(p), dtype=bool)
    for i in range(p.shape[1]):
        a = p[:, i]
        u = p[:, (i + 1) % p.shape[1]] - a
        length = np.linalg.norm(u, axis=1)
        real = length >= _EPS
        u = u / np.where(real, length, 1.0)[:, None]
        off = np.abs(u[:, None, 0] * (q[:, :, 1] - a[:, None, 1]) - u[:, None, 1] * (q[:, :, 0] - a[:, None, 0]))
        on = ((q - a[:, None]) * u[:, None]).sum(axis=2)
        for j in range(q.shape[1]):
            k = (j + 1) % q.shape[1]
            s, t = np.minimum(on[:, j], on[:, k]), np.maximum(on[:, j], on[:, k])
            out |= real & (np.maximum(off[:, j], off[:, k]) <= gap + 1e-9) & (np.minimum(t, length) - np.maximum(s, 0.0) > 1e-9)
    return out


def _turn(ax, ay, bx, by, cx, cy) -> float:
    """Positive where a, b, c turn left; exact in sign."""
    left, right = (bx - ax) * (cy - ay), (by - ay) * (cx - ax)
    d = left - right
    if abs(d) > 4e-16 * (abs(left) + abs(right)):
        return d
    ax, ay, bx, by, cx, cy = map(Fraction, (ax, ay, bx, by, cx, cy))
    d = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    return (d > 0) - (d < 0)


def _in_circle(ax, ay, bx, by, cx, cy, px, py) -> bool:
    """Whether p is inside the circle of the counter-clockwise triangle a, b, c; exact."""
    ux, uy, vx, vy, wx, wy = ax - px, ay - py, bx - px, by - py, cx - px, cy - py
    uu, vv, ww = ux * ux + uy * uy, vx * vx + vy * vy, wx * wx + wy * wy
    e, f, g, h, i, j = vx * wy, wx * vy, wx * uy, ux * wy, ux * vy, vx * uy
    d = uu * (e - f) + vv * (g - h) + ww * (i - j)
    if abs(d) > 2e-15 * (uu * (abs(e) + abs(f)) + vv * (abs(g) + abs(h)) + ww * (abs(i) + abs(j))):
        return d > 0
    ax, ay, bx, by, cx, cy, px, py = map(Fraction, (ax, ay, bx, by, cx, cy, px, py))
    ux, uy, vx, vy, wx, wy = ax - px, ay - py, bx - px, by - py, cx - px, cy - py
    uu, vv, ww = ux * ux + uy * uy, vx * vx + vy * vy, wx * wx + wy * wy
    return uu * (vx * wy - wx * vy) + vv * (wx * uy - ux * wy) + ww * (ux * vy - vx * uy) > 0


def delaunay(points: np.ndarray) -> np.ndarray:
    """Triangles (rows of three point numbers, counter-clockwise) by insertion along strips: a point is found by walking
    from the last one, and the triangles whose circle holds it are replaced. Signs are exact, so no point is misplaced."""
    pts = np.asarray(points, dtype=float)
    n = len(pts)
    if n < 3:
        return np.zeros((0, 3), dtype=int)
    low, span = pts.min(0), max(float(np.ptp(pts, axis=0).max()), _EPS)
    unit = (pts - low) / span
    xs, ys = [*unit[:, 0].tolist(), -50.0, 50.0, 0.0], [*unit[:, 1].tolist(), -50.0, -50.0, 80.0]
    # strips of as many points, up and down in turn
    strip = np.empty(n, dtype=int)
    strip[np.lexsort((unit[:, 1], unit[:, 0]))] = np.arange(n) // max(1, int(np.sqrt(3 * n)))
    order = np.lexsort((np.where(strip % 2, -unit[:, 1], unit[:, 1]), strip))
    # corners of triangle t, and the triangles across from them
    corner, across, dead = [(n, n + 1, n + 2)], [[-1, -1, -1]], [False]
    last, free = 0, []
    for p in order.tolist():
        px, py = xs[p], ys[p]
        t = last
        while True:
            a, b, c = corner[t]
            ax, ay, bx, by, cx, cy = xs[a], ys[a], xs[b], ys[b], xs[c], ys[c]
            if _turn(ax, ay, bx, by, px, py) < 0:
                t = across[t][2]
            elif _turn(bx, by, cx, cy, px, py) < 0:
                t = across[t][0]
            elif _turn(cx, cy, ax, ay, px, py) < 0:
                t = across[t][1]
            else:
                break
        if (px == ax and py == ay) or (px == bx and py == by) or (px == cx and py == cy):
            continue
        gone, todo, rim = [t], [t], []
        dead[t] = True
        while todo:
            t = todo.pop()
            own, beside = corner[t], across[t]
            for k in (0, 1, 2):
                o = beside[k]
                if o >= 0:
                    if dead[o]:
                        continue
                    a, b, c = corner[o]
                    if _in_circle(xs[a], ys[a], xs[b], ys[b], xs[c], ys[c], px, py):
                        dead[o] = True
                        gone.append(o)
                        todo.append(o)
                        continue
                rim.append((own[k - 2], own[k - 1], o))
        free += gone
        begins = {}
        for a, b, o in rim:
            if free:
                t = free.pop()
                dead[t] = False
                corner[t], across[t] = (a, b, p), [-1, -1, o]
            else:
                t = len(corner)
                corner.append((a, b, p))
                across.append([-1, -1, o])
                dead.append(False)
            if o >= 0:
                u = corner[o]
                across[o][0 if u[0] != a and u[0] != b else 1 if u[1] != a and u[1] != b else 2] = t
            begins[a] = t
        for t in begins.values():
            nxt = begins[corner[t][1]]
            across[t][0], across[nxt][1] = nxt, t
        last = t
    tri = np.array([c for c, d in zip(corner, dead, strict=True) if not d])
    tri = tri[(tri < n).all(axis=1)]
    if not len(tri):
        return tri
    a, b, c = pts[tri[:, 0]], pts[tri[:, 1]], pts[tri[:, 2]]
    turn = (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])
    return tri[np.abs(turn) > _EPS * span * span]


def _circles(pts: np.ndarray, tri: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and squared radii of circumcircles; flat triangles get infinite radii."""
    a, b, c = pts[tri[:, 0]], pts[tri[:, 1]], pts[tri[:, 2]]
    b, c = b - a, c - a
    d = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
    with np.errstate(divide="ignore", invalid="ignore"):
        bb, cc = (b**2).sum(1), (c**2).sum(1)
        u = np.column_stack([(c[:, 1] * bb - b[:, 1] * cc) / d, (b[:, 0] * cc - c[:, 0] * bb) / d])
        r2 = (u**2).sum(1)
    r2[np.abs(d) < 1e-300] = np.inf
    return u + a, r2


def tight_boundary(points: np.ndarray) -> Region:
    """The tightest single alpha shape that still holds every point in one connected region."""
    pts = np.unique(np.asarray(points, dtype=float).reshape(-1, 2), axis=0)
    tri = delaunay(pts)
    if not len(tri):
        return Region()
    _, r2 = _circles(pts, tri)
    order = np.argsort(r2, kind="stable")
    tri = tri[order]
    low, high = 0, len(tri) - 1
    while low < high:
        mid = (low + high) // 2
        if _one_region(tri[: mid + 1], len(pts)):
            high = mid
        else:
            low = mid + 1
    return Region([pts[t] for t in tri[: low + 1]])


def _one_region(tri: np.ndarray, n: int) -> bool:
    """Whether the triangles use all points and hang together by edges."""
    if len(np.unique(tri)) < n:
        return False
    edge = np.sort(np.vstack([tri[:, [0, 1]], tri[:, [1, 2]], tri[:, [2, 0]]]), axis=1)
    code = edge[:, 0] * n + edge[:, 1]
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    of = order % len(tri)
    return not connected(len(tri), of[:-1][same], of[1:][same]).any()
