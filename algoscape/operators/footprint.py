"""Footprints: the regions of the plane in which an algorithm does well, and how densely and purely."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Pieces, Region, box_pairs, connected, pack, tight_boundary, unpack
from ..functions.shipping import ship_package
from ..functions.tables import Tables
from ..sources.metadata import with_row_id

#: Pieces narrower than this (plane units) are dropped when a shape is drawn; a fifth of it at the end.
SLIVER = 5e-5

#: Rows (places and flags) that the driver counts itself; all rows count either way.
MEMORY_ROWS = 1_000_000

SCHEMA = "kind string, algo string, pieces array<array<array<double>>>, area double, elements long, good_elements long, density double, purity double"


def neighbour_radius(n: int, span: tuple[float, float], k: int) -> float:
    """Radius at which a circle holds about k of n points spread evenly over the box (plane case)."""
    return math.sqrt(span[0] * span[1] * k / (n * math.pi)) if n else 0.0


def least_neighbours(n: int) -> int:
    return max(min(math.ceil(n / 20), 50), 3)


def components(points: DataFrame, radius: float | Column, k: int | Column, row: str = "instances", apart: str | None = None) -> DataFrame:
    """row, class: connected components of points (row, z_1, z_2) within the radius that hold a core point, one with more than
    k points around it, itself included; numbered by first core row; -1 for points without a class.

    Neighbours meet in a grid of the radius' width; labels spread along neighbours and halve their paths. Points that
    differ in ``apart`` are never neighbours; radius and k may be columns that are alike where ``apart`` is.
    """
    tables = Tables(points.sparkSession, "components")
    cell = [F.floor(F.col(c) / F.lit(radius)).alias(f"c{i}") for i, c in enumerate(("z_1", "z_2"))]
    group = F.col(apart) if apart else F.lit(0)
    here = points.select(row, "z_1", "z_2", F.lit(radius).alias("radius"), F.lit(k).alias("k"), F.struct(group.alias("g"), *cell).alias("cell"))
    around = F.array(*(F.struct(F.col("cell.g").alias("g"), (F.col("cell.c0") + i).alias("c0"), (F.col("cell.c1") + j).alias("c1")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    there = here.withColumn("cell", F.explode(around))
    a, b = here.alias("a"), there.alias("b")
    d2 = F.pow(F.col("a.z_1") - F.col("b.z_1"), 2) + F.pow(F.col("a.z_2") - F.col("b.z_2"), 2)
    edges = tables.save(a.join(b, F.col("a.cell") == F.col("b.cell")).where(F.sqrt(d2) <= F.col("a.radius")).select(F.col(f"a.{row}").alias("u"), F.col(f"b.{row}").alias("v"), F.col("a.k").alias("k")), "edges")
    files = 1 + edges.count() // 500_000
    core = edges.groupBy("u").agg((F.count("*") >= F.first("k") + 1).alias("core"))
    labels = tables.save(edges.groupBy("u").agg(F.min("v").alias("label")), "labels-0", files)
    # labels only fall, so equal sums of hashes mean that none changed
    mark = F.sum(F.xxhash64("u", "label").cast("decimal(38,0)"))
    had, step = labels.agg(mark).first()[0], 0
    while True:
        step += 1
        spread = edges.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("label"))
        # a label's own label is as good and nearer to the root
        short = spread.join(labels.select(F.col("u").alias("label"), F.col("label").alias("next")), "label").select("u", F.least("label", "next").alias("label"))
        labels = tables.save(short, f"labels-{step}", files)
        tables.drop(f"labels-{step - 1}")
        has = labels.agg(mark).first()[0]
        if has == had:
            break
        had = has
    firsts = labels.join(core, "u").where("core").groupBy("label").agg(F.min("u").alias("first"))
    order = with_row_id(firsts, "first", "class").select("label", F.col("class").cast("int").alias("class"))
    return labels.join(order, "label", "left").select(F.col("u").alias(row), F.coalesce("class", F.lit(-1)).alias("class"))


def cluster(points: np.ndarray, radius: float, k: int) -> np.ndarray:
    """The same classes for points in memory. Points of one cell, its diagonal the radius, are neighbours; cells within
    reach are linked by their nearest points, and points of cells with more than k are core without being counted."""
    n = len(points)
    if not n:
        return np.full(0, -1)
    limit = radius * radius * (1 + 1e-12)
    side = radius / math.sqrt(2) * (1 - 1e-9) if radius > 0 else 1e-12
    at = np.floor((points - points.min(axis=0)) / side).astype(np.int64)
    tall = int(at[:, 1].max()) + 8
    code = (at[:, 0] + 2) * tall + at[:, 1] + 2
    order = np.argsort(code, kind="stable")
    cells, first, size = np.unique(code[order], return_index=True, return_counts=True)
    z = points[order]
    own = np.repeat(np.arange(len(cells)), size)
    low, high = np.minimum.reduceat(z, first), np.maximum.reduceat(z, first)
    near = size[own].copy()
    links: list[tuple[np.ndarray, np.ndarray]] = []
    label = np.arange(len(cells))
    for dx in range(-2, 3):
        for dy in range(-2, 3):
            if dx == 0 and dy == 0:
                continue
            there = np.minimum(np.searchsorted(cells, cells + dx * tall + dy), len(cells) - 1)
            i = np.flatnonzero(cells[there] == cells + dx * tall + dy)
            j = there[i]
            gap = np.maximum(np.maximum(low[i] - high[j], low[j] - high[i]), 0.0)
            i, j = i[(gap**2).sum(axis=1) <= limit], j[(gap**2).sum(axis=1) <= limit]
            # pairs are measured where counts are open, or a link is
            todo = (size[i] <= k) | ((i < j) & (label[i] != label[j]))
            i, j = i[todo], j[todo]
            joined = np.zeros(len(i), dtype=bool)
            of = np.repeat(np.arange(len(i)), size[i])
            a = np.repeat(first[i], size[i]) + np.arange(len(of)) - np.repeat(np.cumsum(size[i]) - size[i], size[i])
            total = np.cumsum(size[j][of])
            begin = 0
            while begin < len(of):
                end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + 4_000_000, "right")))
                m = size[j][of[begin:end]]
                x = np.repeat(np.arange(begin, end), m)
                y = np.repeat(first[j][of[begin:end]] - np.cumsum(m) + m, m) + np.arange(len(x))
                hit = ((z[a[x]] - z[y]) ** 2).sum(axis=1) <= limit
                near += np.bincount(a[x[hit]], minlength=n)
                joined[of[x[hit]]] = True
                begin = end
            links.append((i[joined], j[joined]))
            label = connected(len(cells), *(np.concatenate(x) for x in zip(*links, strict=True)))
    root = np.empty(n, dtype=np.int64)
    core = np.empty(n, dtype=bool)
    root[order], core[order] = label[own], near >= k + 1
    found, start = np.unique(root[core], return_index=True)
    number = np.full(len(cells), -1)
    number[found[np.argsort(start)]] = np.arange(1, len(found) + 1)
    return number[root]


class Scan:
    """All rows of a table, counted and gathered by scans, or on the driver while they are MEMORY_ROWS at most; goodness is
    named by its place in ``flags``."""

    def __init__(self, rows: DataFrame):
        self.rows, self.spark, self.held = rows, rows.sparkSession, None
        if rows.count() <= MEMORY_ROWS:
            got = rows.toArrow()
            z = np.column_stack([got[c].to_numpy() for c in ("z_1", "z_2")]).astype(float)
            flags = got["flags"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(bool)
            self.held = z, flags.reshape(len(z), -1)

    def counts(self, pieces: list[np.ndarray], group: np.ndarray, masks: list[int]) -> np.ndarray:
        """See _counts."""
        if self.held:
            z, flags = self.held
            return _tally(Pieces(pieces), group, int(group.max()) + 1, z, [flags[:, m] for m in masks])
        sent, size = self.spark.sparkContext.broadcast((*pack(pieces), group)), int(group.max()) + 1

        def one(batches):
            index, group = Pieces(unpack(*sent.value[:2])), sent.value[2]
            total = np.zeros((size, 1 + len(masks)), dtype=np.int64)
            for b in batches:
                flags = np.array(b["flags"].tolist(), dtype=bool).reshape(len(b), -1)
                total += _tally(index, group, size, b[["z_1", "z_2"]].to_numpy(float), [flags[:, m] for m in masks])
            at = np.flatnonzero(total[:, 0])
            if len(at):
                yield pd.DataFrame({"i": at, "n": total[at].tolist()})

        out = np.zeros((size, 1 + len(masks)), dtype=np.int64)
        parts = self.rows.mapInPandas(one, "i long, n array<long>")
        for r in parts.groupBy("i").agg(*(F.sum(F.col("n")[j]).alias(f"n{j}") for j in range(1 + len(masks)))).collect():
            out[r["i"]] = r[1:]
        sent.destroy()
        return out

    def inside(self, parts: list[Region], mask: int) -> list[np.ndarray]:
        """See _inside."""
        if self.held:
            return _inside(self.held[0], parts, self.held[1][:, mask])
        pieces, group = [x for p in parts for x in p.pieces], np.repeat(np.arange(len(parts)), [len(p.pieces) for p in parts])
        sent = self.spark.sparkContext.broadcast((*pack(pieces), group))

        def one(batches):
            index, group = Pieces(unpack(*sent.value[:2])), sent.value[2]
            for b in batches:
                z = b[["z_1", "z_2"]].to_numpy(float)
                for i, j in index.holding(z):
                    if len(i):
                        own = np.unique(np.column_stack([group[j], i]), axis=0)
                        yield pd.DataFrame({"i": own[:, 0], "z_1": z[own[:, 1], 0], "z_2": z[own[:, 1], 1]})

        got = self.rows.where(F.col("flags")[mask]).mapInPandas(one, "i long, z_1 double, z_2 double").distinct().toPandas()
        sent.destroy()
        by = dict(list(got.groupby("i")))
        return [by[i][["z_1", "z_2"]].to_numpy(float) if i in by else np.zeros((0, 2)) for i in range(len(parts))]


def _tally(index: Pieces, group: np.ndarray, size: int, z: np.ndarray, masks: list[np.ndarray]) -> np.ndarray:
    """Rows, and good rows by each mask, in the pieces of each group; a row counts once in a group."""
    total = np.zeros((size, 1 + len(masks)), dtype=np.int64)
    for at in range(0, len(z), 50_000):
        found = [i * size + group[j] for i, j in index.holding(z[at : at + 50_000])]
        if found:
            own, g = np.divmod(np.unique(np.concatenate(found)), size)
            total += np.column_stack([np.bincount(g, minlength=size), *(np.bincount(g[m[at + own]], minlength=size) for m in masks)])
    return total


def _counts(z: np.ndarray | Scan, pieces: list[np.ndarray], group: np.ndarray, masks: list) -> np.ndarray:
    """For each group of pieces the rows inside and those of each mask, as columns."""
    if not pieces:
        return np.zeros((0, 1 + len(masks)), dtype=np.int64)
    return z.counts(pieces, group, masks) if isinstance(z, Scan) else _tally(Pieces(pieces), group, int(group.max()) + 1, z, masks)


def _inside(z: np.ndarray | Scan, parts: list[Region], good) -> list[np.ndarray]:
    """Distinct good points inside each part."""
    if not parts:
        return []
    if isinstance(z, Scan):
        return z.inside(parts, good)
    own = z[good]
    index, group = Pieces([x for p in parts for x in p.pieces]), np.repeat(np.arange(len(parts)), [len(p.pieces) for p in parts])
    held = np.concatenate([np.zeros((0, 2), dtype=np.int64), *(np.column_stack([group[j], i]) for i, j in index.holding(own))])
    held = np.unique(held, axis=0)
    bounds = np.searchsorted(held[:, 0], np.arange(len(parts) + 1))
    return [np.unique(own[held[a:b, 1]], axis=0) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _common(z: np.ndarray | Scan, first: Region, second: Region, good_1, good_2) -> tuple[int, int, int]:
    """Rows that both regions hold, and those of each goodness."""
    if not isinstance(z, Scan):
        held = first.contains(z) & second.contains(z)
        return int(held.sum()), int((held & good_1).sum()), int((held & good_2).sum())
    if z.held:
        return _common(z.held[0], first, second, z.held[1][:, good_1], z.held[1][:, good_2])
    sent = z.spark.sparkContext.broadcast((_packed(first), _packed(second)))

    def one(batches):
        indexes = [Pieces(_unpacked(*p).pieces) for p in sent.value]
        total = np.zeros(3, dtype=np.int64)
        for b in batches:
            q = b[["z_1", "z_2"]].to_numpy(float)
            held = np.ones(len(q), dtype=bool)
            for index in indexes:
                own = np.zeros(len(q), dtype=bool)
                for i, _ in index.holding(q):
                    own[i] = True
                held &= own
            total += (held.sum(), (held & b["g1"].to_numpy(bool)).sum(), (held & b["g2"].to_numpy(bool)).sum())
        yield pd.DataFrame([total.tolist()], columns=["n", "g1", "g2"])

    rows = z.rows.select("z_1", "z_2", F.col("flags")[good_1].alias("g1"), F.col("flags")[good_2].alias("g2"))
    got = rows.mapInPandas(one, "n long, g1 long, g2 long").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "g1", "g2"))).first()
    sent.destroy()
    return tuple(got)


def prune(region: Region, z: np.ndarray | Scan, good, purity: float) -> Region:
    """Without triangles whose share of good rows is under ``purity``; a triangle without rows stays."""
    return _prune_all([region], z, [good], purity)[0]


def _prune_all(regions: list[Region], z: np.ndarray | Scan, good: list, purity: float) -> list[Region]:
    """Several regions, each with its goodness, pruned by one count."""
    return _pure(len(regions), *_shares(regions, z, good), purity)


def _shares(regions: list[Region], z: np.ndarray | Scan, good: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Triangles of several regions, each with its goodness: the region's place, the corners, and the rows and good rows
    inside, by one count."""
    name = [id(g) if isinstance(g, np.ndarray) else g for g in good]
    masks = list(dict(zip(name, good, strict=True)).values())
    kind = np.array([list(dict.fromkeys(name)).index(x) for x in name], dtype=np.int64)
    triangles = [(i, t) for i, r in enumerate(regions) for t in r.triangles()]
    own = np.array([i for i, _ in triangles], dtype=np.int64)
    counted = _counts(z, [t for _, t in triangles], np.arange(len(triangles)), masks)
    corners = np.array([t for _, t in triangles]).reshape(-1, 3, 2)
    return own, corners, np.column_stack([counted[:, 0], counted[np.arange(len(own)), 1 + kind[own]]])


def _pure(n: int, own: np.ndarray, corners: np.ndarray, counted: np.ndarray, purity: float) -> list[Region]:
    """The n regions of these triangles without those whose share of good rows is under ``purity``."""
    kept: list[list[np.ndarray]] = [[] for _ in range(n)]
    for i, t, (rows, good) in zip(own.tolist(), corners, counted.tolist(), strict=True):
        if rows == 0 or not purity > good / rows:
            kept[i].append(t)
    return [Region(k) for k in kept]


def outline(points: np.ndarray) -> Region:
    """Region of one cluster of points."""
    if len(np.unique(points, axis=0)) < 3:
        return Region()
    return tight_boundary(points).without_slivers(SLIVER)


def _union(regions: list[Region]) -> Region:
    """Each region gives up what those before it hold; regions whose boxes are apart are not compared."""
    some = [r for r in regions if r]
    corners = [np.concatenate(r.pieces) for r in some]
    low, high = np.array([c.min(axis=0) for c in corners]).reshape(-1, 2), np.array([c.max(axis=0) for c in corners]).reshape(-1, 2)
    before: dict[int, list[int]] = {}
    for i, j in zip(*(x.tolist() for x in box_pairs(low, high, low, high)), strict=True):
        if j < i:
            before.setdefault(i, []).append(j)
    out: list[Region] = []
    for i, r in enumerate(some):
        meet = [p for j in before.get(i, []) for p in out[j].pieces]
        out.append(r.subtract(Region(meet)) if meet else r)
    return Region([p for o in out for p in o.pieces])


def tighten(region: Region, z: np.ndarray | Scan, good, purity: float) -> Region:
    """Each part drawn again around the good rows inside it; parts with fewer than three go."""
    drawn = [outline(p) for p in _inside(z, region.parts(), good)]
    return _union(_prune_all(drawn, z, [good] * len(drawn), purity)) if drawn else Region()


def contradict(first: Region, second: Region, z: np.ndarray | Scan, good_1, good_2, purity: float, tries: int = 3) -> tuple[Region, Region]:
    """Two best footprints that overlap: the less pure one gives the overlap up and is drawn again, until they no longer
    overlap, are equally pure there, or the tries are used up."""
    for attempt in range(1, tries + 1):
        if not first.overlaps(second):
            break
        n, g1, g2 = _common(z, first, second, good_1, good_2)
        p1, p2 = (g1 / n, g2 / n) if n else (math.nan, math.nan)
        if p1 > p2:
            second = second.subtract(first)
            second = tighten(second, z, good_2, purity) if attempt < tries else second
        elif p2 > p1:
            first = first.subtract(second)
            first = tighten(first, z, good_1, purity) if attempt < tries else first
        else:
            break
    return first, second


def _packed(region: Region) -> tuple[bytes, bytes]:
    """Corners of all pieces in turn, and their numbers, as bytes."""
    xy = np.concatenate(region.pieces) if region else np.zeros((0, 2))
    return xy.tobytes(), np.array([len(p) for p in region.pieces], dtype=np.int64).tobytes()


def _unpacked(xy: bytes, n: bytes) -> Region:
    return Region(np.split(np.frombuffer(xy).reshape(-1, 2), np.cumsum(np.frombuffer(n, dtype=np.int64))[:-1]) if n else [])


def _nested(regions: list[Region]) -> pa.Array:
    """Pieces of regions as lists of corners."""
    pieces = [p for r in regions for p in r.pieces]
    xy = np.concatenate(pieces) if pieces else np.zeros((0, 2))
    at = lambda n: pa.array(np.cumsum([0, *n]), pa.int32())
    corners = pa.ListArray.from_arrays(pa.array(np.arange(len(xy) + 1) * 2, pa.int32()), pa.array(xy.ravel()))
    return pa.ListArray.from_arrays(at(len(r.pieces) for r in regions), pa.ListArray.from_arrays(at(len(p) for p in pieces), corners))


def _regions(column: pa.Array) -> list[Region]:
    """Regions from lists of corners."""
    out = []
    for own in (column.slice(i, 1) for i in range(len(column))):
        pieces = own.flatten()
        n = pieces.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        xy = pieces.flatten().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 2)
        out.append(Region(np.split(xy, np.cumsum(n)[:-1]) if len(n) else []))
    return out


@dataclass
class Outlines:
    """All rows, the goodness of each footprint by its key, and the outlines of its clusters before any pruning."""

    scan: Scan
    flags: dict[tuple[str, str], Column]
    clusters: dict[tuple[str, str], list[Region]]

    @cached_property
    def shares(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The footprint's place of every cluster, and the triangles of all clusters (see _shares), counted once."""
        whole = [(i, r) for i, own in enumerate(self.clusters.values()) for r in own]
        of = [i for i, _ in whole]
        return np.array(of, dtype=np.int64), *_shares([r for _, r in whole], self.scan, of)

    def pruned(self, purity: float) -> list[list[Region]]:
        """The pruned clusters of each footprint."""
        return _by_footprint(len(self.clusters), *self.shares, purity)


def _by_footprint(n: int, of: np.ndarray, own: np.ndarray, corners: np.ndarray, counted: np.ndarray, purity: float) -> list[list[Region]]:
    out: list[list[Region]] = [[] for _ in range(n)]
    for i, r in zip(of.tolist(), _pure(len(of), own, corners, counted, purity), strict=True):
        out[i].append(r)
    return out


def outlines(df: DataFrame, algos: list[str], good: list[str], best: str, beta: str) -> Outlines:
    """Clusters of the distinct good points of every footprint, all of them, found and outlined by a task a footprint."""
    spark = df.sparkSession
    ship_package(spark)
    tables = Tables(spark, "footprints")
    flags = {("space", ""): F.lit(True), ("hard", ""): ~F.col(beta)}
    for i, (a, g) in enumerate(zip(algos, good, strict=True)):
        flags["good", a], flags["best", a] = F.col(g), F.col(best) == i + 1
    every = F.array(*(F.coalesce(f.cast("boolean"), F.lit(False)) for f in flags.values()))
    rows = tables.save(df.dropna(subset=["z_1", "z_2"]).select("z_1", "z_2", every.alias("flags")), "rows")
    own = rows.select("z_1", "z_2", F.posexplode("flags").alias("id", "own")).where("own").select("id", "z_1", "z_2").distinct()

    def draw(batch: pd.DataFrame) -> pd.DataFrame:
        z = np.unique(batch[["z_1", "z_2"]].to_numpy(float), axis=0)
        k = least_neighbours(len(z))
        radius = neighbour_radius(len(z), tuple(np.ptp(z, axis=0)), k)
        # points on a line have no neighbours
        classes = cluster(z, radius, k) if radius > 0 else np.full(len(z), -1)
        order = np.argsort(classes, kind="stable")
        bounds = np.searchsorted(classes[order], np.arange(1, classes.max() + 2))
        drawn = [_packed(outline(z[order[a:b]])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return pd.DataFrame([(batch["id"].iloc[0], i, *d) for i, d in enumerate(drawn, 1)], columns=["id", "class", "xy", "n"])

    drawn = own.repartition(16 * len(flags), "id").groupBy("id").applyInPandas(draw, "id int, class int, xy binary, n binary")
    keys = list(flags)
    clusters: dict[tuple[str, str], list[Region]] = {k: [] for k in keys}
    for r in sorted(drawn.collect(), key=lambda r: (r["id"], r["class"])):
        clusters[keys[r["id"]]].append(_unpacked(r["xy"], r["n"]))
    return Outlines(Scan(rows), flags, clusters)


def footprints(df: DataFrame, algos: list[str], good: list[str], best: str, beta: str, purity: float = 0.55, drawn: Outlines | None = None) -> DataFrame:
    """One row (see SCHEMA) for the space, each algorithm's good and best footprint, and the hard region.

    The outlines of clusters (given, or drawn here) lose their impure triangles by a count of all rows and are joined, a
    footprint a task. Contradictions between best footprints are settled pair by pair, by counts of all rows. The rows
    inside each region are then counted by one scan of the table.
    """
    spark = df.sparkSession
    o = drawn or outlines(df, algos, good, best, beta)
    keys = list(o.flags)
    sent = spark.sparkContext.broadcast([[_packed(p) for p in own] for own in o.pruned(purity)])

    def one(batches):
        for b in batches:
            yield pd.DataFrame([(int(i), *_packed(_union([_unpacked(*p) for p in sent.value[i]]))) for i in b["id"]], columns=["id", "xy", "n"])

    todo = spark.range(len(keys)).repartition(max(1, min(len(keys), spark.sparkContext.defaultParallelism)))
    regions = {keys[r["id"]]: _unpacked(r["xy"], r["n"]) for r in todo.mapInPandas(one, "id long, xy binary, n binary").collect()}
    regions = {k: regions[k] for k in keys}
    settled = _settle(regions, algos, o.scan, {k: i for i, k in enumerate(keys)}, purity)
    return count_inside(df, settled, o.flags)


def _settle(regions: dict[tuple[str, str], Region], algos: list[str], z: np.ndarray | Scan, good: dict, purity: float) -> dict[tuple[str, str], Region]:
    """Contradictions between best footprints settled pair by pair, then slivers dropped."""
    regions = dict(regions)
    for i, a in enumerate(algos):
        for b in algos[i + 1 :]:
            first, second = ("best", a), ("best", b)
            regions[first], regions[second] = contradict(regions[first], regions[second], z, good[first], good[second], purity)
    return {k: r.without_slivers(SLIVER / 5) for k, r in regions.items()}


def _measures(region: Region, n: int, g: int) -> tuple[float, int, int, float, float]:
    """area, elements, good_elements, density and purity of a region with n rows, g of them good."""
    a = region.area()
    return float(a), n, g, n / a if a > 0 else 0.0, g / n if n else 0.0


def count_inside(df: DataFrame, regions: dict[tuple[str, str], Region], flags: dict) -> DataFrame:
    """Rows and good rows inside each region, by one scan: a partial count per task, summed by region."""
    spark = df.sparkSession
    ship_package(spark)
    keys = list(regions)
    sent = spark.sparkContext.broadcast([_packed(regions[k]) for k in keys])
    points = df.select("z_1", "z_2", F.array(*(F.coalesce(flags[k].cast("boolean"), F.lit(False)) for k in keys)).alias("flags")).where("z_1 is not null and z_2 is not null")

    def one(batches):
        total = np.zeros((len(sent.value), 2), dtype=np.int64)
        parts = [_unpacked(*p).pieces for p in sent.value]
        indexes = [Pieces(p) for p in parts]
        for b in batches:
            z = b[["z_1", "z_2"]].to_numpy(float)
            good = np.array(b["flags"].tolist(), dtype=bool).reshape(len(b), -1)
            for i, x in enumerate(indexes):
                total[i] += _tally(x, np.zeros(len(parts[i]), dtype=int), 1, z, [good[:, i]])[0]
        yield pd.DataFrame({"i": np.arange(len(total)), "n": total[:, 0], "g": total[:, 1]})

    got = {r["i"]: (r["n"], r["g"]) for r in points.mapInPandas(one, "i long, n long, g long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("g").alias("g")).collect()}
    out = []
    for i, k in enumerate(keys):
        out.append((*k, *_measures(regions[k], *got.get(i, (0, 0)))))
    kind, algo, *numbers = (list(c) for c in zip(*out, strict=True)) if out else [[] for _ in range(7)]
    types = [pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    columns = [pa.array(kind, pa.string()), pa.array(algo, pa.string()), _nested([regions[k] for k in keys]), *map(pa.array, numbers, types)]
    return spark.createDataFrame(pa.table(columns, names=[c.split()[0] for c in SCHEMA.split(", ")]), SCHEMA)


def assess(df: DataFrame, stored: DataFrame, algos: list[str], good: list[str], best: str, beta: str) -> DataFrame:
    """Stored footprints measured on new rows; empty ones, and those without positive rows, give zeros."""
    regions, flags = {}, {}
    had = stored.select("kind", "algo", "pieces").toArrow()
    for kind, algo, region in zip(had["kind"].to_pylist(), had["algo"].to_pylist(), _regions(had["pieces"].combine_chunks()), strict=True):
        k = (kind, algo)
        regions[k] = region
        if k[0] in ("space", "hard"):
            flags[k] = F.lit(True) if k[0] == "space" else ~F.col(beta)
        elif k[1] in algos:
            i = algos.index(k[1])
            flags[k] = F.col(good[i]) if k[0] == "good" else F.col(best) == i + 1
        else:
            flags[k] = F.lit(False)
    out = count_inside(df, regions, flags)
    none = F.col("good_elements") == 0
    return out.withColumns({c: F.when(none, F.lit(0).cast(t)).otherwise(F.col(c)) for c, t in (("elements", "long"), ("density", "double"), ("purity", "double"))})


def summary(table: DataFrame) -> DataFrame:
    """algo with area, density (both also as shares of the space's) and purity of its good and best footprints, three
    places."""
    space = table.where("kind = 'space'").select("area", "density").first()
    share = lambda c, of: F.lit(0.0) if not of else F.col(c) / F.lit(float(of))
    metrics = {"area": F.col("area"), "area_normalized": share("area", space["area"]), "density": F.col("density"), "density_normalized": share("density", space["density"]), "purity": F.col("purity")}
    each = table.where("kind in ('good', 'best')").select("kind", "algo", *(m.alias(n) for n, m in metrics.items()))
    return each.groupBy("algo").agg(*(F.round(F.coalesce(F.max(F.when(F.col("kind") == k, F.col(n))), F.lit(0.0)), 3).alias(f"{n}_{k}") for k in ("good", "best") for n in metrics))


def purity_sweep(df: DataFrame, algos: list[str], good: list[str], best: str, beta: str, levels: list[float] | None = None) -> DataFrame:
    """purity_level with the mean summary metrics over algorithms. Outlines are drawn and their triangles counted once; each
    level then settles its own footprints, by a task a level while the driver holds the rows (see Scan)."""
    out, drawn = None, outlines(df, algos, good, best, beta)
    levels = levels or [round(0.05 * i, 2) for i in range(20)]
    tables = _level_tables(drawn, algos, levels) if drawn.scan.held else (footprints(df, algos, good, best, beta, x, drawn) for x in levels)
    for level, table in zip(levels, tables, strict=True):
        s = summary(table)
        one = s.agg(*(F.avg(c).alias(c) for c in s.columns if c != "algo")).withColumn("purity_level", F.lit(float(level)))
        out = one if out is None else out.unionByName(one)
    return out


def _level_tables(o: Outlines, algos: list[str], levels: list[float]) -> list[DataFrame]:
    """The footprints of several levels, without their pieces, from rows in memory."""
    spark = o.scan.spark
    ship_package(spark)
    keys = list(o.flags)
    sent = spark.sparkContext.broadcast((*o.scan.held, o.shares))

    def one(batches):
        z, flags, shares = sent.value
        for b in batches:
            for at in b["id"]:
                regions = {k: _union(r) for k, r in zip(keys, _by_footprint(len(keys), *shares, levels[at]), strict=True)}
                regions = _settle(regions, algos, z, {k: flags[:, i] for i, k in enumerate(keys)}, levels[at])
                got = []
                for i, k in enumerate(keys):
                    own = regions[k].pieces
                    n, g = _tally(Pieces(own), np.zeros(len(own), dtype=int), 1, z, [flags[:, i]])[0].tolist()
                    got.append((at, *k, *_measures(regions[k], n, g)))
                yield pd.DataFrame(got, columns=["level", *names])

    names, _, types = zip(*(c.partition(" ") for c in SCHEMA.split(", ") if not c.startswith("pieces")), strict=True)
    schema = ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True))
    rows = spark.range(0, len(levels), 1, len(levels)).mapInPandas(one, f"level long, {schema}").collect()
    sent.destroy()
    return [spark.createDataFrame([tuple(r)[1:] for r in rows if r["level"] == i], schema) for i in range(len(levels))]


# ---- relational forms, for polygons given as tables
def polygon_areas(corners: DataFrame) -> DataFrame:
    """polygon, area from rows (polygon, seq, x, y) by the shoelace rule."""
    from pyspark.sql import Window

    w = Window.partitionBy("polygon").orderBy("seq")
    first = [F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for c in ("x", "y")]
    nxt = corners.withColumns({"nx": F.coalesce(F.lead("x").over(w), first[0]), "ny": F.coalesce(F.lead("y").over(w), first[1])})
    return nxt.groupBy("polygon").agg((F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y")) / 2).alias("area"))


def points_in_polygons(points: DataFrame, polygons: dict[str, list[tuple[float, float]]], row: str = "instances") -> DataFrame:
    """row, polygon of each point (z_1, z_2) inside a convex counter-clockwise polygon, its border included; half-plane
    tests as expressions, behind a box test."""
    hits = []
    for name, corners in polygons.items():
        xs, ys = [c[0] for c in corners], [c[1] for c in corners]
        inside = F.col("z_1").between(min(xs), max(xs)) & F.col("z_2").between(min(ys), max(ys))
        for (ax, ay), (bx, by) in zip(corners, [*corners[1:], corners[0]], strict=True):
            inside &= (bx - ax) * (F.col("z_2") - ay) - (by - ay) * (F.col("z_1") - ax) >= 0
        hits.append(F.when(inside, F.lit(name)))
    return points.select(row, F.explode(F.array_compact(F.array(*hits))).alias("polygon"))
