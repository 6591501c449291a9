"""Linear projection of instances to two dimensions, fitted on second moments alone."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship_package
from ..functions.tables import Tables

#: Rows of a block; all pairs of two blocks are in memory at a time.
BLOCK = 1_000
_NO_PAIRS = (0, 0.0, 0.0, 0.0, 0.0, 0.0)
#: Places of a block of plane_correlations, rows and columns of its pairs measured at a time, and doubles of blocks broadcast at a time.
PLACES = 8_000
TILE = (128, 256)
SHARD = 8_000_000


@dataclass
class Gramian:
    """Second moments of features X and targets (features, then performances), over rows without missing features.

    For each target: n, sum of squares, cross sums with X, and the features' own second moments over the target's rows.
    """

    features: list[str]
    targets: list[str]
    xx: np.ndarray
    xt: np.ndarray
    tt: np.ndarray
    n: np.ndarray
    per_target: dict[str, np.ndarray]

    @staticmethod
    def of(df: DataFrame, features: list[str], algos: list[str]) -> Gramian:
        """One aggregate; its size depends on the number of columns alone."""
        rows = df.where(" and ".join(f"`{c}` is not null" for c in features))
        p = len(features)
        sums = [F.sum(F.col(a) * F.col(b)).alias(f"x_{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features) if i <= j]
        some = rows.agg(F.lit(0).alias("__none"), *(F.bool_or(F.col(a).isNull()).alias(a) for a in algos)).first()
        missing = {a for a in algos if some[a]}
        for k, y in enumerate(algos):
            sums += [F.count(y).alias(f"n_{k}"), F.sum(F.col(y) * F.col(y)).alias(f"q_{k}")]
            sums += [F.sum(F.col(y) * F.col(a)).alias(f"c_{i}_{k}") for i, a in enumerate(features)]
            if y in missing:
                has = F.col(y).isNotNull()
                sums += [F.sum(F.when(has, F.col(a) * F.col(b))).alias(f"m{k}_{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features) if i <= j]
        got = rows.agg(F.count("*").alias("n"), *sums).first()

        def square(prefix: str) -> np.ndarray:
            m = np.zeros((p, p))
            for i in range(p):
                for j in range(i, p):
                    m[i, j] = m[j, i] = got[f"{prefix}_{i}_{j}"] or 0.0
            return m

        xx = square("x")
        cross = np.array([[got[f"c_{i}_{k}"] or 0.0 for k in range(len(algos))] for i in range(p)]).reshape(p, len(algos))
        return Gramian(
            list(features),
            [*features, *algos],
            xx,
            np.hstack([xx, cross]),
            np.concatenate([np.diag(xx), [got[f"q_{k}"] or 0.0 for k in range(len(algos))]]),
            np.concatenate([np.full(p, float(got["n"])), [float(got[f"n_{k}"]) for k in range(len(algos))]]),
            {y: square(f"m{k}") for k, y in enumerate(algos) if y in missing},
        )

    def pick(self, names: list[str]) -> Gramian:
        """The Gramian with fewer features; targets keep their performances."""
        at = [self.features.index(c) for c in names]
        rest = list(range(len(self.features), len(self.targets)))
        cols = at + rest
        return Gramian(names, [self.targets[i] for i in cols], self.xx[np.ix_(at, at)], self.xt[np.ix_(at, cols)], self.tt[cols], self.n[cols], {y: m[np.ix_(at, at)] for y, m in self.per_target.items()})

    def loss(self, a: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean over targets of the mean squared error of B A x, and its gradients by A (2 x p) and B (m x 2)."""
        m, k = b.shape[0], np.maximum(self.n, 1)
        w = b @ a
        total, dw = 0.0, np.zeros_like(w)
        whole = w @ self.xx
        for j, y in enumerate(self.targets):
            s = w[j] @ self.per_target[y] if y in self.per_target else whole[j]
            total += (self.tt[j] - 2 * w[j] @ self.xt[:, j] + s @ w[j]) / k[j]
            dw[j] = 2 * (s - self.xt[:, j]) / k[j]
        return total / m, b.T @ dw / m, dw @ a.T / m


@dataclass
class Solution:
    a: np.ndarray
    b: np.ndarray
    loss: float


def analytic(g: Gramian) -> Solution:
    """Least squares of rank two: the best two directions of what X predicts of the targets."""
    inverse = np.linalg.pinv(g.xx)
    explained = g.xt.T @ inverse @ g.xt
    values, vectors = np.linalg.eigh((explained + explained.T) / 2)
    v = vectors[:, np.argsort(-np.abs(values))[:2]]
    if v.shape[1] < 2:
        v = np.hstack([v, np.zeros((len(v), 2 - v.shape[1]))])
    a = v.T @ g.xt.T @ inverse
    return Solution(a, v, g.loss(a, v)[0])


def bfgs(f, x: np.ndarray, iterations: int = 300, tolerance: float = 1e-8) -> np.ndarray:
    """Quasi-Newton descent with backtracking."""
    h = np.eye(len(x))
    fx, g = f(x)
    for _ in range(iterations):
        d = -h @ g
        if d @ g >= 0:
            h, d = np.eye(len(x)), -g
        step = 1.0
        while True:
            new = x + step * d
            fn, gn = f(new)
            if fn <= fx + 1e-4 * step * (g @ d) or step < 1e-12:
                break
            step /= 2
        s, y = new - x, gn - g
        if fx - fn < tolerance * max(1.0, abs(fx)) and np.linalg.norm(gn) < 1e-5 or step < 1e-12:
            x, fx = (new, fn) if fn < fx else (x, fx)
            break
        sy = s @ y
        if sy > 1e-12:
            hy = h @ y
            h += (1 + y @ hy / sy) * np.outer(s, s) / sy - (np.outer(s, hy) + np.outer(hy, s)) / sy
        x, fx, g = new, fn, gn
    return x


def solve(g: Gramian, tries: int = 5, seed: int = 1, starts: list[np.ndarray] | None = None) -> Solution:
    """The best of several descents from random starts in [-1, 1], by loss; all on the Gramian."""
    return min(trials(g, tries, seed, starts), key=lambda s: s.loss)


def trials(g: Gramian, tries: int = 5, seed: int = 1, starts: list[np.ndarray] | None = None) -> list[Solution]:
    p, m = len(g.features), len(g.targets)
    rng = np.random.default_rng(seed)
    starts = [rng.uniform(-1, 1, 2 * (p + m)) for _ in range(tries)] if starts is None else [np.asarray(s, dtype=float) for s in starts]
    if any(len(s) != 2 * (p + m) for s in starts):
        raise ValueError(f"a start needs {2 * (p + m)} numbers")

    def f(x: np.ndarray):
        loss, da, db = g.loss(x[: 2 * p].reshape(2, p), x[2 * p :].reshape(m, 2))
        return loss, np.concatenate([da.ravel(), db.ravel()])

    out = []
    for s in starts:
        x = bfgs(f, s)
        out.append(Solution(x[: 2 * p].reshape(2, p), x[2 * p :].reshape(m, 2), f(x)[0]))
    return out


def coordinate(features: list[str], weights: list[float]) -> Column:
    """Weighted sum of columns."""
    total = F.lit(0.0)
    for c, w in zip(features, weights, strict=True):
        total = total + F.col(c) * F.lit(float(w))
    return total


def project(df: DataFrame, features: list[str], a) -> DataFrame:
    """df with z_1 and z_2."""
    return df.withColumns({f"z_{i + 1}": coordinate(features, list(a[i])) for i in range(2)})


def _merged(a: tuple, b: tuple) -> tuple:
    """Count, means, squares and cross product about the means of two sets of pairs together."""
    if not a[0] or not b[0]:
        return a if a[0] else b
    n, dx, dz, w = a[0] + b[0], b[1] - a[1], b[2] - a[2], a[0] * b[0] / (a[0] + b[0])
    return (n, a[1] + dx * b[0] / n, a[2] + dz * b[0] / n, a[3] + b[3] + w * dx * dx, a[4] + b[4] + w * dz * dz, a[5] + b[5] + w * dx * dz)


def _block_moments(x: np.ndarray, y: np.ndarray, label: np.ndarray | None) -> tuple:
    """_merged's parts over all pairs of a row of x and a row of y; the last two columns are the plane. With labels
    (of x, which is y) over the pairs of two labels, each once."""
    d2 = [sum((x[:, i, None] - y[None, :, i]) ** 2 for i in at) for at in (range(x.shape[1] - 2), range(x.shape[1] - 2, x.shape[1]))]
    once = slice(None) if label is None else label[:, None] < label[None, :]
    dx, dz = (np.sqrt(d[once]).ravel() for d in d2)
    if not len(dx):
        return _NO_PAIRS
    # taken from the first value, so that equal distances have no spread at all
    u, v = dx - dx[0], dz - dz[0]
    mu, mv = u.mean(), v.mean()
    u, v = u - mu, v - mv
    return (len(u), float(dx[0] + mu), float(dz[0] + mv), float(u @ u), float(v @ v), float(u @ v))


def distance_correlation(df: DataFrame, features: list[str], row: str = "instances") -> DataFrame:
    """n_pairs and corr: correlation of all pairwise distances in feature space and in the plane.

    Rows are packed into blocks by a hash of their label, and every two blocks meet once; a task hands on the moments
    of its distances alone. Rows of one label, which share a block, make no pair.
    """
    spark = df.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    tables = Tables(spark, "pairs")
    cols = [*features, "z_1", "z_2"]
    some = tables.save(df.select(row, *(F.col(c).cast("double").alias(c) for c in cols)).dropna(), "rows")
    n = max(1, math.ceil(some.count() / BLOCK))
    width = len(cols)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [rows["k"].iloc[0]], "x": [rows[cols].to_numpy(float).tobytes()], "label": [pd.factorize(rows[row])[0].astype(np.int64).tobytes()]})

    def moments(batches):
        total = _NO_PAIRS
        for b in batches:
            for i, j, x, y, label in zip(b["i"], b["j"], b["x"], b["y"], b["label"], strict=True):
                p, q = (np.frombuffer(v, dtype=float).reshape(-1, width) for v in (x, y))
                total = _merged(total, _block_moments(p, q, np.frombuffer(label, dtype=np.int64) if i == j else None))
        yield pd.DataFrame([total], columns=["n", "x", "z", "xx", "zz", "xz"])

    blocks = tables.save(some.withColumn("k", F.pmod(F.xxhash64(row), F.lit(n))).groupBy("k").applyInPandas(pack, "k long, x binary, label binary"), "blocks")
    # each block meets itself and the half of the circle after it, so that all have equal work
    meet = spark.range(n * (n // 2 + 1)).select((F.col("id") % n).alias("i"), F.floor(F.col("id") / n).alias("t"))
    meet = meet.where((F.col("t") * 2 < n) | (F.col("i") * 2 < n)).select("i", ((F.col("i") + F.col("t")) % n).alias("j"))
    pairs = meet.join(blocks.select(F.col("k").alias("i"), "x", "label"), "i").join(blocks.select(F.col("k").alias("j"), F.col("x").alias("y")), "j")
    parts = pairs.select("i", "j", "x", "y", "label").mapInPandas(moments, "n long, x double, z double, xx double, zz double, xz double").collect()
    count, _, _, xx, zz, xz = reduce(_merged, (tuple(r) for r in parts), _NO_PAIRS)
    return spark.createDataFrame([(count, xz / math.sqrt(xx * zz) if xx * zz > 0 else None)], "n_pairs long, corr double")


def _squares(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Factors whose product holds the squared distances of all rows."""
    n, one = (x**2).sum(axis=1)[:, None], np.ones((len(x), 1))
    return np.hstack([-2 * x, n, one]), np.ascontiguousarray(np.hstack([x, one, n]).T)


def _plane_sums(x: np.ndarray, y: np.ndarray, wx: np.ndarray, wy: np.ndarray, planes: list[np.ndarray], label: np.ndarray | None) -> np.ndarray:
    """A row for the features and each plane: sums over all pairs of a row of x and a row of y, weighted by wx and wy, of
    1, of the distance, its square, and its product with the distance of the features. With labels x is y, and a pair
    of two labels counts once."""
    spaces = [(x, y), *((x @ a.T, y @ a.T) for a in planes)]
    factors = [(_squares(p)[0], _squares(q)[1]) for p, q in spaces]
    out = np.zeros((len(spaces), 4))
    if label is None:
        out[:, 0] = wx.sum() * wy.sum()
        # squares need no pairs
        out[:, 2] = [wy.sum() * (wx @ (p**2).sum(axis=1)) + wx.sum() * (wy @ (q**2).sum(axis=1)) - 2 * (wx @ p) @ (wy @ q) for p, q in spaces]
    plain = bool((wx == 1).all() and (wy == 1).all())
    for a in range(0, len(x), TILE[0]):
        for b in range(0, len(y), TILE[1]):
            u, v = wx[a : a + TILE[0]], wy[b : b + TILE[1]]
            dx = both = None
            if label is not None:
                both = np.where(label[a : a + TILE[0], None] != label[None, b : b + TILE[1]], np.outer(u, v) / 2, 0.0)
                out[:, 0] += both.sum()
            for k, (p, q) in enumerate(factors):
                d = p[a : a + TILE[0]] @ q[:, b : b + TILE[1]]
                np.abs(d, out=d)  # rounding can pass below zero
                if both is not None:
                    out[k, 2] += d.ravel() @ both.ravel()
                np.sqrt(d, out=d)
                out[k, 1] += u @ (d @ v) if both is None else d.ravel() @ both.ravel()
                if k == 0:
                    dx = d
                    if both is not None:
                        dx *= both
                    elif not plain:
                        dx *= u[:, None]
                        dx *= v
                else:
                    out[k, 3] += dx.ravel() @ d.ravel()
    return out


def plane_correlations(df: DataFrame, features: list[str], planes: list[np.ndarray], row: str = "instances") -> list[float | None]:
    """distance_correlation's corr for several planes (2 x features) from one pass over all pairs.

    Rows of one place count once, by their number, unless labels repeat: rows of one label make no pair, so then rows
    count once by label and place. The work is quadratic in the places; blocks of them are broadcast in shards, and a task
    hands on sums alone. Where distances hardly spread, they are measured column by column instead.
    """
    spark = df.sparkSession
    ship_package(spark)
    tables = Tables(spark, "planes")
    some = tables.save(df.select(row, *(F.col(c).cast("double").alias(c) for c in features)).dropna(), "rows")
    repeated = some.count() != some.select(row).distinct().count()
    by = [row] if repeated else features
    places = tables.save(some.groupBy(*([row] if repeated else []), *features).agg(F.count("*").cast("double").alias("w")), "places")
    got = places.agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in features)).first()
    if not got["n"]:
        return [None] * len(planes)
    # products of numbers far from zero would lose digits
    middle = np.array([got[c] for c in features])
    tasks = 2 * spark.sparkContext.defaultParallelism
    n = max(math.ceil(got["n"] / PLACES), min(math.ceil(got["n"] / 500), tasks))
    shards = max(1, math.ceil(got["n"] * (len(features) + 2) / SHARD))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        label = pd.factorize(rows[row])[0] if repeated else np.arange(len(rows))
        return pd.DataFrame({"k": [rows["k"].iloc[0]], "x": [(rows[features].to_numpy(float) - middle).tobytes()], "w": [rows["w"].to_numpy(float).tobytes()], "label": [label.astype(np.int64).tobytes()]})

    blocks = tables.save(places.withColumn("k", F.pmod(F.xxhash64(*by), F.lit(n))).groupBy("k").applyInPandas(pack, "k long, x binary, w binary, label binary"), "blocks")

    def held(s: int) -> list[tuple]:
        return [(r["k"], *(bytes(r[c]) for c in ("x", "w", "label"))) for r in sorted(blocks.where(F.pmod("k", F.lit(shards)) == s).collect())]

    def measure(first: list[tuple], second: list[tuple] | None) -> np.ndarray:
        sent = spark.sparkContext.broadcast((first, second))
        pairs = len(first) * (len(first) + 1) // 2 if second is None else len(first) * len(second)

        def sums(batches):
            one, two = sent.value
            at = [(i, j) for i in range(len(one)) for j in range(i, len(one))] if two is None else [(i, j) for i in range(len(one)) for j in range(len(two))]
            total = np.zeros((len(planes) + 1, 4))
            for b in batches:
                for i, j in (at[t] for t in b["id"]):
                    (_, x, wx, label), (_, y, wy, _) = one[i], (one if two is None else two)[j]
                    p, q = (np.frombuffer(v, dtype=float).reshape(-1, len(features)) for v in (x, y))
                    u, v = np.frombuffer(wx, dtype=float), np.frombuffer(wy, dtype=float)
                    total += _plane_sums(p, q, u, v, planes, np.frombuffer(label, dtype=np.int64) if two is None and i == j else None)
            yield pd.DataFrame(total, columns=["n", "d", "dd", "dx"]).assign(k=range(len(total)))

        todo = spark.range(0, pairs, 1, max(1, min(pairs, 8 * tasks)))
        total = np.zeros((len(planes) + 1, 4))
        for r in todo.mapInPandas(sums, "n double, d double, dd double, dx double, k long").collect():
            total[r["k"]] += [r["n"], r["d"], r["dd"], r["dx"]]
        sent.destroy()
        return total

    total = np.zeros((len(planes) + 1, 4))
    for s in range(shards):
        first = held(s)
        total += measure(first, None)
        for t in range(s + 1, shards):
            total += measure(first, held(t))
    if not repeated:
        # rows of one place are pairs without distance
        total[:, 0] += places.agg(F.sum(F.col("w") * (F.col("w") - 1) / 2)).first()[0]
    out: list[float | None] = []
    pairs, dx, xx = total[0, :3]
    for a, (_, dz, zz, xz) in zip(planes, total[1:], strict=True):
        if not pairs or not xx * zz > 0:
            out.append(None)
            continue
        vx, vz = 1 - dx * dx / (pairs * xx), 1 - dz * dz / (pairs * zz)
        if min(vx, vz) < 1e-10:
            out.append(distance_correlation(project(df, features, a), features, row).first()["corr"])
        else:
            out.append(float((xz - dx * dz / pairs) / math.sqrt(xx * zz * vx * vz)))
    return out


def fit_quality(df: DataFrame, features: list[str], targets: list[str], b) -> DataFrame:
    """target, n, error (sum of squares) and r2 (squared correlation) of each target's reconstruction from z."""
    aggs = []
    for i, t in enumerate(targets):
        hat = F.col("z_1") * F.lit(float(b[i][0])) + F.col("z_2") * F.lit(float(b[i][1]))
        both = F.when(F.col(t).isNotNull() & F.col("z_1").isNotNull(), hat)
        aggs += [F.count(both).alias(f"n{i}"), F.sum(F.pow(F.col(t) - hat, 2)).alias(f"e{i}"), F.corr(t, both).alias(f"r{i}")]
    one = df.agg(*aggs)
    rows = F.array(*(F.struct(F.lit(t).alias("target"), F.col(f"n{i}").alias("n"), F.col(f"e{i}").alias("error"), F.pow(F.col(f"r{i}"), 2).alias("r2")) for i, t in enumerate(targets)))
    return one.select(F.inline(rows))


def fit(df: DataFrame, features: list[str], algos: list[str], *, analytic_solution: bool = False, tries: int = 5, seed: int = 1, start: list[float] | None = None, solution: list[float] | None = None) -> tuple[Solution, DataFrame]:
    """Projection and projected rows. Of the numeric trials, the one whose plane keeps distances best wins."""
    g = Gramian.of(df, features, algos)
    p, m = len(features), len(g.targets)
    if analytic_solution:
        s = analytic(g)
        return s, project(df, features, s.a)
    if solution is not None:
        if len(solution) != 2 * (p + m):
            raise ValueError(f"a solution needs {2 * (p + m)} numbers")
        x = np.asarray(solution, dtype=float)
        a, b = x[: 2 * p].reshape(2, p), x[2 * p :].reshape(m, 2)
        return Solution(a, b, g.loss(a, b)[0]), project(df, features, a)
    found = trials(g, tries, seed, None if start is None else [np.asarray(start, dtype=float)])
    kept = plane_correlations(df, features, [s.a for s in found]) if len(found) > 1 else [0.0]
    scored = [(corr if corr is not None and corr == corr else -2.0, -s.loss) for corr, s in zip(kept, found, strict=True)]
    s = found[max(range(len(found)), key=lambda i: scored[i])]
    return s, project(df, features, s.a)


def summary(spark: SparkSession, features: list[str], a) -> DataFrame:
    """Projection matrix as rows Z_1 and Z_2, rounded to four places."""
    names = ", ".join(f"`{c}` double" for c in features)
    return spark.createDataFrame([(f"Z_{i + 1}", *(round(float(x), 4) for x in a[i])) for i in range(2)], f"row string, {names}")
