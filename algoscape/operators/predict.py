"""Prediction of goodness per algorithm, selection of one algorithm, and their summary."""

from __future__ import annotations

from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.neighbours import Voters
from ..functions.shipping import ship_package
from ..functions.tables import Tables
from .subset import nearest_rows

#: Rows a kernel machine is fitted on: beyond that a hashed sample of this size. Every row is predicted.
KERNEL_ROWS = 3_000
#: Rows that the neighbours of ``knn_losses`` are taken from; None for all. Every row counts in a loss.
MODEL_ROWS: int | None = None


def fold_of(folds: int, seed: int = 1, row: str = "instances") -> Column:
    """Fold 0..folds-1 of a row by a seeded hash of its label."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(row)), F.lit(folds)).cast("int")


def stratified_folds(df: DataFrame, flag: str, folds: int, order: str = "instances") -> DataFrame:
    """df with fold (0-based): rows of each class are dealt in turn, ordered by a column; classes are numbered by
    range partitions, so no class is one task."""
    from ..sources.metadata import with_row_id

    parts = [with_row_id(df.where(F.coalesce(F.col(flag), F.lit(False)) == F.lit(v)), order, "__n") for v in (False, True)]
    return parts[0].unionByName(parts[1]).withColumn("fold", F.pmod(F.col("__n") - 1, F.lit(folds)).cast("int")).drop("__n")


# ---- k nearest neighbours
def knn_predict(train: DataFrame, test: DataFrame, columns: list[str], flags: list[str], k: int = 3, *, metric: str = "euclidean", row: str = "instances", other_fold: str | None = None) -> DataFrame:
    """row, share_<flag> and hat_<flag> for each test row: vote of the k nearest training rows, ties of distance by
    label; a vote of one half or less is false. With ``other_fold`` only training rows of other folds count. Rows without
    a place meet nothing. Rows meet by grid cells that widen (see subset.nearest_rows), not all with all."""
    extra = [other_fold] if other_fold else []
    meets = F.col(f"a.{other_fold}") != F.col(f"b.{other_fold}") if other_fold else F.lit(True)
    near = nearest_rows(test.select(row, *columns, *extra), train.select(row, *columns, *flags, *extra), columns, k, meets, Tables(test.sparkSession, "knn"), carry=flags, metric=metric, row=row)
    votes = near.groupBy(row).agg(*(F.avg(F.col(f).cast("double")).alias(f"share_{f}") for f in flags))
    return votes.select(row, *(F.col(f"share_{f}") for f in flags), *((F.col(f"share_{f}") > 0.5).alias(f"hat_{f}") for f in flags))


def _nearest(z: np.ndarray, q: np.ndarray, k: int, skip: np.ndarray | None = None) -> np.ndarray:
    """Row numbers of the k nearest rows of z for every row of q, ties by number, in blocks of queries; skipped rows last."""
    k = min(k, len(z))
    out = np.zeros((len(q), k), dtype=np.int64)
    for at in range(0, len(q), 512):
        own = q[at : at + 512]
        d = np.zeros((len(own), len(z)))
        for c in range(z.shape[1]):
            d += (own[:, c, None] - z[None, :, c]) ** 2
        if skip is not None:
            d[skip[at : at + 512]] = np.inf
        most = np.partition(d, k - 1, axis=1)[:, k - 1] if k else np.zeros(len(own))
        if np.isnan(most).any():
            out[at : at + 512] = np.argsort(d, axis=1, kind="stable")[:, :k]
            continue
        i, j = np.nonzero(d <= most[:, None])
        order = np.lexsort([d[i, j], i])
        out[at : at + 512] = j[order][np.searchsorted(i, np.arange(len(own)))[:, None] + np.arange(k)] if k else 0
    return out


def _knn_vote(z: np.ndarray, y: np.ndarray, q: np.ndarray, k: int, skip: np.ndarray | None = None) -> np.ndarray:
    """Shares of true flags among the k nearest rows of z for every row of q."""
    return y[_nearest(z, q, k, skip)].mean(axis=1)


def knn_losses(df: DataFrame, projections: dict[tuple[int, ...], tuple[list[str], np.ndarray]], flags: list[str], fold: Column, k: int = 3) -> dict[tuple[int, ...], float]:
    """Worst cross-validated k-NN loss over the flags in each projection, over all rows.

    All rows are broadcast once, as features, flags and folds; a task counts the misses of its rows in every projection.
    """
    spark = df.sparkSession
    ship_package(spark)
    names = sorted({c for cols, _ in projections.values() for c in cols})
    every = Tables(spark, "losses").save(df.select("instances", *names, *flags).dropna().withColumn("__fold", fold), "rows")
    rows = bounded(every, MODEL_ROWS).orderBy("instances").drop("instances").toPandas()
    work = list(projections.items())
    sent = spark.sparkContext.broadcast((rows[names].to_numpy(float), rows[flags].to_numpy(bool), rows["__fold"].to_numpy(int)[:, None], [v for _, v in work]))
    n = every.count()

    def plane(x, use, a):
        # by columns, so that equal rows have equal places
        return sum(x[:, names.index(c), None] * v[None, :] for c, v in zip(use, np.asarray(a).T, strict=True))

    def count(batches):
        x, y, folds, given = sent.value
        had = list(batches)
        if not had:
            return
        b = pd.concat(had, ignore_index=True)
        q, truth, own = b[names].to_numpy(float), b[flags].to_numpy(bool), b["__fold"].to_numpy(int)[:, None]
        out = []
        for i, (use, a) in enumerate(given):
            shares = Voters(plane(x, use, a), y, folds, k).shares(plane(q, use, a), own, [[k]] * len(flags))
            out += [(i, j, int(((s[:, 0] > 0.5) != truth[:, j]).sum()), len(b)) for j, s in enumerate(shares)]
        yield pd.DataFrame(out, columns=["id", "flag", "wrong", "n"])

    tasks = max(spark.sparkContext.defaultParallelism, n // 50_000)
    parts = every.drop("instances").repartition(tasks).mapInPandas(count, "id long, flag long, wrong long, n long")
    losses = parts.groupBy("id", "flag").agg((F.sum("wrong") / F.greatest(F.sum("n"), F.lit(1))).alias("loss"))
    got = {r["id"]: r["loss"] for r in losses.groupBy("id").agg(F.max("loss").alias("loss")).collect()}
    sent.destroy()
    return {c: got[i] for i, (c, _) in enumerate(work)}


def bounded(df: DataFrame, most: int | None, row: str = "instances") -> DataFrame:
    """At most ``most`` rows, those with the least hashes of their label; all rows where it is None."""
    if most is None or df.count() <= most:
        return df
    return df.withColumn("__h", F.xxhash64(row)).orderBy("__h").limit(most).drop("__h")


# ---- kernel machines
def kernel(x: np.ndarray, y: np.ndarray, scale: float, polynomial: bool) -> np.ndarray:
    dot = x @ y.T
    if polynomial:
        return (1 + scale * dot) ** 2
    return np.exp(-scale * ((x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * dot))


def fit_svm(x: np.ndarray, y: np.ndarray, c: float, scale: float, polynomial: bool, weight: np.ndarray | None = None, sweeps: int = 60) -> dict[str, Any]:
    """Soft-margin kernel classifier by dual coordinate ascent (the bias is a constant feature), with a logistic
    calibration of its margins. Classes weigh by their shares unless weights are given."""
    t = np.where(y, 1.0, -1.0)
    if len(set(t.tolist())) < 2:
        return {"x": x[:1], "alpha": np.zeros(1), "c": c, "scale": scale, "polynomial": polynomial, "slope": 0.0, "offset": 30.0 if y.any() else -30.0}
    k = kernel(x, x, scale, polynomial) + 1.0
    share = y.mean()
    cap = c * (np.where(y, (1 - share) / share, 1.0) if weight is None else weight / weight.mean())
    alpha, f, rng = np.zeros(len(x)), np.zeros(len(x)), np.random.default_rng(1)
    for _ in range(sweeps):
        most = 0.0
        for i in rng.permutation(len(x)):
            new = min(max(alpha[i] + (1 - t[i] * f[i]) / max(k[i, i], 1e-12), 0.0), cap[i])
            step = new - alpha[i]
            if step:
                f += step * t[i] * k[i]
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-4 * c:
            break
    slope, offset = _calibrate(f, y)
    used = alpha > 1e-9
    return {"x": x[used], "alpha": (alpha * t)[used], "c": c, "scale": scale, "polynomial": polynomial, "slope": slope, "offset": offset}


def _calibrate(f: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Logistic fit of labels on margins by Newton steps, with smoothed targets."""
    up, down = y.sum(), (~y).sum()
    target = np.where(y, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, float(np.log((up + 1) / (down + 1)))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * f + b, -30, 30)))
        g = np.array([((p - target) * f).sum(), (p - target).sum()])
        w = np.maximum(p * (1 - p), 1e-12)
        h = np.array([[(w * f * f).sum() + 1e-9, (w * f).sum()], [(w * f).sum(), w.sum() + 1e-9]])
        move = np.linalg.solve(h, g)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-9:
            break
    return float(a), float(b)


def svm_scores(model: dict[str, Any], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decision and probability of being good."""
    f = np.zeros(len(x))
    if len(model["alpha"]):
        held, alpha = np.asarray(model["x"], dtype=float), np.asarray(model["alpha"], dtype=float)
        for at in range(0, len(x), 1024):
            f[at : at + 1024] = (kernel(x[at : at + 1024], held, model["scale"], model["polynomial"]) + 1.0) @ alpha
    p = 1 / (1 + np.exp(-np.clip(model["slope"] * f + model["offset"], -30, 30)))
    return (f > 0) if model["slope"] else p > 0.5, p


def latin_points(n: int, low: float = -10.0, high: float = 4.0, seed: int = 1) -> list[tuple[float, float]]:
    """n points of a Latin hypercube over powers of two for box constraint and kernel scale, sorted."""
    rng = np.random.default_rng(seed)
    cells = np.column_stack([rng.permutation(n), rng.permutation(n)])
    return sorted(map(tuple, (2.0 ** (low + (high - low) * (cells + rng.random((n, 2))) / n)).tolist()))


def train(df: DataFrame, flags: list[str], *, knn: bool = True, folds: int = 5, polynomial: bool = False, weights: list[str] | None = None, parameters: list[list[float]] | None = None, points: int = 30, seed: int = 1) -> tuple[dict[str, Any], DataFrame]:
    """Models over z_1, z_2 and predictions for every row (instances, hat_<flag>, prob_<flag>), NULL without a place in the
    plane. The point with the least out-of-fold error wins, the first on ties. See _train_knn and _train_kernels."""
    if knn:
        return _train_knn(df, flags, folds, [[int(p[0])] for p in parameters] if parameters else [[1, 3, 5, 7, 9]] * len(flags))
    return _train_kernels(df, flags, folds, polynomial, weights, parameters, points, seed)


def _dealt(y: np.ndarray, folds: int) -> np.ndarray:
    """Fold of every row for each flag: rows of each class are dealt in turn."""
    held = np.zeros(y.shape, dtype=np.int16)
    for j in range(y.shape[1]):
        for v in (False, True):
            at = np.flatnonzero(y[:, j] == v)
            held[at, j] = np.arange(len(at)) % folds
    return held


def _numbered(rows: DataFrame, flags: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places and flags of all rows in the order of their numbers, as arrays of 16 bytes and a byte a flag."""
    got = rows.select("number", "z_1", "z_2", *flags).toArrow()
    order = np.argsort(got["number"].to_numpy())
    z, y = (np.column_stack([got[c].to_numpy() for c in cols]) if cols else np.zeros((got.num_rows, 0)) for cols in (["z_1", "z_2"], flags))
    return z[order].astype(float), y[order].astype(bool)


def _train_knn(df: DataFrame, flags: list[str], folds: int, ks: list[list[int]]) -> tuple[dict[str, Any], DataFrame]:
    """k-NN models, whose rows are all rows with a place; predictions are out of fold for every row.

    Places, flags and folds of all rows are broadcast; tasks look up the neighbours of their rows once for all flags and ks.
    """
    from ..sources.metadata import with_row_id

    spark = df.sparkSession
    ship_package(spark)
    tables = Tables(spark, "models")

    df = tables.save(df.select("instances", "z_1", "z_2", *(F.coalesce(F.col(f), F.lit(False)).alias(f) for f in flags)), "given")
    rows = tables.save(with_row_id(df.dropna(subset=["z_1", "z_2"]), "instances", "number"), "rows")
    z, y = _numbered(rows, flags)
    held = _dealt(y, folds)
    sent = spark.sparkContext.broadcast((Voters(z, y, held, max(max(k) for k in ks)), held))
    names = [[f"s_{j}_{c}" for c in range(len(k))] for j, k in enumerate(ks)]
    flat = [n for own in names for n in own]

    def vote(batches):
        index, held = sent.value
        had = list(batches)
        if had:
            b = pd.concat(had, ignore_index=True)
            got = index.shares(b[["z_1", "z_2"]].to_numpy(float), held[b["number"].to_numpy() - 1], ks)
            yield pd.concat([b[["instances", *flags]], pd.DataFrame(np.hstack(got), columns=flat)], axis=1)

    tasks = max(spark.sparkContext.defaultParallelism, len(z) // 50_000)
    kept = rows.select("instances", *flags)
    voted = tables.save(rows.repartition(tasks).mapInPandas(vote, T.StructType([*kept.schema.fields, *(T.StructField(n, T.DoubleType()) for n in flat)])), "folds")
    sent.destroy()
    missed = voted.agg(*(F.avg(((F.col(n) > 0.5) != F.col(f)).cast("double")).alias(n) for f, own in zip(flags, names, strict=True) for n in own)).first()
    best = [min(range(len(own)), key=lambda c, own=own: (missed[own[c]] or 0.0, c)) for own in names]
    models = [{"flag": f, "k": ks[j][best[j]], "metric": "euclidean"} for j, f in enumerate(flags)]
    chosen = [F.col(own[b]) for own, b in zip(names, best, strict=True)]
    hats = [x for f, s in zip(flags, chosen, strict=True) for x in ((s > 0.5).alias(f"hat_{f}"), s.alias(f"prob_{f}"))]
    nothing = [x for f in flags for x in (F.lit(None).cast("boolean").alias(f"hat_{f}"), F.lit(None).cast("double").alias(f"prob_{f}"))]
    unplaced = df.where(F.col("z_1").isNull() | F.isnan("z_1") | F.col("z_2").isNull() | F.isnan("z_2"))
    out = voted.select("instances", *hats).unionByName(unplaced.select("instances", *nothing))
    return {"knn": True, "models": models, "rows": rows.drop("instances")}, tables.save(out, "predictions")


def _train_kernels(df: DataFrame, flags: list[str], folds: int, polynomial: bool, weights: list[str] | None, parameters: list[list[float]] | None, points: int, seed: int) -> tuple[dict[str, Any], DataFrame]:
    """Kernel machines; predictions are out of fold for the rows that the models are fitted on, by the models themselves for
    all others.

    One group per flag, parameter point and fold runs as a task over the broadcast rows (at most KERNEL_ROWS by
    hash); the chosen point is fitted again on all of these rows.
    """
    spark = df.sparkSession
    ship_package(spark)
    cols = ["instances", "z_1", "z_2", *flags, *(weights or [])]
    rows = bounded(df.select(*cols).dropna(subset=["z_1", "z_2"]), KERNEL_ROWS).toPandas().sort_values("instances").reset_index(drop=True)
    z = rows[["z_1", "z_2"]].to_numpy(float)
    mu, sigma = z.mean(axis=0), z.std(axis=0, ddof=1) if len(z) > 1 else np.ones(2)
    sigma = np.where(sigma > 0, sigma, 1.0)
    x = (z - mu) / sigma
    y = rows[flags].to_numpy(bool)
    w = None if not weights else rows[weights].to_numpy(float)
    given = parameters or latin_points(points, seed=seed)
    grid = [(j, tuple(p)) for j in range(len(flags)) for p in ([given[j]] if parameters else given)]
    held = _dealt(y, folds)
    sent = spark.sparkContext.broadcast((x, y, w, held, grid))
    todo = spark.range(len(grid) * folds).repartition(max(1, min(len(grid) * folds, spark.sparkContext.defaultParallelism)))

    def predict(xt, yt, wt, xq, p):
        if not len(xt):
            return np.zeros(len(xq), dtype=bool), np.zeros(len(xq))
        return svm_scores(fit_svm(xt, yt, p[0], p[1], polynomial, wt), xq)

    def one(batches):
        x, y, w, held, grid = sent.value
        for b in batches:
            out = []
            for i in b["id"]:
                (j, p), k = grid[i // folds], i % folds
                test = held[:, j] == k
                hat, prob = predict(x[~test], y[~test, j], None if w is None else w[~test, j], x[test], p)
                out += list(zip([i // folds] * len(hat), np.flatnonzero(test).tolist(), hat.tolist(), prob.tolist(), strict=True))
            yield pd.DataFrame(out, columns=["point", "row", "hat", "prob"])

    tables = Tables(spark, "models")
    got = tables.save(todo.mapInPandas(one, "point long, row long, hat boolean, prob double"), "folds")
    truth = y
    best: dict[int, int] = {}
    # misses of each point are counted where they are; the driver then gets the predictions of the chosen points alone
    flat = spark.createDataFrame(pd.DataFrame([(i, j, bool(v)) for i, r in enumerate(truth) for j, v in enumerate(r)], columns=["row", "flag", "truth"]), "row long, flag long, truth boolean")
    flag_of = spark.createDataFrame([(g, j) for g, (j, _) in enumerate(grid)], "point long, flag long")
    counted = got.join(F.broadcast(flag_of), "point").join(F.broadcast(flat), ["row", "flag"]).groupBy("point").agg(F.avg((F.col("hat") != F.col("truth")).cast("double")).alias("miss"))
    miss = {r["point"]: r["miss"] for r in counted.collect()}
    for g in sorted(miss):
        j = grid[g][0]
        if j not in best or miss[g] < miss[best[j]]:
            best[j] = g
    errors = got.where(F.col("point").isin(sorted(best.values()))).toPandas()
    out = rows[["instances"]].copy()
    models = []
    for j, f in enumerate(flags):
        e = errors[errors.point == best[j]].sort_values("row")
        out[f"hat_{f}"], out[f"prob_{f}"] = e.hat.to_numpy(bool), e.prob.to_numpy(float)
        p = grid[best[j]][1]
        m = fit_svm(x, y[:, j], p[0], p[1], polynomial, None if w is None else w[:, j])
        models.append({"flag": f} | {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in m.items()})
    model = {"knn": False, "mu": mu.tolist(), "sigma": sigma.tolist(), "models": models}
    oof = spark.createDataFrame(out)
    rest = score(df.select("instances", "z_1", "z_2").join(F.broadcast(oof.select("instances")), "instances", "left_anti"), model)
    return model, tables.save(oof.unionByName(rest.select(*oof.columns)), "predictions")


def score(df: DataFrame, model: dict[str, Any]) -> DataFrame:
    """df with hat_<flag> and prob_<flag> from stored models; a narrow pass over the rows, also on a stream."""
    spark = df.sparkSession
    ship_package(spark)
    models, knn = model["models"], model["knn"]
    names = [m["flag"] for m in models]
    schema = T.StructType([*df.schema.fields, *(T.StructField(f"hat_{n}", T.BooleanType()) for n in names), *(T.StructField(f"prob_{n}", T.DoubleType()) for n in names)])
    if knn:
        z, y = _numbered(model["rows"], names)
        ks = [[m["k"]] for m in models]
        # one column of folds that no query is in
        sent = spark.sparkContext.broadcast(Voters(z, y, np.zeros((len(z), 1), dtype=np.int16), max(k for k, in ks)))
    else:
        sent, mu, sigma = spark.sparkContext.broadcast(models), np.array(model["mu"]), np.array(model["sigma"])

    def one(batches):
        held = sent.value
        for b in batches:
            z = b[["z_1", "z_2"]].to_numpy(float)
            ok = ~np.isnan(z).any(axis=1)
            if knn:
                shares = held.shares(z[ok], np.full((int(ok.sum()), 1), -1), ks)
                got = [(s[:, 0] > 0.5, s[:, 0]) for s in shares]
            else:
                got = [svm_scores(m, (z[ok] - mu) / sigma) for m in held]
            hats, probs = {}, {}
            for name, (h, p) in zip(names, got, strict=True):
                full = np.full(len(b), None, dtype=object)
                full[ok] = [bool(v) for v in h]
                prob = np.full(len(b), np.nan)
                prob[ok] = p
                hats[f"hat_{name}"], probs[f"prob_{name}"] = full, prob
            yield b.assign(**hats, **probs)

    return df.mapInPandas(one, schema)


# ---- assessment
def confusion(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """name, tn, fn, fp, tp, precision, recall, accuracy for each (truth, prediction), in one aggregate; the full
    table is counted even if a class is absent, and ratios without rows are NULL."""
    cells = {"tn": (False, False), "fn": (True, False), "fp": (False, True), "tp": (True, True)}
    one = df.agg(*(F.count_if((F.col(t) == F.lit(a)) & (F.col(h) == F.lit(b))).alias(f"{c}_{i}") for i, (t, h) in enumerate(pairs) for c, (a, b) in cells.items()))
    rows = F.array(*(F.struct(F.lit(t).alias("name"), *(F.col(f"{c}_{i}").alias(c) for c in cells)) for i, (t, _) in enumerate(pairs)))
    return one.select(F.inline(rows)).withColumns(
        {
            "precision": F.try_divide("tp", F.col("tp") + F.col("fp")),
            "recall": F.try_divide("tp", F.col("tp") + F.col("fn")),
            "accuracy": F.try_divide(F.col("tp") + F.col("tn"), F.col("tn") + F.col("fn") + F.col("fp") + F.col("tp")),
        }
    )


def select(df: DataFrame, hats: list[str], precision: list[float | None], default: int) -> DataFrame:
    """df with selection0 (place of the predicted-good algorithm of the highest precision, 0 for none) and selection1
    (the default place where there is none)."""
    if len(hats) == 1:
        place = F.coalesce(F.col(hats[0]).cast("int"), F.lit(0))
    else:
        weight = F.array(*(F.coalesce(F.col(h).cast("int"), F.lit(0)) * F.lit(float(p or 0.0)) for h, p in zip(hats, precision, strict=True)))
        place = F.when(F.array_max(weight) > 0, F.array_position(weight, F.array_max(weight)).cast("int")).otherwise(F.lit(0))
    return df.withColumn("selection0", place).withColumn("selection1", F.when(F.col("selection0") == 0, F.lit(default)).otherwise(F.col("selection0")))


def default_algorithm(df: DataFrame, flags: list[str]) -> int:
    """Place of the algorithm that is good most often; the first on ties."""
    got = df.agg(*(F.avg(F.col(f).cast("double")).alias(f) for f in flags)).first()
    shares = [got[f] or 0.0 for f in flags]
    return shares.index(max(shares)) + 1


def summary(df: DataFrame, algos: list[str], flags: list[str], hats: list[str], parameters: list[tuple[float | None, float | None]] | None = None) -> DataFrame:
    """One row an algorithm, then Oracle and Selector: mean and deviation of performance over all and over selected rows,
    share of good rows, and accuracy, precision, recall in percent. Needs best_perf, selection0 and selection1."""
    pick = lambda s, cols: F.element_at(F.array(*cols), F.when(F.col(s) > 0, F.col(s)))
    got_good = lambda s: F.coalesce(pick(s, flags), F.lit(False))
    aggs = [x for i, (a, g, h) in enumerate(zip(algos, flags, hats, strict=True)) for x in (F.avg(a).alias(f"m{i}"), F.stddev_samp(a).alias(f"s{i}"), F.avg(F.col(g).cast("double")).alias(f"g{i}"), F.avg(F.when(F.col(h), F.col(a))).alias(f"hm{i}"), F.stddev_samp(F.when(F.col(h), F.col(a))).alias(f"hs{i}"))]
    any_good = reduce(lambda a, b: a | b, (F.col(f) for f in flags))
    chosen = F.col("selection0") > 0
    tg, fg, fb = chosen & got_good("selection0"), chosen & ~got_good("selection0"), any_good & ~got_good("selection0")
    aggs += [F.avg("best_perf").alias("om"), F.stddev_samp("best_perf").alias("os"), F.avg(pick("selection1", algos)).alias("sm"), F.stddev_samp(pick("selection1", algos)).alias("ss")]
    aggs += [F.avg(got_good("selection1").cast("double")).alias("sg"), F.avg(pick("selection0", algos)).alias("sm0"), F.stddev_samp(pick("selection0", algos)).alias("ss0")]
    aggs += [F.count_if(tg).alias("tg"), F.count_if(fg).alias("fg"), F.count_if(fb).alias("fb")]
    s = df.agg(*aggs)
    c = {r["name"]: r for r in confusion(df, list(zip(flags, hats, strict=True))).collect()}
    nothing = F.lit(None).cast("double")
    params = parameters or [(None, None)] * len(algos)

    def row(name, *values):
        names = ["avg_all", "std_all", "probability_of_good", "avg_selected", "std_selected", "accuracy", "precision", "recall", "parameter_1", "parameter_2"]
        digits = [3, 3, 3, 3, 3, 1, 1, 1, 3, 3]
        return F.struct(F.lit(name).alias("algorithm"), *(F.round(v, d).alias(n) for v, n, d in zip(values, names, digits, strict=True)))

    number = lambda v: F.lit(None if v is None else float(v)).cast("double")
    rows = []
    for i, (a, f) in enumerate(zip(algos, flags, strict=True)):
        m = c[f]
        rows.append(row(a[5:] if a.startswith("algo_") else a, F.col(f"m{i}"), F.col(f"s{i}"), F.col(f"g{i}"), F.col(f"hm{i}"), F.col(f"hs{i}"), *(number(None if m[x] is None else 100 * m[x]) for x in ("accuracy", "precision", "recall")), *map(number, params[i])))
    rows.append(row("Oracle", F.col("om"), F.col("os"), F.lit(1.0), *[nothing] * 7))
    precision, recall = (100 * F.try_divide("tg", F.col("tg") + F.col(x)) for x in ("fg", "fb"))
    rows.append(row("Selector", F.col("sm"), F.col("ss"), F.col("sg"), F.col("sm0"), F.col("ss0"), nothing, precision, recall, nothing, nothing))
    return s.select(F.inline(F.array(*rows)))
