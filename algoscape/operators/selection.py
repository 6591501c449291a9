"""Feature selection: correlation rule, clustering of features, and search for one feature a cluster."""

from __future__ import annotations

import logging
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.special import correlation_p_value
from .predict import fold_of, knn_losses
from .project import Gramian, solve

log = logging.getLogger(__name__)


def correlations(df: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """left, right, n, rho, t for each pair of columns, rows with a missing side left out; one aggregate."""
    def both(a: str, b: str):
        return F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1))

    pairs = [(a, b) for a in left for b in right]
    one = df.agg(*(x for i, (a, b) in enumerate(pairs) for x in (F.corr(a, b).alias(f"r{i}"), both(a, b).alias(f"n{i}"))))
    rows = F.array(*(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("rho")) for i, (a, b) in enumerate(pairs)))
    out = one.select(F.inline(rows)).withColumn("rho", F.when(~F.isnan("rho"), F.col("rho")))
    return out.withColumn("t", F.col("rho") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("rho") * F.col("rho"))))


def with_p_values(spark: SparkSession, table: DataFrame) -> DataFrame:
    """Adds p to a correlation table, which has a row a pair of columns."""
    rows = [(*r, correlation_p_value(r["rho"], r["n"])) for r in table.collect()]
    return spark.createDataFrame(rows, "left string, right string, n long, rho double, t double, p double")


def ranked(table: DataFrame, order: list[str]) -> DataFrame:
    """Correlation table with the place of each feature (left) within its algorithm (right), strongest first; ties and
    missing correlations by the features' order."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("left"))
    strength = F.coalesce(F.abs("rho"), F.lit(0.0))
    return table.withColumn("place", F.row_number().over(Window.partitionBy("right").orderBy(strength.desc(), place)))


def correlation_rule(table: DataFrame, order: list[str], rho: float, p_value: float = 0.05) -> list[str]:
    """Features that are the best of some algorithm, or correlate by ``rho`` or more with one; correlations that are
    not significant count as 0. Needs the column p."""
    sure = table.withColumn("rho", F.when(F.col("p") <= p_value, F.col("rho")).otherwise(F.lit(0.0)))
    kept = {r["left"] for r in ranked(sure, order).where((F.col("place") == 1) | (F.abs("rho") >= rho)).select("left").distinct().collect()}
    return [c for c in order if c in kept]


def top_rule(table: DataFrame, order: list[str], least: int = 3, start: int = 1) -> list[str]:
    """The best features of each algorithm, as many places deep as it takes to have ``least`` of them."""
    rows = ranked(table, order).select("left", "place").collect()
    for depth in range(start, len(order) + 1):
        kept = {r["left"] for r in rows if r["place"] <= depth}
        if len(kept) >= min(least, len(order)):
            break
    return [c for c in order if c in kept]


def correlation_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Pearson correlations of all columns as a matrix, from one aggregate; undefined ones count as 0."""
    got = df.agg(*(F.corr(a, b).alias(f"r{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j)).first()
    out = np.eye(len(columns))
    for i in range(len(columns)):
        for j in range(i + 1, len(columns)):
            r = got[f"r{i}_{j}"]
            out[i, j] = out[j, i] = 0.0 if r is None or r != r else r
    return out


def cluster_features(corr: np.ndarray, k: int, replicates: int = 20, iterations: int = 1000, seed: int = 1) -> np.ndarray:
    """k-means of standardised features under correlation distance. Centroids are means of member vectors, so all
    distances follow from the correlation matrix and no row is needed."""
    p = len(corr)
    rng = np.random.default_rng(seed)
    best, best_cost = np.zeros(p, dtype=int), np.inf
    for _ in range(replicates):
        own = _spread(corr, k, rng)
        for _ in range(iterations):
            d = _centroid_distances(corr, own, k)
            new = d.argmin(axis=1)
            for c in range(k):
                if not (new == c).any():
                    far = int(np.argmax(d[np.arange(p), new] * (np.bincount(new, minlength=k)[new] > 1)))
                    new[far] = c
            if (new == own).all():
                break
            own = new
        cost = _centroid_distances(corr, own, k)[np.arange(p), own].sum()
        if cost < best_cost - 1e-12:
            best, best_cost = own, cost
    return best


def _spread(corr: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    p = len(corr)
    seeds = [int(rng.integers(p))]
    while len(seeds) < k:
        d = (1 - corr[:, seeds]).min(axis=1).clip(0)
        d[seeds] = 0
        seeds.append(int(rng.choice(p, p=d / d.sum())) if d.sum() > 0 else int(rng.choice([i for i in range(p) if i not in seeds])))
    own = (1 - corr[:, seeds]).argmin(axis=1)
    own[seeds] = np.arange(k)
    return own


def _centroid_distances(corr: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    out = np.full((len(corr), k), np.inf)
    for c in range(k):
        m = own == c
        if m.any():
            norm = np.sqrt(max(corr[np.ix_(m, m)].sum(), 1e-300))
            out[:, c] = 1 - corr[:, m].sum(axis=1) / norm
    return out


def silhouette(corr: np.ndarray, own: np.ndarray) -> float:
    """Mean silhouette of a clustering under correlation distance."""
    d, total = 1 - corr, []
    for i in range(len(corr)):
        mine = (own == own[i]) & (np.arange(len(corr)) != i)
        others = [d[i, own == c].mean() for c in set(own.tolist()) if c != own[i]]
        if not mine.any() or not others:
            total.append(0.0)
            continue
        a, b = d[i, mine].mean(), min(others)
        total.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(total))


def silhouette_scan(corr: np.ndarray, low: int = 3, seed: int = 1) -> list[tuple[int, float]]:
    """(k, mean silhouette) for every number of clusters from ``low``."""
    return [(k, silhouette(corr, cluster_features(corr, k, seed=seed))) for k in range(low, len(corr))]


def first_good_k(scan: list[tuple[int, float]], threshold: float = 0.5) -> int:
    """First k whose silhouette is over the threshold, else the best."""
    return next((k for k, s in scan if s > threshold), max(scan, key=lambda x: x[1])[0])


class Search:
    """Cost of feature choices, remembered by choice: projection, then the worst algorithm's k-NN loss."""

    def __init__(self, df: DataFrame, features: list[str], algos: list[str], flags: list[str], folds: int = 5, seed: int = 1):
        self.df, self.features, self.algos, self.flags, self.folds, self.seed = df, features, algos, flags, folds, seed
        self.gramian = Gramian.of(df, features, algos)
        self.known: dict[tuple[int, ...], float] = {}

    def costs(self, choices: list[tuple[int, ...]]) -> list[float]:
        """Costs of several choices; the new ones are evaluated in one job, a group each."""
        new = [c for c in dict.fromkeys(choices) if c not in self.known]
        if new:
            projections = {}
            for c in new:
                names = [self.features[i] for i in c]
                projections[c] = (names, solve(self.gramian.pick(names), tries=5, seed=self.seed).a)
            self.known |= knn_losses(self.df, projections, self.flags, fold_of(self.folds, self.seed), k=3)
        return [self.known[c] for c in choices]

    def brute_force(self, clusters: list[list[int]]) -> tuple[int, ...]:
        """The best of all choices of one feature a cluster."""
        every = list(product(*clusters))
        costs = self.costs(every)
        return every[int(np.argmin(costs))]

    def genetic(self, clusters: list[list[int]], population: int = 50, generations: int = 100, stall: int = 5, tolerance: float = 1e-3) -> tuple[int, ...]:
        """Genetic search: tournaments, uniform crossover, one elite, mutation of single genes."""
        rng = np.random.default_rng(self.seed)
        sizes = np.array([len(c) for c in clusters])
        pop = rng.integers(0, sizes, size=(population, len(sizes)))
        best, best_cost, still = None, np.inf, 0
        for _ in range(generations):
            costs = np.array(self.costs([tuple(c[g] for c, g in zip(clusters, row, strict=True)) for row in pop]))
            i = int(costs.argmin())
            still = 0 if costs[i] < best_cost - tolerance else still + 1
            if costs[i] < best_cost:
                best, best_cost = pop[i].copy(), costs[i]
            if still >= stall or best_cost <= 0:
                break
            pairs = rng.integers(0, population, size=(2, population, 2))
            parents = [pop[np.where(costs[q[:, 0]] <= costs[q[:, 1]], q[:, 0], q[:, 1])] for q in pairs]
            pop = np.where(rng.random(pop.shape) < 0.5, *parents)
            change = rng.random(pop.shape) < 0.1
            pop = np.where(change, rng.integers(0, sizes, size=pop.shape), pop)
            pop[0] = best
        return tuple(c[g] for c, g in zip(clusters, best, strict=True))


def select_features(df: DataFrame, features: list[str], algos: list[str], flags: list[str], *, rho: float = 0.1, clusters: int = 10, replicates: int = 100, iterations: int = 1000, seed: int = 1, brute_limit: int = 1000) -> list[str]:
    """Features that remain: by correlation, then one of each cluster of alike features, chosen by prediction loss."""
    if len(features) <= 1:
        raise ValueError("at least two features are needed")
    if len(features) <= 3:
        return features
    table = with_p_values(df.sparkSession, correlations(df, features, algos))
    kept = correlation_rule(table, features, rho)
    if len(kept) <= 1:
        raise ValueError("at most one feature correlates with performance; lower rho")
    if len(kept) <= 3 or len(kept) <= clusters:
        return kept
    corr = correlation_matrix(df, kept)
    scan = silhouette_scan(corr, seed=seed)
    if scan and max(s for _, s in scan) < 0.5:
        log.warning("no number of clusters reaches a mean silhouette of 0.5")
    own = cluster_features(corr, clusters, replicates, iterations, seed)
    groups = [[i for i in range(len(kept)) if own[i] == c] for c in range(clusters)]
    search = Search(df, kept, algos, flags, seed=seed)
    few = np.prod([float(len(g)) for g in groups]) <= brute_limit / 10
    chosen = search.brute_force(groups) if few else search.genetic(groups)
    return [kept[i] for i in sorted(chosen)]


def forest_losses(df: DataFrame, features: list[str], flags: list[str], choices: list[tuple[int, ...]], trees: int = 50, folds: int = 3, seed: int = 1) -> dict[tuple[int, ...], float]:
    """Older cost: two principal components, then a random forest for each flag; the sum of cross-validated losses.

    Stands in for an out-of-bag loss, which the forest here does not report.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    out = {}
    held = df.withColumn("__fold", F.pmod(F.xxhash64(F.lit(seed), "instances"), F.lit(folds)))
    for choice in choices:
        names = [features[i] for i in choice]
        stages = [VectorAssembler(inputCols=names, outputCol="v", handleInvalid="skip"), StandardScaler(inputCol="v", outputCol="s", withMean=True), PCA(k=min(2, len(names)), inputCol="s", outputCol="z")]
        placed = Pipeline(stages=stages).fit(held).transform(held)
        total = 0.0
        for f in flags:
            rows = placed.select("z", F.col(f).cast("double").alias("y"), "__fold")
            wrong = n = 0
            for k in range(folds):
                train, test = rows.where(F.col("__fold") != k), rows.where(F.col("__fold") == k)
                if train.isEmpty() or test.isEmpty():
                    continue
                model = RandomForestClassifier(featuresCol="z", labelCol="y", numTrees=trees, seed=seed).fit(train)
                got = model.transform(test).agg(F.count_if(F.col("prediction") != F.col("y")).alias("w"), F.count("*").alias("n")).first()
                wrong, n = wrong + got["w"], n + got["n"]
            total += wrong / max(n, 1)
        out[choice] = total
    return out
