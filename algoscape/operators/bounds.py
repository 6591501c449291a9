"""Empirical boundary of the plane: corners of the feature box, pruned by correlation, projected, and their hull."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import convex_hull
from .project import project
from .selection import correlations, with_p_values

#: Corners grow as 2 ** features.
MOST_FEATURES = 20


def significant(df: DataFrame, features: list[str], p_value: float = 0.05) -> np.ndarray:
    """Correlation matrix with the entries that are not significant set to 0."""
    at = {c: i for i, c in enumerate(features)}
    out = np.zeros((len(features),) * 2)
    for r in with_p_values(df.sparkSession, correlations(df, features, features)).collect():
        if r["p"] is not None and r["p"] < p_value and r["left"] != r["right"]:
            out[at[r["left"]], at[r["right"]]] = r["rho"]
    return out


def extremes(df: DataFrame, features: list[str]) -> list[tuple[float, float]]:
    got = df.agg(*(x for i, c in enumerate(features) for x in (F.min(c).alias(f"a{i}"), F.max(c).alias(f"b{i}")))).first()
    return [(got[f"a{i}"], got[f"b{i}"]) for i in range(len(features))]


def vertices(spark: SparkSession, features: list[str], span: list[tuple[float, float]]) -> DataFrame:
    """vertex and one column a feature: every corner of the box; bit i of the vertex picks feature i's maximum."""
    if len(features) > MOST_FEATURES:
        raise ValueError(f"2 ** {len(features)} corners: choose at most {MOST_FEATURES} features")
    v = spark.range(2 ** len(features)).withColumnRenamed("id", "vertex")
    bit = lambda i: F.shiftright("vertex", i).bitwiseAND(F.lit(1))
    return v.select("vertex", *(F.when(bit(i) == 1, F.lit(float(b))).otherwise(F.lit(float(a))).alias(c) for i, (c, (a, b)) in enumerate(zip(features, span, strict=True))))


def prune(corners: DataFrame, features: list[str], corr: np.ndarray, threshold: float = 0.7) -> DataFrame:
    """Without corners that contradict a strong correlation: unequal signs under a positive one, equal signs under a
    negative one. Signs are those of the values, so the features should be centred."""
    out = corners
    for i in range(len(features)):
        for j in range(i + 1, len(features)):
            x, y = F.signum(features[i]), F.signum(features[j])
            if corr[i, j] > threshold:
                out = out.where(x == y)
            elif corr[i, j] < -threshold:
                out = out.where(x != y)
    return out


def hull(points: DataFrame) -> DataFrame:
    """seq, z_1, z_2: the closed convex hull of points, counter-clockwise; each task keeps its own hull first, so
    the last step sees hull corners only. Empty if the points do not span an area."""

    def own(batches):
        import pandas as pd

        kept = np.zeros((0, 2))
        for b in batches:
            kept = convex_hull(np.vstack([kept, b[["z_1", "z_2"]].to_numpy(float)]), keep_degenerate=True)
        yield pd.DataFrame(kept, columns=["z_1", "z_2"])

    spark = points.sparkSession
    some = points.select("z_1", "z_2").where("z_1 is not null and z_2 is not null").mapInPandas(own, "z_1 double, z_2 double")
    corners = convex_hull(some.toPandas().to_numpy(float).reshape(-1, 2))
    if len(corners) < 3:
        return spark.createDataFrame([], "seq int, z_1 double, z_2 double")
    closed = [*corners.tolist(), corners[0].tolist()]
    return spark.createDataFrame([(i + 1, x, y) for i, (x, y) in enumerate(closed)], "seq int, z_1 double, z_2 double")


def boundary(df: DataFrame, features: list[str], a, *, p_value: float = 0.05, threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Hull of all projected corners, and of those that fit the correlations; without the latter, the former twice."""
    corners = vertices(df.sparkSession, features, extremes(df, features))
    edge = hull(project(corners, features, a))
    pruned = hull(project(prune(corners, features, significant(df, features, p_value), threshold), features, a))
    return edge, edge if pruned.isEmpty() else pruned
