"""Preparation of features and performances: outlier bounds, power transform, standard scores."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from ..functions.shipping import ship_package
from .labels import MACHINE_EPSILON

SCHEMA = "name string, role string, med double, iqr double, lo double, hi double, shift double, lambda double, mu double, sigma double"


def bounds(df: DataFrame, columns: list[str], reach: float = 5.0) -> dict[str, tuple[float, float, float, float]]:
    """Median, interquartile range, and median -/+ ``reach`` ranges of each column, NULLs left out."""
    out = {}
    for c, (low, mid, high) in quantiles(df, columns, [0.25, 0.5, 0.75]).items():
        out[c] = (None,) * 4 if mid is None else (mid, high - low, mid - reach * (high - low), mid + reach * (high - low))
    return out


def clamp(c: str, low: float | None, high: float | None) -> Column:
    """A value held inside bounds; NULL stays NULL."""
    if low is None:
        return F.col(c)
    x = F.col(c)
    return F.when(x > high, F.lit(high)).when(x < low, F.lit(low)).otherwise(x)


def box_cox(x: Column, lam: float) -> Column:
    """Power transform of a positive value."""
    return F.log(x) if lam == 0 else (F.pow(x, F.lit(float(lam))) - 1) / F.lit(float(lam))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of count, mean and squares about the mean of two sets of values together."""
    n = a[:, 0] + b[:, 0]
    step, share = b[:, 1] - a[:, 1], b[:, 0] / np.maximum(n, 1)
    return np.column_stack([n, np.where(a[:, 0] == 0, b[:, 1], np.where(b[:, 0] == 0, a[:, 1], a[:, 1] + step * share)), a[:, 2] + b[:, 2] + np.where(share * a[:, 0] > 0, step * step * a[:, 0] * share, 0.0)])


def log_likelihoods(df: DataFrame, columns: dict[str, Column], lambdas: dict[str, list[float]]) -> dict[str, list[float | None]]:
    """Profile log-likelihood of the power transform for every column and each of its lambdas, in one pass: a task hands
    on counts, means and squares alone. (As one aggregate, the expressions are too many for compiled code.)"""
    spark = df.sparkSession
    ship_package(spark)
    names = list(columns)
    given = [(k, float(v)) for k, c in enumerate(names) for v in lambdas[c]]

    def part(batches):
        # by column: values, sum of logarithms, least, most; by column and lambda: see _joined
        own, spread = np.tile([0.0, 0.0, np.inf, -np.inf], (len(names), 1)), np.zeros((len(given), 3))
        with np.errstate(all="ignore"):
            for b in batches:
                values = [b.column(k).drop_null().to_numpy(zero_copy_only=False) for k in range(len(names))]
                logs = [np.log(x[x > 0]) for x in values]
                for k, x in enumerate(values):
                    if len(x):
                        own[k] = own[k, 0] + len(x), own[k, 1] + logs[k].sum(), min(own[k, 2], x.min()), max(own[k, 3], x.max())
                new = np.zeros_like(spread)
                for i, (k, v) in enumerate(given):
                    y = logs[k] if v == 0 else (np.power(values[k], v) - 1) / v
                    if len(y):
                        mean = y.mean()
                        new[i] = len(y), mean, ((y - mean) ** 2).sum()
                spread = _joined(spread, new)
        yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary()), pa.array([spread.tobytes()], pa.binary())], names=["own", "spread"])

    own, spread = np.tile([0.0, 0.0, np.inf, -np.inf], (len(names), 1)), np.zeros((len(given), 3))
    with np.errstate(all="ignore"):
        for r in df.select(*(x.cast("double").alias(c) for c, x in columns.items())).mapInArrow(part, "own binary, spread binary").collect():
            more = np.frombuffer(bytes(r["own"])).reshape(-1, 4)
            own = np.column_stack([own[:, :2] + more[:, :2], np.minimum(own[:, 2], more[:, 2]), np.maximum(own[:, 3], more[:, 3])])
            spread = _joined(spread, np.frombuffer(bytes(r["spread"])).reshape(-1, 3))
    out: dict[str, list[float | None]] = {c: [] for c in columns}
    for (k, v), (m, _, squares) in zip(given, spread.tolist(), strict=True):
        n, s, least, most = own[k].tolist()
        var = squares / m if m else 0.0
        out[names[k]].append(None if not n or not least < most or not 0 < var < math.inf else -n / 2 * math.log(var) + (v - 1) * s)
    return out


def fit_lambdas(df: DataFrame, columns: dict[str, Column], low: float = -5.0, high: float = 5.0, grid: int = 11, rounds: int = 4) -> dict[str, float]:
    """Maximum-likelihood lambda of each column: each round is one aggregate over a grid around the best so far.

    A constant or empty column gets 1, which only shifts it.
    """
    span = {c: (low, high) for c in columns}
    best = dict.fromkeys(columns, 1.0)
    for _ in range(rounds):
        lambdas = {c: [round(a + (b - a) * i / (grid - 1), 9) for i in range(grid)] for c, (a, b) in span.items()}
        for c, values in log_likelihoods(df, columns, lambdas).items():
            usable = [(v, -abs(x), x) for v, x in zip(values, lambdas[c], strict=True) if v is not None]
            if usable:
                best[c] = max(usable)[2]
                step = (span[c][1] - span[c][0]) / (grid - 1)
                span[c] = (best[c] - step, best[c] + step)
    return best


def _least(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    got = df.agg(*(F.min(c).alias(c) for c in columns)).first()
    return {c: got[c] for c in columns}


def moments(df: DataFrame, columns: dict[str, Column]) -> dict[str, tuple[float | None, float | None]]:
    """Mean and sample standard deviation of each expression, in one aggregate."""
    got = df.agg(*(x for c, e in columns.items() for x in (F.avg(e).alias(f"m_{c}"), F.stddev_samp(e).alias(f"s_{c}")))).first()
    return {c: (got[f"m_{c}"], got[f"s_{c}"]) for c in columns}


def fit(df: DataFrame, features: list[str], algos: list[str], *, bound: bool = True, normalise: bool = True) -> list[dict]:
    """Parameters of the preparation, one record a column (see SCHEMA); features are clamped, then shifted above 0,
    power-transformed and standardised; performances share one shift."""
    stats = bounds(df, features)
    rows = {c: {"name": c, "role": "feature", "med": stats[c][0], "iqr": stats[c][1], "lo": stats[c][2], "hi": stats[c][3]} for c in features}
    rows |= {c: {"name": c, "role": "algo", "med": None, "iqr": None, "lo": None, "hi": None} for c in algos}
    held = df.withColumns({c: clamp(c, stats[c][2], stats[c][3]) for c in features}) if bound and features else df
    least = _least(held, [*features, *algos])
    least_y = min((least[c] for c in algos if least[c] is not None), default=None)
    shifted = {}
    for c in features:
        rows[c]["shift"] = None if least[c] is None else 1.0 - least[c]
    for c in algos:
        rows[c]["shift"] = None if least_y is None else MACHINE_EPSILON - least_y
    for c, r in rows.items():
        shifted[c] = F.col(c) + F.lit(r["shift"])
    if normalise:
        lambdas = fit_lambdas(held, shifted)
        scaled = {c: box_cox(x, lambdas[c]) for c, x in shifted.items()}
        for c, (mu, sigma) in moments(held, scaled).items():
            rows[c] |= {"lambda": lambdas[c], "mu": mu, "sigma": sigma}
    else:
        for r in rows.values():
            r |= {"lambda": None, "mu": None, "sigma": None}
    if not bound:
        for c in features:
            rows[c] |= {"lo": None, "hi": None}
    return list(rows.values())


def standardise(x: Column, mu: float | None, sigma: float | None) -> Column:
    """Standard score; a column without spread is only centred."""
    return (x - F.lit(mu)) / F.lit(sigma if sigma else 1.0)


def apply(df: DataFrame, parameters: list[dict]) -> DataFrame:
    """Columns of a table prepared with stored parameters, matched by name; missing columns are skipped."""
    out = {}
    for r in parameters:
        c = r["name"]
        if c not in df.columns:
            continue
        x = clamp(c, r["lo"], r["hi"]) if r["role"] == "feature" else F.col(c)
        if r["lambda"] is not None and r["shift"] is not None:
            moved = x + F.lit(r["shift"])
            # values under the training minimum stay at the smallest the transform takes
            x = standardise(box_cox(F.when(moved <= 0, F.lit(2.220446049250313e-16)).otherwise(moved), r["lambda"]), r["mu"], r["sigma"])
        out[c] = x
    return df.withColumns(out) if out else df


def as_table(spark: SparkSession, parameters: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r.get(f.split()[0]) for f in SCHEMA.split(", ")) for r in parameters], SCHEMA)


def global_least(df: DataFrame, columns: list[str]) -> Column:
    """Expression for the least value of several columns over the table, inside an aggregate."""
    return reduce(F.least, (F.min(c) for c in columns)) if len(columns) > 1 else F.min(columns[0])
