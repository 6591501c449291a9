"""Goodness labels, best performance, ties and the portfolio, as row-wise expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Smallest step of a double at 1; stands in for zero where a ratio to the best is taken.
MACHINE_EPSILON = 2.220446049250313e-16


def best_value(algos: list[str], maximise: bool) -> Column:
    """Best performance of the row; NULLs are skipped."""
    cols = [F.col(a) for a in algos]
    return cols[0] if len(cols) == 1 else (F.greatest(*cols) if maximise else F.least(*cols))


def best_index(algos: list[str], maximise: bool) -> Column:
    """1-based place of the first best algorithm; NULL without any performance."""
    best = best_value(algos, maximise)
    return F.when(best.isNotNull(), F.array_position(F.array(*algos), best).cast("int"))


def relative_gap(algo: str, algos: list[str], maximise: bool) -> Column:
    """How far a performance is from the row's best, relative to the best; zeros count as machine epsilon.

    Meant for positive performances; the sign turns for negative ones.
    """
    zero = lambda x: F.when(x == 0, F.lit(MACHINE_EPSILON)).otherwise(x)
    y, best = zero(F.col(algo)), zero(best_value(algos, maximise))
    return 1 - y / best if maximise else y / best - 1


def good(algo: str, algos: list[str], *, maximise: bool, absolute: bool, epsilon: float) -> Column:
    """Whether an algorithm does well on the row; a missing performance never does."""
    if absolute:
        fits = F.col(algo) >= epsilon if maximise else F.col(algo) <= epsilon
    else:
        fits = relative_gap(algo, algos, maximise) <= epsilon
    return F.coalesce(fits, F.lit(False))


def ties(algos: list[str], maximise: bool) -> Column:
    """Number of algorithms that reach the best performance."""
    best = best_value(algos, maximise)
    return F.size(F.filter(F.array(*algos), lambda x: x == best))


def tie_break(algos: list[str], maximise: bool, seed: int, row: str = "instances") -> Column:
    """Place of one of the tied best algorithms, drawn by a hash of the row's label and a seed."""
    best = best_value(algos, maximise)
    places = F.filter(F.sequence(F.lit(1), F.lit(len(algos))), lambda i: F.element_at(F.array(*algos), i) == best)
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(row))), 1, 8), 16, 10).cast("long")
    return F.when(best.isNotNull(), F.element_at(places, (1 + draw % F.size(places)).cast("int")))


def count_good(flags: list[str]) -> Column:
    return reduce(lambda a, b: a + b, (F.col(c).cast("int") for c in flags))


def label(df: DataFrame, algos: list[str], *, maximise: bool = False, absolute: bool = True, epsilon: float = 0.2, beta_threshold: float = 0.55, seed: int | None = None) -> DataFrame:
    """df with best_perf, best_algo (place), best_name, n_best, good_<algo>, num_good and beta_easy.

    With a seed, ties are broken by its hash; without one the first algorithm wins.
    """
    flags = [f"good_{_short(a)}" for a in algos]
    place = best_index(algos, maximise) if seed is None else tie_break(algos, maximise, seed)
    out = df.withColumns({"best_perf": best_value(algos, maximise), "best_algo": place, "n_best": ties(algos, maximise)})
    out = out.withColumn("best_name", F.element_at(F.array(*(F.lit(_short(a)) for a in algos)), F.col("best_algo")))
    out = out.withColumns({f: good(a, algos, maximise=maximise, absolute=absolute, epsilon=epsilon) for f, a in zip(flags, algos, strict=True)})
    out = out.withColumn("num_good", count_good(flags))
    return out.withColumn("beta_easy", F.col("num_good") > beta_threshold * len(algos))


def _short(algo: str) -> str:
    return algo[5:] if algo.startswith("algo_") else algo


def drop_never_good(df: DataFrame, algos: list[str]) -> list[str]:
    """Algorithms that are good on some row, from one aggregate over the good_ columns."""
    got = df.agg(*(F.bool_or(f"good_{_short(a)}").alias(a) for a in algos)).first()
    kept = [a for a in algos if got[a]]
    if not kept:
        raise ValueError("no algorithm is good on any instance")
    return kept


def portfolio(df: DataFrame) -> DataFrame:
    """Rows by best algorithm; 0 stands for none."""
    return df.groupBy(F.coalesce("best_algo", F.lit(0)).alias("best_algo")).agg(F.count("*").alias("n"))


def unique_good(df: DataFrame, algos: list[str]) -> DataFrame:
    """algo, share of rows where it is good and no other is."""
    one = df.agg(*(F.avg((F.col(f"good_{_short(a)}") & (F.col("num_good") <= 1)).cast("double")).alias(a) for a in algos))
    return one.select(F.inline(F.array(*(F.struct(F.lit(_short(a)).alias("algo"), F.col(a).alias("share")) for a in algos))))


def cost_weights(df: DataFrame, algos: list[str]) -> DataFrame:
    """w_<algo>: distance of a performance from the mean of all performances; zeros become the smallest
    other weight, missing performances the largest."""
    total = reduce(lambda a, b: a + b, (F.coalesce(F.sum(a), F.lit(0.0)) for a in algos))
    count = reduce(lambda a, b: a + b, (F.count(a) for a in algos))
    mean = df.agg(F.try_divide(total, count)).first()[0]
    if mean is None:
        return df.withColumns({f"w_{_short(a)}": F.lit(None).cast("double") for a in algos})
    far = {a: F.abs(F.col(a) - mean) for a in algos}
    low, high = df.agg(_extreme(F.least, [F.min(F.when(w > 0, w)) for w in far.values()]), _extreme(F.greatest, [F.max(w) for w in far.values()])).first()
    return df.withColumns({f"w_{_short(a)}": F.when(w.isNull(), F.lit(high)).when(w == 0, F.lit(low)).otherwise(w) for a, w in far.items()})


def _extreme(which, cols: list[Column]) -> Column:
    return cols[0] if len(cols) == 1 else which(*cols)
