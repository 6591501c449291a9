"""Exact order statistics of many columns at any size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which one exact percentile aggregate is used; it holds a column's distinct values in memory.
SMALL = 200_000
_BINS = 4096
_FETCH = 2_000


def _ranks(n: int, p: float) -> tuple[int, int, float]:
    """0-based ranks and the share of the upper one for the quantile with plotting positions (i - 0.5) / n."""
    at = min(max(n * p - 0.5, 0.0), n - 1.0)
    low = math.floor(at)
    return low, min(low + 1, n - 1), at - low


def quantiles(df: DataFrame, columns: list[str], probabilities: list[float], small: int = SMALL) -> dict[str, list[float | None]]:
    """Quantiles of each column, NULLs left out, with sorted value i of n placed at (i - 0.5) / n."""
    first = df.agg(*(x for c in columns for x in (F.count(c).alias(f"n_{c}"), F.min(c).alias(f"a_{c}"), F.max(c).alias(f"b_{c}")))).first()
    n = {c: first[f"n_{c}"] for c in columns}
    some = [c for c in columns if n[c]]
    out: dict[str, list[float | None]] = {c: [None] * len(probabilities) for c in columns}
    if not some:
        return out
    if max(n.values()) <= small:
        # the builtin places value i at (i - 1) / (n - 1)
        asked = {c: [0.0 if n[c] == 1 else min(max((n[c] * p - 0.5) / (n[c] - 1), 0.0), 1.0) for p in probabilities] for c in some}
        got = df.agg(*(F.percentile(c, F.array(*map(F.lit, asked[c]))).alias(c) for c in some)).first()
        return out | {c: [float(x) for x in got[c]] for c in some}
    want = {c: {r for p in probabilities for r in _ranks(n[c], p)[:2]} for c in some}
    values = order_statistics(df, want, {c: (float(first[f"a_{c}"]), float(first[f"b_{c}"])) for c in some})
    for c in some:
        for k, p in enumerate(probabilities):
            low, high, part = _ranks(n[c], p)
            out[c][k] = values[c][low] * (1 - part) + values[c][high] * part if part else values[c][low]
    return out


def order_statistics(df: DataFrame, ranks: dict[str, set[int]], span: dict[str, tuple[float, float]]) -> dict[str, dict[int, float]]:
    """Sorted values at the given 0-based ranks, by counting rows in ever narrower ranges.

    Each pass counts one range per open rank in ``_BINS`` bins for all columns at once; a range with few rows, or
    of one value, is settled. No pass sorts or holds a column.
    """
    found: dict[str, dict[int, float]] = {c: {} for c in ranks}
    # column, low, high -> ranks in it, each relative to the rows at or above low
    open_: dict[tuple[str, float, float], list[tuple[int, int]]] = {(c, *span[c]): [(r, r) for r in sorted(rs)] for c, rs in ranks.items()}
    while open_:
        todo = list(open_)
        parts = []
        for i, (c, low, high) in enumerate(todo):
            x = F.col(c).cast("double")
            width = (high - low) / _BINS
            bin_ = F.least(F.floor((x - low) / width), F.lit(_BINS - 1)).cast("int") if width > 0 else F.lit(0)
            parts.append(F.when((x >= low) & (x <= high), F.struct(F.lit(i).alias("i"), bin_.alias("bin"), x.alias("x"))))
        rows = df.select(F.explode(F.array_compact(F.array(*parts))).alias("r")).select("r.*")
        counts = rows.groupBy("i", "bin").agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).collect()
        by: dict[int, list] = {}
        for r in sorted(counts, key=lambda r: r["bin"]):
            by.setdefault(r["i"], []).append(r)
        nxt: dict[tuple[str, float, float], list[tuple[int, int]]] = {}
        fetch: dict[tuple[str, float, float], list[tuple[int, int]]] = {}
        for i, key in enumerate(todo):
            before = 0
            for r in by.get(i, []):
                inside = [(rank, at - before) for rank, at in open_[key] if before <= at < before + r["n"]]
                if inside:
                    if r["a"] == r["b"]:
                        found[key[0]].update({rank: r["a"] for rank, _ in inside})
                    else:
                        (fetch if r["n"] <= _FETCH else nxt).setdefault((key[0], r["a"], r["b"]), []).extend(inside)
                before += r["n"]
        if fetch:
            keys = list(fetch)
            lists = df.agg(*(F.sort_array(F.collect_list(F.when((F.col(c) >= a) & (F.col(c) <= b), F.col(c).cast("double")))).alias(f"f{i}") for i, (c, a, b) in enumerate(keys))).first()
            for i, key in enumerate(keys):
                found[key[0]].update({rank: lists[f"f{i}"][at] for rank, at in fetch[key]})
        open_ = nxt
    return found
