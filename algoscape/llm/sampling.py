"""Bounded samples of rows, the same at every partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def least_hashes(hashes: DataFrame, n: int, total: int) -> DataFrame:
    """The n least values of the column h, which holds no value twice; a cut by the row count keeps the sort small."""
    share = min(1.0, 1.5 * n / max(total, 1) + 1e-6)
    few = hashes if share >= 1 else hashes.where(F.pmod("h", F.lit(1 << 30)) <= int(share * (1 << 30)))
    return few.orderBy(F.pmod("h", F.lit(1 << 30)), "h").limit(n)


def bounded_hashes(hashes: DataFrame, n: int) -> DataFrame:
    """At most n rows of a table with distinct values of h, which is written first: those with the least."""
    hashes = Scratch(hashes.sparkSession, "sample").save(hashes, "hashes")
    total = hashes.count()
    return least_hashes(hashes, n, total) if total > n else hashes


def bounded_rows(rows: DataFrame, by: list[str], n: int, seed: int) -> DataFrame:
    """At most n of the rows that differ in the columns ``by``, those with the least hashes; rows equal in them count once.

    The hashes of all rows are written, so a row is left out only where more than n remain, whatever repeats.
    """
    marked = rows.withColumn("h", F.xxhash64(F.lit(seed), *by))
    return marked.join(F.broadcast(bounded_hashes(marked.select("h").distinct(), n)), "h", "left_semi").dropDuplicates(["h"]).drop("h")
