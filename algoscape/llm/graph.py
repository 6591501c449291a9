"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

EDGES_PER_FILE = 200_000


def _neighbour_minimum(edges: DataFrame) -> DataFrame:
    """u, m: the smallest of u and its neighbours; partial aggregation absorbs hot nodes."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def large_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest node around it. edges: u, v without loops; least: written minima."""
    return _both_ways(edges).join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _down(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def small_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them; least: written minima."""
    linked = _down(edges).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, component (its smallest node) of every node in ``edges`` (u, v); each step is a written table.

    Nulls and loops are ignored. Ends when a step changes no edge; the number of steps grows with the logarithm of
    the longest path.
    """
    at = scratch.save(edges.where("u <> v").select("u", "v").distinct(), f"{name}-0")
    # equal sets of distinct edges have equal counts and hash sums
    mark = [F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    had, step = at.agg(*mark).first(), 0
    while True:
        step += 1
        # steps never add edges by more than a node each; few edges are written to few files
        files = 1 + 2 * had[0] // EDGES_PER_FILE
        # minima are written first: a join of written tables can split a node with very many neighbours
        around = scratch.save(_neighbour_minimum(_both_ways(at)), f"{name}-{step}-around", files=files)
        big = scratch.save(large_star(at, around), f"{name}-{step}-large", files=files)
        below = scratch.save(_neighbour_minimum(_down(big)), f"{name}-{step}-below", files=files)
        new = scratch.save(small_star(big, below), f"{name}-{step}", files=files)
        for old in ("around", "large", "below"):
            scratch.drop(f"{name}-{step}-{old}")
        has = new.agg(*mark).first()
        scratch.drop(f"{name}-{step - 1}")
        at = new
        if has == had:
            break
        had = has
    roots = at.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return at.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
