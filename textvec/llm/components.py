"""Connected components of an edge list, by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def _state(edges: DataFrame) -> tuple:
    """Number of edges and an order-free digest of them."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _least(edges: DataFrame) -> DataFrame:
    """The least neighbour of each u: combined before the shuffle, stored so that the join after it can split a hub."""
    return stored(edges.groupBy("u").agg(F.min("v").alias("m")))


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both)
    out = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    return stored(out.filter("u <> v").distinct())


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    # from each edge (u, v): v to the least neighbour of u; and u itself to it
    joined = down.join(least, "u")
    out = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return stored(out.filter("u <> v").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (two long columns of any names); component: the smallest id reachable.

    Rounds are O(log^2) of the longest path; each is written to the shared folder, so a lost
    executor repeats one round at most.  Nulls and loops are dropped.
    """
    a, b = edges.columns
    edges = edges.select(F.greatest(F.col(a), F.col(b)).alias("u"), F.least(F.col(a), F.col(b)).alias("v")).filter("u <> v").distinct()
    edges = stored(edges)
    seen = _state(edges)
    while seen[0]:
        new = small_star(large_star(edges))
        now = _state(new)
        dropped(edges)
        edges = new
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def links_forest(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of a bipartite link matrix, as (rows, columns): labels spread until they stand."""
    n, m = links.shape
    row, column = np.arange(n), np.full(m, n)
    i, j = np.nonzero(links)
    used = []
    while True:
        # each column takes the least label among its rows, then each row among its columns
        best = np.full(m, n)
        np.minimum.at(best, j, row[i])
        better = np.flatnonzero(best < column)
        if len(better):
            pick = np.zeros(m, dtype=bool)
            pick[better] = True
            e = np.flatnonzero(pick[j] & (row[i] == best[j]))
            used.append(e[np.unique(j[e], return_index=True)[1]])
            column[better] = best[better]
        best = np.full(n, n)
        np.minimum.at(best, i, column[j])
        worse = np.flatnonzero(best < row)
        if len(worse):
            pick = np.zeros(n, dtype=bool)
            pick[worse] = True
            e = np.flatnonzero(pick[i] & (column[j] == best[i]))
            used.append(e[np.unique(i[e], return_index=True)[1]])
            row[worse] = best[worse]
        if not len(better) and not len(worse):
            e = np.unique(np.concatenate(used)) if used else np.empty(0, np.int64)
            return i[e], j[e]
