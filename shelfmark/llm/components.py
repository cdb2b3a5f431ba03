"""Connected components by alternating large-star and small-star steps on a DataFrame of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, written


def _with_least(rows: DataFrame, most: int) -> DataFrame:
    """(a, b, m): m is the least b of each a.

    An a of over ``most`` rows gets its m from a broadcast table, so its rows stay where they are;
    ``most`` is a share of all rows, so there are few such a.
    """
    low = rows.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    hot = low.where(F.col("n") > most).select(F.col("a").alias("hot"), F.col("m").alias("hot_m"))
    marked = rows.join(F.broadcast(hot), F.col("a") == F.col("hot"), "left")
    rest = marked.where("hot is null").select("a", "b").join(low.where(F.col("n") <= most).select("a", "m"), "a")
    return rest.select("a", "b", "m").union(marked.where("hot is not null").select("a", "b", F.col("hot_m").alias("m")))


LEAST_HOT = 1000


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link; the component is its smallest node.

    ``links`` has columns u and v (long). Each step is two aggregations and two joins, written to
    the shared folder, so a lost executor costs one step at most. The number of steps grows with
    the logarithm of the longest chain. Only a row count and a checksum reach the driver. A node
    with more than a share of the links is not brought into one task: there are at most eight times
    as many of these as shuffle partitions, whatever the size of the data.
    Self links and repeated links are allowed; links with a null end are ignored.
    """

    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    parts = shuffle_partitions(links.sparkSession)
    e = written(links.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), "links")
    before = state(e)
    while before[0]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        most = max(LEAST_HOT, before[0] // (4 * parts))
        large = _with_least(both, most).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        small = _with_least(large, most).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b")
        e = written(small.distinct(), "links")
        after = state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def forest(u, v):
    """Inside a task: (node, smallest node reachable) for the links u[i]-v[i], without the roots themselves."""
    import numpy as np

    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (jump := new[new] != new).any():
            new[jump] = new[new[jump]]
        if (new == root).all():
            break
        root = new
    some = root != np.arange(len(nodes))
    return nodes[some], nodes[root[some]]
