"""Queues of open cases: batches of like evidence, coverage, drilling, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import common_prefix
from .order import numbered

GOLDEN = 0.6180339887499  # fixed value of the stride's rule


def batches(items: DataFrame, shape: list[str], evidence: str) -> DataFrame:
    """(shape, n, common): items of one shape and the common prefix of their evidence.

    The least and the greatest text share what all share, so two aggregates do.
    """
    grouped = items.groupBy(*shape).agg(F.count("*").alias("n"), F.min(evidence).alias("_a"), F.max(evidence).alias("_b"))
    return grouped.withColumn("common", common_prefix(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def drill(items: DataFrame, shape: list[str], axis: str) -> DataFrame:
    return items.groupBy(*shape, axis).agg(F.count("*").alias("n"))


def tally(items: DataFrame, keys: Column) -> DataFrame:
    """Counts by key where an item may have several."""
    return items.select(F.explode(F.array_distinct(keys)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def spread_sample(items: DataFrame, key: list[str], order: list[Column], want: int, seed: int = 0) -> DataFrame:
    """``want`` items of each group, spread over its order by a stride near the golden section; the next seed gives others.

    The stride has no divisor in common with the group's size, so no item comes twice. Sizes are
    counted by an aggregate, and places wanted join the numbered rows, which a group of any size deals to many tasks; a group of ``want`` items or
    fewer is taken whole. A null key is a group like any other.
    """
    n = F.col("_n")
    divisor = lambda a: F.aggregate(F.sequence(F.lit(1), F.lit(90)), F.struct(a.alias("a"), n.alias("b")), lambda x, _: F.when(x["b"] == 0, x).otherwise(F.struct(x["b"].alias("a"), (x["a"] % F.nullif(x["b"], F.lit(0))).alias("b"))))["a"]
    near = F.greatest(F.floor(n * GOLDEN), F.lit(1)).cast("long")
    free = F.filter(F.sequence(near, near + 200), lambda x: (x < n) & (divisor(x) == 1))
    stride = F.when(n <= 2, 1).otherwise(F.coalesce(F.get(free, F.lit(0)), F.lit(1)))
    sizes = items.groupBy(*key).agg(F.count("*").alias("_n"))
    place = F.explode(F.transform(F.sequence(F.lit(0), F.least(F.lit(want), n) - 1), lambda i: (seed + i * stride) % n))
    wanted = sizes.select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(key)], place.alias("_at"))
    placed = numbered(items, key, order, "_i")
    on = [F.col(k).eqNullSafe(F.col(f"_k{j}")) for j, k in enumerate(key)] + [F.col("_i") == F.col("_at")]
    return placed.join(wanted, on, "left_semi").drop("_i")


def pending(items: DataFrame, decided: DataFrame, key: str) -> DataFrame:
    return items.join(decided.select(key).distinct(), key, "left_anti")
