"""Health of a library: counts by many dimensions at once, duplicates, collisions, shares.

Unless a function says otherwise: nulls of a dimension are a group, null measures add nothing, repeated rows count as
often as they come, an empty table gives an empty result (totals of nothing are one row), and ties are open
where an order doesn't tell rows apart. Names with an underscore in front are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import running


def grouped(df: DataFrame, sets: list[list[str]], aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates over several grouping sets in one pass; absent dimensions are null, ``level`` tells sets apart."""
    dims = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *dims).agg(F.grouping_id(*dims).alias("level"), *[v.alias(k) for k, v in aggregates.items()])


def duplicates(files: DataFrame, size: str, name: Column, sample: int = 3) -> DataFrame:
    """(size, name, n, reclaimable): files of one size and lower-case name; size must be positive."""
    keyed = files.where(F.col(size) > 0).select(F.col(size).cast("long").alias("size"), F.lower(name).alias("name"))
    return keyed.groupBy("size", "name").agg(F.count("*").alias("n")).where("n > 1").withColumn("reclaimable", (F.col("n") - 1) * F.col("size"))


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First n rows of each group; Spark cuts groups short before the shuffle as well (window group limit)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def with_share(counted: DataFrame, measure: str, share: str = "share") -> DataFrame:
    """Adds each row's share of the total; for rows that were counted already, so few."""
    total = counted.agg(F.sum(measure).alias("_total"))
    return counted.crossJoin(F.broadcast(total)).withColumn(share, F.round(F.col(measure) / F.col("_total"), 6)).drop("_total")  # one row


def running_share(counted: DataFrame, measure: str, order: list[Column]) -> DataFrame:
    """Cumulative share of groups in order (place, covered, share): how much the first of them cover."""
    total = counted.agg(F.sum(measure).alias("_total"))
    out = running(counted, [], order, measure, "covered", "place").crossJoin(F.broadcast(total))  # one row
    return out.withColumn("place", F.col("place").cast("int")).withColumn("share", F.round(F.col("covered") / F.col("_total"), 6)).drop("_total")


def collisions(paths: DataFrame, path: str, folded: Column, size: str) -> DataFrame:
    """Paths that differ but fold to one: (folded, n, bytes: that of the largest)."""
    return paths.groupBy(folded.alias("folded")).agg(F.countDistinct(path).alias("n"), F.max(size).alias("bytes")).where("n > 1")


def candidate_multiplicity(df: DataFrame, subject: str) -> DataFrame:
    """(n, subjects): how many subjects have how many rows, of those with more than one."""
    return df.groupBy(subject).agg(F.count("*").alias("n")).where("n > 1").groupBy("n").agg(F.count("*").alias("subjects"))


def rates(df: DataFrame, keys: list[str], state: str) -> DataFrame:
    """Matched over all, and over those with any evidence."""
    n = lambda s: F.count(F.when(F.col(state) == s, 1))
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), n("matched").alias("matched"), (n("matched") + n("unmatched")).alias("tried"))
    ratio = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)), 6)
    return out.withColumn("rate_of_all", ratio("matched", "n")).withColumn("rate_of_tried", ratio("matched", "tried"))


def exclusive_groups(df: DataFrame, group: Column, item: str) -> DataFrame:
    """Groups that hold exactly one distinct item."""
    one = df.select(group.alias("group"), F.col(item).alias("item"))
    return one.groupBy("group").agg(F.min("item").alias("item"), F.max("item").alias("_other")).where("item = _other").drop("_other")
