"""Items that are shown as one entry, in order of preference.

Null group values are a group like any other, null keys count as members, ties in preference are in the order of key,
repeated rows are members as often as they come, an empty table gives an empty result. ``entries`` gives an
entry in one row, for lists; ``members`` gives a row for each member, for groups of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import numbered


def entries(items: DataFrame, group: list[Column], preference: Column, key: str, separator: str = "|") -> DataFrame:
    """(g0.., first, n, members): members ordered by preference, then key."""
    names = [f"g{k}" for k in range(len(group))]
    grouped = items.select(*[g.alias(n) for g, n in zip(group, names, strict=True)], F.struct(preference.alias("p"), F.col(key).alias("key")).alias("m")).groupBy(*names).agg(F.sort_array(F.collect_list("m")).alias("_m"))
    keys = F.transform("_m", lambda x: x["key"].cast("string"))
    return grouped.select(*names, keys[0].alias("first"), F.size("_m").alias("n"), F.array_join(keys, separator).alias("members"))


def members(items: DataFrame, group: list[Column], preference: Column, key: str) -> DataFrame:
    """(g0.., place, key, n): a row for each member of an entry, place 0 for the one that is shown; no group is gathered."""
    names = [f"g{k}" for k in range(len(group))]
    rows = items.select(*[g.alias(n) for g, n in zip(group, names, strict=True)], preference.alias("_rank"), F.col(key).alias("key"))
    placed = numbered(rows, names, [F.asc("_rank"), F.asc("key")], "place")
    sizes = rows.groupBy(*names).agg(F.count("*").alias("n")).select(*[F.col(n).alias(f"_{n}") for n in names], "n")
    return placed.join(sizes, [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names]).select(*names, "place", "key", "n")


def preference(by: list[Column]) -> Column:
    """Rank of the first condition that holds."""
    out = F.lit(len(by))
    for k in range(len(by) - 1, -1, -1):
        out = F.when(by[k], k).otherwise(out)
    return out
