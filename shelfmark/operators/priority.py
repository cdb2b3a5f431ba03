"""Values from many sources: which one is shown, by declared priorities.

Unless a function says otherwise: sources that aren't listed come last, a null value is a value and a null key a
key like any other, of equal ranks the least by the order given wins, an empty table gives an empty result. Names with an
underscore in front are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def source_rank(source: Column, order: list[str]) -> Column:
    """Place in a priority list; sources that aren't listed come last."""
    out = F.lit(len(order))
    for k in range(len(order) - 1, -1, -1):
        out = F.when(source == order[k], k).otherwise(out)
    return out


def pick(values: DataFrame, keys: list[str], rank: Column, at: str = "at", source: str = "source", value: str = "value") -> DataFrame:
    """One value a key: least rank, then newest, then source, then value; a value of unknown time comes after dated ones.

    An aggregate of the least ordering struct, combined before the shuffle: no window, no sort of a key's rows.
    """
    best = F.min(F.struct(rank.alias("_r"), F.col(at).isNull().alias("_u"), (-F.col(at)).alias("_a"), F.col(source).alias("source"), F.col(value).alias("value"), F.col(at).alias("at")))
    return values.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.source").alias(source), F.col("_b.value").alias(value), F.col("_b.at").alias(at))


def pick_all(values: DataFrame, keys: list[str], rank: Column, at: str = "at", source: str = "source", value: str = "value") -> DataFrame:
    """All distinct values of the winning source of each key, never mixed across sources."""
    won = pick(values, keys, rank, at, source, value).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(source).alias("_source"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col(source).eqNullSafe(F.col("_source"))]
    return values.join(won, on).select(*keys, source, value).distinct()


def merged(values: DataFrame, subject: str, field: str, fields: list[str], rank: Column, **names) -> DataFrame:
    """One row a subject with the shown value of each field."""
    return pick(values, [subject, field], rank, **names).groupBy(subject).pivot(field, fields).agg(F.first(names.get("value", "value")))


def shifts(values: DataFrame, keys: list[str], before: Column, after: Column, **names) -> DataFrame:
    """Keys whose shown value differs between two priority tables, with both values.

    Both winners come from one aggregation, so nothing is joined.
    """
    at, source, value = (names.get(k, k) for k in ("at", "source", "value"))
    least = lambda rank: F.min(F.struct(rank.alias("r"), F.col(at).isNull().alias("u"), (-F.col(at)).alias("a"), F.col(source).alias("s"), F.col(value).alias("v")))
    both = values.groupBy(*keys).agg(least(before).alias("_old"), least(after).alias("_new"))
    return both.where(~F.col("_old.v").eqNullSafe(F.col("_new.v"))).select(*keys, F.col("_old.v").alias("old_value"), F.col("_new.v").alias("new_value"))


def least_by(df: DataFrame, keys: list[str], order: list[Column], outputs: list[str]) -> DataFrame:
    """The row of each key with the least ordering tuple (shown titles, main members, covers); nulls come last."""
    parts = [x for k, c in enumerate(order) for x in (c.isNull().alias(f"_n{k}"), c.alias(f"_o{k}"))]
    best = F.min(F.struct(*parts, *[F.col(o) for o in outputs]))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, *[F.col(f"_b.{o}").alias(o) for o in outputs])


def others_in_order(df: DataFrame, keys: list[str], order: list[Column], value: str, separator: str = "|") -> DataFrame:
    """Names besides the shown one, each once, in the order of preference (least first, nulls last).

    Rows are combined to one a name before the shuffle, so only a key's distinct names meet.
    """
    parts = [x for k, c in enumerate(order) for x in (c.isNull().alias(f"_n{k}"), c.alias(f"_o{k}"))]
    first = df.groupBy(*keys, value).agg(F.min(F.struct(*parts)).alias("_first"))
    lists = first.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_first", F.col(value).alias("_name")))).alias("_l")).where(F.size("_l") > 1)
    return lists.select(*keys, F.array_join(F.transform(F.slice("_l", F.lit(2), F.size("_l") - 1), lambda x: x["_name"]), separator).alias("others"))


def unchanged_inputs(wanted: DataFrame, done: DataFrame, keys: list[str], fingerprint: str) -> DataFrame:
    """Work still to do: wanted (keys, fingerprint) rows that aren't in the ledger as they are."""
    return wanted.join(done.select(*keys, fingerprint), [*keys, fingerprint], "left_anti")
