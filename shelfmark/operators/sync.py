"""Differences between what is wanted, what was written and what is there.

Unless a function says otherwise: paths are unique on each side, a null path matches nothing, null values are equal
to each other but an unknown time is never the same, and an empty side is a side without files. Names with an underscore in front are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import base_name, utf16_units


def row_diff(old: DataFrame, new: DataFrame, key: str, values: list[str], readable: str | None = None) -> DataFrame:
    """(key, state): added, removed, changed, unchanged, or unreadable where the new row can't be read."""
    o = old.select(key, F.struct(*values).alias("_old"), F.lit(True).alias("_was"))
    n = new.select(key, F.struct(*values).alias("_new"), F.lit(True).alias("_is"), (F.col(readable) if readable else F.lit(True)).alias("_ok"))
    same = F.col("_old").eqNullSafe(F.col("_new"))
    state = F.when(F.col("_is").isNull(), "removed").when(~F.col("_ok"), "unreadable").when(F.col("_was").isNull(), "added").when(same, "unchanged").otherwise("changed")
    return o.join(n, key, "full").select(key, state.alias("state"))


def unmodified(size_a: Column, size_b: Column, time_a: Column, time_b: Column) -> Column:
    """Same size, and both times known and equal: an unknown time is never the same."""
    return F.coalesce((size_a == size_b) & (time_a == time_b), F.lit(False))


def three_way(desired: DataFrame, manifest: DataFrame, actual: DataFrame, key: str = "path") -> DataFrame:
    """(path, action) by a full join of three sides; the manifest bounds what may be touched.

    add, update, keep; delete what was written and is wanted no more; ``changed`` where a written file
    was modified since, ``gone`` where it vanished, ``foreign`` where a wanted place holds a file that
    was never written; files neither wanted nor written are left alone (no row).
    """
    d = desired.select(key, F.col("version").alias("_dv"), F.lit(True).alias("_d"))
    m = manifest.select(key, F.col("version").alias("_mv"), F.col("size").alias("_ms"), F.col("mtime").alias("_mt"), F.lit(True).alias("_m"))
    a = actual.select(key, F.col("size").alias("_as"), F.col("mtime").alias("_at"), F.lit(True).alias("_a"))
    same = unmodified(F.col("_ms"), F.col("_as"), F.col("_mt"), F.col("_at"))
    action = (
        F.when(F.col("_d") & F.col("_m").isNull(), F.when(F.col("_a"), "foreign").otherwise("add"))
        .when(F.col("_d") & F.col("_a").isNull(), "gone")
        .when(F.col("_d"), F.when(~same, "changed").when(F.col("_dv") == F.col("_mv"), "keep").otherwise("update"))
        .when(F.col("_m") & F.col("_a").isNull(), "forget")
        .when(F.col("_m"), F.when(same, "delete").otherwise("changed"))
    )
    return d.join(m, key, "full").join(a, key, "full").select(key, action.alias("action")).where("action is not null")


def strangers(manifest: DataFrame, actual: DataFrame, key: str = "path", size: str = "size") -> DataFrame:
    """(files, bytes) that are there but were never written."""
    return actual.join(manifest.select(key), key, "left_anti").agg(F.count("*").alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def trim_suggestions(items: DataFrame, key: str, size: str, n: int) -> DataFrame:
    """The n largest items with a running total of what dropping them frees (a window over n rows only)."""
    largest = items.select(key, size).orderBy(F.desc(size), F.asc(key)).limit(n)
    by = Window.orderBy(F.desc(size), F.asc(key))
    return largest.withColumn("place", F.row_number().over(by)).withColumn("freed", F.sum(size).over(by.rowsBetween(Window.unboundedPreceding, 0)))


def over_capacity(items: DataFrame, size: str, capacity: int) -> DataFrame:
    """(bytes, over): total, and what exceeds a capacity, if anything does."""
    return items.agg(F.sum(size).alias("bytes")).withColumn("over", F.when(F.col("bytes") > capacity, F.col("bytes") - capacity))


RESERVED = ["CON", "PRN", "AUX", "NUL", *[f"COM{k}" for k in range(1, 10)], *[f"LPT{k}" for k in range(1, 10)]]


def screen(path: Column, size: Column, most_bytes: int, most_units: int = 255, forbidden: str = r'[<>:"\\|?*\x00-\x1f]') -> Column:
    """Why a file can't stand on a target file system, null if it can."""
    name = base_name(path)
    return (
        F.when(size > most_bytes, "too big")
        .when(name.rlike(forbidden), "forbidden character")
        .when(F.upper(F.regexp_replace(name, r"\..*$", "")).isin(RESERVED), "reserved name")
        .when(name.rlike(r"[ .]$"), "trailing dot or blank")
        .when(utf16_units(name) > most_units, "name too long")
    )


def playlists(members: DataFrame, item: str, name: str, order: Column) -> DataFrame:
    """One playlist (lines in order) for each item of two or more members."""
    found = members.groupBy(item).agg(F.sort_array(F.collect_list(F.struct(order.alias("k"), F.col(name).alias("name")))).alias("_m")).where(F.size("_m") > 1)
    return found.select(item, F.array_join(F.transform("_m", lambda x: x["name"]), "\n").alias("lines"))
