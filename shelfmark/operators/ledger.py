"""Append-only logs and what follows from them: latest rows, undo, sweeps, replaced parts.

Tables are Parquet, which has no update in place: an upsert is an append, and a view keeps the
latest row of each key. ``compact`` writes that view out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Latest row of each key, by an aggregate that combines before the shuffle."""
    rest = [c for c in log.columns if c not in keys]
    best = F.max(F.struct(*[F.col(o).alias(f"_o{k}") for k, o in enumerate(order)], *[F.col(c) for c in rest]))
    return log.groupBy(*keys).agg(best.alias("_b")).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def undone(log: DataFrame, undo: DataFrame, batch: str = "batch") -> DataFrame:
    """The log without the batches that were taken back: the latest rows before them count again."""
    return log.join(undo.select(batch).distinct(), batch, "left_anti")


def live(rows: DataFrame, lifted: str) -> DataFrame:
    """Rows that were not softly deleted."""
    return rows.where(F.col(lifted).isNull())


def covering_batch(log: DataFrame, batch: str, key: str, of: Column) -> DataFrame:
    """(key, batch): the first later batch that touched each key of some rows."""
    some = log.where(of).select(F.col(key).alias("_k"), F.col(batch).alias("_b")).distinct()
    later = some.join(log.select(F.col(key).alias("_k"), F.col(batch).alias("_l")), "_k").where("_l > _b")
    return later.groupBy("_k").agg(F.min("_l").alias("batch")).withColumnRenamed("_k", key)


def orphans_dropped(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    return rows.join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_semi")


def orphans(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    return rows.join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def swept(entries: DataFrame, scan: int, root: str, complete: bool, key: str = "key", seen: str = "seen") -> DataFrame:
    """After a complete pass over a root, its entries not seen in that pass go; other roots stay."""
    return entries.where(~F.startswith(F.col(key), F.lit(root + "/")) | (F.col(seen) == scan)) if complete else entries


def next_scan(entries: DataFrame, seen: str = "seen") -> DataFrame:
    return entries.agg((F.coalesce(F.max(seen), F.lit(0)) + 1).alias("scan"))


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key the new rows don't bring, with the new rows."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def added_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys).distinct(), keys, "left_anti"))


def import_counts(existing: DataFrame, incoming: DataFrame, key: str, valid: Column) -> DataFrame:
    """(added, replaced, bad) of rows to import."""
    ok = incoming.where(valid).select(key).distinct().join(existing.select(key).distinct().withColumn("_had", F.lit(True)), key, "left")
    counts = ok.agg(F.count(F.when(F.col("_had").isNull(), 1)).alias("added"), F.count("_had").alias("replaced"))
    bad = incoming.where(~F.coalesce(valid, F.lit(False))).agg(F.count("*").alias("bad"))
    return counts.crossJoin(F.broadcast(bad))  # one row each


def union_keys(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def compact(log: DataFrame, keys: list[str], order: list[str], path: str, partition: str | None = None) -> None:
    """Write the latest rows out; with a partition column only the partitions they are in are replaced."""
    writer = latest(log, keys, order).write.mode("overwrite")
    (writer.partitionBy(partition).option("partitionOverwriteMode", "dynamic") if partition else writer).parquet(path)
