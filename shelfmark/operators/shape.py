"""From files to items: stems, disc families, volumes, trees, stray companions.

Unless a function says otherwise: a null key has no directory, stem or mark and joins nothing, repeated keys count as often
as they come, an empty table gives an empty result, members of an item come in one row, as many as it has files.
Names with an underscore in front are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ancestors, base_name, dir_of, disc_family, extension, has_disc_mark, natural_key, stem

VOLUME = r"(?i)^(.*?)\.(?:part0*([0-9]+)\.rar|r([0-9]{2})|z([0-9]{2})|(?:7z|zip|rar)\.([0-9]{3}))$"


def same_stem(files: DataFrame, key: str, size: str) -> DataFrame:
    """(dir, stem, files, bytes, exts): files of one directory and stem are one item."""
    one = files.select(dir_of(F.col(key)).alias("dir"), stem(F.col(key)).alias("stem"), extension(F.col(key)).alias("ext"), F.col(size).alias("size"))
    return one.groupBy("dir", "stem").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.array_join(F.array_sort(F.collect_set("ext")), ",").alias("exts"))


def volumes(files: DataFrame, key: str) -> DataFrame:
    """(dir, base, n, complete): split archives and whether no volume number is missing."""
    name = base_name(F.col(key))
    number = F.coalesce(*[F.nullif(F.regexp_extract(name, VOLUME, g), F.lit("")).try_cast("int") for g in (2, 3, 4, 5)])
    one = files.select(dir_of(F.col(key)).alias("dir"), F.regexp_extract(name, VOLUME, 1).alias("base"), number.alias("number")).where("number is not null")
    grouped = one.groupBy("dir", "base").agg(F.countDistinct("number").alias("n"), F.min("number").alias("_a"), F.max("number").alias("_b"))
    return grouped.withColumn("complete", F.col("_b") - F.col("_a") + 1 == F.col("n")).drop("_a", "_b")


def disc_families(items: DataFrame, group: list[str], name: str) -> DataFrame:
    """(group, family, n, members): two or more items that differ in a disc mark only, at least one marked."""
    one = items.select(*group, disc_family(F.col(name)).alias("family"), F.col(name).alias("name"))
    found = one.groupBy(*group, "family").agg(F.count("*").alias("n"), F.max(has_disc_mark(F.col("name"))).alias("_marked"), F.sort_array(F.collect_list(F.struct(natural_key(F.col("name")).alias("k"), "name"))).alias("_m"))
    return found.where("n >= 2 and _marked").withColumn("members", F.array_join(F.transform("_m", lambda x: x["name"]), "|")).drop("_m", "_marked")


def tree_roots(files: DataFrame, key: str, anchors: Column) -> DataFrame:
    """(key, root): the topmost ancestor directory that holds an anchor file, for files under one."""
    roots = files.where(anchors).select(dir_of(F.col(key)).alias("root")).distinct()
    above = files.select(F.col(key).alias("_key"), ancestors(F.col(key)).alias("_above")).select(F.col("_key").alias("key"), F.posexplode("_above").alias("depth", "root"))
    return above.join(roots, "root").groupBy("key").agg(F.min(F.struct("depth", "root")).alias("_r")).select("key", F.col("_r.root").alias("root"))


def assigned(files: DataFrame, key: str, layers: list[tuple[str, Column]]) -> DataFrame:
    """Rule cascade: the first layer with a group for a file takes it; a file without any is its own."""
    chosen = F.coalesce(*[F.when(g.isNotNull(), F.struct(F.lit(rule).alias("rule"), g.alias("item"))) for rule, g in layers], F.struct(F.lit("single").alias("rule"), F.col(key).alias("item")))
    return files.withColumn("_c", chosen).select("*", "_c.rule", "_c.item").drop("_c")


def stranded(companions: DataFrame, mains: DataFrame, key: str) -> DataFrame:
    """Companions with no main file of their directory and stem; ``elsewhere`` is the least directory that has one."""
    c = companions.select(F.col(key).alias("key"), dir_of(F.col(key)).alias("dir"), stem(F.col(key)).alias("stem"))
    m = mains.select(dir_of(F.col(key)).alias("dir"), stem(F.col(key)).alias("stem")).distinct()
    lost = c.join(m, ["dir", "stem"], "left_anti")
    return lost.join(m.groupBy("stem").agg(F.min("dir").alias("elsewhere")), "stem", "left").select("key", "elsewhere")


def crowded(files: DataFrame, key: str, roots: DataFrame, least: int = 2) -> DataFrame:
    """Tree roots with several distinct stems directly inside."""
    one = files.select(dir_of(F.col(key)).alias("root"), stem(F.col(key)).alias("stem"))
    return one.join(roots.select("root").distinct(), "root").groupBy("root").agg(F.countDistinct("stem").alias("stems")).where(F.col("stems") >= least)
