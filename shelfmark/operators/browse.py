"""Browsing: facets, grouped pages, ranked search.

A page is one plan: groups by key, then sort and limit, which Spark runs as a top-k without a full
sort. Keys carry a total order, so pages never overlap.

Unless a function says otherwise: a null key is a group like any other, repeated rows count as often as they come,
an empty table gives an empty result. Names with an underscore in front are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower


def facet(df: DataFrame, name: str, value: Column) -> DataFrame:
    """(facet, value, n) of the values that are there."""
    return df.select(value.alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n")).select(F.lit(name).alias("facet"), F.col("value").cast("string").alias("value"), "n")


def facets(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Several facets from one scan: a row's values are exploded, then counted (combined before the shuffle)."""
    pairs = F.array(*[F.struct(F.lit(k).alias("facet"), v.cast("string").alias("value")) for k, v in columns.items()])
    return df.select(F.inline(pairs)).where("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))


def list_facet(df: DataFrame, name: str, lists: Column, separator: str = ",") -> DataFrame:
    """Facet of a separated list: each distinct trimmed part of a row counts once."""
    parts = F.array_distinct(F.transform(F.split(lists, separator), lambda x: F.trim(x)))
    return facet(df.select(F.explode(parts).alias("part")).where("part <> ''"), name, F.col("part"))


def ranked(facet_rows: DataFrame, limit: int | None = None) -> DataFrame:
    out = facet_rows.orderBy(F.desc("n"), F.asc("value"))
    return out.limit(limit) if limit else out


def residual(df: DataFrame, known: DataFrame, key: str, label: str = "unidentified") -> DataFrame:
    """Count of the rows without a match: total less matched, no anti join needed when keys are unique."""
    both = df.select(F.col(key)).join(known.select(F.col(key)).distinct().withColumn("_known", F.lit(True)), key, "left")
    return both.agg(F.count(F.when(F.col("_known").isNull(), 1)).alias("n")).select(F.lit(label).alias("value"), "n")


def loose_key(group: Column, own: Column) -> Column:
    """Group by ``group`` where there is one, else each row by itself (nulls don't become one group)."""
    return F.coalesce(F.concat(F.lit("g:"), group.cast("string")), F.concat(F.lit("k:"), own.cast("string")))


def grouped_page(df: DataFrame, key: list[str], aggregates: dict[str, Column], order: list[Column], offset: int, limit: int) -> DataFrame:
    grouped = df.groupBy(*key).agg(*[v.alias(k) for k, v in aggregates.items()])
    return grouped.orderBy(*order).offset(offset).limit(limit)


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def group_total(df: DataFrame, key: list[str]) -> DataFrame:
    return df.select(*key).distinct().agg(F.count("*").alias("n"))


#: Rank of a search hit: name starts with the needle, name holds it, an alias likewise, a description holds it.
NAME_PREFIX, NAME, ALIAS_PREFIX, ALIAS, DESCRIPTION = range(5)


def _hit(text: Column, needle: str, prefix: int | None, inside: int) -> Column:
    folded, needle = ascii_lower(text), F.lit("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in needle))
    out = F.when(F.startswith(folded, needle), prefix) if prefix is not None else None
    return (out.when(F.contains(folded, needle), inside) if out is not None else F.when(F.contains(folded, needle), inside)).cast("int")


def search(names: DataFrame, needle: str, aliases: DataFrame | None = None, descriptions: DataFrame | None = None) -> DataFrame:
    """(key, rank): best hit of each key. Inputs have (key, text); only hits are shuffled."""
    hits = names.select("key", _hit(F.col("text"), needle, NAME_PREFIX, NAME).alias("rank"))
    if aliases is not None:
        hits = hits.union(aliases.select("key", _hit(F.col("text"), needle, ALIAS_PREFIX, ALIAS).alias("rank")))
    if descriptions is not None:
        hits = hits.union(descriptions.select("key", _hit(F.col("text"), needle, None, DESCRIPTION).alias("rank")))
    return hits.where("rank is not null").groupBy("key").agg(F.min("rank").alias("rank"))


def details(subjects: DataFrame, key: str, parts: dict[str, tuple[DataFrame, list[str]]], most: int = 100) -> DataFrame:
    """The subjects with, for each part, its rows as a list of structs (name) and how many there are (n_name).

    ``parts`` maps a name to (rows, order): rows with the key, their columns of order first. A page's
    subjects are few, so each part is cut to their rows before anything is grouped; a list holds the
    first ``most`` rows (Spark cuts groups short before the shuffle), its count all of them. A
    subject without rows has an empty list; subjects are kept as often as they come, null keys have no rows.
    """
    out, wanted = subjects, subjects.select(F.col(key).alias("_key")).where("_key is not null").distinct()
    for name, (rows, order) in parts.items():
        others = [c for c in rows.columns if c != key and c not in order]
        own = rows.select(F.col(key).alias("_key"), F.struct(*order, *others).alias("_row")).join(wanted, "_key", "left_semi")
        first = own.withColumn("_at", F.row_number().over(Window.partitionBy("_key").orderBy("_row"))).where(F.col("_at") <= most)
        lists = first.groupBy("_key").agg(F.sort_array(F.collect_list("_row")).alias(name))
        counts = own.groupBy("_key").agg(F.count("*").alias(f"n_{name}"))
        both = lists.join(counts, "_key").withColumnRenamed("_key", f"_{name}")
        empty = F.array().cast(both.schema[name].dataType)
        out = out.join(both, out[key] == F.col(f"_{name}"), "left").drop(f"_{name}")
        out = out.withColumns({name: F.coalesce(name, empty), f"n_{name}": F.coalesce(f"n_{name}", F.lit(0))})
    return out
