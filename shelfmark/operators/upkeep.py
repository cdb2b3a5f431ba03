"""Upkeep and reporting over catalogue tables: roots, what is missing, what is shared, what a change would take.

Unless a function says otherwise: a null key belongs to nothing and joins nothing, repeated rows count as often as they come,
an empty table gives an empty result, other columns are left out. Names with an underscore in front are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import root_of
from .order import running


def under(key: Column, prefix: str) -> Column:
    """Whether a key is the prefix itself or lies below it (``ab`` isn't below ``a``)."""
    return (key == prefix) | F.startswith(key, F.lit(prefix.rstrip("/") + "/"))


def root_stats(entries: DataFrame, key: str, size: str) -> DataFrame:
    """(root, files, bytes, unreadable); an unknown size counts as unreadable, not as zero bytes."""
    return entries.groupBy(root_of(F.col(key)).alias("root")).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"), F.count(F.when(F.col(size).isNull(), 1)).alias("unreadable"))


def without_subtree(entries: DataFrame, key: str, prefix: str) -> DataFrame:
    return entries.where(~under(F.col(key), prefix))


def keep_subtree(entries: DataFrame, key: str, prefix: str, scan: int, seen: str = "seen") -> DataFrame:
    """Marks a whole subtree as seen in a scan."""
    return entries.withColumn(seen, F.when(under(F.col(key), prefix), F.lit(scan)).otherwise(F.col(seen)))


def only_under(rows: DataFrame, group: str, key: str, prefix: str) -> DataFrame:
    """Groups wholly inside a prefix: those that go with it."""
    outside = F.sum((~under(F.col(key), prefix)).cast("int"))
    return rows.groupBy(group).agg(F.count("*").alias("n"), outside.alias("_out")).where("_out = 0").drop("_out")


def losing(selected: DataFrame, owner: str, key: str, prefix: str) -> DataFrame:
    """(owner, lost, left) for owners that lose rows with a prefix."""
    gone = F.sum(under(F.col(key), prefix).cast("int"))
    return selected.groupBy(owner).agg(gone.alias("lost"), (F.count("*") - gone).alias("left")).where("lost > 0")


def top_level(entries: DataFrame, key: str, root: str, limit: int) -> DataFrame:
    """First names under a root, in order."""
    name = F.split(F.col(key), "/")[1]
    return entries.where(under(F.col(key), root)).select(name.alias("name")).where("name is not null").distinct().orderBy("name").limit(limit)


def contents(members: DataFrame, key: str, ordinal: str, name: str, separator: str = "|") -> DataFrame:
    """Members of each container in order (a container's own rows at most)."""
    lists = members.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(ordinal, name))).alias("_m"))
    return lists.select(key, F.size("_m").alias("n"), F.array_join(F.transform("_m", lambda x: x[name].cast("string")), separator).alias("members"))


def not_run(subjects: DataFrame, conclusions: DataFrame, key: str) -> DataFrame:
    """Subjects without a conclusion row: not yet run, which is no state of its own."""
    return subjects.join(conclusions.select(key), key, "left_anti")


def valued(values: DataFrame, field: str, source: str, subject: list[str]) -> DataFrame:
    """(field, source, n, subjects): rows and distinct subjects of each."""
    one = values.groupBy(field, source, *subject).agg(F.count("*").alias("_n"))  # subjects become distinct with a plain sum above
    return one.groupBy(field, source).agg(F.sum("_n").alias("n"), F.count("*").alias("subjects"))


def present_fields(values: DataFrame, subject: str, field: str, separator: str = ",") -> DataFrame:
    return values.groupBy(subject).agg(F.array_join(F.array_sort(F.collect_set(field)), separator).alias("fields"))


def shared(values: DataFrame, hash_: str, subject: str) -> DataFrame:
    """(hash, subjects) of hashes that more than one subject has."""
    return values.select(hash_, subject).distinct().groupBy(hash_).agg(F.count("*").alias("subjects")).where("subjects > 1")


def all_from(rows: DataFrame, subject: str, source: Column, sources: list[str]) -> DataFrame:
    """Subjects all of whose rows come from given sources."""
    other = F.sum((~F.coalesce(source.isin(sources), F.lit(False))).cast("int"))
    return rows.groupBy(subject).agg(F.count("*").alias("n"), other.alias("_o")).where("_o = 0").drop("_o")


def all_of(rows: DataFrame, group: str, holds: Column) -> DataFrame:
    """Groups every row of which satisfies a condition."""
    return rows.groupBy(group).agg(F.min(F.coalesce(holds, F.lit(False)).cast("int")).alias("_m"), F.count("*").alias("n")).where("_m = 1").drop("_m")


def covered(subjects: DataFrame, values: DataFrame, key: str, by: str) -> DataFrame:
    """(by, n, with_value): how many subjects of each kind have any value."""
    has = values.select(key).distinct().withColumn("_has", F.lit(1))
    return subjects.join(has, key, "left").groupBy(by).agg(F.count("*").alias("n"), F.count("_has").alias("with_value"))


def within_budget(batches: DataFrame, order: list[Column], cost: str, cap: int) -> DataFrame:
    """Batches in order while their running cost (spent) stays within a cap."""
    return running(batches, [], order, cost, "spent").where(F.col("spent") <= cap)


def renamed(members: DataFrame, name: str, item: str, old: str, new: str) -> DataFrame:
    """Members of ``old`` move to ``new``; those already there aren't doubled."""
    return members.withColumn(name, F.when(F.col(name) == old, F.lit(new)).otherwise(F.col(name))).dropDuplicates([name, item])


def changed_members(conclusions: DataFrame, members: DataFrame, changed: DataFrame, subject: str, key: str) -> DataFrame:
    """Conclusions that still stand: none of the subject's members changed."""
    stale = members.join(changed.select(key), key, "left_semi").select(subject).distinct()
    return conclusions.join(stale, subject, "left_anti")


def stages(named: list[tuple[str, DataFrame]]) -> DataFrame:
    """(stage, left): what remains to be done, one small count a stage."""
    out = None
    for place, (name, todo) in enumerate(named):
        one = todo.agg(F.count("*").alias("left")).select(F.lit(place).alias("place"), F.lit(name).alias("stage"), "left")
        out = one if out is None else out.union(one)
    return out


def different_values(values: DataFrame, subject: str, field: str, value: str, a, b) -> DataFrame:
    """(field, a, b): fields whose values differ between two subjects that are to be merged."""
    both = values.where(F.col(subject).isin(a, b)).groupBy(field).agg(F.max(F.when(F.col(subject) == a, F.col(value))).alias("a"), F.max(F.when(F.col(subject) == b, F.col(value))).alias("b"))
    return both.where(~F.col("a").eqNullSafe(F.col("b")))


def key_counts(entries: DataFrame, keys: DataFrame, entry: str, key: str, by: str) -> DataFrame:
    """(by, keys): distinct keys (serials) of each kind of entry; entries without a key, and keys without an entry, don't count.

    A null kind is a kind like any other.
    """
    return keys.where(F.col(key).isNotNull()).select(entry, key).distinct().join(entries.select(entry, by), entry).groupBy(by).agg(F.countDistinct(key).alias("keys"))


def without_members(groups: DataFrame, members: DataFrame, group: str) -> DataFrame:
    """Groups that no member names, null ones among them: what a clean-up deletes."""
    return groups.join(members.select(group), group, "left_anti")


def forgotten(values: DataFrame, told: DataFrame, keys: list[str]) -> DataFrame:
    """Values without those of the told (keys); a null in a key is matched by a null."""
    t = told.select(*[F.col(k).alias(f"_t{j}") for j, k in enumerate(keys)]).distinct()
    return values.join(t, [F.col(k).eqNullSafe(F.col(f"_t{j}")) for j, k in enumerate(keys)], "left_anti")


def shown_year(values: DataFrame, subject: str, first_source: str, year: str = "value", source: str = "source") -> DataFrame:
    """(subject, year): the earliest year that ``first_source`` says, else the earliest of all; only four digits are a year."""
    one = F.when(F.col(year).rlike("^[0-9]{4}$"), F.col(year))
    told = F.min(F.when(F.col(source) == first_source, one))
    return values.groupBy(subject).agg(F.coalesce(told, F.min(one)).alias("year"))


def left_after(members: DataFrame, moving: DataFrame, group: str, member: str, counted: DataFrame) -> DataFrame:
    """(group, n): members left in each of the ``counted`` groups once the moving ones are gone, 0 where none is."""
    left = members.select(group, member).distinct().join(moving.select(member).distinct(), member, "left_anti").groupBy(group).agg(F.count("*").alias("n"))
    return counted.select(group).distinct().join(left, group, "left").select(group, F.coalesce("n", F.lit(0)).alias("n"))


def settled(units: DataFrame, item: str, prints: str, reason: str) -> DataFrame:
    """(item, settled): whether every unit of an item has a print or a stated reason for having none."""
    return units.groupBy(item).agg(F.bool_and(F.col(prints).isNotNull() | F.col(reason).isNotNull()).alias("settled"))


def breakdown(pending: DataFrame, decided: DataFrame, axis: str) -> DataFrame:
    """(axis, pending, decided): open and decided cases of each part, parts of either kind; a null part is one."""
    both = pending.select(axis, F.lit(1).alias("p"), F.lit(0).alias("d")).union(decided.select(axis, F.lit(0), F.lit(1)))
    return both.groupBy(axis).agg(F.sum("p").alias("pending"), F.sum("d").alias("decided"))
