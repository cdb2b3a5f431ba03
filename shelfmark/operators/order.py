"""Order without one task: places, running sums and neighbours in groups of any size.

Rows are dealt by ranges of (group, order) and sorted within; so a group of half of all rows lies in
many tasks. A small table, with a row for each group and task that holds some of it, says how many
rows and how much of a measure came before. The rest is equi joins on (task, group) and on places,
which spread evenly whatever the sizes of groups.

The order should tell all rows apart (end it with an id): rows equal in all of it can't be parted
by ranges, and which of them comes first is left open. Null groups are a group like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

BLOCK_SEATS = 512


def _dealt(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The rows with _part (their task), _group and _at (their number within the task), in order; written, so that ranges stay as they are."""
    group = F.struct(*[F.col(c) for c in by]) if by else F.lit(0)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*[F.asc_nulls_first(c) for c in by], *order]
    sorted_ = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    number = F.monotonically_increasing_id()  # the task in the upper bits, the place within it in the lower 33
    told = sorted_.withColumn("_number", number)
    told = told.select(*rows.columns, group.alias("_group"), F.shiftright("_number", 33).cast("int").alias("_part"), F.col("_number").bitwiseAND((1 << 33) - 1).alias("_at"))
    return written(told, "ordered")


def _before(dealt: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """(_part, _group, _first, before of each measure): what lies in earlier tasks; a row for each task and group in it."""
    parts = dealt.groupBy("_part", "_group").agg(F.min("_at").alias("_first"), *[v.alias(k) for k, v in measures.items()])
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("_part", "_group", "_first", *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"_{k}") for k in measures])


def _with(dealt: DataFrame, before: DataFrame) -> DataFrame:
    b = before.select(F.col("_part").alias("_p"), F.col("_group").alias("_g"), *[c for c in before.columns if c not in ("_part", "_group")])
    return dealt.join(b, (F.col("_part") == F.col("_p")) & F.col("_group").eqNullSafe(F.col("_g")))


def numbered(rows: DataFrame, by: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """The rows with their place in their group, from 0."""
    dealt = _dealt(rows, by, order)
    out = _with(dealt, _before(dealt, {"n": F.count("*")}))
    return out.select(*rows.columns, (F.col("_n") + F.col("_at") - F.col("_first")).alias(name))


def running(rows: DataFrame, by: list[str], order: list[Column], measure: str, name: str = "sum", place: str | None = None) -> DataFrame:
    """The rows with the sum of a measure over those of their group up to them, themselves included; nulls add nothing.

    ``place`` names a column for the place in the group, from 1. Sums of floats depend on how rows
    are dealt in their last digits; give a decimal or integer where that matters.
    """
    dealt = _dealt(rows, by, order)
    out = _with(dealt, _before(dealt, {"n": F.count("*"), "m": F.sum(measure)}))
    within = Window.partitionBy("_part", "_group").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    total = F.col("_m") + F.coalesce(F.sum(measure).over(within), F.lit(0))
    kind = rows.select(F.sum(measure)).schema[0].dataType
    places = [(F.col("_n") + F.col("_at") - F.col("_first") + 1).alias(place)] if place else []
    return out.select(*rows.columns, total.cast(kind).alias(name), *places)


def around(rows: DataFrame, folder: str, name: str, k: int, of: DataFrame | None = None) -> DataFrame:
    """(folder, name, neighbour, seat): up to ``k`` names beside each name of a folder in its order, not itself.

    They begin half of k seats before it; a name near the beginning has more after it, one near the end
    has fewer. ``of`` (folder, name) limits the names that are asked for. A folder's seats are dealt in
    blocks, with those just beyond their borders, so a folder of any size spreads over all tasks and a name moves
    once or twice, not once a neighbour. Repeated rows of one name
    have one seat; null names have none, and names without a folder have no neighbours.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so that tasks are not made one for being small when compressed
    one = rows.select(F.col(folder).alias("folder"), F.col(name).alias("name")).where("folder is not null and name is not null").repartition(n, "folder", "name").distinct()
    seated = written(numbered(one, ["folder"], [F.asc("name")], "at"), "seats")
    size = max(BLOCK_SEATS, k)
    blocks = F.array_distinct(F.array(*[F.floor((F.col("at") + x) / size) for x in (-k, 0, k)]))
    dealt = seated.select("*", F.explode(blocks).alias("block")).where("block >= 0").repartition(n, "folder", "block")
    seats = dealt.groupBy("folder", "block").agg(F.sort_array(F.collect_list(F.struct("at", "name"))).alias("seats"))  # a block's and k on either side
    first = lambda at: F.greatest(at - k // 2, F.lit(0))
    last = lambda at: first(at) + k - F.when(at >= first(at) + k, 1).otherwise(0)  # noqa: E731  k others: one seat more if its own lies among them
    near = lambda x: F.slice("seats", (first(x["at"]) - F.col("seats")[0]["at"] + 1).cast("int"), F.lit(k + 1))
    own = F.filter("seats", lambda x: F.floor(x["at"] / size) == F.col("block"))
    asked = seats.select("folder", F.explode(F.transform(own, lambda x: F.struct(x["name"].alias("name"), x["at"].alias("at"), near(x).alias("near")))).alias("x")).select("folder", "x.*")
    if of is not None:
        asked = asked.join(of.select(F.col(folder).alias("folder"), F.col(name).alias("name")).distinct(), ["folder", "name"], "left_semi")
    beside = F.filter("near", lambda y: (y["at"] <= last(F.col("at"))) & (y["at"] != F.col("at")))
    return asked.select("folder", "name", F.explode(beside).alias("x")).select(F.col("folder").alias(folder), F.col("name").alias(name), F.col("x.name").alias("neighbour"), F.col("x.at").alias("seat"))
