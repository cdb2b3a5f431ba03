"""What a device should hold: what it takes as it is, what is converted or can't be had, how paths are spelled, what items are.

Unless a function says otherwise: a null key matches nothing, a null group is a group like any
other, repeated rows count as often as they come, an empty table gives an empty result, and other
columns are left out of the result. Names with an underscore in front are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

CONTAINERS = ["zip", "7z", "rar"]

MIB_A_SECOND = {"unpack": 80.0, "rezip": 25.0}  # fixed values: what a conversion gets through


def decided(files: DataFrame, matrix: DataFrame, fallback: tuple[list[str] | None, str | None] | None = None, zip_bytes: int = 2**32 - 1, zip_entries: int = 65535) -> DataFrame:
    """Files with (decision, reason, target): unclaimed, as is, convert or unsupported on a device.

    ``files`` (platform, path, entries, inner_bytes, largest, inner_name, and any others): the last
    four tell what a container holds, null where nobody could look. ``matrix`` (platform, accepts,
    recipe): extensions that a platform takes (null: anything), and ``rezip``, ``unpack`` or null for
    the rest; platforms compare with case folded, of several rows of one the least counts.
    ``fallback`` speaks for platforms that aren't listed and for a null one. A container is unpacked
    only if it holds one file that the device takes, and packed anew only within the bounds of a zip.
    """
    entry = matrix.where("platform is not null").groupBy(T.fold(F.col("platform")).alias("_f")).agg(F.min(F.struct("accepts", "recipe")).alias("_e"))
    both = files.withColumn("_f", T.fold(F.col("platform"))).join(entry, "_f", "left")
    if fallback is not None:
        takes = F.lit(None) if fallback[0] is None else F.array(*[F.lit(x) for x in fallback[0]])
        other = F.struct(takes.cast("array<string>").alias("accepts"), F.lit(fallback[1]).cast("string").alias("recipe"))
        both = both.withColumn("_e", F.coalesce("_e", other))
    accepts, recipe, n = F.col("_e.accepts"), F.col("_e.recipe"), F.col("entries")
    ext, inner = T.extension(F.col("path")), T.base_name(F.col("inner_name"))
    taken = lambda x: F.coalesce(F.array_contains(accepts, x), F.lit(False))
    opened = (
        F.when(recipe.isNull(), "no recipe")
        .when(n.isNull() & ext.isin(CONTAINERS), "contents unknown")
        .when(n.isNull(), "not a container")
        .when(ext == "rar", "can't be unpacked")
        .when(n == 0, "nothing inside")
    )
    rezip = F.when((F.col("inner_bytes") >= zip_bytes) | (F.col("largest") >= zip_bytes), "too big").when(n > zip_entries, "too many entries")
    unpack = F.when(n > 1, "several entries").when(F.coalesce(inner, F.lit("")) == "", "no name").when(~taken(T.extension(inner)), "inside not wanted")
    why = F.coalesce(opened, F.when(recipe == "rezip", rezip).when(recipe == "unpack", unpack))
    told = F.when(F.col("_e").isNull() | accepts.isNull(), "unclaimed").when(taken(ext), "as is").when(why.isNotNull(), "unsupported").otherwise("convert")
    rest = T.rest_of(F.col("path"))
    target = F.when(recipe == "rezip", F.concat(F.regexp_replace(rest, r"(?<=[^/])\.[^./]*$", ""), F.lit(".zip"))).when(recipe == "unpack", F.concat(F.regexp_extract(rest, "^(.*/)?", 0), inner))
    out = both.withColumn("decision", told)
    return out.select(*files.columns, "decision", F.when(F.col("decision") == "unsupported", why).alias("reason"), F.when(F.col("decision") == "convert", target).otherwise(F.when(F.col("decision") != "unsupported", rest)).alias("target"))


def seconds(recipe: Column, bytes_: Column) -> Column:
    """A rough time for a conversion of so many unpacked bytes; null for an unknown recipe."""
    rate = F.lit(None).cast("double")
    for name, mib in MIB_A_SECOND.items():
        rate = F.when(recipe == name, mib).otherwise(rate)
    return bytes_ / (rate * 2**20)


def gathered(selected: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Member files of the selected items, each as often as it is a member; an item that is selected twice counts once."""
    return members.join(selected.select(key), key, "left_semi")


def aligned(paths: DataFrame, dirs: DataFrame, path: str = "path") -> DataFrame:
    """Paths with (aligned): directories spelled as on a target that ignores case, else as in the first path that names them.

    ``dirs`` (path): the directories there, each a whole spelling of its path; of two that differ in
    case only, the greatest speaks, and it replaces all parts up to its own. Parts below the last
    recorded one are spelled as in the first path, in the order of paths, that has them. Every
    distinct directory is spelled once. A null path stays null; repeated rows are kept.
    """
    own = paths.select(F.col(path).alias("_p"), T.dir_of(F.col(path)).alias("_d")).where("_d <> ''").groupBy("_d").agg(F.min("_p").alias("_p"))
    each = own.select("_d", "_p", F.posexplode(F.split("_d", "/")).alias("_k", "_s"))
    each = each.withColumn("_f", T.fold(F.array_join(F.slice(F.split("_d", "/"), F.lit(1), F.col("_k") + 1), "/")))
    there = dirs.where(F.col("path").isNotNull()).groupBy(T.fold(F.col("path")).alias("_f")).agg(F.max("path").alias("_t"))
    first = each.groupBy("_f").agg(F.min(F.struct("_p", "_s")).alias("_m")).join(there, "_f", "left").select("_f", "_t", F.col("_m._s").alias("_c"))
    parts = F.array_sort(F.collect_list(F.struct("_k", "_t", "_c")))  # as many as a path has parts
    below = lambda up, x: F.coalesce(x["_t"], F.concat(up, F.when(up == "", "").otherwise("/"), x["_c"]))
    spelled = each.join(first, "_f").groupBy("_d").agg(F.aggregate(parts, F.lit(""), below).alias("_a"))
    both = paths.withColumn("_d", T.dir_of(F.col(path))).join(spelled, "_d", "left")
    return both.select(*paths.columns, F.coalesce(F.concat("_a", F.lit("/"), T.base_name(F.col(path))), path).alias("aligned"))


def standalone(items: DataFrame, kinds: DataFrame, by_name: Column, key: str = "key") -> DataFrame:
    """(key, standalone): patch or extra if all containers of an item say so, runs if they differ or one can't say.

    ``kinds`` (key, kind): patch, extra, whole, or null where a container can't say. Items none of
    whose containers can say are patches where ``by_name`` holds, else they run.
    """
    all_are = lambda kind: F.bool_and(F.coalesce(F.col("kind") == kind, F.lit(False)))
    g = kinds.groupBy(key).agg(F.count("kind").alias("_n"), all_are("patch").alias("_p"), all_are("extra").alias("_x"))
    told = F.when(F.col("_n") > 0, F.when(F.col("_p"), "patch").when(F.col("_x"), "extra").otherwise("runs"))
    return items.withColumn("_b", by_name).join(g, key, "left").select(key, F.coalesce(told, F.when(F.col("_b"), "patch").otherwise("runs")).alias("standalone"))


def serial_candidates(evidence: DataFrame, hits: DataFrame) -> DataFrame:
    """(item, source, game, ordinal, accepted, confidence): what an item's serials point at, the most trusted evidence of each game.

    ``evidence`` (item, ordinal, serial, platforms, sure), least ordinal first; a list of platforms
    that isn't empty bounds the hits. ``hits`` (serial, platform, source, game, shown): accepted are
    hits whose shown serial is the very same and whose evidence is sure. Rows meet on the serial.
    """
    both = evidence.join(hits, "serial").where((F.coalesce(F.size("platforms"), F.lit(0)) <= 0) | F.array_contains("platforms", F.col("platform")))
    good = F.coalesce((T.serial_key(F.col("shown")) == F.col("serial")) & F.col("sure"), F.lit(False))
    best = both.groupBy("item", "source", "game").agg(F.min(F.struct("ordinal", (~good).alias("_w"))).alias("_b"))
    return best.select("item", "source", "game", "_b.ordinal", (~F.col("_b._w")).alias("accepted"), F.when(F.col("_b._w"), "medium").otherwise("high").alias("confidence"))


def container_summary(containers: DataFrame, kind: str = "kind") -> DataFrame:
    """Counts of containers by kind: opened, failed, unread, the share opened of those that were tried, and what they hold.

    ``containers`` (kind, state, solid, inner_files, inner_bytes, without_crc), state opened, failed
    or unread. One with any file without a checksum must be unpacked whole. The share is null if none was tried.
    """
    is_ = lambda state: F.count(F.when(F.col("state") == state, 1))
    g = containers.groupBy(kind).agg(
        F.count("*").alias("containers"), is_("opened").alias("opened"), is_("failed").alias("failed"), is_("unread").alias("unread"),
        F.count(F.when(F.col("solid"), 1)).alias("solid"), F.coalesce(F.sum("inner_files"), F.lit(0)).alias("inner_files"), F.coalesce(F.sum("inner_bytes"), F.lit(0)).alias("inner_bytes"),
        F.count(F.when(F.col("without_crc") > 0, 1)).alias("whole"),
    )
    return g.withColumn("rate", F.try_divide(F.col("opened"), F.col("containers") - F.col("unread")))


def reference_totals(dats: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """(level, name, dats, sums): totals by each column alone and of all rows, from one pass; name is null for all and for a null group."""
    g = dats.groupingSets([[c] for c in by] + [[]], *by).agg(F.grouping_id().alias("_g"), F.count("*").alias("dats"), *[F.sum(c).alias(c) for c in sums])
    level, name = F.lit("all"), F.lit(None).cast("string")
    for k, c in enumerate(by):
        at = (2 ** len(by) - 1) - 2 ** (len(by) - 1 - k)
        level = F.when(F.col("_g") == at, c).otherwise(level)
        name = F.when(F.col("_g") == at, F.col(c).cast("string")).otherwise(name)
    return g.select(level.alias("level"), name.alias("name"), "dats", *sums)


def unresolved(memberships: DataFrame, items: DataFrame, item: str = "item", print_: str = "print") -> DataFrame:
    """Memberships of collections that land on no item, neither by its key nor by its print."""
    left = memberships.join(items.select(item).distinct(), item, "left_anti")
    return left.join(items.select(print_).distinct(), print_, "left_anti").select(*memberships.columns)
