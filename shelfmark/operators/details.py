"""Details of one item and what is decided about it: first verdicts, candidates, undo with before-images, merges, media, reports.

Unless a function says otherwise: a null key matches nothing, a null group is a group like any
other, repeated rows count as often as they come, an empty table gives an empty result, and other
columns are left out of the result. Names with an underscore in front are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower


def first_verdict(items: DataFrame, units: DataFrame, by_content: DataFrame, by_path: DataFrame, key: str = "key") -> DataFrame:
    """(key, verdict, anchor): the verdict on an item's content, else the one on its path; items with neither are left out.

    ``units`` (key, ordinal, print, reason): content counts only where every unit has a print or a
    stated reason for having none; the first unit's print then speaks. ``by_content`` (print,
    verdict) and ``by_path`` (key, verdict): of several verdicts the least. An aggregate finds the
    first unit, so no item's units are sorted.
    """
    lead = units.groupBy(key).agg(F.min(F.struct("ordinal", F.col("print").alias("print"))).alias("_u"), F.bool_and(F.col("print").isNotNull() | F.col("reason").isNotNull()).alias("_s"))
    lead = lead.where("_s").select(key, F.col("_u.print").alias("print"))
    content = lead.join(by_content.groupBy("print").agg(F.min("verdict").alias("_c")), "print").select(key, "_c")
    both = items.select(key).distinct().join(content, key, "left").join(by_path.groupBy(key).agg(F.min("verdict").alias("_p")), key, "left")
    told = both.select(key, F.coalesce("_c", "_p").alias("verdict"), F.when(F.col("_c").isNotNull(), "content").otherwise("path").alias("anchor"))
    return told.where("verdict is not null")


def candidates(hits: DataFrame, exact: Column, doubts: dict[str, Column]) -> DataFrame:
    """Hits with (confidence, accepted, doubts): high and accepted if exact and without any doubt, else medium.

    A doubt that is null is none; an exactness that is null is none either.
    """
    names = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in doubts.items()]))
    out = hits.withColumn("doubts", F.array_join(names, ","))
    sure = F.coalesce(exact, F.lit(False)) & (F.col("doubts") == "")
    return out.withColumn("accepted", sure).withColumn("confidence", F.when(F.col("accepted"), "high").otherwise("medium"))


def accepted_print(candidate_rows: DataFrame, prints: DataFrame, inside: DataFrame, item: str, order: str, member: str) -> DataFrame:
    """(item, member, print): the print of the first accepted candidate's member; where no print of it is kept, the one its container states."""
    first = candidate_rows.where("accepted").groupBy(item).agg(F.min(F.struct(F.col(order), F.col(member))).alias("_f")).select(item, F.col(f"_f.{member}").alias(member))
    one = lambda t, name: t.groupBy(member).agg(F.min("print").alias(name))
    return first.join(one(prints, "_a"), member, "left").join(one(inside, "_b"), member, "left").select(item, member, F.coalesce("_a", "_b").alias("print")).where("print is not null")


def content_prints(units: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, print): the first print in the order of units; units without one are passed over."""
    return units.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(F.struct(F.col(order), F.col(value))).alias("_f")).select(key, F.col(f"_f.{value}").alias("print"))


def stashed(conclusions: DataFrame, keys: DataFrame, key: str, batch: int) -> DataFrame:
    """(key, image, batch): before-images of a batch's keys, each a struct of the whole row, so none of its names can clash.

    A key without a row yet gets one null image, a key with several rows one image for each; null
    keys have none.
    """
    images = conclusions.select(F.col(key).alias("_key"), F.struct(*conclusions.columns).alias("image"))
    one = keys.select(F.col(key).alias("_key")).where("_key is not null").distinct()
    return one.join(images, "_key", "left").select(F.col("_key").alias("key"), "image", F.lit(batch).alias("batch"))


def restored(conclusions: DataFrame, stash: DataFrame, existing: DataFrame, key: str, batch: int) -> DataFrame:
    """Conclusions as before a batch: its keys get their before-images back where the item still exists, and lose what came since.

    A batch that was stashed more than once (a repeated run) gives its rows back once: its images are distinct rows.
    """
    images = stash.where(F.col("batch") == batch).select("key", "image").distinct()
    there = existing.select(F.col(key).alias("key")).distinct()
    back = images.where("image is not null").join(there, "key", "left_semi").select(*[F.col("image").getField(c).alias(c) for c in conclusions.columns])
    mine = images.select(F.col("key").alias("_key")).distinct()
    return conclusions.join(mine, F.col(key) == F.col("_key"), "left_anti").unionByName(back)


def redone(log: DataFrame, undone: DataFrame, batch: int, as_batch: int) -> DataFrame:
    """The log with an undone batch's rows appended once more under a new number; nothing if it wasn't undone."""
    again = log.where(F.col("batch") == batch).join(undone.select("batch").distinct(), "batch", "left_semi")
    return log.unionByName(again.withColumn("batch", F.lit(as_batch).cast(log.schema["batch"].dataType)))


def merge_impact(tables: dict[str, DataFrame], group: str, moving: DataFrame) -> DataFrame:
    """(group, kind, n): rows of each table that a merge would move, from one pass over each; groups without any are left out."""
    out = None
    for kind, t in tables.items():
        one = t.select(F.col(group), F.lit(kind).alias("kind"))
        out = one if out is None else out.union(one)
    return out.join(moving.select(group).distinct(), group, "left_semi").groupBy(group, "kind").agg(F.count("*").alias("n"))


def merged_into(rows: DataFrame, group: str, moving: DataFrame, keep) -> DataFrame:
    """Rows of the moving groups go to the group kept; rows that are alike then are one."""
    m = moving.select(F.col(group).alias("_g")).distinct().withColumn("_m", F.lit(True))
    at = rows.columns
    moved = rows.join(m, F.col(group) == F.col("_g"), "left").withColumn(group, F.when(F.col("_m"), F.lit(keep)).otherwise(F.col(group)))
    return moved.select(*at).distinct()


def kept_aliases(titles: DataFrame, names: DataFrame, group: str, title: str, keep) -> DataFrame:
    """Titles with the merged groups' names as further titles of the group kept, those it has (case of A-Z ignored) left out."""
    have = titles.where(F.col(group) == keep).select(ascii_lower(F.col(title)).alias("_l"))
    new = names.where(F.col(title).isNotNull()).groupBy(ascii_lower(F.col(title)).alias("_l")).agg(F.min(title).alias(title))
    return titles.select(group, title).unionByName(new.join(have, "_l", "left_anti").select(F.lit(keep).cast(titles.schema[group].dataType).alias(group), title))


def preferred(members: DataFrame, told: DataFrame, group: str, member: str, order: list[Column]) -> DataFrame:
    """(group, member): the one that was told, if it is a member, else the least by ``order`` (nulls last) and name."""
    t = told.select(F.col(group).alias("_g"), F.col(member).alias("_m")).distinct()
    both = members.join(t, F.col(group).eqNullSafe(F.col("_g")) & (F.col(member) == F.col("_m")), "left")
    parts = [x for k, c in enumerate(order) for x in (c.isNull().alias(f"_n{k}"), c.alias(f"_o{k}"))]
    best = F.min(F.struct(F.col("_m").isNull().alias("_t"), *parts, F.col(member)))
    return both.groupBy(group).agg(best.alias("_b")).select(group, F.col(f"_b.{member}").alias(member))


def matched_media(mains: DataFrame, files: DataFrame, item: str = "item", folder: str = "folder", stem: str = "stem", name: str = "name") -> DataFrame:
    """(item, name, why): files beside an item's main file, of the same stem (case of A-Z ignored), or any where the folder has one item.

    Main files themselves are no media. Folders with one item join by folder, the rest by folder and
    stem, so a folder with very many items and files never gives all pairs.
    """
    own = mains.select(F.col(folder).alias("_d"), F.col(name).alias("_n")).distinct()
    free = files.join(own, (F.col(folder) == F.col("_d")) & (F.col(name) == F.col("_n")), "left_anti").select(folder, name, ascii_lower(F.col(stem)).alias("_s"))
    sole = mains.groupBy(folder).agg(F.count("*").alias("_c"), F.min(item).alias(item), F.min(ascii_lower(F.col(stem))).alias("_t")).where("_c = 1")
    alone = free.join(sole, folder).select(item, name, F.when(F.col("_s") == F.col("_t"), "stem").otherwise("folder").alias("why"))
    many = mains.join(sole.select(folder), folder, "left_anti").select(item, folder, ascii_lower(F.col(stem)).alias("_s"))
    return alone.unionByName(many.join(free, [folder, "_s"]).select(item, name, F.lit("stem").alias("why")))


def file_lines(members: DataFrame, inside: DataFrame, key: str, member: str, order: str) -> DataFrame:
    """(key, member, name, role, inner): a line a member in order, then one for each file in it; what holds files has no role of its own."""
    held = inside.select(member).distinct().withColumn("_held", F.lit(True))
    own = members.join(held, member, "left").select(key, order, member, F.col(member).cast("string").alias("name"), F.when(F.col("_held").isNull(), F.col("role")).alias("role"), F.lit(False).alias("inner"))
    within = members.select(key, order, member, "role").join(inside.select(member, F.col("path").cast("string").alias("name")), member)
    return own.unionByName(within.select(key, order, member, "name", "role", F.lit(True).alias("inner")))


def merged_media(media: DataFrame, group: str, order: list[str], item: str) -> DataFrame:
    """(group, place, item): media of all members of a group, each once, where it came first.

    Rows are combined to one an item before items of a group are ranked.
    """
    first = media.groupBy(group, item).agg(F.min(F.struct(*order)).alias("_f"))
    lists = first.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("_f", item))).alias("_l"))
    return lists.select(group, F.posexplode("_l").alias("place", "_x")).select(group, "place", F.col(f"_x.{item}").alias(item))


def kinds_of(rows: DataFrame, group: str, kind: str, unknown: str = "unknown", separator: str = ",") -> DataFrame:
    """(group, kinds): the distinct kinds in order, ``unknown`` last where some row has none."""
    g = rows.groupBy(group).agg(F.array_sort(F.collect_set(kind)).alias("_k"), F.max(F.col(kind).isNull()).alias("_u"))
    return g.select(group, F.array_join(F.concat("_k", F.when(F.col("_u"), F.array(F.lit(unknown))).otherwise(F.array().cast("array<string>"))), separator).alias("kinds"))


def like(rows: DataFrame, said: DataFrame, columns: list[str], ident: str) -> DataFrame:
    """``said`` with the least id of the rows equal in all columns, where null equals null; null where there is none."""
    known = rows.groupBy(*[F.col(c).alias(f"_k{j}") for j, c in enumerate(columns)]).agg(F.min(ident).alias(ident))
    on = [F.col(c).eqNullSafe(F.col(f"_k{j}")) for j, c in enumerate(columns)]
    return said.select(*columns).join(known, on, "left").select(*columns, ident)


def main_of_other_role(items: DataFrame, members: DataFrame, item: str, member: str, role: str = "role", main: str = "main") -> DataFrame:
    """(item, role): items whose main file is listed as a member of another role."""
    listed = members.select(item, F.col(member).alias("_m"), role)
    on = [item]
    return items.select(item, member).join(listed, on).where((F.col(member) == F.col("_m")) & (F.col(role) != main)).groupBy(item).agg(F.min(role).alias("role"))


def standing(paths: DataFrame, contents: DataFrame, items: DataFrame, item: str = "item") -> DataFrame:
    """(item, name, anchor): collections an item is in by its path or its print; by both counts as by content, which outlives a renaming."""
    a = paths.select(item, "name").join(items.select(item), item, "left_semi").withColumn("anchor", F.lit("path"))
    b = contents.select("print", "name").distinct().join(items.select("print", item), "print").select(item, "name", F.lit("content").alias("anchor"))
    return a.unionByName(b).groupBy(item, "name").agg(F.min("anchor").alias("anchor"))


def taken_back(manifest: DataFrame, surprises: DataFrame, path: str = "path", stamp: str = "stamp") -> DataFrame:
    """The manifest with the stamps found of changed files, where it still has the stamp that was expected; (was) tells of those taken.

    ``surprises`` (path, kind, expected, found); of several for a path the greatest found stamp counts.
    """
    s = surprises.where("kind = 'changed' and found is not null").groupBy(F.col(path).alias("_p"), F.col("expected").alias("_e")).agg(F.max("found").alias("_f"))
    both = manifest.join(s, (F.col(path) == F.col("_p")) & (F.col(stamp) == F.col("_e")), "left")
    return both.select(path, F.coalesce("_f", stamp).alias(stamp), F.when(F.col("_f").isNotNull(), F.col(stamp)).alias("was"))


def findings(rows: DataFrame, kinds: dict[str, Column], order: list[Column], most: int, columns: list[str]) -> DataFrame:
    """(kind, n, place, columns): how many rows each finding has, and the first ``most`` of them.

    Rows are cut to ``most`` for each kind and slice of rows first, so a common kind isn't ranked whole.
    """
    from pyspark.sql import Window

    flags = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in kinds.items()]))
    each = rows.select(F.explode(flags).alias("kind"), *columns, *[c.alias(f"_o{k}") for k, c in enumerate(order)])
    by = [F.col(f"_o{k}").asc_nulls_last() for k in range(len(order))]
    sliced = each.withColumn("_s", F.pmod(F.xxhash64(*columns), F.lit(64)))
    some = sliced.withColumn("_r", F.row_number().over(Window.partitionBy("kind", "_s").orderBy(*by))).where(F.col("_r") <= most)
    first = some.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(*by))).where(F.col("place") <= most)
    return each.groupBy("kind").agg(F.count("*").alias("n")).join(first.select("kind", "place", *columns), "kind")


def rates(rows: DataFrame, by: str, outcome: str, good: str) -> DataFrame:
    """(by, n, good, rate): how many tries of each kind came out well; a null outcome is a try that didn't."""
    g = rows.groupBy(by).agg(F.count("*").alias("n"), F.count(F.when(F.col(outcome) == good, 1)).alias("good"))
    return g.withColumn("rate", F.col("good") / F.col("n"))


def scope_totals(rows: DataFrame, scope: str, size: str) -> DataFrame:
    """(scope, folders, files, bytes) of (scope, folder, size) rows; folders are counted after a first aggregate, not gathered."""
    per = rows.groupBy(scope, "folder").agg(F.count("*").alias("_n"), F.sum(size).alias("_b"))
    return per.groupBy(scope).agg(F.count("*").alias("folders"), F.sum("_n").alias("files"), F.sum("_b").alias("bytes"))


def next_stage(stages: DataFrame) -> DataFrame:
    """(stage, waiting_on) of (place, stage, left, before) rows: each unfinished stage and the prerequisite it waits on, if that is unfinished."""
    b = stages.select(F.col("stage").alias("_b"), F.col("left").alias("_l"))
    both = stages.where("left > 0").join(b, F.col("before") == F.col("_b"), "left")
    return both.select("place", "stage", F.when(F.col("_l") > 0, F.col("_b")).alias("waiting_on"))


def merge_plan(variants: DataFrame, identified: DataFrame, verdicts: DataFrame, prints: DataFrame, moving: DataFrame, into: str, facts: list[str]) -> DataFrame:
    """(key, state, anchor, work, .. facts, from_work, replaces): the verdicts that move variants under another work, and what can't be moved.

    ``variants`` (key, work), ``identified`` (key, .. facts), ``verdicts`` (anchor, decision, .. facts),
    ``prints`` (key, print), ``moving`` (key). A variant's anchor is its print, or its key where there is none.
    Only the work changes: the other facts are those of a verdict of kind ``release`` on the anchor,
    else what was identified, else null. State is ``moved``; ``held`` where the work is that one already;
    ``unknown`` where there is no such variant (these two have no verdict). ``replaces`` tells whether the
    anchor has a verdict. Keys to move count once; of several rows of one key or anchor the least counts.
    """
    least = lambda t, key, columns, name: t.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"_{name}")).agg(F.min(F.struct(*columns)).alias(name))
    keys = moving.select(F.col("key").alias("key")).where("key is not null").distinct()
    own = variants.where("key is not null").groupBy(F.col("key").alias("_v")).agg(F.min("work").alias("_work"))
    both = keys.join(own, F.col("key") == F.col("_v"), "left").join(least(prints, "key", ["print"], "p"), F.col("key") == F.col("_p"), "left")
    both = both.withColumn("anchor", F.coalesce("p.print", "key"))
    both = both.join(least(identified, "key", facts, "i"), F.col("key") == F.col("_i"), "left").join(least(verdicts, "anchor", ["decision", *facts], "d"), F.col("anchor") == F.col("_d"), "left")
    state = F.when(F.col("_v").isNull(), "unknown").when(F.col("_work").eqNullSafe(F.lit(into)), "held").otherwise("moved")
    moved = F.col("state") == "moved"
    said = F.col("d.decision") == "release"
    shown = [F.when(moved, F.when(said, F.col("d").getField(f)).otherwise(F.col("i").getField(f))).alias(f) for f in facts]
    out = both.withColumn("state", state)
    return out.select("key", "state", F.when(moved, F.col("anchor")).alias("anchor"), F.when(moved, F.lit(into)).alias("work"), *shown, F.when(moved, F.col("_work")).alias("from_work"), F.when(moved, F.col("_d").isNotNull()).alias("replaces"))
