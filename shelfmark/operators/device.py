"""What a selection becomes on a device: files, playlists, where entries start, media; each step knows what the one before rejected.

Paths on a device are those of the library without the root's name; keys keep it. A null path
or key matches nothing, repeated rows count once where a path can hold one file only, and empty
tables give empty results. Names with an underscore in front are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .order import numbered
from .sync import screen


def _moved(path: Column, directory: Column) -> Column:
    """A path with its first directory replaced, where there is another for it."""
    return F.when(directory.isNotNull() & (F.instr(path, "/") > 0), F.concat(directory, F.lit("/"), T.rest_of(path))).otherwise(path)


def desired_files(members: DataFrame, decisions: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """(variant, source, path, bytes, converted, unreadable): the files that selected variants want to have there.

    ``members`` (variant, key, is_file, len); ``decisions`` (key, decision, target, bytes) of main files,
    of which only ``convert`` changes what lands: its target and size. ``places`` (variant, directory)
    moves a variant under another first directory. Members that aren't files are left out.
    """
    turned = decisions.where("decision = 'convert'").groupBy(F.col("key").alias("_k")).agg(F.min(F.struct("target", "bytes")).alias("_c"))
    rows = members.where("is_file and key is not null").select("variant", "key", "len").distinct().join(turned, F.col("key") == F.col("_k"), "left")
    if places is not None:
        rows = rows.join(places.groupBy(F.col("variant").alias("_v")).agg(F.min("directory").alias("_d")), F.col("variant") == F.col("_v"), "left")
    directory = F.col("_d") if places is not None else F.lit(None).cast("string")
    path = _moved(F.coalesce("_c.target", T.rest_of(F.col("key"))), directory)
    size = F.coalesce(F.when(F.col("_c").isNotNull(), F.col("_c.bytes")).otherwise(F.col("len")), F.lit(0)).cast("long")
    return rows.select("variant", F.col("key").alias("source"), path.alias("path"), size.alias("bytes"), F.col("_c").isNotNull().alias("converted"), F.col("len").isNull().alias("unreadable"))


def empty_variants(variants: DataFrame, members: DataFrame) -> DataFrame:
    """Selected variants none of whose members is a file."""
    return variants.join(members.where("is_file").select("variant").distinct(), "variant", "left_anti")


def screened(files: DataFrame, most_bytes: int, ignores_case: bool = True) -> DataFrame:
    """Files with (reason): why one can't stand there, null if it can.

    Of several sources for one path, as the file system compares paths, the first in the order of path
    and source stands and the others collide with it; files that can't stand anyway claim nothing.
    """
    why = screen(F.col("path"), F.col("bytes"), most_bytes)
    told = files.withColumn("_why", why).withColumn("_f", T.fold(F.col("path")) if ignores_case else F.col("path"))
    first = told.where("_why is null").groupBy(F.col("_f").alias("_g")).agg(F.min(F.struct("path", "source")).alias("_m"))
    both = told.join(first, F.col("_f") == F.col("_g"), "left")
    mine = (F.col("_m.path") == F.col("path")) & (F.col("_m.source") == F.col("source"))
    return both.select(*files.columns, F.coalesce("_why", F.when(~mine, "collides")).alias("reason"))


def playlists_of(kept: DataFrame, discs: DataFrame) -> DataFrame:
    """(variant, path, lines): a playlist for each variant of several discs that all stand there.

    ``discs`` (variant, key, disc) are main files; lines are paths beside the playlist, in order of disc. It
    is named after the first disc without its number and stands beside it; a disc in another folder keeps its path.
    """
    landed = discs.join(kept.where("reason is null").select(F.col("source").alias("key"), "path"), "key", "left")
    g = landed.groupBy("variant").agg(F.count("*").alias("_n"), F.count("path").alias("_there"), F.min(F.struct("disc", "path")).alias("_one"), F.sort_array(F.collect_list(F.struct("disc", "path"))).alias("_all"))  # as many as an item has discs
    g = g.where("_n > 1 and _n = _there").withColumn("_dir", T.dir_of(F.col("_one.path")))
    stem = F.regexp_replace(T.base_name(F.col("_one.path")), r"(?i)[ _-]*[(\[]?(?:disc|disk|cd)[ _-]*[0-9a-z]{1,2}[)\]]?(?=\.[^.]*$)", "")
    name = F.concat(F.regexp_replace(stem, r"\.[^.]*$", ""), F.lit(".m3u"))
    beside = F.transform("_all", lambda x: F.when(T.dir_of(x["path"]) == F.col("_dir"), T.base_name(x["path"])).otherwise(F.concat(F.lit("/"), x["path"])))
    return g.select("variant", F.when(F.col("_dir") == "", name).otherwise(F.concat("_dir", F.lit("/"), name)).alias("path"), F.array_join(beside, "\n").alias("lines"))


def launching(mains: DataFrame, files: DataFrame, playlists: DataFrame, gone: DataFrame) -> DataFrame:
    """(variant, launch, left_off): what a variant's entry starts there, null for its main file as it is; or why it has no entry.

    ``mains`` (variant, key), ``files`` as ``screened`` gives them, ``playlists`` (variant, path) those that
    stand there, ``gone`` (path) what was removed from the device and stays so. A playlist goes before the
    main file; a converted or moved main file starts under its own path.
    """
    m = mains.select("variant", "key").distinct()
    own = files.select(F.col("variant").alias("_v"), F.col("source").alias("_s"), F.col("path").alias("_path"), "converted", "reason")
    lists = playlists.groupBy(F.col("variant").alias("_lv")).agg(F.min("path").alias("_list"))
    both = m.join(own, (F.col("variant") == F.col("_v")) & (F.col("key") == F.col("_s")), "left").join(lists, F.col("variant") == F.col("_lv"), "left")
    off = gone.select(F.col("path").alias("_gone")).where("_gone is not null").distinct()
    target = F.coalesce("_list", F.when(F.col("reason").isNull(), F.col("_path")))
    both = both.withColumn("_t", target).join(off, F.col("_t") == F.col("_gone"), "left")
    left = F.when(F.col("_gone").isNotNull(), "gone").when(F.col("_list").isNull() & F.col("reason").isNotNull(), F.concat(F.lit("rejected: "), F.col("reason")))
    named = F.col("_list").isNotNull() | F.col("converted") | (F.col("_path") != T.rest_of(F.col("key")))
    return both.select("variant", F.when(left.isNull() & named, F.col("_t")).alias("launch"), left.alias("left_off"))


# Folders of media kinds for formats that find media by name (fixed values).
FOLDERS = {"cover": "covers", "screenshot": "screenshots", "title": "titlescreens", "logo": "marquees", "video": "videos", "manual": "manuals", "fanart": "fanart"}


def media_laid(media: DataFrame, on_card: DataFrame, by_name: bool = True) -> DataFrame:
    """(path, hash, ext, bytes, variant, kind, state): where media land; ``laid``, ``crowded out``, or unplaced.

    ``media`` (variant, anchor, ordinal, kind, hash, ext, bytes), anchor 0 for a variant's own and 1 for its
    work's, null ext or bytes for what isn't in the pool; ``on_card`` as ``launching`` gives it, with
    (key): a variant that is left off gets none. By name, media are called after what the entry starts,
    so a place holds one file: the first claimant's, in order of variant, anchor and ordinal. By content
    (``by_name`` off) a file serves all who refer to it. Rows that aren't laid have no path but those crowded out.
    """
    there = on_card.where("left_off is null").select(F.col("variant").alias("_v"), F.coalesce("launch", T.rest_of(F.col("key"))).alias("_as")).distinct()
    rows = media.distinct().join(there, F.col("variant") == F.col("_v"))
    folder = F.lit(None).cast("string")
    for kind, name in FOLDERS.items():
        folder = F.when(F.col("kind") == kind, name).otherwise(folder)
    stem = F.regexp_replace(T.rest_of(F.col("_as")), r"(?<=[^/])\.[^./]*$", "")
    place = F.concat(F.lit("media/"), T.root_of(F.col("_as")), F.lit("/"), folder, F.lit("/"), stem, F.lit("."), F.col("ext")) if by_name else F.concat(F.lit("media/"), F.substring("hash", 1, 2), F.lit("/"), F.col("hash"), F.lit("."), F.col("ext"))
    state = F.when(folder.isNull(), "unknown kind").when(F.col("ext").isNull() | F.col("bytes").isNull(), "not in the pool")
    told = rows.withColumn("_state", state).withColumn("_path", F.when(state.isNull(), place))
    # one seat a place; a place that very many refer to spreads over tasks
    seats = numbered(told.where("_path is not null"), ["_path"], [F.asc("variant"), F.asc("anchor"), F.asc("ordinal"), F.asc("hash")], "_seat")
    other = F.when(F.col("_seat") == 0, "laid").otherwise("crowded out" if by_name else "shared")
    columns = lambda path, state: [path.alias("path"), "hash", "ext", "bytes", "variant", "kind", state.alias("state")]
    return seats.select(*columns(F.col("_path"), other)).union(told.where("_path is null").select(*columns(F.lit(None).cast("string"), F.col("_state"))))
