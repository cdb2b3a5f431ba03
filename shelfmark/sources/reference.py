"""Reference databases: game lists in XML and text, title files in JSON, a wiki dump."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROM = "array<struct<_name:string,_size:long,_crc:string,_md5:string,_sha1:string,_status:string>>"


def _crc(c: Column) -> Column:
    return F.conv(F.upper(c), 16, 10).cast("long")


def _roms(rows: DataFrame) -> DataFrame:
    rom = F.col("rom")
    return rows.select("game", "description", "cloneof", "serial", rom["_name"].alias("rom"), rom["_size"].alias("size"), _crc(rom["_crc"]).alias("crc32"), F.lower(rom["_md5"]).alias("md5"), F.lower(rom["_sha1"]).alias("sha1"), rom["_status"].alias("status"))


def logiqx(spark: SparkSession, path: str) -> DataFrame:
    """One row a file of a game (``<game><rom/></game>``); games without files have null file columns."""
    schema = f"_name string, _cloneof string, _serial string, description string, rom {_ROM}"
    games = spark.read.format("xml").option("rowTag", "game").schema(schema).load(path)
    return _roms(games.select(F.col("_name").alias("game"), "description", F.col("_cloneof").alias("cloneof"), F.col("_serial").alias("serial"), F.explode_outer("rom").alias("rom")))


def software_list(spark: SparkSession, path: str) -> DataFrame:
    """One row a file of a software list (``<software><part><dataarea><rom/>``)."""
    schema = f"_name string, _cloneof string, description string, info array<struct<_name:string,_value:string>>, part array<struct<_name:string,dataarea:array<struct<_name:string,rom:{_ROM}>>>>"
    rows = spark.read.format("xml").option("rowTag", "software").schema(schema).load(path)
    serial = F.get(F.filter("info", lambda i: i["_name"] == "serial"), F.lit(0))["_value"]
    parts = rows.select(F.col("_name").alias("game"), "description", F.col("_cloneof").alias("cloneof"), serial.alias("serial"), F.explode_outer("part").alias("part"))
    areas = parts.select("game", "description", "cloneof", "serial", F.explode_outer("part.dataarea").alias("area"))
    return _roms(areas.select("game", "description", "cloneof", "serial", F.explode_outer("area.rom").alias("rom")))


def hash_table(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated hash, status, name, system with ``;`` comments; the hash's kind is told by its length."""
    rows = spark.read.option("sep", "\t").option("comment", ";").option("quote", "").schema("hash string, status string, name string, system string").csv(path)
    h = F.lower(F.trim("hash"))
    of = lambda n: F.when(F.length(h) == n, h)
    return rows.select("name", "system", "status", of(32).alias("md5"), of(40).alias("sha1"))


def serials(entries: DataFrame, serial: str) -> DataFrame:
    """(.., key, shown): each serial of a separated list once, by its first spelling."""
    from ..functions.text import serial_key

    keep = [c for c in entries.columns if c != serial]
    parts = entries.select(*keep, F.posexplode(F.split(serial, r"\s*[,/;]\s*")).alias("pos", "shown"))
    keyed = parts.withColumn("key", serial_key(F.col("shown"))).where("key is not null")
    return keyed.groupBy(*keep, "key").agg(F.min_by("shown", "pos").alias("shown"))


def titles(spark: SparkSession, path: str, region: str) -> DataFrame:
    """(title_id, region, name, publisher, languages) of a JSON object keyed by title id (one object a file)."""
    kind = "map<string,struct<name:string,publisher:string,languages:array<string>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("id", "t"))
    return rows.select(F.upper("id").alias("title_id"), F.lit(region).alias("region"), "t.name", "t.publisher", "t.languages")


def best_title(rows: DataFrame, regions: list[str]) -> DataFrame:
    """One row a title: name and publisher of the best region that has them, all languages in that order, all regions."""
    from ..operators.priority import source_rank

    rank = source_rank(F.col("region"), regions)
    named = F.when(F.col("name").isNotNull(), F.struct(rank.alias("r"), F.col("region").alias("g")))
    grouped = rows.groupBy("title_id").agg(F.min_by("name", named).alias("name"), F.min_by("publisher", named).alias("publisher"), F.sort_array(F.collect_list(F.struct(rank.alias("r"), "region", "languages"))).alias("_l"), F.sort_array(F.collect_set("region")).alias("regions"))
    return grouped.withColumn("languages", F.array_distinct(F.flatten(F.transform("_l", lambda x: F.coalesce(x["languages"], F.array().cast("array<string>")))))).drop("_l")


def wiki_subjects(spark: SparkSession, path: str, kind: int = 4) -> DataFrame:
    """Subjects of one kind from a dump of JSON lines: (id, name, name_cn, date, infobox)."""
    schema = "id long, type int, name string, name_cn string, date string, infobox string"
    return spark.read.schema(schema).json(path).where(F.col("type") == kind).drop("type")


def infobox_values(infobox: Column, key: str) -> Column:
    """Values of a wiki infobox field: one, or each of a braced list."""
    block = F.regexp_extract(infobox, rf"(?s)\|[ \t]*{key}[ \t]*=[ \t]*(\{{.*?\n\}}|[^\r\n]*)", 1)
    listed = F.transform(F.regexp_extract_all(block, F.lit(r"\[(?:[^\]|]*\|)?([^\]]*)\]"), F.lit(1)), lambda x: F.trim(x))
    one = F.filter(F.array(F.trim(block)), lambda x: x != "")
    return F.filter(F.when(block.startswith("{"), listed).otherwise(one), lambda x: x != "")
