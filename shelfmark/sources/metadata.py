"""Frontend metadata files: lists in XML and in ``key: value`` lines, read and written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import read_partial_date, read_players, read_rating

GAMELIST = "path string, name string, desc string, image string, rating string, releasedate string, developer string, publisher string, genre string, players string, lang string, favorite string"


def gamelist(spark: SparkSession, path: str) -> DataFrame:
    """Entries of game list files, with their file and the values as written."""
    return spark.read.format("xml").option("rowTag", "game").schema(GAMELIST).load(path).withColumn("file", F.input_file_name())


def typed(rows: DataFrame) -> DataFrame:
    """Values read leniently: malformed ones are missing."""
    return rows.withColumns({"rating": read_rating(F.col("rating")), "releasedate": read_partial_date(F.col("releasedate")), "players": read_players(F.col("players")), "favorite": F.lower("favorite") == "true"})


def write_gamelist(rows: DataFrame, path: str, partition: str | None = None) -> None:
    """Write game lists, a folder for each value of ``partition`` if given; null values make no element."""
    writer = rows.write.format("xml").option("rootTag", "gameList").option("rowTag", "game").mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).save(path)


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """(file, entry, key, value, ordinal) of files of ``key: value`` lines.

    An entry begins with ``game:``; lines that begin with blanks continue the value before (a lone dot
    is an empty line); ``#`` begins a comment. Entry 0 is what stands before the first game.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", r"\r\n?", "\n").alias("text"))
    joined = F.regexp_replace(F.regexp_replace("text", r"(?m)^#.*(?:\n|\z)", ""), r"\n[ \t]+", "\u0001")
    lines = F.filter(F.split(joined, "\n"), lambda x: x.rlike(r"^[^\s:][^:]*:"))
    one = files.select("file", F.posexplode(lines).alias("ordinal", "line"))
    one = one.withColumn("key", F.lower(F.trim(F.regexp_extract("line", r"^([^:]*):", 1))))
    value = F.trim(F.regexp_replace(F.regexp_extract("line", r"(?s)^[^:]*:[ \t]*(.*)$", 1), "\u0001\\.(?=\u0001|$)", "\u0001"))
    one = one.withColumn("value", F.regexp_replace(F.regexp_replace(value, "^\u0001", ""), "\u0001", "\n")).drop("line")
    from pyspark.sql import Window

    by = Window.partitionBy("file").orderBy("ordinal")  # the lines of one file
    return one.withColumn("entry", F.sum((F.col("key") == "game").cast("int")).over(by))


def write_key_values(rows: DataFrame, path: str, partition: str) -> None:
    """Write entries (partition, entry, key, value, ordinal), one text a value of ``partition``."""
    value = F.regexp_replace(F.regexp_replace("value", "\n\n", "\n  .\n"), "\n(?!  \\.)", "\n  ")
    line = F.concat(F.when(F.col("key") == "game", "\n").otherwise(""), F.col("key"), F.lit(": "), value)
    lines = rows.select(partition, F.struct("entry", "ordinal", line.alias("line")).alias("l")).groupBy(partition).agg(F.sort_array(F.collect_list("l")).alias("l"))
    lines.select(partition, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("value")).write.partitionBy(partition).mode("overwrite").text(path)


def export_json(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def import_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; a malformed line keeps its text in ``bad`` and nulls elsewhere."""
    text = spark.read.text(path)
    parsed = text.withColumn("row", F.from_json("value", f"{schema}, bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}))
    return parsed.select("row.*")
