"""File trees and archives: entries, members, magic numbers, fingerprints."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension

ENTRY = "key string, len long, modified timestamp"


def scan(spark: SparkSession, folder: str, root: str, pattern: str = "*") -> DataFrame:
    """(key, len, modified) of all files below a folder; contents aren't read (the columns are pruned)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    base = F.lit(folder.rstrip("/").removeprefix("file://").removeprefix("file:") + "/")
    # text after the folder's own name, whatever scheme stands before it
    inner = F.expr("substring(path, instr(path, base) + length(base))")
    return files.select("path", "length", "modificationTime").withColumn("base", base).select(F.concat(F.lit(root + "/"), inner).alias("key"), F.col("length").alias("len"), F.col("modificationTime").alias("modified"))


def contents(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length, content); one file a row, so meant for headers, listings and metadata files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "length", "content")


MEMBER = "path string, ordinal int, inner string, size long, crc32 long, is_dir boolean, error string"


def zip_members(files: DataFrame) -> DataFrame:
    """Members of zip archives from their directory; nothing is unpacked. A broken archive is one row with its error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, data in zip(part["path"], part["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        rows += [(path, k, m.filename, m.file_size, m.CRC, m.is_dir(), None) for k, m in enumerate(z.infolist())]
                except (zipfile.BadZipFile, ValueError, NotImplementedError) as e:
                    rows.append((path, None, None, None, None, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MEMBER.split(", ")])

    return files.select("path", "content").mapInPandas(run, MEMBER)


#: Magic numbers of common formats, as (kind, offset, hex).
MAGICS = [
    ("zip", 0, "504B0304"),
    ("zip", 0, "504B0506"),
    ("7z", 0, "377ABCAF271C"),
    ("rar", 0, "526172211A07"),
    ("gzip", 0, "1F8B"),
    ("zstd", 0, "28B52FFD"),
    ("xz", 0, "FD377A585A00"),
    ("png", 0, "89504E470D0A1A0A"),
    ("jpeg", 0, "FFD8FF"),
    ("pdf", 0, "255044462D"),
    ("nes", 0, "4E45531A"),
    ("chd", 0, "4D436F6D70724844"),
    ("iso9660", 32769, "4344303031"),
]


def magic(content: Column, kinds: list[tuple[str, int, str]] = MAGICS) -> Column:
    """Kind of a file by the bytes at known places, null if none fits."""
    return F.coalesce(*[F.when(F.substring(content, at + 1, len(code) // 2) == F.unhex(F.lit(code)), kind) for kind, at, code in kinds])


def header_bytes(key: Column, content: Column, length: Column) -> Column:
    """Bytes that a dumping tool put in front: by magic, or by extension and size where there is none; 0 if none."""
    begins = lambda at, code: F.substring(content, at, len(code) // 2) == F.unhex(F.lit(code))
    copier = extension(key).isin("sfc", "smc", "swc", "fig") & (length % 1024 == 512)
    return F.when(begins(1, "4E45531A") | begins(1, "4644531A"), 16).when(begins(1, "4C594E58"), 64).when(begins(2, "415441524937383030"), 128).when(copier, 512).otherwise(0)


def fingerprints(files: DataFrame) -> DataFrame:
    """(path, size, crc32, sha1, bare_*): of the file as it is, and without a dumper's header where there is one."""
    skip = header_bytes(F.col("path"), F.col("content"), F.col("length"))
    bare = F.when(skip > 0, F.expr("substring(content, skip + 1)"))
    out = files.withColumn("skip", skip).withColumn("bare", bare)
    return out.select("path", F.col("length").alias("size"), F.crc32("content").alias("crc32"), F.sha1("content").alias("sha1"), F.octet_length("bare").cast("long").alias("bare_size"), F.crc32("bare").alias("bare_crc32"), F.sha1("bare").alias("bare_sha1"))


def decoded(raw: Column, charsets: tuple[str, ...] = ("utf-8", "gbk", "shift_jis", "euc_kr")) -> Column:
    """Name bytes as text by the first charset that reads them all; Latin-1 reads whatever is left."""

    @F.pandas_udf("string")
    def run(names: pd.Series) -> pd.Series:
        def one(b):
            if b is None:
                return None
            for c in charsets:
                try:
                    return bytes(b).decode(c)
                except UnicodeDecodeError:
                    continue
            return bytes(b).decode("latin-1")

        return names.map(one)

    return run(raw)
