"""Byte ranges of files too large to read: archive listings, files on disc images, key tables.

A table of wanted ranges becomes a table of bytes, read inside tasks by seeking; what the bytes say
gives the next ranges. So a listing is a few steps over tables of (path, range), each planned from
the one before: an archive's tail says where its directory lies, a volume descriptor where the root is,
a directory where a file is. Steps need no shuffle; a task holds one row's bytes at a time, and no
range is larger than ``MOST``. A file that can't be read as expected is a row with an error.

Paths are local, ``file:`` or any store that ``pyarrow.fs`` opens by its address (hdfs, s3, gs).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 64 << 20
TAIL = 66_000  # a zip's end record, its longest comment and what stands before it
FETCHED = "path string, at long, data binary, size long, error string"


def _open(path: str):
    from pyarrow import fs

    files, inner = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return files.open_input_file(inner)


def fetched(ranges: DataFrame) -> DataFrame:
    """(path, at, data, size, error) for (path, at, length): the bytes from ``at`` on, or from the end if it is negative.

    A range beyond the end gives what there is; ``size`` is the whole file's. Null places give no bytes.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, at, length in zip(part["path"], part["at"], part["length"], strict=True):
                data = size = error = None
                try:
                    if pd.isna(at) or pd.isna(length):
                        raise ValueError("no place to read from")
                    if length > MOST:
                        raise ValueError("larger than may be read at once")
                    with _open(path) as f:
                        size = f.size()
                        at = max(0, size + int(at)) if at < 0 else int(at)
                        data = f.read_at(max(0, min(int(length), size - at)), at) if at < size else b""
                except (OSError, ValueError) as e:
                    error = f"{type(e).__name__}: {e}"[:200]
                yield pd.DataFrame({"path": [path], "at": pd.array([None if pd.isna(at) else at], "Int64"), "data": [data], "size": pd.array([size], "Int64"), "error": [error]})

    return ranges.select("path", F.col("at").cast("long").alias("at"), F.col("length").cast("long").alias("length")).mapInPandas(run, FETCHED)


def _each(rows: DataFrame, schema: str, step) -> DataFrame:
    """Rows that ``step(path, at, data, size)`` makes of fetched bytes; errors of either go on as a row with nulls and the error last."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, at, data, size, error in zip(part["path"], part["at"], part["data"], part["size"], part["error"], strict=True):
                try:
                    if error is not None:
                        raise ValueError(error)
                    out += [(path, *row, None) for row in step(path, at, data, size)]
                except (ValueError, struct.error, IndexError, OSError) as e:
                    out.append((path, *[None] * (len(names) - 2), str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=names, dtype=object)

    return rows.select("path", "at", "data", "size", "error").mapInPandas(run, schema)


# zip ---------------------------------------------------------------------------------------------


def _zip_directory(path: str, at: int, tail: bytes, size: int):
    """Where the directory lies, from the end record; the wide one where the plain one is full."""
    end = tail.rfind(b"PK\5\6")
    while end >= 0 and (len(tail) - end < 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] > len(tail)):
        end = tail.rfind(b"PK\5\6", 0, end)
    if end < 0:
        raise ValueError("no end of a zip archive")
    n, length, begin = struct.unpack_from("<HII", tail, end + 10)
    last = at + end
    if (n == 0xFFFF or length == 0xFFFFFFFF or begin == 0xFFFFFFFF) and tail[end - 20 : end - 16] == b"PK\6\7":
        wide = struct.unpack_from("<Q", tail, end - 12)[0] - at
        if wide < 0 or tail[wide : wide + 4] != b"PK\6\6":
            raise ValueError("no wide end of a zip archive")
        n, length, begin = struct.unpack_from("<QQQ", tail, wide + 32)
        last = at + wide
    # bytes put before the archive shift all places
    yield last - length, length, (last - length) - begin, n


def _zip_entries(path: str, at: int, data: bytes, size: int):
    k = ordinal = 0
    while data[k : k + 4] == b"PK\1\2":
        flags, method, _, crc, packed, full, n, extra, comment = struct.unpack_from("<HHIIIIHHH", data, k + 8)
        offset = struct.unpack_from("<I", data, k + 42)[0]
        raw, more = data[k + 46 : k + 46 + n], data[k + 46 + n : k + 46 + n + extra]
        while len(more) >= 4:
            kind, length = struct.unpack_from("<HH", more)
            if kind == 1:
                wide = iter(struct.iter_unpack("<Q", more[4 : 4 + length // 8 * 8]))
                full, packed, offset = (next(wide, (v,))[0] if v == 0xFFFFFFFF else v for v in (full, packed, offset))
            more = more[4 + length :]
        name = raw.decode("utf-8" if flags & 0x800 else "cp437", "replace")
        yield ordinal, name, raw, full, packed, crc, method == 0, bool(flags & 1), name.endswith("/"), offset
        k, ordinal = k + 46 + n + extra + comment, ordinal + 1
    if k < len(data):
        raise ValueError("the directory of a zip archive is cut off")


ENTRY = "path string, ordinal int, inner string, raw_name binary, size long, packed long, crc32 long, stored boolean, encrypted boolean, is_dir boolean, offset long, error string"


def zip_entries(paths: DataFrame) -> DataFrame:
    """Entries of zip archives (path), from the tail and the directory alone; names of no stated charset are given as bytes too."""
    tails = fetched(paths.select("path", F.lit(-TAIL).alias("at"), F.lit(TAIL).alias("length")))
    places = _each(tails, "path string, at long, length long, shift long, n long, error string", _zip_directory)
    good = places.where("error is null")
    entries = _each(fetched(good), ENTRY, _zip_entries)
    return entries.unionByName(places.where("error is not null").select("path", "error"), allowMissingColumns=True)


# rar ---------------------------------------------------------------------------------------------


def _vint(data: bytes, k: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[k]
        out, shift, k = out | (b & 127) << shift, shift + 7, k + 1
        if b < 128:
            return out, k


def _rar5(f, at: int, size: int):
    ordinal = 0
    while at < size:
        head = f.read_at(min(1 << 16, size - at), at)
        length, k = _vint(head, 4)
        begin, end = at, k + length
        if len(head) < end or zlib.crc32(head[4:end]) != struct.unpack_from("<I", head)[0]:
            raise ValueError("a block of a rar archive is broken")
        kind, k = _vint(head, k)
        flags, k = _vint(head, k)
        if flags & 1:
            _, k = _vint(head, k)
        data = 0
        if flags & 2:
            data, k = _vint(head, k)
        if kind == 4:
            raise ValueError("the names of a rar archive are encrypted")
        if kind == 2:
            own, k = _vint(head, k)
            full, k = _vint(head, k)
            _, k = _vint(head, k)
            k += 4 if own & 2 else 0
            crc = struct.unpack_from("<I", head, k)[0] if own & 4 else None
            k += 4 if own & 4 else 0
            method, k = _vint(head, k)
            _, k = _vint(head, k)
            n, k = _vint(head, k)
            raw = head[k : k + n]
            yield ordinal, raw.decode("utf-8", "replace"), raw, None if own & 8 else full, data, crc, not method >> 7 & 7, False, bool(own & 1), begin
            ordinal += 1
        if kind == 5:
            return
        at += end + data


def _rar4(f, at: int, size: int):
    ordinal = 0
    while at + 7 <= size:
        head = f.read_at(min(1 << 16, size - at), at)
        crc, kind, flags, length = struct.unpack_from("<HBHH", head)
        if length < 7 or len(head) < length or zlib.crc32(head[2:length]) & 0xFFFF != crc:
            raise ValueError("a block of a rar archive is broken")
        data = struct.unpack_from("<I", head, 7)[0] if flags & 0x8000 or kind == 0x74 else 0
        if kind == 0x73 and flags & 0x80:
            raise ValueError("the names of a rar archive are encrypted")
        if kind == 0x74:
            full, _, crc32, _, _, method, n, _ = struct.unpack_from("<IBIIBBHI", head, 11)
            k = 32
            if flags & 0x100:
                high, top = struct.unpack_from("<II", head, k)
                data, full, k = data | high << 32, full | top << 32, k + 8
            raw = head[k : k + n].split(b"\0")[0]
            yield ordinal, raw.decode("utf-8", "replace").replace("\\", "/"), raw, full, data, crc32, method == 0x30, bool(flags & 4), flags & 0xE0 == 0xE0, at
            ordinal += 1
        if kind == 0x7B:
            return
        at += length + data


def rar_entries(paths: DataFrame) -> DataFrame:
    """Entries of rar archives (path), by following their blocks from head to head; data are skipped."""

    def walk(path: str, at: int, data: bytes, size: int):
        if data[:7] != b"Rar!\x1a\7\1" and data[:7] != b"Rar!\x1a\7\0":
            raise ValueError("no rar archive")
        with _open(path) as f:
            yield from _rar5(f, 8, size) if data[6] == 1 else _rar4(f, 7, size)

    return _each(fetched(paths.select("path", F.lit(0).alias("at"), F.lit(8).alias("length"))), ENTRY, walk)


# disc images -------------------------------------------------------------------------------------

SECTOR = 2048
_PLACE = "path string, at long, length long, rest string, error string"


def _root(path: str, at: int, data: bytes, size: int):
    if data[:6] != b"\1CD001":
        raise ValueError("no ISO 9660 volume")
    begin, length = struct.unpack_from("<I", data, 158)[0], struct.unpack_from("<I", data, 166)[0]
    yield begin * SECTOR, length, None


def _below(want: str, is_dir: bool):
    def step(path: str, at: int, data: bytes, size: int):
        for sector in range(0, len(data), SECTOR):
            k = sector
            while k < len(data) and data[k]:
                begin, length = struct.unpack_from("<I", data, k + 2)[0], struct.unpack_from("<I", data, k + 10)[0]
                name = data[k + 33 : k + 33 + data[k + 32]].split(b";")[0].decode("latin-1").rstrip(".")
                if name.upper() == want.upper().rstrip(".") and bool(data[k + 25] & 2) == is_dir:
                    yield begin * SECTOR, length, None
                    return
                k += data[k]
        raise ValueError(f"no {want}")

    return step


def disc_files(paths: DataFrame, inner: str, most: int = 1 << 20) -> DataFrame:
    """(path, inner, at, length, data, error): a file of ISO 9660 images by its path in them, at most ``most`` bytes of it.

    One step for each part of the path, each reading one directory; case and version marks are ignored.
    """
    where = _each(fetched(paths.select("path", F.lit(16 * SECTOR).alias("at"), F.lit(SECTOR).alias("length"))), _PLACE, _root)
    failed = where.where("error is not null").select("path", "error")
    parts = inner.split("/")
    for k, part in enumerate(parts):
        where = _each(fetched(where.where("error is null")), _PLACE, _below(part, k < len(parts) - 1))
        failed = failed.union(where.where("error is not null").select("path", "error"))
    found = where.where("error is null")
    got = fetched(found.withColumn("length", F.least("length", F.lit(most))))
    out = got.select("path", F.lit(inner).alias("inner"), "at", F.octet_length("data").cast("long").alias("length"), "data", "error")
    return out.unionByName(failed.withColumn("inner", F.lit(inner)), allowMissingColumns=True)


def boot_serial(cnf: Column) -> Column:
    """The serial that a SYSTEM.CNF (bytes) boots, such as ``SLUS_012.34``; null without one."""
    text = F.decode(cnf, "ISO-8859-1")
    return F.nullif(F.upper(F.regexp_extract(text, r"(?im)^\s*BOOT2?\s*=\s*cdrom0?:\\*(?:[^\s;\\]*\\)*([a-z]{4}[_-][0-9]{3}\.?[0-9]{2})", 1)), F.lit(""))


# packed file systems and frames ------------------------------------------------------------------


def package_entries(paths: DataFrame) -> DataFrame:
    """(path, ordinal, inner, at, size, error): files of PFS0 packages (path), from their head alone."""

    def step(path: str, at: int, data: bytes, size: int):
        if data[:4] != b"PFS0":
            raise ValueError("no PFS0 package")
        n, names = struct.unpack_from("<II", data, 4)
        begin = 16 + 24 * n
        if len(data) < min(size, begin + names):
            raise ValueError("the head of a package is larger than was read")
        for k in range(n):
            place, length, name = struct.unpack_from("<QQI", data, 16 + 24 * k)
            raw = data[begin + name : data.find(b"\0", begin + name)]
            yield k, raw.decode("utf-8", "replace"), begin + names + place, length

    heads = fetched(paths.select("path", F.lit(0).alias("at"), F.lit(1 << 18).alias("length")))
    return _each(heads, "path string, ordinal int, inner string, at long, size long, error string", step)


def frame_sizes(paths: DataFrame) -> DataFrame:
    """(path, content, checksum, error): the size that the first frame of a zstd file states, null where it states none."""

    def step(path: str, at: int, data: bytes, size: int):
        if data[:4] != b"\x28\xb5\x2f\xfd":
            raise ValueError("no zstd frame")
        told = data[4]
        single = told >> 5 & 1
        k = 5 + (1 - single) + (0, 1, 2, 4)[told & 3]
        width = (single, 2, 4, 8)[told >> 6]
        if len(data) < k + width:
            raise ValueError("a zstd frame is cut off")
        content = int.from_bytes(data[k : k + width], "little") + 256 * (width == 2)
        yield content if width else None, bool(told & 4)

    heads = fetched(paths.select("path", F.lit(0).alias("at"), F.lit(18).alias("length")))
    return _each(heads, "path string, content long, checksum boolean, error string", step)


# key tables --------------------------------------------------------------------------------------


def sfo_values(files: DataFrame) -> DataFrame:
    """(path, key, value, error): the keys of PARAM.SFO files (path, data); texts, and whole numbers as text.

    An entry that points outside its file is left out; a file that isn't one is a row with an error.
    """

    def entries(path: str, at: int, data: bytes, size: int):
        if data is None or data[:4] != b"\0PSF":
            raise ValueError("no key table")
        keys, values, n = struct.unpack_from("<III", data, 8)
        for k in range(min(n, (len(data) - 20) // 16)):
            key, kind, length, _, value = struct.unpack_from("<HHIII", data, 20 + 16 * k)
            name, raw = data[keys + key : data.find(b"\0", keys + key)], data[values + value : values + value + length]
            if len(raw) < length or not name:
                continue
            yield name.decode("latin-1"), str(int.from_bytes(raw[:4], "little")) if kind == 0x0404 else raw.split(b"\0")[0].decode("utf-8", "replace")

    rows = files.select("path", F.lit(0).cast("long").alias("at"), "data", F.octet_length("data").cast("long").alias("size"), F.lit(None).cast("string").alias("error"))
    return _each(rows, "path string, key string, value string, error string", entries)
