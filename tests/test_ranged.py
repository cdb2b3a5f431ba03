import random
import struct
import zipfile
import zlib

from shelfmark.sources import ranged as R


def vint(n):
    out = bytearray()
    while True:
        out.append(n & 127 | (128 if n > 127 else 0))
        n >>= 7
        if not n:
            return bytes(out)


def rar5_block(kind, body, data=b"", skip=None):
    size = len(data) if skip is None else skip
    inner = vint(kind) + vint(2 if size else 0) + (vint(size) if size else b"") + body
    inner = vint(len(inner)) + inner
    return struct.pack("<I", zlib.crc32(inner)) + inner + data


def rar5_file(name, size, crc, method=3, is_dir=False):
    raw = name.encode()
    return vint(4 | is_dir) + vint(size) + vint(32) + struct.pack("<I", crc) + vint(method << 7) + vint(0) + vint(len(raw)) + raw


def rar4_block(kind, flags, body):
    rest = struct.pack("<BHH", kind, flags, 7 + len(body)) + body
    return struct.pack("<H", zlib.crc32(rest) & 0xFFFF) + rest


def paths(spark, *names):
    return spark.createDataFrame([(str(n),) for n in names], "path string")


def test_zip_entries(spark, tmp_path):
    plain, big, shifted, broken, empty = (tmp_path / f"{n}.zip" for n in ("plain", "big", "shifted", "broken", "empty"))
    rng = random.Random(1)
    with zipfile.ZipFile(plain, "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(300):
            z.writestr(f"dir/文件 {k}.bin", rng.randbytes(k * 7))
        z.writestr("sub/", "")
        z.writestr(zipfile.ZipInfo("stored.txt"), "x" * 99)
        z.comment = b"PK\5\6 in a comment " * 9  # zipfile itself can't read that again
        members = z.infolist()
    with zipfile.ZipFile(empty, "w"):
        pass
    shifted.write_bytes(b"#!/bin/sh stub" * 50 + plain.read_bytes())
    broken.write_bytes(plain.read_bytes()[:-4000])
    got = R.zip_entries(paths(spark, plain, shifted, broken, empty, tmp_path / "none.zip")).collect()
    want = [(k, m.filename, m.file_size, m.compress_size, m.CRC, m.compress_type == 0, m.is_dir()) for k, m in enumerate(members)]
    for p in (plain, shifted):
        mine = sorted((r.ordinal, r.inner, r.size, r.packed, r.crc32, r.stored, r.is_dir) for r in got if r.path == str(p))
        assert mine == want
    assert {(r.path.rsplit("/", 1)[1], r.inner) for r in got if r.error} == {("broken.zip", None), ("none.zip", None)}
    assert not [r for r in got if r.path == str(empty)]


def test_a_sparse_archive_of_five_gigabytes(spark, tmp_path, monkeypatch):
    """The listing of a wide archive reads its tail and directory only."""
    big = tmp_path / "big.zip"
    hole = 5 << 30
    names = [f"disc {k}.iso".encode() for k in range(50)]
    directory = b"".join(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0, 0, 0, 0, k, 0xFFFFFFFF, 0xFFFFFFFF, len(n), 28, 0, 0, 0, 0, 0xFFFFFFFF) + n + struct.pack("<HHQQQ", 1, 24, 6 << 30, 5 << 30, k << 20) for k, n in enumerate(names))
    with open(big, "wb") as f:
        f.seek(hole)
        f.write(directory)
        f.write(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, 50, 50, len(directory), hole))
        f.write(struct.pack("<IIQI", 0x07064B50, 0, hole + len(directory), 1))
        f.write(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
    got = R.zip_entries(paths(spark, big)).orderBy("ordinal").collect()
    assert [(r.inner, r.size, r.packed, r.crc32, r.offset, r.error) for r in got] == [(n.decode(), 6 << 30, 5 << 30, k, k << 20, None) for k, n in enumerate(names)]
    read = R.fetched(paths(spark, big).selectExpr("path", f"-{R.TAIL} as at", f"{R.TAIL} as length")).first()
    assert len(read.data) + len(directory) < 1 << 20 and read.size > 5 << 30
    assert R.fetched(paths(spark, big).selectExpr("path", "0 as at", "2000000000 as length")).first().error


def test_rar_entries(spark, tmp_path):
    five, four, bad, no = (tmp_path / f"{n}.rar" for n in ("five", "four", "bad", "no"))
    with open(five, "wb") as f:  # the first file's data are a hole of 3 GB
        f.write(b"Rar!\x1a\7\1\0" + rar5_block(1, vint(0)) + rar5_block(2, rar5_file("盘/a.iso", 9 << 30, 7), skip=3 << 30))
        f.seek(3 << 30, 1)
        f.write(rar5_block(2, rar5_file("d", 0, 0, 0, True)) + rar5_block(2, rar5_file("b.txt", 3, 8, 0), b"abc") + rar5_block(5, vint(0)))
    name = b"GAME\\c.bin"
    file = struct.pack("<IIBIIBBHI", 4, 10, 0, 99, 0, 29, 0x33, len(name), 0) + name
    four.write_bytes(b"Rar!\x1a\7\0" + rar4_block(0x73, 0, bytes(6)) + rar4_block(0x74, 0x8000, file) + b"data" + rar4_block(0x7B, 0, b""))
    bad.write_bytes(four.read_bytes()[:7] + b"\0" * 60)
    no.write_bytes(b"nothing")
    got = R.rar_entries(paths(spark, five, four, bad, no)).collect()
    rows = sorted((r.path.rsplit("/", 1)[1], r.ordinal, r.inner, r.size, r.packed, r.crc32, r.stored, r.is_dir) for r in got if not r.error)
    assert rows == [("five.rar", 0, "盘/a.iso", 9 << 30, 3 << 30, 7, False, False), ("five.rar", 1, "d", 0, 0, 0, True, True), ("five.rar", 2, "b.txt", 3, 3, 8, True, False), ("four.rar", 0, "GAME/c.bin", 10, 4, 99, False, False)]
    assert {r.path.rsplit("/", 1)[1] for r in got if r.error} == {"bad.rar", "no.rar"}


def record(name, sector, size, is_dir=False):
    raw = name if isinstance(name, bytes) else name.encode()
    n = 33 + len(raw) + (len(raw) + 1) % 2
    out = struct.pack("<BBIIII", n, 0, sector, 0, size, 0) + bytes(7) + bytes([2 if is_dir else 0]) + bytes(6) + bytes([len(raw)]) + raw
    return out.ljust(n, b"\0")


def image(path, files, folders=()):
    """A made-up image: files in the root and in one folder; the content lies past a hole of 4 GB."""
    far = (4 << 30) // R.SECTOR - 100
    root, sub, content = [record(b"\0", 18, 2048, True), record(b"\1", 18, 2048, True)], {}, []
    for k, (name, data) in enumerate(files.items()):
        folder, _, base = name.rpartition("/")
        (sub.setdefault(folder, []) if folder else root).append(record(base, far + k, len(data)))
        content.append((far + k, data))
    for k, folder in enumerate(sub):
        root.append(record(folder, 30 + k, 2048, True))
    with open(path, "wb") as f:
        f.seek(16 * R.SECTOR)
        f.write((b"\1CD001\1".ljust(156, b"\0") + record(b"\0", 18, 2048, True)).ljust(2048, b"\0"))
        f.seek(18 * R.SECTOR)
        f.write(b"".join(root).ljust(2048, b"\0"))
        for k, entries in enumerate(sub.values()):
            f.seek((30 + k) * R.SECTOR)
            f.write(b"".join(entries).ljust(2048, b"\0"))
        for sector, data in content:
            f.seek(sector * R.SECTOR)
            f.write(data)


def sfo(values):
    keys, data, index = b"", b"", b""
    for k, v in values.items():
        raw = struct.pack("<I", v) if isinstance(v, int) else v.encode() + b"\0"
        index += struct.pack("<HHIII", len(keys), 0x0404 if isinstance(v, int) else 0x0204, len(raw), len(raw), len(data))
        keys, data = keys + k.encode() + b"\0", data + raw
    at = 20 + len(index)
    return b"\0PSF" + struct.pack("<IIII", 0x101, at, at + len(keys), len(values)) + index + keys + data


def test_files_on_discs(spark, tmp_path):
    one, two, three, none = (tmp_path / f"{n}.iso" for n in ("one", "two", "three", "none"))
    image(one, {"README.TXT;1": b"x", "SYSTEM.CNF;1": b"BOOT2 = cdrom0:\\SLUS_202.02;1 \r\nVER = 1.00\r\n"})
    image(two, {"system.cnf": b"BOOT=cdrom:\\exe\\SCES-01234;1\n"})
    image(three, {"PSP_GAME/PARAM.SFO;1": sfo({"DISC_ID": "ULUS10339", "TITLE": "名", "PARENTAL_LEVEL": 5})})
    none.write_bytes(b"\0" * 40_000)
    all_ = paths(spark, one, two, three, none)
    cnf = R.disc_files(all_, "SYSTEM.CNF")
    got = {r.path.rsplit("/", 1)[1]: (r.serial, r.error) for r in cnf.select("path", R.boot_serial(cnf.data).alias("serial"), "error").collect()}
    assert got == {"one.iso": ("SLUS_202.02", None), "two.iso": ("SCES-01234", None), "three.iso": (None, "no SYSTEM.CNF"), "none.iso": (None, "no ISO 9660 volume")}
    found = R.disc_files(all_, "PSP_GAME/PARAM.SFO")
    values = {r.key: r.value for r in R.sfo_values(found.where("error is null")).collect()}
    assert values == {"DISC_ID": "ULUS10339", "TITLE": "名", "PARENTAL_LEVEL": "5"}
    assert {r.error for r in found.where("error is not null").collect()} == {"no PSP_GAME", "no ISO 9660 volume"}
    assert R.disc_files(all_, "SYSTEM.CNF", most=5).where("error is null").first().length == 5
    odd = spark.createDataFrame([("a", b"\0PSF" + struct.pack("<IIII", 0, 20, 20, 2**31)), ("b", b"no"), ("c", None)], "path string, data binary")
    assert {(r.path, r.error) for r in R.sfo_values(odd).collect()} == {("b", "no key table"), ("c", "no key table")}
    assert R.zip_entries(all_.limit(0)).count() == 0 == R.disc_files(all_.limit(0), "x").count()


def test_packages_and_frames(spark, tmp_path):
    import zstandard

    nsp, bad, one, two, cut = (tmp_path / n for n in ("a.nsp", "b.nsp", "one.zst", "two.zst", "cut.zst"))
    names = [b"0100.nca", b"0100.tik"]
    table = b"".join(n + b"\0" for n in names).ljust(32, b"\0")
    nsp.write_bytes(b"PFS0" + struct.pack("<III", 2, len(table), 0) + struct.pack("<QQII", 0, 5 << 30, 0, 0) + struct.pack("<QQII", 5 << 30, 704, 9, 0) + table)
    bad.write_bytes(b"XFS0" + bytes(60))
    got = {(r.path.rsplit("/", 1)[1], r.ordinal, r.inner, r.at, r.size) for r in R.package_entries(paths(spark, nsp, bad)).where("error is null").collect()}
    assert got == {("a.nsp", 0, "0100.nca", 96, 5 << 30), ("a.nsp", 1, "0100.tik", 96 + (5 << 30), 704)}
    sizes = [0, 5, 255, 256, 300, 70_000]
    for k, n in enumerate(sizes):
        (tmp_path / f"s{k}.zst").write_bytes(zstandard.ZstdCompressor(write_checksum=k % 2 == 1).compress(b"x" * n))
    one.write_bytes(zstandard.ZstdCompressor(write_content_size=False).compress(b"y" * 999))
    two.write_bytes(b"nothing at all")
    cut.write_bytes(b"\x28\xb5\x2f\xfd\xe0")
    rows = R.frame_sizes(paths(spark, *[tmp_path / f"s{k}.zst" for k in range(len(sizes))], one, two, cut)).collect()
    told = {r.path.rsplit("/", 1)[1]: (r.content, r.checksum, r.error) for r in rows}
    assert [told[f"s{k}.zst"] for k in range(len(sizes))] == [(n, k % 2 == 1, None) for k, n in enumerate(sizes)]
    assert told["one.zst"][0] is None and told["two.zst"][2] == "no zstd frame" and told["cut.zst"][2] == "a zstd frame is cut off"


def test_headers(spark):
    from pyspark.sql import functions as F

    from shelfmark.sources import headers as H

    def made(size=0x200, **at):
        out = bytearray(size)
        for place, raw in at.items():
            k = int(place[1:], 16)
            out[k : k + len(raw)] = raw
        return bytes(out)

    n64 = made(x0=bytes.fromhex("80371240"), x20=b"SUPER GAME 64       ", x3b=b"NSME")
    two = b"".join(n64[k : k + 2][::-1] for k in range(0, len(n64), 2))
    four = b"".join(n64[k : k + 4][::-1] for k in range(0, len(n64), 4))
    gb = lambda flag: made(x104=bytes.fromhex("CEED6666CC0D000B"), x134=b"TETRIS\0junk", x143=flag)
    data = {
        "gba": (made(x4=bytes.fromhex("24FFAE51699AA221"), xa0=b"ADVANCE GAME", xac=b"AXVE", xb0=b"01"), ("GBA", "ADVANCE GAME", "AXVE", "01", None)), "nds": (made(x0=b"DUAL\0", xc=b"ADAE", x10=b"01", x15c=b"\x56\xcf"), ("NDS", "DUAL", "ADAE", "01", None)),
        "gb": (gb(b"\0"), ("GB", "TETRIS", None, None, "no")), "gbc": (gb(b"\xc0"), ("GB", "TETRIS", None, None, "only")), "both": (gb(b"\x80"), ("GB", "TETRIS", None, None, "too")),
        "md": (made(x100=b"SEGA MEGA DRIVE (C)T-81 1992", x120=b"SOME  TITLE", x180=b"GM T-81033 -00"), ("MD", "SOME  TITLE", "GM T-81033 -00", "T-81", None)),
        "n64": (n64, ("N64", "SUPER GAME 64", "NSME", None, None)), "v64": (two, ("N64", "SUPER GAME 64", "NSME", None, None)), "swapped": (four, ("N64", "SUPER GAME 64", "NSME", None, None)),
        "nes": (b"NES\x1a" + bytes(12), ("NES", None, None, None, None)), "none": (b"plain text", None), "empty": (b"", None), "null": (None, None),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in data.items()], "name string, data binary")
    out = df.select("name", H.header_fields(F.col("data")).alias("h"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.name: None if r.h is None else tuple(r.h) for r in out.collect()}
    for k, (_, want) in data.items():
        assert got[k] == want, (k, got[k])
