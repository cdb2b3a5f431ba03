import gzip
import hashlib

import zipfile
import zlib

from pyspark.sql import functions as F

from shelfmark.sources import files, metadata, reference


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_scan_and_archives(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    with zipfile.ZipFile(tmp_path / "a" / "x.zip", "w") as z:
        z.writestr("one.bin", b"12345")
        z.writestr("dir/", b"")
    (tmp_path / "a" / "b" / "bad.zip").write_bytes(b"PK\x03\x04 nothing")
    (tmp_path / "a" / "y.txt.gz").write_bytes(gzip.compress(b"hello"))
    nes = b"NES\x1a" + bytes(12) + b"game"
    (tmp_path / "g.nes").write_bytes(nes)
    (tmp_path / "s.smc").write_bytes(bytes(512) + b"r" * 1024)
    got = files.scan(spark, str(tmp_path), "lib")
    assert {r.key for r in got.collect()} == {"lib/a/x.zip", "lib/a/b/bad.zip", "lib/a/y.txt.gz", "lib/g.nes", "lib/s.smc"}
    raw = files.contents(spark, str(tmp_path))
    members = files.zip_members(files.contents(spark, str(tmp_path), "*.zip")).collect()
    assert {(r.inner, r.size, r.crc32, r.is_dir, r.error) for r in members} == {("one.bin", 5, zlib.crc32(b"12345"), False, None), ("dir/", 0, 0, True, None), (None, None, None, None, "BadZipFile")}
    kinds = {r.p.rsplit("/", 1)[1]: r.k for r in raw.select(F.col("path").alias("p"), files.magic(F.col("content")).alias("k")).collect()}
    assert kinds == {"x.zip": "zip", "bad.zip": "zip", "y.txt.gz": "gzip", "g.nes": "nes", "s.smc": None}
    prints = {r.path.rsplit("/", 1)[1]: r for r in files.fingerprints(raw).collect()}
    assert prints["g.nes"].bare_sha1 == hashlib.sha1(b"game").hexdigest() and prints["g.nes"].crc32 == zlib.crc32(nes)
    assert prints["s.smc"].bare_size == 1024 and prints["x.zip"].bare_crc32 is None


def test_charsets(spark):
    names = ["日本", "中文", "plain", "é"]
    raw = [names[0].encode("utf-8"), names[1].encode("gbk"), b"plain", None]
    df = spark.createDataFrame([(x,) for x in raw], "raw binary")
    assert [r[0] for r in df.select(files.decoded(F.col("raw"))).collect()] == ["日本", "中文", "plain", None]


DAT = """<?xml version="1.0"?><datafile><header><name>x</name></header>
<game name="A (Japan)" cloneof="B"><description>A</description><rom name="a.bin" size="5" crc="CBF53A1C" sha1="AB"/><rom name="b.bin" crc="00000001"/></game>
<game name="Empty"><description>E</description></game></datafile>"""
LIST = """<softwarelist><software name="s1"><description>S</description><info name="serial" value="AB-123"/><part name="cart"><dataarea name="rom"><rom name="r" size="3" crc="ff" sha1="CC" status="baddump"/></dataarea></part></software></softwarelist>"""


def test_reference_files(spark, tmp_path):
    (tmp_path / "d.xml").write_text(DAT)
    (tmp_path / "l.xml").write_text(LIST)
    (tmp_path / "h.txt").write_text("; comment\n" + "a" * 32 + "\tok\tName \"x\"\tSys\n" + "B" * 40 + "\tbad\tOther\tSys\n")
    got = rows(reference.logiqx(spark, str(tmp_path / "d.xml")).select("game", "cloneof", "rom", "size", "crc32", "sha1"))
    assert got == sorted([("A (Japan)", "B", "a.bin", 5, 0xCBF53A1C, "ab"), ("A (Japan)", "B", "b.bin", None, 1, None), ("Empty", None, None, None, None, None)], key=str)
    assert rows(reference.software_list(spark, str(tmp_path / "l.xml")).select("game", "serial", "rom", "size", "crc32", "status")) == [("s1", "AB-123", "r", 3, 255, "baddump")]
    assert rows(reference.hash_table(spark, str(tmp_path / "h.txt")).select("name", "md5", "sha1")) == sorted([('Name "x"', "a" * 32, None), ("Other", None, "b" * 40)], key=str)
    entries = spark.createDataFrame([("g", "SLUS-00001, slus 00001 / 12 ; ab")], "game string, serial string")
    assert rows(reference.serials(entries, "serial")) == [("g", "SLUS00001", "SLUS-00001")]


def test_titles(spark, tmp_path):
    (tmp_path / "us.json").write_text('{"01a": {"name": "Name", "publisher": "P", "languages": ["en", "fr"]}, "02b": {"languages": ["en"]}}')
    (tmp_path / "jp.json").write_text('{"01a": {"name": "名前", "publisher": "Q", "languages": ["ja", "en"]}, "02b": {"name": "二", "publisher": null}}')
    both = reference.titles(spark, str(tmp_path / "us.json"), "US").union(reference.titles(spark, str(tmp_path / "jp.json"), "JP"))
    got = rows(reference.best_title(both, ["US", "JP"]).select("title_id", "name", "publisher", "languages", "regions"))
    assert got == [("01A", "Name", "P", ["en", "fr", "ja"], ["JP", "US"]), ("02B", "二", None, ["en"], ["JP", "US"])]


def test_infobox(spark):
    box = "{{Infobox\n|name= X \n|alias={\n[First]\n[en|Second]\n}\n|empty=\n}}"
    df = spark.createDataFrame([(box,)], "b string")
    one = df.select(*[reference.infobox_values(F.col("b"), k) for k in ("name", "alias", "empty", "none")]).first()
    assert list(one) == [["X"], ["First", "Second"], [], []]


def test_gamelist_round_trip(spark, tmp_path):
    xml = "<gameList><game><path>./a.zip</path><name>A &amp; B</name><rating>0.8</rating><releasedate>19940517T000000</releasedate><players>1-4</players></game><game><path>./b.zip</path><rating>7</rating><players>x</players><favorite>true</favorite></game></gameList>"
    (tmp_path / "g.xml").write_text(xml)
    read = metadata.gamelist(spark, str(tmp_path / "g.xml")).drop("file")
    typed = {r.path: r for r in metadata.typed(read).collect()}
    assert typed["./a.zip"].rating == 0.8 and tuple(typed["./a.zip"].releasedate) == (1994, 5, 17) and tuple(typed["./a.zip"].players) == (1, 4)
    assert typed["./b.zip"].rating is None and typed["./b.zip"].players is None and typed["./b.zip"].favorite
    metadata.write_gamelist(read, str(tmp_path / "out"))
    assert rows(metadata.gamelist(spark, str(tmp_path / "out")).drop("file")) == rows(read)


def test_key_values_round_trip(spark, tmp_path):
    text = "collection: X\n# note\n\ngame: One\nfile: a.bin\ndescription: first\n  second\n  .\n  third\n\nGame: Two\nx-id: 4\n"
    (tmp_path / "m.txt").write_text(text)
    read = metadata.key_values(spark, str(tmp_path / "m.txt"))
    want = [(0, "collection", "X"), (1, "game", "One"), (1, "file", "a.bin"), (1, "description", "first\nsecond\n\nthird"), (2, "game", "Two"), (2, "x-id", "4")]
    assert [tuple(r) for r in read.orderBy("ordinal").select("entry", "key", "value").collect()] == want
    metadata.write_key_values(read.withColumn("p", F.lit("x")), str(tmp_path / "out"), "p")
    again = metadata.key_values(spark, str(tmp_path / "out" / "p=x"))
    assert [tuple(r) for r in again.orderBy("ordinal").select("entry", "key", "value").collect()] == want


def test_json(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    metadata.export_json(df, str(tmp_path / "j"))
    (tmp_path / "j" / "more.txt").write_text('{"k": 3, "v": "c"}\nnot json\n')
    got = metadata.import_json(spark, str(tmp_path / "j"), "k int, v string").collect()
    assert sorted((r.k, r.v) for r in got if r.bad is None) == [(1, "a"), (2, None), (3, "c")] and [r.bad for r in got if r.bad] == ["not json"]
