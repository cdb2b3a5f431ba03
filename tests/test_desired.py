"""What devices should hold, on small tables of hard cases: missing values, ties, repeats, empty tables."""

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.operators import desired as W


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


FILES = "platform string, path string, entries long, inner_bytes long, largest long, inner_name string"


def test_decisions(spark):
    matrix = spark.createDataFrame([("GBA", ["gba"], "unpack"), ("gba", ["zip"], None), ("ps", None, "rezip"), (None, ["never"], None), ("Md", ["zip"], "rezip")], "platform string, accepts array<string>, recipe string")
    cases = {
        ("Gba", "r/x/a.GBA", None, None, None, None): ("as is", None, "x/a.GBA"),
        ("gba", "r/x/a.zip", 1, 5, 5, "in/b.gba"): ("convert", None, "x/b.gba"),
        ("gba", "r/a.zip", 2, 5, 5, "b.gba"): ("unsupported", "several entries", None),
        ("gba", "r/a.zip", 1, 5, 5, None): ("unsupported", "no name", None),
        ("gba", "r/a.zip", 1, 5, 5, "b.rar"): ("unsupported", "inside not wanted", None),
        ("gba", "r/a.zip", None, None, None, None): ("unsupported", "contents unknown", None),
        ("gba", "r/a", None, None, None, None): ("unsupported", "not a container", None),
        ("gba", "r/a.rar", 1, 5, 5, "b.gba"): ("unsupported", "can't be unpacked", None),
        ("gba", "r/a.7z", 0, 0, 0, None): ("unsupported", "nothing inside", None),
        ("PS", "r/a.iso", None, None, None, None): ("unclaimed", None, "a.iso"),
        ("md", "r/v1.2/a.b.7z", 3, 10, 5, "x"): ("convert", None, "v1.2/a.b.zip"),
        ("md", "r/a.7z", 3, 2**32, 5, "x"): ("unsupported", "too big", None),
        ("md", "r/a.7z", 65536, 10, 5, "x"): ("unsupported", "too many entries", None),
        (None, "r/a.zip", None, None, None, None): ("unclaimed", None, "a.zip"),
        ("other", None, None, None, None, None): ("unclaimed", None, None),
    }
    files = spark.createDataFrame(list(cases), FILES)
    got = {tuple(r)[:6]: tuple(r)[6:] for r in W.decided(files, matrix).collect()}
    assert got == cases
    told = {r.path: r.decision for r in W.decided(files.where("platform is null or platform = 'other'"), matrix.limit(0), (["zip"], None)).collect()}
    assert told == {"r/a.zip": "as is", None: "unsupported"}
    assert rows(W.decided(files.limit(0), matrix)) == []


def test_seconds(spark):
    df = spark.createDataFrame([("unpack", 80 * 2**20), ("rezip", 50 * 2**20), ("other", 1), (None, 1)], "r string, b long")
    assert [r[0] for r in df.select(W.seconds(F.col("r"), F.col("b"))).collect()] == [1.0, 2.0, None, None]


def test_directories_are_spelled_alike(spark):
    paths = spark.createDataFrame([(1, "GB/Rpg/a"), (2, "gb/RPG/b"), (3, "gb/rpg/b"), (4, "top"), (5, "Gb/c"), (6, None), (7, "GB/Rpg/a"), (8, "É/x"), (9, "é/y")], "id int, path string")
    out = {r.id: r.aligned for r in W.aligned(paths, spark.createDataFrame([("gB",), (None,)], "path string")).collect()}
    assert out == {1: "gB/Rpg/a", 2: "gB/Rpg/b", 3: "gB/Rpg/b", 4: "top", 5: "gB/c", 6: None, 7: "gB/Rpg/a", 8: "É/x", 9: "É/y"}
    assert rows(W.aligned(paths.limit(0), paths.select("path"))) == []


def test_recorded_directories_speak_for_their_whole_path(spark):
    paths = spark.createDataFrame([("a/b/f1",), ("X/b/f2",), ("X/b/C/f3",), ("x/B/c/f4",), ("n/m/f5",), ("N/M/f6",)], "path string")
    dirs = spark.createDataFrame([("A/b",), ("a/B",), ("x/B",)], "path string")
    assert {r.path: r.aligned for r in W.aligned(paths, dirs).collect()} == {"a/b/f1": "a/B/f1", "X/b/f2": "x/B/f2", "X/b/C/f3": "x/B/C/f3", "x/B/c/f4": "x/B/C/f4", "n/m/f5": "N/M/f5", "N/M/f6": "N/M/f6"}


def test_standalone(spark):
    items = spark.createDataFrame([(k, k == "e") for k in "abcdefg"] + [(None, None)], "key string, named boolean")
    kinds = spark.createDataFrame([("a", "patch"), ("a", "patch"), ("b", "extra"), ("c", "patch"), ("c", "extra"), ("d", "patch"), ("d", None), ("e", None), ("f", "whole"), (None, "patch")], "key string, kind string")
    assert rows(W.standalone(items, kinds, F.col("named"))) == [("a", "patch"), ("b", "extra"), ("c", "runs"), ("d", "runs"), ("e", "patch"), ("f", "runs"), ("g", "runs"), (None, "runs")]


def test_serials_keep_the_most_trusted_evidence(spark):
    found = spark.createDataFrame([(1, 2, "AB12", [], True), (1, 1, "AB12", None, False), (2, 1, "AB12", ["x"], True), (3, 1, "AB12", ["y"], True), (4, 1, None, [], True), (5, 1, "AB13", [], None)], "item int, ordinal int, serial string, platforms array<string>, sure boolean")
    hits = spark.createDataFrame([("AB12", "x", "s", "g", "ab-12"), ("AB13", None, "s", "h", "AB13-long"), (None, "x", "s", "n", "n")], "serial string, platform string, source string, game string, shown string")
    assert rows(W.serial_candidates(found, hits)) == [(1, "s", "g", 1, False, "medium"), (2, "s", "g", 1, True, "high"), (5, "s", "h", 1, False, "medium")]


def test_containers_none_tried(spark):
    df = spark.createDataFrame([("zip", "unread", None, None, None, None), (None, "opened", True, 2, 9, 1)], "kind string, state string, solid boolean, inner_files long, inner_bytes long, without_crc long")
    assert rows(W.container_summary(df)) == [("zip", 1, 0, 0, 1, 0, 0, 0, 0, None), (None, 1, 1, 0, 0, 1, 2, 9, 1, 1.0)]


def test_totals_tell_null_groups_from_all(spark):
    df = spark.createDataFrame([("p", None, 1), (None, "s", 2)], "platform string, source string, games int")
    assert rows(W.reference_totals(df, ["platform", "source"], ["games"])) == [("all", None, 2, 3), ("platform", "p", 1, 1), ("platform", None, 1, 2), ("source", "s", 1, 2), ("source", None, 1, 1)]


def test_memberships_without_a_landing(spark):
    items = spark.createDataFrame([("k", "h"), ("l", None)], "item string, print string")
    m = spark.createDataFrame([("fav", "k", None), ("fav", None, "h"), ("fav", "gone", None), ("fav", "gone", "h"), ("old", None, "lost"), ("old", None, None)], "name string, item string, print string")
    assert rows(W.unresolved(m, items)) == [("fav", "gone", None), ("old", None, "lost"), ("old", None, None)]
    assert rows(W.unresolved(m.limit(0), items)) == []


def test_globs(spark):
    names = ["x (Disc 1)", "(disc 2)", "x(Disc 3)", "[b](Disc 4)", "x (Disc A)", None, "a (disc 1) (disc 2)", "多（Disc 5)", "x (Diſc 1)"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(T.without_glob_suffix(F.col("n"), "(disc #)")).collect()] == ["x ", "", None, "[b]", None, None, "a (disc 1) ", None, None]
    many = spark.createDataFrame([("Kelvin",), ("Kelvin",), ("kelvi\nn",), ("ab",)], "n string")
    assert [r[0] for r in many.select(T.matches_glob(F.col("n"), "@elv*")).collect()] == [True, False, True, False]
    for bad in ("", "*****"):
        with pytest.raises(ValueError):
            T.matches_glob(F.col("n"), bad)


def test_translators(spark):
    names = {"G [tr zh]": None, "G [tr zh dwt_so]": "dwt_so", "G [tr zh-Hans MS emu]": "MS emu", "G [TR zh x]": None, "G [tr en x][tr chi y]": "y", "G [tr zh][tr zh late]": None, "G (tr zh x)": None, "G": None}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.g for r in df.select("n", T.translation_group(F.col("n")).alias("g")).collect()} == names
