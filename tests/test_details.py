"""Detail operators on small tables of hard cases: missing values, ties, repeats, empty tables."""

from pyspark.sql import functions as F

from shelfmark.operators import details as D


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_verdict_on_content_needs_every_unit_settled(spark):
    items = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "key string")
    units = spark.createDataFrame([("a", 2, "x", None), ("a", 1, "y", None), ("b", 1, "y", None), ("b", 2, None, None), ("c", 1, None, "no disc")], "key string, ordinal int, print string, reason string")
    content = spark.createDataFrame([("y", "good"), ("y", "fine"), (None, "never")], "print string, verdict string")
    path = spark.createDataFrame([("b", "by hand"), ("a", "unused"), (None, "never")], "key string, verdict string")
    assert rows(D.first_verdict(items, units, content, path)) == [("a", "fine", "content"), ("b", "by hand", "path")]
    assert rows(D.first_verdict(items.limit(0), units, content, path)) == []


def test_candidates_with_unknown_exactness(spark):
    df = spark.createDataFrame([(1, True, None), (2, True, True), (3, None, False)], "id int, exact boolean, odd boolean")
    out = D.candidates(df, F.col("exact"), {"odd": F.col("odd")}).select("id", "accepted", "confidence", "doubts")
    assert rows(out) == [(1, True, "high", ""), (2, False, "medium", "odd"), (3, False, "medium", "")]


def test_undo_gives_back_what_was_there(spark):
    before = spark.createDataFrame([(1, "a"), (2, None), (4, "kept")], "key int, v string")
    stash = D.stashed(before, spark.createDataFrame([(1,), (1,), (2,), (3,)], "key int"), "key", 9)
    after = spark.createDataFrame([(1, "new"), (2, "new"), (3, "new"), (4, "kept")], "key int, v string")
    exist = spark.createDataFrame([(1,), (2,), (3,)], "key int")
    assert rows(D.restored(after, stash, exist, "key", 9)) == [(1, "a"), (2, None), (4, "kept")]
    assert rows(D.restored(after, stash, exist.where("key <> 1"), "key", 9)) == [(2, None), (4, "kept")]
    assert rows(D.restored(after, stash, exist, "key", 8)) == rows(after)


def test_images_hold_any_column(spark):
    """Columns had, batch, image and key are the rows' own; a batch that was stashed twice is given back once."""
    before = spark.createDataFrame([(1, 5, 7, "i", "k"), (2, None, None, None, None)], "id int, had int, batch int, image string, key string")
    stash = D.stashed(before, spark.createDataFrame([(1,), (2,), (None,)], "id int"), "id", 9)
    after = before.selectExpr("id", "0 as had", "0 as batch", "'x' as image", "'y' as key")
    exist = before.select("id")
    assert rows(D.restored(after, stash.union(stash), exist, "id", 9)) == rows(before)


def test_redo_only_of_what_was_undone(spark):
    log = spark.createDataFrame([("k", 1), ("k", 2)], "key string, batch int")
    assert rows(D.redone(log, log.where("batch = 1"), 2, 3)) == [("k", 1), ("k", 2)]
    assert rows(D.redone(log, log.where("batch = 2"), 2, 3)) == [("k", 1), ("k", 2), ("k", 3)]


def test_merge_moves_once(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), (None, 3)], "g string, v int")
    assert rows(D.merged_into(df, "g", df.where("g = 'b'"), "a")) == [("a", 1), ("a", 2), (None, 3)]
    names = spark.createDataFrame([("b", "One"), ("b", "one"), ("b", "TWO"), ("b", None)], "g string, t string")
    assert rows(D.kept_aliases(spark.createDataFrame([("a", "Two")], "g string, t string"), names, "g", "t", "a")) == [("a", "One"), ("a", "Two")]


def test_preferred_told_one_must_be_a_member(spark):
    m = spark.createDataFrame([("g", "b", 1), ("g", "a", 1), ("g", "c", None), ("h", "z", 5), (None, "n", 1)], "g string, m string, r int")
    told = spark.createDataFrame([("g", "c"), ("h", "gone"), (None, "n")], "g string, m string")
    assert rows(D.preferred(m, told, "g", "m", [F.col("r")])) == [("g", "c"), ("h", "z"), (None, "n")]
    assert rows(D.preferred(m, told.limit(0), "g", "m", [F.col("r")])) == [("g", "a"), ("h", "z"), (None, "n")]


def test_media_of_a_shared_folder_by_stem_only(spark):
    mains = spark.createDataFrame([(1, "d", "One", "One.iso"), (2, "d", "two", "two.iso"), (3, "e", "x", "x.iso")], "item int, folder string, stem string, name string")
    files = spark.createDataFrame([("d", "ONE", "ONE.png"), ("d", "cover", "cover.png"), ("d", "two", "two.iso"), ("e", "cover", "cover.png"), ("e", "X", "X.png"), (None, "x", "x.png")], "folder string, stem string, name string")
    assert rows(D.matched_media(mains, files)) == [(1, "ONE.png", "stem"), (3, "X.png", "stem"), (3, "cover.png", "folder")]


def test_kinds_without_any(spark):
    df = spark.createDataFrame([("a", None), ("b", "x"), ("b", None), ("c", "y"), ("c", "x"), ("c", "x")], "g string, k string")
    assert rows(D.kinds_of(df, "g", "k")) == [("a", "unknown"), ("b", "x,unknown"), ("c", "x,y")]


def test_files_taken_back_only_with_the_expected_stamp(spark):
    manifest = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", None)], "path string, stamp int")
    s = spark.createDataFrame([("a", "changed", 1, 5), ("a", "changed", 1, 4), ("b", "changed", 2, 5), ("c", "gone", 1, 5), ("d", "changed", None, 7)], "path string, kind string, expected int, found int")
    assert rows(D.taken_back(manifest, s)) == [("a", 5, 1), ("b", 1, None), ("c", 1, None), ("d", None, None)]


def test_findings_of_an_empty_table(spark):
    df = spark.createDataFrame([(1, True), (2, None)], "id int, odd boolean")
    assert rows(D.findings(df, {"odd": F.col("odd")}, [F.col("id")], 3, ["id"])) == [("odd", 1, 1, 1)]
    assert rows(D.findings(df.limit(0), {"odd": F.col("odd")}, [F.col("id")], 3, ["id"])) == []


def test_merge_plan(spark):
    frame = spark.createDataFrame
    variants = frame([("a", "Old"), ("b", "New"), ("c", None), ("d", "Old"), ("e", "Other")], "key string, work string")
    identified = frame([("a", "JP", "s1"), ("c", "EU", None), ("d", "US", "s4")], "key string, region string, serial string")
    verdicts = frame([("pa", "release", "said", "sv"), ("d", "not a game", "x", "y"), (None, "release", "n", "n")], "anchor string, decision string, region string, serial string")
    prints = frame([("a", "pa"), ("b", "pb"), ("c", None), (None, "pn")], "key string, print string")
    moving = frame([("a",), ("a",), ("b",), ("c",), ("d",), ("e",), ("gone",), (None,)], "key string")
    got = rows(D.merge_plan(variants, identified, verdicts, prints, moving, "New", ["region", "serial"]))
    assert got == sorted(
        [
            ("a", "moved", "pa", "New", "said", "sv", "Old", True), ("b", "held", None, None, None, None, None, None), ("c", "moved", "c", "New", "EU", None, None, False),
            ("d", "moved", "d", "New", "US", "s4", "Old", True), ("e", "moved", "e", "New", None, None, "Other", False), ("gone", "unknown", None, None, None, None, None, None),
        ],
        key=str,
    )
    assert D.merge_plan(variants, identified, verdicts, prints, moving.limit(0), "New", ["region"]).count() == 0
