from pyspark.sql import functions as F

from shelfmark.operators import device as D
from shelfmark.operators import evidence as E
from shelfmark.operators import matching
from shelfmark.storage import shared_dir


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


MEMBERS = "variant string, key string, is_file boolean, len long"


def chain(spark):
    members = spark.createDataFrame(
        [
            ("v1", "lib/PS/a (Disc 1).iso", True, 10), ("v1", "lib/PS/a (Disc 2).iso", True, 20), ("v1", "lib/PS/readme.txt", True, 1),
            ("v2", "lib/GB/b.7z", True, 5), ("v3", "lib/GB/big.gb", True, 2000), ("v4", "lib/GB/dir", False, None), ("v5", "lib/gb/B.gb", True, None),
            ("v6", "lib/XX/moved.bin", True, 7), ("v7", "lib/PS/c (Disc 1).iso", True, 3000), ("v7", "lib/PS/c (Disc 2).iso", True, 3), ("v8", "lib/GB/kept.gb", True, 4), ("v8", "lib/GB/kept.gb", True, 4),
        ],
        MEMBERS,
    )
    decisions = spark.createDataFrame([("lib/GB/b.7z", "convert", "GB/b.gb", 9), ("lib/GB/kept.gb", "as is", "x", 1), (None, "convert", "no", 1)], "key string, decision string, target string, bytes long")
    places = spark.createDataFrame([("v6", "YY")], "variant string, directory string")
    files = D.screened(D.desired_files(members, decisions, places), 1000)
    discs = spark.createDataFrame([("v1", "lib/PS/a (Disc 2).iso", 2), ("v1", "lib/PS/a (Disc 1).iso", 1), ("v7", "lib/PS/c (Disc 1).iso", 1), ("v7", "lib/PS/c (Disc 2).iso", 2), ("v8", "lib/GB/kept.gb", 1)], "variant string, key string, disc int")
    mains = spark.createDataFrame([("v1", "lib/PS/a (Disc 1).iso"), ("v2", "lib/GB/b.7z"), ("v3", "lib/GB/big.gb"), ("v4", "lib/GB/dir"), ("v5", "lib/gb/B.gb"), ("v6", "lib/XX/moved.bin"), ("v7", "lib/PS/c (Disc 1).iso"), ("v8", "lib/GB/kept.gb")], "variant string, key string")
    return members, files, discs, mains


def test_files_screened(spark):
    members, files, _, mains = chain(spark)
    got = {r.source: (r.path, r.bytes, r.converted, r.unreadable, r.reason) for r in files.collect()}
    assert got["lib/GB/b.7z"] == ("GB/b.gb", 9, True, False, None)
    assert got["lib/gb/B.gb"] == ("gb/B.gb", 0, False, True, "collides")
    assert got["lib/GB/big.gb"][4] == "too big" == got["lib/PS/c (Disc 1).iso"][4]
    assert got["lib/XX/moved.bin"][0] == "YY/moved.bin" and len(got) == len(files.collect()) == 10
    assert rows(D.empty_variants(mains.select("variant"), members)) == [("v4",)]


def test_launching_follows_what_was_rejected(spark):
    _, files, discs, mains = chain(spark)
    lists = D.playlists_of(files, discs)
    assert rows(lists) == [("v1", "PS/a.m3u", "a (Disc 1).iso\na (Disc 2).iso")]
    none = spark.createDataFrame([(None,)], "path string")
    told = {r.variant: (r.launch, r.left_off) for r in D.launching(mains, files, lists, none).collect()}
    assert told == {"v1": ("PS/a.m3u", None), "v2": ("GB/b.gb", None), "v3": (None, "rejected: too big"), "v4": (None, None), "v5": (None, "rejected: collides"), "v6": ("YY/moved.bin", None), "v7": (None, "rejected: too big"), "v8": (None, None)}
    gone = spark.createDataFrame([("PS/a.m3u",), ("GB/b.gb",), ("GB/kept.gb",), ("GB/kept.gb",)], "path string")
    told = {r.variant: (r.launch, r.left_off) for r in D.launching(mains, files, lists, gone).collect()}
    assert {v for v, (_, why) in told.items() if why == "gone"} == {"v1", "v2", "v8"}


def test_media_are_named_after_what_starts(spark):
    _, files, discs, mains = chain(spark)
    on_card = D.launching(mains, files, D.playlists_of(files, discs), spark.createDataFrame([], "path string")).join(mains, "variant")
    media = [("v1", 0, 1, "cover", "h1", "png", 5), ("v1", 1, 1, "cover", "h2", "png", 6), ("v2", 1, 1, "cover", "h2", "png", 6), ("v3", 0, 1, "cover", "h3", "png", 1), ("v8", 0, 1, "other", "h4", "png", 1), ("v8", 0, 2, "video", "h5", None, None), ("v8", 1, 1, "cover", "h2", "png", 6), ("v8", 1, 1, "cover", "h2", "png", 6)]
    df = spark.createDataFrame(media, "variant string, anchor int, ordinal int, kind string, hash string, ext string, bytes long")
    got = rows(D.media_laid(df, on_card).select("variant", "hash", "path", "state"))
    assert got == sorted([("v1", "h1", "media/PS/covers/a.png", "laid"), ("v1", "h2", "media/PS/covers/a.png", "crowded out"), ("v2", "h2", "media/GB/covers/b.png", "laid"), ("v8", "h4", None, "unknown kind"), ("v8", "h5", None, "not in the pool"), ("v8", "h2", "media/GB/covers/kept.png", "laid")], key=str)
    shared = rows(D.media_laid(df, on_card, by_name=False).where("hash = 'h2'").select("variant", "path", "state"))
    assert shared == [("v1", "media/h2/h2.png", "laid"), ("v2", "media/h2/h2.png", "shared"), ("v8", "media/h2/h2.png", "shared")]
    assert D.media_laid(df.limit(0), on_card).count() == 0


def test_layers_read_only_what_is_open(spark):
    n = 2000
    items = spark.range(n).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 40).cast("int").alias("part")).union(spark.createDataFrame([(None, 3)], "key string, part int"))
    path = f"{shared_dir(spark)}/contents-test"
    spark.range(n).select(F.concat(F.lit("k"), "id").alias("key"), F.concat(F.lit("c"), F.col("id") % 7).alias("entry"), (F.col("id") % 40).cast("int").alias("part")).where("substring(key, 2) % 3 <> 1").write.mode("overwrite").partitionBy("part").parquet(path)
    contents = spark.read.parquet(path)
    names = spark.range(n).where("id % 40 not in (5, 6)").select(F.concat(F.lit("k"), "id").alias("key"), F.concat(F.lit("n"), F.col("id")).alias("entry"))
    seen = []

    def by_contents(open_):
        seen.append(E.cut_to(contents, "part", open_, "key").select("key", "entry"))
        return seen[-1]

    got = E.layered(items, "key", [("name", lambda o: names.join(o.select("key"), "key", "left_semi")), ("contents", by_contents)])
    assert rows(got) == rows(matching.cascade(items.distinct(), "key", [("name", names), ("contents", contents.select("key", "entry"))]))
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert any(f"PartitionFilters: [part#{k.split(' ')[0]} IN ({x})" in plan for k in plan.split("PartitionFilters: [part#")[1:] for x in ("5,6", "6,5"))
    assert E.layered(items, "key", []).where("layer <> 'unmatched'").count() == 0
