import pytest
from pyspark.sql import functions as F

from shelfmark.streaming import pending as P

LOG = "id long, by string, item string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_marks(spark):
    log = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "z"), (4, None, "n"), (5, "a", "x")], LOG)
    none = spark.createDataFrame([], "by string, mark long")
    first = P.pending(log, none)
    assert rows(first) == rows(log)
    seen = first.where("id <= 4")  # one more comes while the work runs
    marks = P.marked(seen)
    assert rows(marks) == sorted([("a", 2), ("b", 3), (None, 4)], key=str)
    assert rows(P.pending(log, marks)) == [(5, "a", "x")]
    again = marks.union(spark.createDataFrame([("a", 1)], "by string, mark long"))  # an old run settles late
    assert rows(P.pending(log, again)) == [(5, "a", "x")]
    assert rows(P.counts(log, marks)) == sorted([("a", 3, 1), ("b", 1, 0), (None, 1, 0)], key=str)
    keys = spark.createDataFrame([("x",), ("x",)], "item string")
    assert rows(P.forgotten(log, keys, "item", marks)) == sorted([(1, "a", "x"), (2, "a", "y"), (3, "b", "z"), (4, None, "n")], key=str)
    assert P.pending(log.limit(0), marks).count() == 0


def test_runs_that_are_cut_off_lose_and_repeat_nothing(spark, tmp_path):
    """Two interleaved writers, a run that dies after writing half of its result, and one that dies before its mark is set."""
    log, into, checkpoint = (str(tmp_path / n) for n in ("log", "into", "checkpoint"))
    append = lambda *ids: spark.createDataFrame([(i, "a" if i % 2 else "b", f"item {i}") for i in ids], LOG).coalesce(1).write.mode("append").parquet(log)
    seen = lambda: sorted(r.id for r in spark.read.schema(LOG + ", shout string").parquet(into).collect())
    work = lambda df: df.withColumn("shout", F.upper("item"))
    append(1, 2, 3), append(4)
    assert P.consumed(spark, log, LOG, into, checkpoint, work) == 1 and seen() == [1, 2, 3, 4]
    append(5, 6), append(7)

    def dies_in_work(df):
        df.where("id = 5").withColumn("shout", F.lit("half")).write.mode("overwrite").parquet(f"{into}/batch=1")
        raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        P.consumed(spark, log, LOG, into, checkpoint, dies_in_work)
    append(8)  # after the batch was fixed: it belongs to the next

    def dies_after_writing(df):
        work(df).write.mode("overwrite").parquet(f"{into}/batch=1")
        raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        P.consumed(spark, log, LOG, into, checkpoint, dies_after_writing)
    assert P.consumed(spark, log, LOG, into, checkpoint, work, files_a_batch=1) >= 2
    assert seen() == [1, 2, 3, 4, 5, 6, 7, 8]
    assert {r.shout for r in spark.read.schema(LOG + ", shout string").parquet(into).collect()} == {f"ITEM {i}" for i in range(1, 9)}
    assert P.consumed(spark, log, LOG, into, checkpoint, work) == 0 and seen() == [1, 2, 3, 4, 5, 6, 7, 8]
