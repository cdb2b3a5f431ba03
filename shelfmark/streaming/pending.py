"""Pending work: a log that is appended to while it is worked off, up to marks.

A log has rows (id, by, ..); ids grow for each ``by``. Work reads what is pending together with a
mark, the greatest id it saw; when the work is done the mark is settled, and rows up to it are
pending no more. What was appended in between stays pending for the next run. As a job over a folder
of files, ``consumed`` does the same with the mark kept by Spark's own checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pending(log: DataFrame, settled: DataFrame, by: str = "by", number: str = "id") -> DataFrame:
    """Rows of the log beyond the greatest settled mark of their ``by``; ``settled`` has (by, mark), as often as it was settled."""
    done = settled.groupBy(F.col(by).alias("_by")).agg(F.max("mark").alias("_mark"))
    both = log.join(done, F.col(by).eqNullSafe(F.col("_by")), "left")
    return both.where(F.col("_mark").isNull() | (F.col(number) > F.col("_mark"))).select(*log.columns)


def marked(rows: DataFrame, by: str = "by", number: str = "id") -> DataFrame:
    """(by, mark) of the rows that work was given: take both from one reading, so that no later row is marked unseen."""
    return rows.groupBy(by).agg(F.max(number).alias("mark"))


def forgotten(log: DataFrame, keys: DataFrame, key: str, settled: DataFrame, by: str = "by", number: str = "id") -> DataFrame:
    """The log without pending rows of these keys; what is settled is kept as history."""
    open_ = pending(log, settled, by, number).join(keys.select(key).distinct(), key, "left_semi").select(F.col(by).alias("_by"), F.col(number).alias("_number")).distinct()
    return log.join(open_, F.col(by).eqNullSafe(F.col("_by")) & (F.col(number) == F.col("_number")), "left_anti")


def counts(log: DataFrame, settled: DataFrame, by: str = "by", number: str = "id") -> DataFrame:
    """(by, n, waiting): rows of the log and how many of them are pending."""
    n = log.groupBy(by).agg(F.count("*").alias("n"))
    waiting = pending(log, settled, by, number).groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_w"))
    return n.join(waiting, F.col(by).eqNullSafe(F.col("_by")), "left").select(by, "n", F.coalesce("_w", F.lit(0)).alias("waiting"))


def consumed(spark: SparkSession, log: str, schema: str, into: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] | None = None, files_a_batch: int = 1000) -> int:
    """Work off what was appended to a folder of Parquet files since the last run; returns the number of batches that were begun.

    A batch is a set of files that the checkpoint fixed before work began. Its result replaces the
    folder of its number in ``into``, so a batch that was cut off half-way is done again over the same files
    and nothing is lost or doubled: readers see each row's result once. Runs may not overlap (the
    checkpoint admits one); files appended during a run belong to it or to the next.
    """
    begun = []

    def one(batch: DataFrame, number: int) -> None:
        begun.append(number)
        (work(batch) if work else batch).write.mode("overwrite").parquet(f"{into.rstrip('/')}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(log)
    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return len(begun)
