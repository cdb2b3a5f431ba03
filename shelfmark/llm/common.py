"""Helpers that several operators share: tables, the shared folder, tokenizer files, batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else (tests) a local one."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or ""
    if not found:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="shelfmark-"))
        found = sc._jsc.sc().getCheckpointDir().get()
    elif sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, survives lost executors."""
    path = new_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tokenizer_file(name: str) -> str:
    """Path of a public vocabulary file; resolved inside tasks as well, never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def with_id_and_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a null text read as empty; any other column is left out, so names can't clash."""
    from pyspark.sql import functions as F

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def quoted(columns: list[str]) -> list[str]:
    """Names as they are, with dots and all."""
    return ["`" + c.replace("`", "``") + "`" for c in columns]


def whole_row(df: DataFrame):
    """All columns of a table as one struct, whatever their names, so that none can clash with an operator's own."""
    from pyspark.sql import functions as F

    return F.struct(*quoted(df.columns))


def slices(batches, rows: int = 1000):
    """Arrow batches in slices of a bounded number of rows, so that Python objects of few rows live at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
