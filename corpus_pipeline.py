"""A training corpus from ``documents``: quality, line dedup, near-dedup, decontamination, SentencePiece.

Each stage takes (spark, docs, sf_dir) with docs the stage before wrote, and works on all of them.
All but the last return the columns of ``documents`` (with any others that docs has).

What a stage decides takes effect: documents that the classifier rejects go; boilerplate
lines leave their texts; of every near-duplicate group the document with the smallest id stays;
documents with a leaked benchmark passage go. The last stage returns the encoded documents.

Cases: every row is decided by its own text, whatever its doc_id: rows of one id or without an id
don't share their fate. Of a near-duplicate group one row stays: that with the smallest doc_id, of
several the first; one without an id only if no row in the group has one. Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark import on_workers
from shelfmark.llm import decontaminate, lines, quality, sentencepieces, simhash
from shelfmark.llm.common import new_folder, table, tokenizer_file


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    on_workers(spark)
    return quality.kept(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.without_boilerplate(docs, counts=False)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    on_workers(spark)
    return simhash.one_of_each_group(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    on_workers(spark)
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_chunks, round_trip): the ids, checked by decoding them."""
    on_workers(spark)
    path = tokenizer_file("piece_bpe_32k.model")
    both = sentencepieces.encode_and_decode(docs, path)
    return both.select("doc_id", "ids", "n_chunks", (F.crc32(F.col("text").cast("binary")) == F.col("text_crc32")).alias("round_trip"))


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminated),
    ("SentencePiece encoding and decoding", sentencepiece),
]

ORACLE_SQL = None  # no stage but line dedup can be said in SQL; tests compare the rest with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        folder = new_folder(spark, "stage")
        out.write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
