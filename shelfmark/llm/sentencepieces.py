"""Operator 8: SentencePiece encoding and decoding, giant documents by a max-plus scan.

A document up to ``CHUNK`` characters is encoded in place. A longer one is cut into chunks, dealt
over all tasks. Each chunk yields its transfer matrix between border states (see ``pieces``);
matrices of ``GROUP`` chunks multiply to one, a document's few group matrices are scanned from both
ends, then each group's own; where a border's forward and backward weights add up best lies its
state. With the states of its two borders every chunk is traced back on its own. Results equal the
library's for BPE models.

No step holds more than one document's matrices, which are smaller than the document itself.

Cases: a null text counts as empty and has no pieces; characters outside the vocabulary become byte
pieces; repeated rows and null ids are encoded like any other; an empty table gives an empty
result; other columns are ignored. A visible blank (U+2581) decodes to a space, as in the library.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_partitions, slices, table, tokenizer_file, with_id_and_text, written

CHUNK, GROUP = 1 << 15, 64
ENCODED = "doc_id long, ids array<int>, n_chunks int, text_crc32 long"


def _int_lists(raws: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raws])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raws), "<i4")))


def _text_of(raw: bytes) -> str:
    """Text of decoded bytes, without the blank put in front."""
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def _encode_short(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """Ids of texts that no chunk border cuts; with ``decoded`` also their text again, in the same pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .pieces import normal, pieces

        model = pieces(path)
        for part in slices(batches):
            texts = part.column(1).to_pylist()
            ids = [model.encode_units(normal(t)) for t in texts]
            cols = [part.column(0), _int_lists(ids), pa.array([1] * len(texts), pa.int32()), pa.array([zlib.crc32(t.encode()) for t in texts], pa.int64())]
            names = ["doc_id", "ids", "n_chunks", "text_crc32"]
            if decoded:
                cols.append(pa.array([_text_of(model.decode_raw(np.frombuffer(i, "<i4"))) for i in ids], pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, ENCODED + ", text string" * decoded)


def _chunks(giants: DataFrame, path: str, chunk: int) -> DataFrame:
    """(row, k, n, begin, end, text): chunks with one longest piece's characters more on both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .pieces import normal, pieces

        reach = pieces(path).longest
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = normal(text)
                n = -(-len(text) // chunk)
                for k in range(n):
                    a, b = k * chunk, min(len(text), (k + 1) * chunk)
                    low = max(0, a - reach)
                    yield pa.RecordBatch.from_pylist([{"row": row, "k": k, "n": n, "begin": a - low, "end": b - low, "text": text[low : b + reach]}], schema)

    schema = pa.schema([("row", pa.int64()), ("k", pa.int32()), ("n", pa.int32()), ("begin", pa.int32()), ("end", pa.int32()), ("text", pa.string())])
    return giants.select("row", "text").mapInArrow(run, "row long, k int, n int, begin int, end int, text string")


MATRIX = "row long, g long, k int, height int, width int, weights array<double>"


def _matrices(chunks: DataFrame, path: str) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .pieces import pieces

        for part in parts:
            made = [pieces(path).matrix(r.text, r.begin, r.end, r.k == 0, r.k == r.n - 1) for r in part.itertuples()]
            yield pd.DataFrame({"row": part["row"], "g": part["k"] // GROUP, "k": part["k"], "height": [m.shape[0] for m in made], "width": [m.shape[1] for m in made], "weights": [m.ravel() for m in made]})

    return chunks.mapInPandas(run, MATRIX)


def _loaded(part: pd.DataFrame) -> list[np.ndarray]:
    return [np.asarray(r.weights, np.float64).reshape(r.height, r.width) for r in part.sort_values("k").itertuples()]


def _product(part: pd.DataFrame) -> pd.DataFrame:
    from functools import reduce

    from .pieces import times

    m = reduce(times, _loaded(part))
    return pd.DataFrame({"row": [part["row"].iloc[0]], "g": [part["g"].iloc[0]], "k": [int(part["k"].min())], "height": [m.shape[0]], "width": [m.shape[1]], "weights": [m.ravel()]})


def _scan(ms: list[np.ndarray], before: np.ndarray, after: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Weights of the states at all borders, from the left and from the right."""
    from .pieces import times

    left, right = [before[None, :]], [after[:, None]]
    for m in ms:
        left.append(times(left[-1], m))
    for m in reversed(ms):
        right.append(times(m, right[-1]))
    return [x[0] for x in left], [x[:, 0] for x in reversed(right)]


def _group_borders(part: pd.DataFrame) -> pd.DataFrame:
    ms = _loaded(part)
    left, right = _scan(ms, np.zeros(ms[0].shape[0]), np.zeros(ms[-1].shape[1]))
    part = part.sort_values("k")
    return pd.DataFrame({"row": part["row"], "g": part["g"], "before": left[:-1], "after": right[1:]})


def _states(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("k")
    ms = _loaded(part)
    left, right = _scan(ms, np.asarray(part["before"].iloc[0]), np.asarray(part["after"].iloc[0]))
    best = [int(np.argmax(a + b)) for a, b in zip(left, right, strict=True)]
    return pd.DataFrame({"row": part["row"], "k": part["k"], "enter": best[:-1], "leave": best[1:]})


def _encode_giants(giants: DataFrame, path: str, chunk: int) -> DataFrame:
    spark = giants.sparkSession
    giants = written(giants.withColumn("row", F.monotonically_increasing_id()), "giants")
    chunks = written(_chunks(giants, path, chunk).repartition(shuffle_partitions(spark), "row", "k"), "chunks")
    matrices = written(_matrices(chunks, path), "matrices")
    products = matrices.groupBy("row", "g").applyInPandas(_product, MATRIX)
    borders = products.groupBy("row").applyInPandas(_group_borders, "row long, g long, before array<double>, after array<double>")
    states = matrices.join(borders, ["row", "g"]).groupBy("row", "g").applyInPandas(_states, "row long, k int, enter int, leave int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .pieces import pieces

        for batch in batches:
            rows = batch.to_pylist()
            ids = [pieces(path).chunk_ids(r["text"], r["begin"], r["end"], r["k"] == 0, r["k"] == r["n"] - 1, r["enter"], r["leave"]) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _int_lists(ids)], ["row", "k", "ids"])

    traced = chunks.join(states, ["row", "k"]).select("row", "k", "n", "begin", "end", "text", "enter", "leave").mapInArrow(run, "row long, k int, ids array<int>")
    # as many ids as the document itself has
    whole = traced.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    whole = whole.select("row", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"), F.size("parts").alias("n_chunks"))
    return giants.select("row", "doc_id", F.crc32(F.col("text").cast("binary")).alias("text_crc32")).join(whole, "row").select("doc_id", "ids", "n_chunks", "text_crc32")


def _by_length(docs: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    rows = with_id_and_text(docs)  # the normal form has one character more than the text
    return rows.where(F.length("text") < chunk), rows.where(F.length("text") >= chunk)


def encode(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, ids, n_chunks, text_crc32) of every document."""
    short, giants = _by_length(docs, chunk)
    return _encode_short(short, path).union(_encode_giants(giants, path, chunk))


def encode_and_decode(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """As ``decode(encode(docs))``; short documents are decoded where they were encoded."""
    short, giants = _by_length(docs, chunk)
    return _encode_short(short, path, True).union(decode(_encode_giants(giants, path, chunk), path))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``text``: the ids' pieces as bytes, without the blank put in front."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .pieces import pieces

        for batch in slices(batches, 200):
            texts = [_text_of(pieces(path).decode_raw(x.values.to_numpy())) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return encoded.select("doc_id", "ids", "n_chunks", "text_crc32").mapInArrow(run, f"{ENCODED}, text string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file("piece_bpe_32k.model")
    both = encode_and_decode(table(spark, sf_dir, "documents"), path)
    ids_crc32 = F.crc32(F.array_join("ids", ",").cast("binary"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), ids_crc32.alias("ids_crc32"), "n_chunks", (F.crc32(F.col("text").cast("binary")) == F.col("text_crc32")).alias("round_trip"))
