"""Operator 6: token ids as length-delimited binary records with an offset index.

A record is: length (u64), masked CRC-32C of those 8 bytes (u32), payload, masked CRC-32C of the
payload (u32), all little-endian; the payload is the ids in ``width`` bytes each. Beside each data
file lies an index file, one fixed-size entry a record, so that a reader can fetch records in any
order. A manifest (Parquet, written by Spark's own committer) names the files of the attempts that
succeeded: files of lost or repeated attempts are never read.

Cases: a null text counts as empty, an empty one yields only the end id, a null doc_id sorts first
and is kept, repeated rows each get a record (ties in doc_id by text), an empty table gives an
empty result, other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder, shuffle_partitions, table, tokenizer_file, with_id_and_text

END_ID = 2
INDEX = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("offset", "<u8"), ("n_tokens", "<u4"), ("start", "<u8")])
BATCH_BYTES = 8 << 20
MANIFEST = "file_no long, path string, n_docs long, n_tokens long"


def _filesystem(uri: str):
    from pyarrow import fs

    uri = uri if "://" in uri or uri.startswith("file:") else f"file://{uri}"
    return fs.FileSystem.from_uri(uri.replace("file:///", "file:/").replace("file:/", "file:///", 1) if uri.startswith("file:") else uri)


def frame(payloads: list[bytes]) -> list[bytes]:
    """The framed records of payloads."""
    from .crc32c import crc32c, masked

    heads = [len(p).to_bytes(8, "little") for p in payloads]
    h, d = masked(crc32c(heads)).astype("<u4"), masked(crc32c(payloads)).astype("<u4")
    return [b"".join((a, x.tobytes(), p, y.tobytes())) for a, x, p, y in zip(heads, h, payloads, d, strict=True)]


def unframe(data: bytes, lengths: list[int]) -> list[bytes]:
    """Payloads of consecutive framed records; raises where a length or checksum disagrees."""
    from .crc32c import crc32c, masked

    at, heads, payloads, sums = 0, [], [], []
    for n in lengths:
        heads.append(data[at : at + 8])
        payloads.append(data[at + 12 : at + 12 + n])
        sums.append((data[at + 8 : at + 12], data[at + 12 + n : at + 16 + n]))
        if int.from_bytes(heads[-1], "little") != n:
            raise ValueError("a record's length differs from its index")
        at += n + 16
    h, d = masked(crc32c(heads)).astype("<u4"), masked(crc32c(payloads)).astype("<u4")
    if any(a != x.tobytes() or b != y.tobytes() for (a, b), x, y in zip(sums, h, d, strict=True)):
        raise ValueError("a record's checksum is wrong")
    return payloads


def write_records(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, width: int = 2, n_files: int | None = None) -> DataFrame:
    """Encode documents and write them in ascending doc_id order; returns the manifest.

    One range shuffle of the texts (smaller than their ids) orders the documents; each task streams
    its range to one data file, so memory is bounded by a batch.
    """
    spark = docs.sparkSession
    schema = pa.schema([("file_no", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from .units import encoder

        encode, end = encoder(path, width).encode, int(end_id).to_bytes(width, "little")
        files, root = _filesystem(folder)
        task = TaskContext.get()
        name = f"tokens-{task.partitionId():06d}-{uuid.uuid4().hex}"
        n_docs = n_tokens = offset = size = 0
        out = index = None
        entries, payloads = [], []

        def flush() -> None:
            out.write(b"".join(frame(payloads)))
            index.write(np.array(entries, INDEX).tobytes())
            entries.clear()
            payloads.clear()

        for batch in batches:
            if out is None and batch.num_rows:
                files.create_dir(root, recursive=True)
                out, index = files.open_output_stream(f"{root}/{name}.rec"), files.open_output_stream(f"{root}/{name}.idx")
            ids, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                payload = encode(texts[i].as_py()) + end
                key, n = ids[i].as_py(), len(payload) // width
                entries.append((key or 0, key is not None, offset, n, n_tokens))
                payloads.append(payload)
                offset += len(payload) + 16
                n_tokens += n
                n_docs += 1
                size += len(payload)
                if size > BATCH_BYTES:
                    flush()
                    size = 0
        if out is not None:
            flush()
            out.close()
            index.close()
            yield pa.RecordBatch.from_pylist([{"file_no": task.partitionId(), "path": name, "n_docs": n_docs, "n_tokens": n_tokens}], schema)

    n = n_files or shuffle_partitions(spark)
    rows = with_id_and_text(docs).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_records(manifest: DataFrame, folder: str, width: int = 2, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32[, ids]) read from the files that a manifest names.

    ``start`` counts the ids of all documents before: a running sum over files (one small row each)
    plus the index's running sum within the file.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    files_of = manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    files_of = files_of.select("path", "before", "n_docs").repartition(shuffle_partitions(manifest.sparkSession))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import RecordBatch

        files, root = _filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with files.open_input_stream(f"{root}/{row['path']}.idx") as f:
                    index = np.frombuffer(f.read(), INDEX)
                sizes = index["n_tokens"].astype(np.int64) * width
                with files.open_input_stream(f"{root}/{row['path']}.rec") as f:
                    at = 0
                    while at < len(index):
                        to = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), BATCH_BYTES, "right")) + at)
                        part = sizes[at:to].tolist()
                        payloads = unframe(f.read(sum(part) + 16 * len(part)), part)
                        some = index[at:to]
                        wide = [np.frombuffer(p, f"<u{width}").astype("<u4") for p in payloads]
                        cols = [
                            pa.array(some["doc_id"], pa.int64(), mask=some["has_id"] == 0),
                            pa.array(some["start"].astype(np.int64) + row["before"]),
                            pa.array(some["n_tokens"].astype(np.int64)),
                            pa.array([zlib.crc32(w.tobytes()) for w in wide], pa.int64()),
                        ]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                        if with_ids:
                            cols.append(pa.array([w.astype(np.int32) for w in wide], pa.list_(pa.int32())))
                            names.append("ids")
                        yield RecordBatch.from_arrays(cols, names)
                        at = to

    return files_of.mapInArrow(read, schema)


def fetch_record(folder: str, path: str, i: int, width: int = 2) -> tuple[int | None, np.ndarray]:
    """One record by its place in a file: one seek in the index, one in the data."""
    files, root = _filesystem(folder)
    with files.open_input_file(f"{root}/{path}.idx") as f:
        entry = np.frombuffer(f.read_at(INDEX.itemsize, i * INDEX.itemsize), INDEX)[0]
    n = int(entry["n_tokens"]) * width
    with files.open_input_file(f"{root}/{path}.rec") as f:
        payload = unframe(f.read_at(n + 16, int(entry["offset"])), [n])[0]
    return int(entry["doc_id"]) if entry["has_id"] else None, np.frombuffer(payload, f"<u{width}")


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-records")
    manifest = write_records(table(spark, sf_dir, "documents"), folder, tokenizer_file("byte_bpe_50k.json"))
    return read_records(manifest, folder)
