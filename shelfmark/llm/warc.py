"""Operator 1: WARC derivatives: linked metadata and plain-text conversion records of responses.

A record is a row (type, record_id, refers_to, target_uri, date, headers, block): ``headers`` are
the WARC header lines in their order, ``block`` the bytes after them. For each response two rows
are made, a ``metadata`` record (JSON: the response's WARC and HTTP headers, its digests, title,
metas and links) and a ``conversion`` record (the page's text). Both carry WARC-Refers-To with the
response's WARC-Record-ID, its target, date and block digest of their own, and the source's
identifier and digests stay readable in the metadata. Each response is worked on by itself in one
pass without a shuffle, so no source or copy can make a group large.

Record ids are derived from the response's id and the kind of record: a repeated task yields
the same records, equal responses equal derivatives.

Headers are kept as ordered lists; the objects beside them are for look-up and hold the last of repeated names.
Text and links come from the body without chunks, gzip and deflate; digests are those of the stored bytes.

Cases: a body with another content coding yields metadata only; a null url or html counts as empty; a response without an HTML content type yields metadata
and, if it is some other text, its body as the conversion; a response without a record id refers to
an id made from its block; records of other types are ignored; repeated rows each yield their
records; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

RECORD = "type string, record_id string, refers_to string, target_uri string, date string, headers array<struct<name:string,value:string>>, block binary"
DATE = "1970-01-01T00:00:00Z"  # for pages, whose table has no capture date
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard's name space for URLs
_HEADER = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
_SCHEMA = pa.schema([("type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("headers", _HEADER), ("block", pa.binary())])


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, ' '.join(parts))}>"


def _record(kind: str, record_id: str, target: str, date: str, block: bytes, content_type: str, more: list[tuple[str, str]], refers_to: str | None = None) -> dict:
    headers = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), ("WARC-Target-URI", target), *more, ("WARC-Block-Digest", sha1(block)), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return {"type": kind, "record_id": record_id, "refers_to": refers_to, "target_uri": target, "date": date, "headers": [{"name": n, "value": v} for n, v in headers], "block": block}


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and body of an HTTP response."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return "", [], block
    lines = head.decode("utf-8", "replace").split("\r\n")
    return lines[0], [(n.strip(), v.strip()) for n, c, v in (x.partition(":") for x in lines[1:]) if c], body


def _charset(content_type: str) -> str:
    import codecs

    found = content_type.lower().partition("charset=")[2].split(";")[0].strip(" \"'") or "utf-8"
    try:
        return codecs.lookup(found).name
    except LookupError:
        return "utf-8"


def _dechunked(body: bytes) -> bytes:
    """The data of a chunked body, as far as it goes; a body that isn't chunked (any more) as it is."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            n = int(body[at:end].partition(b";")[0], 16)
        except ValueError:
            n = -1
        if n < 0:
            return body if not out else b"".join(out)
        if not n:
            break
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(out) if out or end >= 0 else body


def _inflated(data: bytes, wbits: int) -> bytes:
    """All of a deflate stream that can be read, with any further gzip members."""
    out = []
    while data:
        z = zlib.decompressobj(wbits)
        for k in range(0, len(data), 4096):  # in parts, so that a broken stream yields what is before the break
            try:
                out.append(z.decompress(data[k : k + 4096]))
            except zlib.error:
                return b"".join(out)
            if z.eof:
                data = z.unused_data + data[k + 4096 :]
                break
        else:
            return b"".join([*out, z.flush()])
        if wbits != 31 or data[:2] != b"\x1f\x8b":
            break
    return b"".join(out)


def content(http: list[tuple[str, str]], body: bytes) -> bytes | None:
    """The body without its transfer and content codings; None for a coding that isn't known."""
    codings = lambda name: [c.strip().lower() for n, v in http if n.lower() == name for c in v.split(",")]
    for coding in reversed(codings("content-encoding") + codings("transfer-encoding")):
        if coding == "chunked":
            body = _dechunked(body)
        elif coding in ("gzip", "x-gzip"):
            body = _inflated(body, 31) if body[:2] == b"\x1f\x8b" else body  # some crawlers store bodies decoded
        elif coding == "deflate":
            body = _inflated(body, 15) or _inflated(body, -15) or body
        elif coding not in ("", "identity"):
            return None
    return body


def _listed(headers: list[tuple[str, str]]) -> list[dict]:
    return [{"name": n, "value": v} for n, v in headers]


def derivatives(record: dict) -> list[dict]:
    """The metadata and conversion records of a response."""
    from .html_text import extract

    block, target, date = record["block"] or b"", record["target_uri"] or "", record["date"] or DATE
    source = [(h["name"], h["value"]) for h in record["headers"] or []]
    named = {n.lower(): v for n, v in source}
    response_id = record["record_id"] or _urn("response", sha1(block))
    status, http, body = http_parts(block)
    content_type = next((v for n, v in http if n.lower() == "content-type"), "")
    kind = content_type.split(";")[0].strip().lower()
    text, page = None, {"title": "", "text": "", "metas": [], "links": []}
    plain = content(http, body)
    if plain is None:
        pass
    elif kind in ("text/html", "application/xhtml+xml", ""):
        page = extract(plain.decode(_charset(content_type), "replace"), target)
        text = page["text"]
    elif kind.startswith("text/"):
        text = plain.decode(_charset(content_type), "replace")
    payload = named.get("warc-payload-digest") or sha1(body)
    envelope = {
        "WARC-Header-Metadata": dict(source),
        "WARC-Header-List": _listed(source),
        "Block-Digest": named.get("warc-block-digest") or sha1(block),
        "Payload-Digest": payload,
        "Actual-Payload-Digest": sha1(body),
        "HTTP-Response-Metadata": {"Response-Message": status, "Headers": dict(http), "Header-List": _listed(http), "Entity-Length": len(body)},
        "HTML-Metadata": {"Title": page["title"], "Metas": [{"name": n, "content": c} for n, c in page["metas"]], "Links": [{"path": p, "url": u, "text": t} for p, u, t in page["links"]]},
    }
    refers = [("WARC-Refers-To", response_id)]
    out = [_record("metadata", _urn("metadata", response_id), target, date, json.dumps(envelope, ensure_ascii=False, separators=(",", ":")).encode(), "application/json", refers, response_id)]
    if text is not None:
        more = [*refers, ("WARC-Refers-To-Target-URI", target), ("WARC-Refers-To-Date", date), ("WARC-Source-Payload-Digest", payload)]
        out.append(_record("conversion", _urn("conversion", response_id), target, date, text.encode(), "text/plain; charset=utf-8", more, response_id))
    return out


def responses_of_pages(pages: DataFrame) -> DataFrame:
    """Response records of the table (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, url, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                url, body = url or "", (page or "").encode()
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
                rows.append(_record("response", _urn("page", str(key), url), url, DATE, block, "application/http; msgtype=response", [("WARC-Payload-Digest", sha1(body))]))
            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, RECORD)


def derive(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of all response records; others make none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                made = [d for r in batch.slice(k, 500).to_pylist() for d in derivatives(r)]
                yield pa.RecordBatch.from_pylist(made, _SCHEMA)

    return records.where("type = 'response'").select(*_SCHEMA.names).mapInArrow(run, RECORD)


def _bytes_of(record: dict) -> bytes:
    lines = "".join(f"{h['name']}: {h['value']}\r\n" for h in record["headers"])
    return f"WARC/1.0\r\n{lines}\r\n".encode() + (record["block"] or b"") + b"\r\n\r\n"


def write(records: DataFrame, folder: str) -> DataFrame:
    """Write records to .warc.gz files, one gzip member a record; the manifest (path, n_records) names the files that count."""
    from .token_records import _filesystem

    schema = pa.schema([("path", pa.string()), ("n_records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        name, out, n = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            if out is None and batch.num_rows:
                files.create_dir(root, recursive=True)
                out = files.open_output_stream(f"{root}/{name}", compression=None)
            for record in batch.to_pylist():
                out.write(gzip.compress(_bytes_of(record), 6, mtime=0))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "n_records": n}], schema)

    records.select(*_SCHEMA.names).mapInArrow(run, "path string, n_records long").write.parquet(f"{folder}/manifest")
    return records.sparkSession.read.schema("path string, n_records long").parquet(f"{folder}/manifest")


def parse(data) -> Iterator[dict]:
    """Records of an open binary stream of WARC data (already decompressed)."""
    while line := data.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = []
        while (line := data.readline()).strip():
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[:1] in (" ", "\t") and headers:
                headers[-1]["value"] += " " + text.strip()
                continue
            name, _, value = text.partition(":")
            headers.append({"name": name.strip(), "value": value.strip()})
        named = {h["name"].lower(): h["value"] for h in headers}
        block = data.read(int(named.get("content-length", 0)))
        yield {"type": named.get("warc-type"), "record_id": named.get("warc-record-id"), "refers_to": named.get("warc-refers-to"), "target_uri": named.get("warc-target-uri"), "date": named.get("warc-date"), "headers": headers, "block": block}


def read(paths: DataFrame) -> DataFrame:
    """Records of the WARC files that a column ``path`` names; streamed, a file a task at a time."""
    from .token_records import _filesystem

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, name = _filesystem(path)
                with files.open_input_stream(name, compression=None) as raw, pa.PythonFile(raw, "r") as plain:
                    held, size = [], 0
                    for record in parse(gzip.GzipFile(fileobj=plain) if path.endswith(".gz") else plain):
                        held.append(record)
                        size += len(record["block"])
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, _SCHEMA)
                            held, size = [], 0
                    yield pa.RecordBatch.from_pylist(held, _SCHEMA)

    return paths.select("path").repartition("path").mapInArrow(run, RECORD)


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = derive(responses_of_pages(table(spark, sf_dir, "pages")))
    header = lambda name: F.get(F.filter("headers", lambda h: h["name"] == name), F.lit(0))["value"]
    source = F.when(F.col("type") == "metadata", F.get_json_object(F.col("block").cast("string"), "$.Payload-Digest")).otherwise(header("WARC-Source-Payload-Digest"))
    return made.select("type", "record_id", "refers_to", "target_uri", F.length("block").cast("long").alias("n_bytes"), header("WARC-Block-Digest").alias("block_digest"), source.alias("source_payload_digest"))
