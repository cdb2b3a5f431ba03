"""Operator 2: token counts that follow edits.

A document's state is a list of leaves, each a run of pre-token units with its length in characters
and its number of tokens, and a segment tree of sums over them (heap order: node k has children 2k
and 2k+1, the root is 1). Leaves part only at a single space between non-space characters, where
no unit can reach across, so a leaf's count depends on its own characters and the one on either side.

An edit is re-encoded together with the leaves that hold its characters and their two neighbours;
the new leaves take the old ones' places and only the sums above them change. Where they don't
fit, the tree is laid out anew from the leaves' counts, without encoding anything again.

State is one row a document (doc_id, text, lengths, sums), made and edited in place without a
shuffle; edits that come as a table of their own are grouped by document first.

Cases: a null text counts as empty; an empty text has one leaf of no tokens; a document of whose edits
some overlap, end before they start or have a null place stays as it is, and says so in ``error``
(null otherwise); edits beyond the text are cut to it; an edit's null text counts as empty; repeated documents each get the
edits of their id; edits with a null or unknown id do nothing; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, tokenizer_file, with_id_and_text

LEAF_UNITS = 32
STATE = "doc_id long, text string, lengths array<int>, sums array<long>"
EDITS = "edits array<struct<start:int,stop:int,text:string>>"
#: What the query's edits replace: secrets, addresses, long numbers, and signs glued to words by noise.
REDACTIONS = (
    (re.compile(r"""\b(?:token|secret|password|api_?key)\s*[=:]\s*["'][^"'\n]{8,}["']"""), "<secret>"),
    (re.compile(r"\b[\w.+-]{1,64}@[\w-]{1,64}\.[\w.-]{2,64}\b"), "<mail>"),
    (re.compile(r"\b\d{1,3}(?:\.\d{1,3}){3}\b"), "<address>"),
    (re.compile(r"\b\d{12,19}\b"), "<number>"),
    (re.compile(r"(?<=\w)(?:#{3}|\*{3}|%{3}|&{3}|\${3})"), ""),
)


def _leaf_ends(units: list[str]) -> list[int]:
    """Unit counts at which leaves end, about ``LEAF_UNITS`` apart and only before a hard boundary."""
    ends, last = [], 0
    for k in range(LEAF_UNITS, len(units)):
        if k - last >= LEAF_UNITS and len(units[k]) > 1 and units[k][0] == " " and not units[k - 1][-1].isspace():
            ends.append(k)
            last = k
    return [*ends, len(units)]


def leaves(text: str, encoder) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, token counts) of the leaves of a text."""
    from .units import blocks

    lengths, counts = [], []
    for part in blocks(text):
        units = encoder.units(part)
        n, size = encoder.counts(units), np.fromiter(map(len, units), np.int64, len(units))
        ends = _leaf_ends(units)
        begins = [0, *ends[:-1]]
        if units:
            lengths.append(np.add.reduceat(size, begins))
            counts.append(np.add.reduceat(n, begins))
    return (np.concatenate(lengths), np.concatenate(counts)) if lengths else (np.zeros(1, np.int64), np.zeros(1, np.int64))


def tree(counts: np.ndarray) -> np.ndarray:
    """Segment tree of sums, as long as twice the leaves' number brought to a power of two."""
    cap = 1 << (len(counts) - 1).bit_length()
    sums = np.zeros(2 * cap, np.int64)
    sums[cap : cap + len(counts)] = counts
    while cap > 1:
        level = sums[cap : 2 * cap].reshape(-1, 2).sum(1)
        cap >>= 1
        sums[cap : 2 * cap] = level
    return sums


def edited(text: str, lengths: np.ndarray, sums: np.ndarray, edits: list[tuple[int, int, str]], encoder) -> tuple[str, np.ndarray, np.ndarray, int, int]:
    """(text, lengths, sums, characters encoded again, nodes of the tree written) after edits given in the old text's places."""
    edits = sorted((min(max(0, a), len(text)), min(max(0, b), len(text)), x or "") for a, b, x in edits)
    if not edits:
        return text, lengths, sums, 0, 0
    ends = np.cumsum(lengths)
    regions: list[list] = []  # [first leaf, last leaf, edits]
    for e in edits:
        a = max(0, int(np.searchsorted(ends, e[0] - 1, "right")))
        b = min(len(ends) - 1, int(np.searchsorted(ends, min(e[1] + 1, len(text) - 1), "right")))
        a = min(a, b)
        if regions and a <= regions[-1][1]:
            regions[-1][1] = max(regions[-1][1], b)
            regions[-1][2].append(e)
        else:
            regions.append([a, b, [e]])
    cap = len(sums) // 2
    out, new_lengths, new_counts, at, encoded, same, changed = [], [], [], 0, 0, True, []
    for a, b, some in regions:
        begin, end = int(ends[a] - lengths[a]), int(ends[b])
        parts, p = [], begin
        for x, y, z in some:
            parts += [text[p:x], z]
            p = y
        parts.append(text[p:end])
        fresh = "".join(parts)
        encoded += len(fresh)
        size, count = leaves(fresh, encoder)
        old = b - a + 1
        if len(size) <= old:  # they fit: empty leaves fill the rest
            size, count = (np.concatenate([x, np.zeros(old - len(size), np.int64)]) for x in (size, count))
            changed.append(np.arange(a, b + 1))
        else:
            same = False
        new_lengths += [lengths[at:a], size]
        new_counts += [sums[cap + at : cap + a], count]
        at = b + 1
        out.append((begin, end, fresh))
    new_lengths.append(lengths[at:])
    new_counts.append(sums[cap + at : cap + len(lengths)])
    counts, lengths = np.concatenate(new_counts), np.concatenate(new_lengths)
    pieces, p = [], 0
    for begin, end, fresh in out:
        pieces += [text[p:begin], fresh]
        p = end
    text = "".join([*pieces, text[p:]])
    if same:
        sums = sums.copy()
        sums[cap : cap + len(counts)] = counts
        nodes = np.unique(np.concatenate(changed)) + cap
        written = len(nodes)
        while len(nodes) and nodes[0] > 1:
            nodes = np.unique(nodes >> 1)
            sums[nodes] = sums[2 * nodes] + sums[2 * nodes + 1]
            written += len(nodes)
    else:
        sums = tree(counts)
        written = len(sums)
    return text, lengths, sums, encoded, written


def fault(edits: list[tuple]) -> str | None:
    """Why a document's edits can't be made."""
    if any(a is None or b is None for a, b, _ in edits):
        return "an edit has a null place"
    if any(b < a for a, b, _ in edits):
        return "an edit ends before it starts"
    places = sorted((a, b) for a, b, _ in edits)
    return "edits overlap" if any(x[1] > y[0] for x, y in zip(places, places[1:], strict=False)) else None


def prefix_tokens(sums: np.ndarray, leaf: int) -> int:
    """Tokens before a leaf, from at most one node a level."""
    k, total = len(sums) // 2 + leaf, 0
    while k > 1:
        if k & 1:
            total += int(sums[k - 1])
        k >>= 1
    return total


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def build(docs: DataFrame, path: str) -> DataFrame:
    """State of every document; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .units import encoder

        for batch in slices(batches):
            made = [leaves(t, encoder(path)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists([x for x, _ in made], pa.int32()), _lists([tree(c) for _, c in made], pa.int64())], ["doc_id", "text", "lengths", "sums"])

    return with_id_and_text(docs).mapInArrow(run, STATE)


def redactions(text: str) -> list[tuple[int, int, str]]:
    """Edits that take personal data, secrets and glued signs out of a text; the earliest wins where two overlap."""
    found = sorted((m.start(), m.end(), x) for pattern, x in REDACTIONS for m in pattern.finditer(text))
    out, at = [], 0
    for a, b, x in found:
        if a >= at:
            out.append((a, b, x))
            at = b
    return out


def with_redactions(state: DataFrame) -> DataFrame:
    """Adds the column ``edits`` with each document's redactions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("text", pa.string())]))
        for batch in slices(batches):
            edits = [[{"start": a, "stop": b, "text": x} for a, b, x in redactions(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(edits, kind)], [*batch.schema.names, "edits"])

    return state.select("doc_id", "text", "lengths", "sums").mapInArrow(run, f"{STATE}, {EDITS}")


def with_edits(state: DataFrame, edits: DataFrame) -> DataFrame:
    """Adds the column ``edits`` from a table (doc_id, start, stop, text): as many in a row as the document has."""
    of = edits.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), F.col("text").cast("string").alias("text"))).alias("edits"))
    return state.join(of, "doc_id", "left").select("doc_id", "text", "lengths", "sums", "edits")


def apply(state: DataFrame, path: str) -> DataFrame:
    """State after the column ``edits``, with tokens_before, n_edits, encoded_chars, written_nodes and error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .units import encoder

        for batch in slices(batches):
            texts, lengths, sums, rest = [], [], [], []
            old_lengths, old_sums = batch.column("lengths"), batch.column("sums")
            for k, (text, edits) in enumerate(zip(batch.column("text").to_pylist(), batch.column("edits").to_pylist(), strict=True)):
                n, s = old_lengths[k].values.to_numpy().astype(np.int64), old_sums[k].values.to_numpy()
                given = [(e["start"], e["stop"], e["text"]) for e in edits or ()]
                error = fault(given)
                given = [] if error else given
                new, size, after, encoded, written = edited(text, n, s, given, encoder(path))
                texts.append(new)
                lengths.append(size)
                sums.append(after)
                rest.append((int(s[1]), len(given), encoded, written, error))
            cols = list(zip(*rest, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string()), _lists(lengths, pa.int32()), _lists(sums, pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())],
                ["doc_id", "text", "lengths", "sums", "tokens_before", "n_edits", "encoded_chars", "written_nodes", "error"],
            )

    return state.select("doc_id", "text", "lengths", "sums", "edits").mapInArrow(run, f"{STATE}, tokens_before long, n_edits long, encoded_chars long, written_nodes long, error string")


def totals(state: DataFrame) -> DataFrame:
    """Tokens of each document: the root of its tree."""
    return state.withColumn("n_tokens", F.get("sums", F.lit(1)))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file("byte_bpe_50k.json")
    state = build(table(spark, sf_dir, "documents"), path)
    after = totals(apply(with_redactions(state), path))
    return after.select("doc_id", "tokens_before", F.col("n_tokens").alias("tokens_after"), "n_edits", "encoded_chars", F.length("text").cast("long").alias("n_chars"), F.size("lengths").cast("long").alias("n_leaves"))
