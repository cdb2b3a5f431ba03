"""Operator 11: alignment of two tokenizers by distinct segments.

A text is cut before runs of white space. There the first tokenizer's pre-tokens part anyway, and
the second's merges can't reach across: its vocabulary is looked through once for pieces that hold a
white-space character after another character, and where such a pair of characters meets a text is not
cut. So both tokenizers give a segment the same tokens alone as in its text, and each distinct segment
of the corpus is tokenised and aligned once:

1. Each task deals its documents to chunks of a bounded size. A chunk has a dictionary of its
   distinct segments, and its documents are lists of places in it.
2. Dictionaries are dealt by buckets of their segments. A bucket's distinct segments are tokenised
   once; byte offsets where tokens of both end cut them into groups, none of which reaches over a
   segment's end. Every chunk is answered with the alignments of its own segments.
3. Documents are composed within their chunk, which also counts the documents that hold an id pair
   linked. The counts are summed over the corpus and joined back by chunk and pair, so what is
   joined are dictionaries and pairs, never occurrences.

Cases: a null or empty text has no tokens, nor has one whose tokens' bytes differ from its own (with
U+2581 in it, which the second tokenizer reads as a blank): zeros, and an empty digest; it doesn't count
for its pairs. Strings of special tokens are plain text. Null ids are kept, repeated rows are documents
each for itself, also in the counts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_partitions, slices, table, tokenizer_file, with_id_and_text, written
from .units import WS, blocks

BLANK = "▁"
SEGMENT = re.compile(f"[{WS}]*[^{WS}]+|[{WS}]+")
_IS_WS = re.compile(f"[{WS}]").fullmatch
CHUNK_CHARS, CHUNK_SEGMENTS = 1 << 24, 3 << 16  # a chunk ends with the document that reaches either
BATCH_PLACES = 1 << 18  # segments of the documents of one row
BUCKETS = 16  # of segments, for each shuffle partition
LARGE_GROUP = 1 << 12  # links of a group that are counted by id rather than one by one
CHUNKS = "chunk long, bucket int, ids array<long>, data binary"
REPLIES = "chunk long, data binary"
_NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def packed(*arrays) -> bytes:
    """Arrays of numbers below 2^32 as compressed bytes, each byte's plane by itself."""
    import zstandard

    sizes = np.array([len(arrays), *map(len, arrays)], "<u4")
    flat = np.concatenate([sizes, *(np.asarray(x, "<u4") for x in arrays)])
    return zstandard.compress(np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpacked(data: bytes) -> list[np.ndarray]:
    import zstandard

    flat = np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()
    at = np.cumsum([flat[0] + 1, *flat[1 : flat[0] + 1]])
    return [flat[i:j].astype(np.int64) for i, j in zip(at[:-1], at[1:], strict=True)]


class Pair:
    """Both tokenizers, the cuts that neither merges across, and the alignment of a segment."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings are plain text
        self.b = b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = _byte_of(ByteLevel.alphabet())
        self.raw_a = [bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t in map(self.a.id_to_token, range(self.a.get_vocab_size()))]
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        self.raw_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        text = [p.replace(BLANK, " ") for i, p in enumerate(pieces) if not (b.is_byte(i) or b.is_control(i) or b.is_unknown(i))]
        self.joined = {p[k : k + 2] for p in text for k in range(len(p) - 1) if _IS_WS(p[k + 1]) and not _IS_WS(p[k])}
        self.joining = re.compile("|".join(map(re.escape, sorted(self.joined)))) if self.joined else None
        self.in_blocks = not any(p[1] == " " for p in self.joined)
        # a letter that no white space joins stands in front of a segment, as the library would put a blank there
        self.front = next(c for c in "aetoinshr" if not any(p[0] == c for p in self.joined))
        self.front_ids = b.encode(self.front)

    def segments(self, text: str) -> list[str]:
        """Parts of a blank and the text; both tokenizers encode each by itself as in the whole."""
        out: list[str] = []
        for part in blocks(f" {text}") if self.in_blocks else [f" {text}"]:
            units = SEGMENT.findall(part)
            if self.joining and self.joining.search(part):
                joined = units[:1]
                for u in units[1:]:
                    if joined[-1][-1] + u[0] in self.joined:
                        joined[-1] += u
                    else:
                        joined.append(u)
                units = joined
            out += units
        return out

    def encode(self, segments: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        n = len(self.front_ids)
        for x, y in zip(self.a.encode_batch_fast(segments, add_special_tokens=False), self.b.encode([self.front + s for s in segments], num_threads=1), strict=True):
            if y[:n] != self.front_ids:
                raise ValueError("the second tokenizer merged a segment with the letter in front of it")
            yield x.ids, y[n:]

    def aligned(self, segments: list[str]) -> Iterator[tuple | None]:
        """(sizes of groups in the first, and in the second tokenizer, ids of both) for each segment; None where bytes differ."""
        raw_a, raw_b = self.raw_a, self.raw_b
        for s, (a, b) in zip(segments, self.encode(segments), strict=True):
            raw, x, y = s.encode(), [raw_a[i] for i in a], [raw_b[i] for i in b]
            if b"".join(x) != raw or b"".join(y) != raw:
                yield None
            elif len(a) == 1 or len(b) == 1:
                yield [len(a)], [len(b)], a, b
            else:
                yield *cuts(list(map(len, x)), list(map(len, y))), a, b


def cuts(x: list[int], y: list[int]) -> tuple[list[int], list[int]]:
    """How many tokens of these lengths each group has, of both; groups end where tokens of both end."""
    many_a, many_b = [], []
    i = j = first_a = first_b = end_a = end_b = 0
    while i < len(x):
        end_a, i = end_a + x[i], i + 1
        while end_b < end_a:
            end_b, j = end_b + y[j], j + 1
        if end_a == end_b:
            many_a.append(i - first_a)
            many_b.append(j - first_b)
            first_a, first_b = i, j
    return many_a, many_b


def _byte_of(alphabet: list[str]) -> dict[str, int]:
    """Bytes of the byte-level alphabet: Latin-1's printable characters stand for themselves, the rest follow from U+0100 on."""
    own = [c for c in range(256) if chr(c) in set(alphabet)]
    rest = [c for c in range(256) if c not in own]
    return {chr(c): c for c in own} | {chr(256 + k): c for k, c in enumerate(rest)}


@lru_cache(2)
def pair(path_a: str, path_b: str) -> Pair:
    """A worker's tokenizers, kept from task to task."""
    return Pair(path_a, path_b)


def _chunks(docs: DataFrame, path_a: str, path_b: str, buckets: int, chunk_chars: int) -> DataFrame:
    """Rows of documents (bucket -1: places in their chunk's dictionary) and of dictionaries (a bucket's segments and their places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = pair(path_a, path_b).segments
        chunk = TaskContext.get().partitionId() << 32
        known: dict[str, int] = {}
        ids, places, chars, held = [], [], 0, 0

        def row(bucket: int, ids_: list | None, data: bytes) -> pa.RecordBatch:
            cols = [pa.array([chunk], pa.int64()), pa.array([bucket], pa.int32()), pa.array([ids_], pa.list_(pa.int64())), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["chunk", "bucket", "ids", "data"])

        def documents() -> pa.RecordBatch:
            return row(-1, ids, packed(list(map(len, places)), np.concatenate([*places, np.zeros(0, np.uint32)])))

        def dictionary() -> Iterator[pa.RecordBatch]:
            words = [s.encode() for s in known]
            of = np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) % buckets
            order = np.argsort(of, kind="stable")
            edges = np.flatnonzero(np.concatenate([[True], np.diff(of[order]) != 0, [True]])) if len(order) else []
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                mine = order[i:j]
                parts = [words[k] for k in mine.tolist()]
                steps = np.diff(mine, prepend=0)  # ascending
                yield row(int(of[mine[0]]), None, packed(steps, list(map(len, parts)), np.frombuffer(b"".join(parts), np.uint8)))

        for batch in slices(batches):
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                found = segments(text) if text else []
                for s in set(found):
                    known.setdefault(s, len(known))
                ids.append(i)
                places.append(np.fromiter(map(known.__getitem__, found), np.uint32, len(found)))
                chars, held = chars + len(text), held + len(found)
                full = chars >= chunk_chars or len(known) >= CHUNK_SEGMENTS
                if held >= BATCH_PLACES or full:
                    yield documents()
                    ids, places, held = [], [], 0
                if full:
                    yield from dictionary()
                    known, chars, chunk = {}, 0, chunk + 1
        if ids:
            yield documents()
        yield from dictionary()

    return with_id_and_text(docs).mapInArrow(run, CHUNKS)


def _aligned(words: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Alignments of every chunk's segments; rows come by bucket, and a bucket's distinct segments are aligned once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(path_a, path_b)
        bucket, known = -1, {}
        for batch in batches:
            out = []
            for b, data in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if b != bucket:
                    bucket, known = b, {}
                steps, sizes, raw = unpacked(data)
                raw, ends = raw.astype(np.uint8).tobytes(), np.cumsum(sizes).tolist()
                words = [raw[i:j].decode() for i, j in zip([0, *ends[:-1]], ends, strict=True)]
                new = [w for w in words if w not in known]
                known.update(zip(new, both.aligned(new), strict=True))
                n, many_a, many_b, ids_a, ids_b = [], [], [], [], []
                for w in words:
                    if (found := known[w]) is None:
                        n.append(0)
                        continue
                    x, y, a, b_ = found
                    n.append(len(x))
                    many_a += x
                    many_b += y
                    ids_a += a
                    ids_b += b_
                out.append(packed(steps, n, many_a, many_b, ids_a, ids_b))
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(out, pa.binary())], ["chunk", "data"])

    return words.mapInArrow(run, REPLIES)


class _Words(NamedTuple):
    """A chunk's segments in order of their places; groups, ids and links of all of them one after the other."""

    groups: np.ndarray  # each segment's first group; one more at the end
    a: np.ndarray  # each group's first id
    b: np.ndarray
    ids_a: np.ndarray
    ids_b: np.ndarray


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _gathered(starts: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, places) of the items of some rows."""
    n = starts[some + 1] - starts[some]
    return n, np.repeat(starts[some] - _starts(n)[:-1], n) + np.arange(n.sum())


def _words(replies: list[bytes]) -> _Words:
    """The replies of all buckets, put in order."""
    parts = [unpacked(r) for r in replies]
    joined = [np.concatenate([*x, np.zeros(0, np.int64)]) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 6
    rows = np.concatenate([*(np.cumsum(p[0]) for p in parts), np.zeros(0, np.int64)])
    _, n, many_a, many_b, ids_a, ids_b = joined
    del parts, joined
    order = np.argsort(rows, kind="stable")
    groups, a, b = _starts(n), _starts(many_a), _starts(many_b)
    n, g = _gathered(groups, order)
    na, at_a = _gathered(a, g)
    nb, at_b = _gathered(b, g)
    return _Words(_starts(n), _starts(na), _starts(nb), ids_a[at_a], ids_b[at_b])


def _links(w: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, pair, times): how often each segment links a pair (a_id << 32 | b_id), the segments in order."""
    na, nb = np.diff(w.a), np.diff(w.b)
    word = np.repeat(np.arange(len(w.groups) - 1), np.diff(w.groups))
    small = np.flatnonzero(na * nb <= LARGE_GROUP)
    n = (na * nb)[small]
    g = np.repeat(small, n)
    k = np.arange(n.sum()) - np.repeat(_starts(n)[:-1], n)
    out = [(word[g], w.ids_a[w.a[g] + k // nb[g]] << 32 | w.ids_b[w.b[g] + k % nb[g]], np.ones(len(g), np.int64))]
    for g in np.flatnonzero(na * nb > LARGE_GROUP).tolist():
        x, m = np.unique(w.ids_a[w.a[g] : w.a[g + 1]], return_counts=True)
        y, n = np.unique(w.ids_b[w.b[g] : w.b[g + 1]], return_counts=True)
        out.append((np.full(len(x) * len(y), word[g]), np.repeat(x << 32, len(y)) | np.tile(y, len(x)), np.repeat(m, len(y)) * np.tile(n, len(x))))
    word, code, times = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((code, word))
    word, code, times = word[order], code[order], times[order]
    new = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (code[1:] != code[:-1])])) if len(word) else np.zeros(0, np.int64)
    return word[new], code[new], np.add.reduceat(times, new) if len(new) else times


def _texts(w: _Words) -> list[str]:
    """Each segment's groups, as ``a1,a2|b1;a3|b2``."""
    a, b = list(map(str, w.ids_a.tolist())), list(map(str, w.ids_b.tolist()))
    x, y = w.a.tolist(), w.b.tolist()
    groups = [f"{a[i]}|{b[k]}" if j - i == 1 == m - k else f"{','.join(a[i:j])}|{','.join(b[k:m])}" for i, j, k, m in zip(x, x[1:], y, y[1:], strict=False)]
    at = w.groups.tolist()
    return [groups[i] if j - i == 1 else ";".join(groups[i:j]) for i, j in zip(at, at[1:], strict=False)]


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = _starts(values)
    return total[at[1:]] - total[at[:-1]]


COMPOSED = "chunk long, pair long, nth int, docs long, ids array<long>, numbers binary, digests array<string>, links binary, groups array<string>"


def _composed(with_groups: bool):
    """Rows of a chunk's pairs (in how many of its documents) and of its documents, with their links by the pairs' numbers."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.list_(pa.string())]
    names = [c.split()[0] for c in COMPOSED.split(", ")]

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(docs):
            return pa.table([pa.array([], k) for k in kinds], names)
        chunk = docs["chunk"][0].as_py()
        words = _words(replies["data"].to_pylist())
        ok = np.diff(words.groups) > 0
        texts = _texts(words)
        per_group = np.diff(words.a) * np.diff(words.b)
        numbers = [words.a[words.groups[1:]] - words.a[words.groups[:-1]], words.b[words.groups[1:]] - words.b[words.groups[:-1]], np.diff(words.groups), _sums(per_group, words.groups)]
        word, code, times = _links(words)
        first = np.searchsorted(word, np.arange(len(ok) + 1))
        pairs, local = np.unique(code, return_inverse=True)
        docs_of, rows = np.zeros(len(pairs), np.int64), []
        for ids, data in zip(docs["ids"].to_pylist(), docs["data"].to_pylist(), strict=True):
            sizes, places = unpacked(data)
            at = _starts(sizes)
            good = (_sums(~ok[places], at) == 0) & (sizes > 0) if len(places) else sizes > 0
            each = [np.where(good, _sums(x[places], at), 0) for x in numbers]
            every = places.tolist()
            groups = [";".join([texts[k] for k in every[i:j]]) if g else "" for g, i, j in zip(good.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)]
            digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
            doc = np.repeat(np.arange(len(sizes)), sizes)
            keep = good[doc]
            held, often = np.unique(doc[keep] * max(1, len(ok)) + places[keep], return_counts=True)
            doc, some = held // max(1, len(ok)), held % max(1, len(ok))
            n, where = _gathered(first, some)
            key, back = np.unique(np.repeat(doc, n) * max(1, len(pairs)) + local[where], return_inverse=True)
            linked = np.bincount(back, np.repeat(often, n) * times[where], len(key)).astype(np.int64)
            doc, nth = key // max(1, len(pairs)), key % max(1, len(pairs))
            docs_of += np.bincount(nth, minlength=len(pairs))
            links = packed(np.bincount(doc, minlength=len(sizes)), nth, linked)
            rows.append((ids, np.stack(each).astype("<i8").tobytes(), digests, links, groups if with_groups else None))
        cols = list(zip(*rows, strict=True))
        n, m = len(pairs), len(rows)
        made = [np.full(n + m, chunk), [*pairs.tolist(), *[None] * m], [*range(n), *[None] * m], [*docs_of.tolist(), *[None] * m], *([None] * n + list(c) for c in cols)]
        return pa.table([pa.array(c, k) for c, k in zip(made, kinds, strict=True)], names)

    return run


def _counted(with_groups: bool):
    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        nth, of, best = (counts[c].to_numpy() for c in ("nth", "docs", "best"))
        size = int(nth.max()) + 1 if len(nth) else 0
        count, is_best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        count[nth], is_best[nth] = of, best.astype(np.int64)
        out = {c: [] for c in ("doc_id", *_NUMBERS, "groups_sha256", *["groups"] * with_groups)}
        for row in docs.select(["ids", "numbers", "digests", "links", "groups"]).to_pylist():
            n, k, times = unpacked(row["links"])
            at = _starts(n)
            numbers = [*np.frombuffer(row["numbers"], "<i8").reshape(4, -1), _sums(is_best[k] * times, at), _sums(count[k] * times, at)]
            out["doc_id"] += row["ids"]
            for c, x in zip(_NUMBERS, numbers, strict=True):
                out[c] += x.tolist()
            out["groups_sha256"] += row["digests"]
            if with_groups:
                out["groups"] += row["groups"]
        return pa.table({c: pa.array(x, pa.string() if c.startswith("groups") else pa.int64()) for c, x in out.items()})

    return run


class Alignment(NamedTuple):
    documents: DataFrame  # doc_id, counts, groups_sha256[, groups]
    pairs: DataFrame  # pair (a_id << 32 | b_id), docs, best


def align(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False, chunk_chars: int = CHUNK_CHARS) -> Alignment:
    n = shuffle_partitions(docs.sparkSession)
    chunks = written(_chunks(docs, path_a, path_b, n * BUCKETS, chunk_chars), "chunks")
    texts = chunks.where("bucket < 0").select("chunk", "ids", "data")
    words = chunks.where("bucket >= 0").select(F.col("chunk").alias("chunk"), "bucket", "data")  # columns of its own, for the cogroup
    replies = _aligned(words.repartition(n, "bucket").sortWithinPartitions("bucket", "chunk"), path_a, path_b)
    composed = written(texts.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_composed(with_groups), COMPOSED), "composed")
    held = composed.where("docs > 0").select(F.col("chunk").alias("chunk"), "pair", "nth", F.col("docs").alias("n"))
    counts = written(held.groupBy("pair").agg(F.sum("n").alias("docs")), "pairs")
    a_id = F.shiftright("pair", 32)
    top = counts.groupBy(a_id.alias("a_id")).agg(F.max("docs").alias("top"))
    pairs = counts.withColumn("a_id", a_id).join(top, "a_id").select("pair", "docs", (F.col("docs") == F.col("top")).alias("best"))
    told = held.join(pairs, "pair").select("chunk", "nth", "docs", "best")
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in _NUMBERS) + ", groups_sha256 string" + ", groups string" * with_groups
    documents = composed.where("pair is null").select("chunk", "ids", "numbers", "digests", "links", "groups")
    return Alignment(documents.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_counted(with_groups), schema), pairs)


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")).documents
