"""Operator 5: benchmark decontamination by greedy string tiling.

A text's words (``\\w+`` of the lower-cased text) become numbers over a benchmark block's
vocabulary. A rolling Karp-Rabin hash over five words finds the seeds that a text shares with the
block; for every item whose seeds could cover enough of it, the longest match not yet covered is
marked again and again until none of five words is left. Tiles may stand in any order, so
reordered passages are caught. An item counts as leaked where tiles cover 0.8 of its words.

A benchmark of at most ``BLOCK_WORDS`` words and ``BLOCK_CHARS`` characters goes to the tasks whole;
there is no shuffle, and a task holds one batch of texts. A larger one is joined: texts and items
meet on equal seeds, and only pairs whose common seeds can cover enough of the item are tiled.

Cases: null and empty texts and items match nothing; an item of under five words leaks into every
text that holds all of it in one run; repeated documents and items each give a row; null ids are kept;
empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, whole_row, with_id_and_text, written

MIN_MATCH, COVERAGE = 5, 0.8
BLOCK_WORDS, BLOCK_CHARS = 500_000, 16 << 20
_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id long, item_id long, tiles int, matched_words int, item_words int, coverage double"


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of every window of ``width`` numbers, modulo 2**64."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            h = h * _BASE + ids[k : k + n].astype(np.uint64)
    return h


def tiling(item: np.ndarray, text: np.ndarray, width: int, seeds: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in item, place in text, length), longest first, then by place.

    ``seeds`` are all pairs of places where ``width`` words agree. Seeds that follow each other are
    one match; a match that a tile overlaps goes back as the parts that are still free.
    """
    diagonal = defaultdict(list)
    for p, t in seeds:
        diagonal[t - p].append(p)
    heap = []
    for shift, places in diagonal.items():
        places.sort()
        begin = last = places[0]
        for p in [*places[1:], None]:
            if p is None or p > last + 1:
                heap.append((-(last - begin + width), begin, begin + shift))
                begin = p
            last = p
    heapq.heapify(heap)
    in_item, in_text, out = np.zeros(len(item), bool), np.zeros(len(text), bool), []
    while heap:
        size, p, t = heapq.heappop(heap)
        taken = in_item[p : p - size] | in_text[t : t - size]
        if not taken.any():
            in_item[p : p - size] = in_text[t : t - size] = True
            out.append((p, t, -size))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= width:
                heapq.heappush(heap, (a - b, p + a, t + a))
    return out


class Block:
    """Items of a benchmark with their vocabulary and seeds."""

    def __init__(self, items: list[tuple[int | None, str]], width: int = MIN_MATCH, coverage: float = COVERAGE):
        self.width, self.coverage, self.number, self.items = width, coverage, {}, []
        self.short: dict[int, dict[tuple, list]] = defaultdict(lambda: defaultdict(list))  # by number of words
        seeds, owners = [], []
        for key, text in items:
            words = _WORD.findall((text or "").lower())
            if not words:
                continue
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words], np.int64)
            if len(words) < width:
                self.short[len(ids)][tuple(ids.tolist())].append(key)
                continue
            owners.append(np.stack([np.full(len(ids) - width + 1, len(self.items)), np.arange(len(ids) - width + 1)], 1))
            seeds.append(rolling(ids, width))
            self.items.append((key, ids))
        flat = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.seeds, self.owners = flat[order], (np.concatenate(owners)[order] if seeds else np.zeros((0, 2), np.int64))

    def leaks(self, text: str) -> Iterator[tuple]:
        """(item_id, tiles, matched words, item words, coverage) of every item that leaked into a text."""
        get = self.number.get
        words = _WORD.findall(text.lower())
        ids = np.fromiter([get(w, 0) for w in words], np.int64, len(words))
        for n, wanted in self.short.items():
            if len(ids) >= n and (on := np.convolve(ids > 0, np.ones(n, np.int64), "valid") == n).any():
                for run in set(map(tuple, np.lib.stride_tricks.sliding_window_view(ids, n)[on].tolist())) & wanted.keys():
                    for key in wanted[run]:
                        yield key, 1, n, n, 1.0
        if len(words) < self.width:
            return
        known = np.convolve(ids > 0, np.ones(self.width, np.int64), "valid") == self.width
        if not known.any() or not len(self.seeds):
            return
        places = np.flatnonzero(known)
        h = rolling(ids, self.width)[places]
        lo, hi = np.searchsorted(self.seeds, h), np.searchsorted(self.seeds, h, "right")
        found = defaultdict(list)
        for t, a, b in zip(places[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
            for i, p in self.owners[a:b].tolist():
                if (self.items[i][1][p : p + self.width] == ids[t : t + self.width]).all():  # equal hashes are checked
                    found[i].append((p, t))
        for i, seeds in found.items():
            key, item = self.items[i]
            reach = np.zeros(len(item) + 1, np.int64)
            for p in {p for p, _ in seeds}:
                reach[p : p + self.width] = 1
            if reach.sum() < self.coverage * len(item):
                continue  # even all seeds together cover too little
            tiles = tiling(item, ids, self.width, seeds)
            matched = sum(n for _, _, n in tiles)
            if matched >= self.coverage * len(item):
                yield key, len(tiles), matched, len(item), matched / len(item)


def _few(benchmark: DataFrame, block_words: int) -> list[tuple] | None:
    """The benchmark's items if they are within the bounds for going to every task."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    words, chars = items.agg(F.sum(F.size(F.split("text", r"(?U)\W+"))), F.sum(F.length("text") + 1)).first()
    return [(r.item_id, r.text) for r in items.collect()] if (words or 0) <= block_words and (chars or 0) <= BLOCK_CHARS else None


def _by_text(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(key, k1, k2) of all rows and (k1, k2, text) of the distinct texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = rows.select(F.col(key).cast("long").alias(key), text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))
    return rows.select(key, "k1", "k2"), rows.groupBy("k1", "k2").agg(F.any_value("text").alias("text"))


def _seeds(texts: DataFrame, width: int, shorter: list[int], whole: bool) -> DataFrame:
    """(k1, k2, n, words, seed): distinct Karp-Rabin hashes of n words; of items (``whole``) short ones have one seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        number: dict[str, int] = {}
        for batch in slices(batches):
            for k1, k2, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = _WORD.findall(text.lower())
                if len(number) > 1_000_000:
                    number.clear()
                for w in set(words) - number.keys():
                    number[w] = int.from_bytes(blake2b(w.encode(), digest_size=8).digest(), "little")
                ids = np.array([number[w] for w in words], np.uint64)
                for n in [min(width, len(ids))] if whole else [width, *shorter]:
                    h = np.unique(rolling(ids, n)).view(np.int64) if n else np.zeros(0, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k1)), pa.array(np.full(len(h), k2)), pa.array(np.full(len(h), n, np.int32)), pa.array(np.full(len(h), len(ids), np.int64)), pa.array(h)], ["k1", "k2", "n", "words", "seed"])

    return texts.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, n int, words long, seed long")


def _joined(texts: DataFrame, items: DataFrame, width: int, coverage: float) -> DataFrame:
    """(k1, k2, g1, g2, tiles, matched_words, item_words, coverage) of distinct texts and distinct items that leaked into them."""
    named = items.select("k1", "k2", "text")
    wanted = written(_seeds(named, width, [], True), "item-seeds")
    shorter = [r.n for r in wanted.where(F.col("n") < width).select("n").distinct().collect()]  # at most ``width`` numbers
    wanted = wanted.select(F.col("k1").alias("g1"), F.col("k2").alias("g2"), "n", F.col("words").alias("item_words"), "seed")
    met = _seeds(texts, width, shorter, False).select("k1", "k2", "n", "seed").join(wanted, ["n", "seed"])
    met = met.groupBy("k1", "k2", "g1", "g2").agg(F.count("*").alias("seeds"), F.max("n").alias("n"), F.max("item_words").alias("item_words"))
    # distinct seeds: they fall short of the bound only where fewer of the item's own distinct seeds are shared
    own = wanted.groupBy("g1", "g2").agg(F.count("*").alias("distinct_seeds"))
    enough = F.col("seeds") * width + (F.col("item_words") - width + 1 - F.col("distinct_seeds")) * width >= F.col("item_words") * coverage
    met = met.join(own, ["g1", "g2"]).where((F.col("n") < width) | enough).select("k1", "k2", "g1", "g2")
    pairs = met.join(texts, ["k1", "k2"]).join(named.select(F.col("k1").alias("g1"), F.col("k2").alias("g2"), F.col("text").alias("item")), ["g1", "g2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*((c, pa.int64()) for c in ("k1", "k2", "g1", "g2")), ("tiles", pa.int32()), ("matched_words", pa.int32()), ("item_words", pa.int32()), ("coverage", pa.float64())])
        for batch in slices(batches, 200):
            rows = [(*r[:4], *leak[1:]) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True) for leak in Block([(None, r[5])], width, coverage).leaks(r[4])]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return pairs.select("k1", "k2", "g1", "g2", "text", "item").mapInArrow(run, "k1 long, k2 long, g1 long, g2 long, tiles int, matched_words int, item_words int, coverage double")


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = MIN_MATCH, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each document and benchmark item that leaked into it."""
    items = _few(benchmark, block_words)
    if items is None:
        (rows, texts), (wanted, parts) = _by_text(docs, "doc_id"), _by_text(benchmark, "item_id")
        found = written(_joined(texts, parts, width, coverage), "leaks")
        out = rows.join(found, ["k1", "k2"]).join(wanted.select("item_id", F.col("k1").alias("g1"), F.col("k2").alias("g2")), ["g1", "g2"])
        return out.select("doc_id", "item_id", "tiles", "matched_words", "item_words", "coverage")
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("tiles", pa.int32()), ("matched_words", pa.int32()), ("item_words", pa.int32()), ("coverage", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(items)  # within the bounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(shared.value, width, coverage)
        for batch in slices(batches):
            rows = [(key, *leak) for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for leak in block.leaks(text)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return with_id_and_text(docs).mapInArrow(run, SCHEMA)


def without_leaks(docs: DataFrame, benchmark: DataFrame, width: int = MIN_MATCH, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs into whose text no item leaked, with all their columns; each row is decided by its text."""
    items = _few(benchmark, block_words)
    if items is None:
        found = _joined(_by_text(docs, "doc_id")[1], _by_text(benchmark, "item_id")[1], width, coverage).select("k1", "k2").distinct()
        rows = docs.select(whole_row(docs).alias("row"))  # so that no name can clash
        own = lambda c: F.col("row").getField(c)
        text = F.coalesce(own("text"), F.lit(""))
        kept = rows.join(found, (F.xxhash64(text) == F.col("k1")) & (F.xxhash64(F.lit(1), text) == F.col("k2")), "left_anti")
        return kept.select(*[own(c).alias(c) for c in docs.columns])
    shared, place = docs.sparkSession.sparkContext.broadcast(items), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(shared.value, width, coverage)
        for batch in slices(batches):
            yield batch.filter(pa.array([next(block.leaks(t or ""), None) is None for t in batch.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
