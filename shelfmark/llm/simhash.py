"""Operator 3: SimHash near-duplicates by a binary-trie self-join.

Fingerprints are collapsed to distinct values first. Within 4 differing bits over six bit blocks at
least two blocks agree wholly, so the join runs over 15 tries, each with one pair of blocks on
top: there the error budget stays unspent, and each pair of top blocks is a subtrie of its own that
any task can take. Below, node pairs of a subtrie are traversed together, a pair's differing bits
add up, and a pair is pruned once they exceed the budget. In a subtrie with many leaves the bits below are
cut into five blocks, of which one agrees wholly in any pair within the budget; so it becomes five
sets of subtries, each with one more block on top, and its leaves are copied five times however
many they are. Only where such a subtrie still has many leaves is it cut into chunks, and every pair of
chunks traversed on its own (same node pairs, other tasks). A task returns a spanning forest of the
links it finds, never all of them: their components are the same.

Cases: a null text counts as empty; texts without words have fingerprint zero and link like any
other; repeated rows share a fingerprint; a null doc_id gets a fingerprint, links like any other and
gets the smallest non-null doc_id of its component (null if there is none); an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import quoted, shuffle_partitions, slices, table, with_id_and_text, written
from .components import components

WORDS, BUDGET = 4, 4
BLOCKS = (11, 11, 11, 11, 10, 10)  # bits, from the highest
CHUNK = 2048
FRONTIER = 1 << 20
_SET_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def fingerprints_of(texts: list[bytes], words: int = WORDS) -> np.ndarray:
    """Unsigned fingerprints: a bit is set if it is in over half of a text's shingle hashes."""
    from .shingles import Words, text_groups, xxh64

    out = np.zeros(len(texts), np.uint64)
    column = np.arange(8) * 256
    for a, b in text_groups(texts):
        w = Words(texts[a:b])
        start, length, _, bounds = w.shingles(words)
        h = xxh64(w.buf, start, length).astype("<u8").view(np.uint8).reshape(-1, 8)
        for d, (i, j) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if j > i:
                seen = np.zeros(2048, np.int64)
                for k in range(i, j, 1 << 20):
                    seen += np.bincount((h[k : min(j, k + (1 << 20))] + column).ravel(), minlength=2048)
                ones = (seen.reshape(8, 256) @ _SET_BITS).ravel()
                out[a + d] = np.packbits(ones * 2 > j - i, bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [x.encode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints_of(texts, words).view(np.int64))], ["doc_id", "fp"])

    return with_id_and_text(docs).mapInArrow(run, "doc_id long, fp long")


def _layouts() -> list[tuple[int, int, int, int, list[tuple[int, int]]]]:
    lows = [64 - sum(BLOCKS[: i + 1]) for i in range(len(BLOCKS))]
    return [(i, j, lows[i], lows[j], [(lows[k], BLOCKS[k]) for k in range(len(BLOCKS)) if k not in (i, j)]) for i, j in combinations(range(len(BLOCKS)), 2)]


def tries(reps: DataFrame) -> DataFrame:
    """(trie, top, below, rep) for each of the 15 tries: the top blocks' bits and the bits below them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, rep = batch.column(0).to_numpy().view(np.uint64), batch.column(1)
            for t, (i, j, low_i, low_j, rest) in enumerate(_layouts()):
                bits = lambda low, n: (fp >> np.uint64(low)) & np.uint64((1 << n) - 1)
                top = (bits(low_i, BLOCKS[i]) << np.uint64(BLOCKS[j])) | bits(low_j, BLOCKS[j])
                below, used = np.zeros(len(fp), np.uint64), 0
                for low, n in rest:
                    below, used = (below << np.uint64(n)) | bits(low, n), used + n
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), t, np.int32)), pa.array(top.astype(np.int32)), pa.array(below.astype(np.int64)), rep], ["trie", "top", "below", "rep"])

    return reps.mapInArrow(run, "trie int, top int, below long, rep long")


def linked(below: np.ndarray, roots: list[tuple[int, int, int, int]], depth: int, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the budget, by traversing node pairs of tries over ranges of ``below``.

    Each range [lo, hi) of ``below`` is sorted, so a trie node is a subrange; a root is a pair of
    ranges, the same twice for a self-join. Of all depths at most a few frontiers are held.
    """
    todo = [(depth, np.array(roots, np.int64).reshape(-1, 4), np.zeros(len(roots), np.int8))]
    sums: dict[int, np.ndarray] = {}
    while todo:
        d, pairs, err = todo.pop()
        if not len(pairs):
            continue
        if len(pairs) > FRONTIER:
            todo += [(d, pairs[k : k + FRONTIER], err[k : k + FRONTIER]) for k in range(0, len(pairs), FRONTIER)]
            continue
        a0, a1, b0, b1 = pairs.T
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():  # two single leaves: the bits left are compared at once
            i, j, e = a0[leaf], b0[leaf], err[leaf]
            rest = (below[i] ^ below[j]) & np.uint64((1 << d) - 1)
            near = (e + np.bitwise_count(rest) <= budget) & (i != j)
            yield i[near], j[near]
            pairs, err = pairs[~leaf], err[~leaf]
            if not len(pairs):
                continue
            a0, a1, b0, b1 = pairs.T
        if d == 0:  # equal keys of different chunks: all within budget; a chain links them
            for x in pairs.tolist():
                ids = np.unique(np.concatenate([np.arange(x[0], x[1]), np.arange(x[2], x[3])]))
                yield ids[:-1], ids[1:]
            continue
        if d - 1 not in sums:
            sums[d - 1] = np.concatenate([[0], np.cumsum((below >> np.uint64(d - 1)) & np.uint64(1))]).astype(np.int64)
        s = sums[d - 1]
        am, bm = a1 - (s[a1] - s[a0]), b1 - (s[b1] - s[b0])
        same = (a0 == b0) & (a1 == b1)
        more = err < budget
        sides = [((a0, am, b0, bm), err, np.ones(len(err), bool)), ((am, a1, bm, b1), err, np.ones(len(err), bool)), ((a0, am, bm, b1), err + 1, more), ((am, a1, b0, bm), err + 1, more & ~same)]
        kept = [(np.stack(x, 1)[k], e[k]) for x, e, on in sides if (k := on & (x[1] > x[0]) & (x[3] > x[2]) & ~((x[0] == x[2]) & (x[1] == x[3]) & (x[1] - x[0] == 1))).any()]
        if kept:
            todo.append((d - 1, np.concatenate([x for x, _ in kept]), np.concatenate([e for _, e in kept])))


def _cuts(depth: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of ``BUDGET`` + 1 blocks of so many bits."""
    edges = [depth * k // (BUDGET + 1) for k in range(BUDGET + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _depths() -> list[int]:
    """Bits below the top, of the 15 tries and then of the sets that each is cut into."""
    plain = [64 - BLOCKS[i] - BLOCKS[j] for i, j, *_ in _layouts()]
    return plain + [d - n for d in plain for _, n in _cuts(d)]


def _deeper() -> Column:
    """The leaves (trie, top, below) of a large subtrie in each of its sets: one more block on top, the rest below."""
    out = F.lit(None)
    for depth in sorted(set(_depths()[: len(_layouts())])):
        sets = []
        for k, (low, n) in enumerate(_cuts(depth)):
            block = F.shiftright("below", low).bitwiseAND((1 << n) - 1)
            rest = F.shiftleft(F.shiftright("below", low + n), low).bitwiseOR(F.col("below").bitwiseAND((1 << low) - 1))
            number = F.lit(len(_layouts())) + F.col("trie") * (BUDGET + 1) + k
            sets.append(F.struct(number.cast("int").alias("trie"), F.shiftleft("top", n).bitwiseOR(block).alias("top"), rest.alias("below")))
        of_depth = F.col("trie").isin([t for t, d in enumerate(_depths()[: len(_layouts())]) if d == depth])
        out = F.when(of_depth, F.array(*sets)).otherwise(out)
    return out


def links(reps: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(u, v): links with the components of all links of at most ``budget`` bits between distinct fingerprints.

    ``reps`` has (fp, rep), a row for each distinct fingerprint.
    """
    spark = reps.sparkSession
    rows = tries(reps).withColumn("top", F.col("top").cast("long"))
    many = lambda df, kind: df.groupBy("trie", "top").agg(F.count("*").alias("count")).where(F.col("count") > 2 * CHUNK).select("trie", "top", kind)
    large = many(rows, F.lit(True).alias("large"))
    rows = rows.join(large, ["trie", "top"], "left").select("trie", "top", "below", "rep", F.explode(F.when(F.col("large"), _deeper()).otherwise(F.array(F.struct("trie", "top", "below")))).alias("d")).select("d.*", "rep")
    hot = many(rows.where(F.col("trie") >= len(_layouts())), F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("below"), "chunks").cast("int")
    units = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least(c, chunk).alias("i"), F.greatest(c, chunk).alias("j")))
    rows = rows.join(hot, ["trie", "top"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("own", F.when(F.col("chunks") > 1, chunk).otherwise(0)).select("trie", "top", "below", "rep", "own", F.explode(F.when(F.col("chunks") > 1, units).otherwise(F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))))).alias("unit"))
    rows = rows.select("trie", "top", "unit.i", "unit.j", "own", "below", "rep").repartition(shuffle_partitions(spark), "trie", "top", "i", "j").sortWithinPartitions("trie", "top", "i", "j", "own", "below")
    depths = np.array(_depths())

    def traverse(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        trie, top, i, j, own, below, rep = cols
        below = below.view(np.uint64)
        cut = np.flatnonzero((np.diff(trie) != 0) | (np.diff(top) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
        lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(trie)]])
        some = hi - lo > 1
        lo, hi = lo[some], hi[some]
        mid = np.array([x + int(np.searchsorted(own[x:y], j[x])) if i[x] != j[x] else x for x, y in zip(lo.tolist(), hi.tolist(), strict=True)], np.int64)
        u, v = [], []
        for depth in np.unique(depths):
            on = depths[trie[lo]] == depth if len(lo) else np.zeros(0, bool)
            roots = [(x, y, x, y) if m == x else (x, m, m, y) for x, m, y in zip(lo[on].tolist(), mid[on].tolist(), hi[on].tolist(), strict=True) if m < y]
            for p, q in linked(below, roots, int(depth), budget):
                from .components import forest

                x, y = forest(rep[p], rep[q]) if len(p) else (p, q)
                u.append(x)
                v.append(y)
        if not u:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        from .components import forest

        return forest(np.concatenate(u), np.concatenate(v))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)] if held else cols
            if not len(cols[0]):
                continue
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]) | (cols[3] != cols[3][-1]))
            done = int(last[-1]) + 1 if len(last) else 0
            if done:
                u, v = traverse([c[:done] for c in cols])
                yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(v.astype(np.int64))], ["u", "v"])
            held = [c[done:] for c in cols]
        if held and len(held[0]):
            u, v = traverse(held)
            yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(v.astype(np.int64))], ["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = WORDS, budget: int = BUDGET) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    fps = written(fingerprints(docs, words), "fingerprints")
    return fps.join(classes(fps, budget).drop("label"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def classes(fps: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(fp, label, component_id) of every distinct fingerprint of (doc_id, fp): its component and the smallest doc_id in it.

    The graph's nodes are fingerprints, so those that no row with a doc_id has link like any other.
    """
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    united = components(links(reps.select("fp", F.col("fp").alias("rep")), budget))
    # written, so that the joins have no aggregate in their stage and a very large component can be split
    reps = written(reps.join(united, reps.fp == united.node, "left").select("fp", "low", "component"), "fingerprint-classes")
    lows = written(reps.where("component is not null").groupBy("component").agg(F.min("low").alias("least")), "components")
    return reps.join(lows, "component", "left").select("fp", F.coalesce("component", "fp").alias("label"), F.when(F.col("component").isNull(), F.col("low")).otherwise(F.col("least")).alias("component_id"))


def one_of_each_group(docs: DataFrame, words: int = WORDS, budget: int = BUDGET) -> DataFrame:
    """One row of docs, with all its columns, for each group: the smallest doc_id, of several the first; without an id only if none has one."""
    numbers, place = {"fp": f"_fp_{len(docs.columns)}", "row": f"_row_{len(docs.columns)}"}, docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField(numbers["fp"], LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = fingerprints_of([(x or "").encode() for x in batch.column(place).to_pylist()], words)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp.view(np.int64))], [*batch.schema.names, numbers["fp"]])

    rows = written(docs.mapInArrow(run, schema).withColumn(numbers["row"], F.monotonically_increasing_id()), "numbered")
    fps = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(numbers["fp"]).alias("fp"), F.col(numbers["row"]).alias("row"))
    grouped = fps.join(classes(fps, budget).select("fp", "label"), "fp")
    first = grouped.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    return rows.join(first.select(F.col("first.row").alias(numbers["row"])), numbers["row"], "left_semi").select(quoted(docs.columns))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
