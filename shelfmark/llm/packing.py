"""Operator 12: best-fit packing after Martello and Toth's dominance reduction.

A document is its ids and an end id. Pieces of the full capacity are cut from the end of longer ones,
so the first piece holds the rest. Which pieces share a sequence depends on their lengths only, and
there are no more lengths than the capacity; so the plan is made from a count for each length (at
most ``capacity`` numbers reach the driver, whatever the size of the corpus), and pieces are told
their places by their rank among those of their length:

1. One task a split encodes its documents and numbers their pieces within (task, length).
2. Counts by (task, length) give each task's first rank, without a sort of the pieces.
3. ``reduced`` fixes sets of one to three pieces that dominate every other set with their largest
   piece, as often as they last. A set F dominates G if the pieces of G can be grouped so that each
   group is no longer than a piece of F of its own: wherever an optimal packing holds G, it can hold F
   instead with no sequence more. What lasts is packed by ``best_fit``, longest first.

Cases: a null text counts as empty, an empty one is the end id alone; a null doc_id is kept; repeated
rows are packed each for itself; an empty table gives an empty result; other columns are ignored.
Which of several equally long pieces comes first follows the splits of the input, so sequence ids and
the company of a piece may differ with the partitioning; their number does not.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, table, tokenizer_file, with_id_and_text, written

CAPACITY, END_ID = 1024, 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
_ROWS = 20_000  # of a batch that a task sends on

Plan = list[tuple[tuple[tuple[int, int], ...], int]]  # ((length, how many), ...), sequences like this


def _fitting(sizes: list[int], counts: Counter, s: int, room: int) -> tuple[int, ...] | None:
    """The lengths of a set that, with one piece of length s, dominates every other with that piece.

    ``sizes`` ascends and holds the lengths left; ``room`` is what a piece of s leaves free.
    """

    def others(a: int) -> int:
        return counts[a] - (a == s)

    small: list[int] = []  # the three shortest others
    for a in sizes:
        small += [a] * min(others(a), 3 - len(small))
        if len(small) == 3:
            break
    if not small or small[0] > room:
        return ()  # nothing fits beside it
    at = bisect_right(sizes, room) - 1
    while not others(sizes[at]):
        at -= 1
    longest = sizes[at]
    if longest == room or len(small) < 2 or small[0] + small[1] > room:
        return (longest,)  # whatever else fits is no longer than this one
    if len(small) == 3 and sum(small) <= room:
        return None  # three others fit: no rule for that
    best, low = (0, 0, 0), 0
    for high in range(at, -1, -1):  # the pair of the greatest sum, of equals that with the longest piece
        a = sizes[high]
        if not others(a):
            continue
        low = bisect_right(sizes, min(room - a, a)) - 1
        while low >= 0 and others(sizes[low]) < 1 + (sizes[low] == a):
            low -= 1
        if low >= 0 and (a + sizes[low], a, sizes[low]) > best:
            best = (a + sizes[low], a, sizes[low])
    total, a, b = best
    if longest >= total:
        return (longest,)  # and at most two others fit
    if longest == a:
        # a alone covers single pieces; a pair is covered unless both of it are longer than b
        longer: list[int] = []
        for x in sizes[bisect_right(sizes, b) :]:
            longer += [x] * min(others(x), 2 - len(longer))
            if len(longer) == 2:
                break
        if len(longer) < 2 or sum(longer) > room:
            return (a, b)
    return None


def reduced(counts: dict[int, int], capacity: int) -> tuple[Plan, Counter]:
    """Sequences that some optimal packing holds, and the counts of what is left for it to pack.

    Taking pieces away leaves every rule's premise true, so a set is fixed as often as all its
    lengths last. Passes repeat until none fixes anything.
    """
    left, plan, again = Counter({s: n for s, n in counts.items() if n}), [], True
    sizes = sorted(left)
    while again:
        again = False
        for s in sizes[::-1]:
            while left[s]:
                more = _fitting(sizes, left, s, capacity - s)
                if more is None:
                    break
                one = Counter((s, *more))
                n = min(left[a] // k for a, k in one.items())
                plan.append((tuple(sorted(one.items(), reverse=True)), n))
                left.subtract({a: k * n for a, k in one.items()})
                again = True
                for a in one:
                    if not left[a]:
                        sizes.remove(a)
    return plan, +left


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Longest pieces first, each into the fullest sequence that has room; equal pieces go at once.

    A sequence that took a piece is the fullest with room for the next equal one, if it has any. Each
    length splits at most two groups of equal sequences, so the plan has few groups however many pieces.
    """
    groups: dict[int, list[list]] = {}  # by free room: [contents, how many]
    rooms: list[int] = []

    def put(contents: tuple, n: int, room: int) -> None:
        if n:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append([contents, n])

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            at = bisect_left(rooms, s)
            if at < len(rooms):
                room = rooms[at]
                contents, many = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, contents, many = capacity, (), n
            each = room // s
            full = min(many, n // each)
            rest = (n - full * each) if full < many else 0
            put((*contents, (s, each)), full, room - each * s)
            if rest:
                put((*contents, (s, rest)), 1, room - rest * s)
            if contents:
                put(contents, many - full - bool(rest), room)
            n -= full * each + rest
    return [(contents, n) for group in groups.values() for contents, n in group]


def planned(counts: dict[int, int], capacity: int) -> Plan:
    fixed, left = reduced(counts, capacity)
    return fixed + best_fit(left, capacity)


def least_sequences(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's second bound: no packing has fewer sequences."""
    best = -(-sum(s * n for s, n in counts.items()) // capacity)
    for a in {s for s in counts if 2 * s <= capacity}:
        alone = sum(n for s, n in counts.items() if s > capacity - a)
        wide = {s: n for s, n in counts.items() if capacity - a >= s and 2 * s > capacity}
        free = sum(n * (capacity - s) for s, n in wide.items())
        rest = sum(s * n for s, n in counts.items() if a <= s and 2 * s <= capacity)
        best = max(best, alone + sum(wide.values()) + max(0, -(-(rest - free) // capacity)))
    return best


def _pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .units import encoder

        encode, end = encoder(path, 4).encode, int(end_id).to_bytes(4, "little")
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
            rows.clear()
            return made

        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        names = [c.split()[0] for c in PIECES.split(", ")]
        for some in slices(batches):
            for i, text in zip(some.column(0).to_pylist(), some.column(1), strict=True):
                ids = memoryview(encode(text.as_py()) + end)
                n = len(ids) // 4
                at, length, k = 0, (n - 1) % capacity + 1, 0
                while at < n:
                    rows.append((i, k, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), part, int(seen[length])))
                    seen[length] += 1
                    at, length, k = at + length, capacity, k + 1
                    if len(rows) >= _ROWS:
                        yield batch()
        if rows:
            yield batch()

    return with_id_and_text(docs).mapInArrow(run, PIECES)


def _places(plan: Plan, capacity: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(shift, keys, places): a piece of a rank among those of its length lies at the last key up to (length << shift) + rank."""
    shift = 62 - capacity.bit_length()
    rows, used, sequence = [], Counter(), 0
    for contents, n in plan:
        offset = 0
        for s, each in contents:
            rows.append(((s << shift) + used[s], sequence, each, offset))
            used[s] += n * each
            offset += s * each
        sequence += n
    table_ = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return shift, table_[:, 0].copy(), table_[:, 1:].copy()


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, n_sequences, least_sequences), a row for each piece.

    ``least_sequences`` is a bound that no packing can beat. The pieces are written once, without
    their ids; a later join on (doc_id, start) or op6's records give these.
    """
    pieces = written(_pieces(docs, path, capacity, end_id), "pieces")
    by_part = written(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    plan = planned(counts, capacity)
    shift, keys, places = _places(plan, capacity)
    totals = sum(n for _, n in plan), least_sequences(counts, capacity)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            key = (length << shift) + rank
            at = np.searchsorted(keys, key, "right") - 1
            sequence, each, offset = places[at].T
            nth = key - keys[at]
            more = [sequence + nth // each, offset + nth % each * length, *(np.full(len(key), t) for t in totals)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *(pa.array(m, pa.int64()) for m in more)], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "n_sequences", "least_sequences"]
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    firsts = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(firsts, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, n_sequences long, least_sequences long")


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
