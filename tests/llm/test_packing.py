import random
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from shelfmark.llm import packing as P
from shelfmark.llm.common import tokenizer_file

PATH = tokenizer_file("byte_bpe_50k.json")


def fewest(items, capacity):
    """The least number of sequences, by trying everything."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for r in sorted({r for r in rooms if r >= items[k]}):
            i = rooms.index(r)
            go(k + 1, [*rooms[:i], r - items[k], *rooms[i + 1 :]])
        go(k + 1, [*rooms, capacity - items[k]])

    go(0, [])
    return best[0] if items else 0


def slow_best_fit(items, capacity):
    rooms = []
    for s in sorted(items, reverse=True):
        fit = [r for r in rooms if r >= s]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - s)
        else:
            rooms.append(capacity - s)
    return sorted(rooms)


def test_reduction_keeps_an_optimal_packing():
    rng, fixed_some, threes = random.Random(1), 0, 0
    for k in range(600):
        capacity = rng.choice([13, 30, 100])
        low = rng.choice([1, capacity // 6, capacity // 4])
        items = [rng.randint(max(1, low), capacity) for _ in range(rng.randint(0, 12))]
        fixed, left = P.reduced(Counter(items), capacity)
        n = sum(m for _, m in fixed)
        packed = Counter(left)
        for contents, m in fixed:
            assert sum(s * t for s, t in contents) <= capacity
            packed.update({s: t * m for s, t in contents})
        assert packed == Counter(items)
        assert n + fewest(list(left.elements()), capacity) == fewest(items, capacity), (items, capacity)
        fixed_some += n > 0 and bool(left)
        threes += any(sum(t for _, t in c) == 3 for c, _ in fixed)
        assert P.least_sequences(Counter(items), capacity) <= fewest(items, capacity)
    assert fixed_some > 10 and threes > 30, (fixed_some, threes)


def test_best_fit_by_groups_is_best_fit():
    rng = random.Random(2)
    for _ in range(400):
        capacity = rng.choice([10, 37, 100])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(0, 80))]
        plan = P.best_fit(Counter(items), capacity)
        rooms = sorted(capacity - sum(s * t for s, t in c) for c, n in plan for _ in range(n))
        assert rooms == slow_best_fit(items, capacity)
        assert sum((Counter({s: t * n for s, t in c}) for c, n in plan), Counter()) == Counter(items)


def test_plan_is_small_however_many_pieces():
    rng = np.random.default_rng(0)
    counts = Counter((1 + (rng.lognormal(5.4, 1.1, 2_000_000)).astype(int) % 1024).tolist())
    plan = P.planned(counts, 1024)
    assert len(plan) < 8000 and sum(n * s * t for c, n in plan for s, t in c) == sum(s * n for s, n in counts.items())
    assert sum(n for _, n in plan) <= 1.001 * P.least_sequences(counts, 1024)


def check(rows, out, capacity):
    t = Tokenizer.from_file(PATH)
    want = Counter()
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        at, size, k = 0, (len(ids) - 1) % capacity + 1, 0
        while at < len(ids):
            want[i, k, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes())] += 1
            at, size, k = at + size, capacity, k + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    held = {}
    for r in out:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= capacity
    assert all(r.n_sequences == len(held) >= r.least_sequences for r in out)
    return len(held)


def test_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = P.op12_best_fit_packing(spark, sf).collect()
    n = check(rows, out, 1024)
    assert n <= 1.02 * out[0].least_sequences + 1


def test_cases(spark):
    rows = [(5, "hello world"), (1, None), (2, ""), (3, "long word " * 900), (5, "hello world"), (None, "no id"), (4, "<|endoftext|>"), *((100 + k, "same text here") for k in range(200))]
    docs = spark.createDataFrame([(*r, 7, "x", 1) for r in rows], "doc_id long, text string, length int, part string, n int")
    sizes = set()
    for parts in (1, 5):
        sizes.add(check(rows, P.pack(docs.repartition(parts), PATH, 64).collect(), 64))
    assert len(sizes) == 1
    assert P.pack(docs.limit(0), PATH).collect() == []
