import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm import decontaminate as D


def brute_tiles(item, text, width):
    """Greedy string tiling as first published: look for the longest unmarked common run, mark it, repeat."""
    p_used, t_used, total = [False] * len(item), [False] * len(text), []
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(text)):
                n = 0
                while p + n < len(item) and t + n < len(text) and item[p + n] == text[t + n] and not p_used[p + n] and not t_used[t + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, t)
        n, p, t = best
        if n < width:
            return total
        p_used[p : p + n] = [True] * n
        t_used[t : t + n] = [True] * n
        total.append((p, t, n))


def brute(docs, items, width=5, coverage=0.8):
    out = []
    for d, text in docs:
        w = re.findall(r"\w+", (text or "").lower())
        for i, x in items:
            v = re.findall(r"\w+", (x or "").lower())
            if not v:
                continue
            if len(v) < width:
                if any(w[k : k + len(v)] == v for k in range(len(w) - len(v) + 1)):
                    out.append((d, i, 1, len(v), len(v), 1.0))
                continue
            if not {tuple(v[k : k + width]) for k in range(len(v) - width + 1)} & {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}:
                continue
            tiles = brute_tiles(v, w, width)
            m = sum(n for _, _, n in tiles)
            if m >= coverage * len(v):
                out.append((d, i, len(tiles), m, len(v), m / len(v)))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@given(st.lists(st.integers(1, 3), min_size=2, max_size=14), st.lists(st.integers(0, 3), max_size=24))
@settings(max_examples=150, deadline=None)
def test_tiling(item, text):
    item_, text_ = np.array(item), np.array(text, np.int64)
    seeds = [(p, t) for p in range(len(item) - 1) for t in range(len(text) - 1) if item[p : p + 2] == text[t : t + 2]]
    assert D.tiling(item_, text_, 2, seeds) == brute_tiles(item, text, 2)


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def test_cases(spark):
    w = ITEM.split()
    docs = [
        (1, "x y " + ITEM + " z"),
        (2, " ".join(w[10:] + ["filler"] + w[:10])),  # reordered
        (3, " ".join(w[:10])),  # half
        (4, ITEM.upper().replace(" ", ", ")),
        (5, None),
        (6, ""),
        (7, "two words"),
        (8, "Two words!"),
        (9, " ".join(w[::-1])),
        (None, ITEM),
        (1, "x y " + ITEM + " z"),
        (10, "noise " * 30_000 + ITEM),
        (11, " ".join(w[:8] + ["gap"] + w[9:])),
        (12, "a longer text that holds two words, and two words again"),
        (13, "two such words"),
    ]
    items = [(1, ITEM), (2, "two words"), (3, None), (4, ""), (None, ITEM), (1, ITEM), (5, "alpha beta gamma delta epsilon")]
    d = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(*r, "c") for r in items], "item_id long, text string, doc_id string")
    want = brute(docs[:11] + docs[12:], items) + [(10, *x[1:]) for x in brute([(10, "noise noise noise " + ITEM)], items)]
    assert result(D.leaks(d, b)) == sorted(want, key=str)
    assert result(D.leaks(d, b, block_words=25)) == sorted(want, key=str)
    assert result(D.leaks(d.limit(0), b)) == [] and result(D.leaks(d, b.limit(0))) == []


def test_rows_without_leaks(spark):
    rows = [(1, ITEM, "a"), (1, "clean text", "b"), (None, "two words", "c"), (None, "fine", "d"), (2, None, "e"), (2, None, "e")]
    d, b = spark.createDataFrame(rows, "doc_id long, text string, item_id string"), spark.createDataFrame([(1, ITEM), (2, "two words"), (3, None)], "item_id long, text string")
    for words in (10_000, 5):
        assert sorted(r.item_id for r in D.without_leaks(d, b, block_words=words).collect()) == ["b", "d", "e", "e"]
        assert D.without_leaks(d, b.limit(0), block_words=words).count() == 6


def test_names_that_clash(spark):
    names = ["k1", "k2", "g1", "row", "item_id", "tiles"]
    docs = spark.createDataFrame([(1, "one two three four five six seven", *"klmnop"), (2, "nothing of that", *"klmnop")], f"doc_id long, text string, {', '.join(f'`{n}` string' for n in names)}")
    items = spark.createDataFrame([(1, "one two three four five six seven", 5)], "item_id long, text string, k1 int")
    for words in (0, 10**6):
        assert [tuple(r) for r in D.without_leaks(docs, items, block_words=words).collect()] == [(2, "nothing of that", *"klmnop")]
        assert [(r.doc_id, r.item_id) for r in D.leaks(docs, items, block_words=words).collect()] == [(1, 1)]


def test_words_of_any_script_count(spark):
    """Words are counted in every script, so a benchmark in Cyrillic meets the bound like any other."""
    items = spark.createDataFrame([(1, "слово " * 600)], "item_id long, text string")
    assert D._few(items, 500) is None and len(D._few(items, 700)) == 1


def test_documents(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = result(D.op5_decontamination(spark, sf))
    assert got == brute(docs, items) and got
    d, b = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    assert result(D.leaks(d, b, block_words=10)) == got  # joined
