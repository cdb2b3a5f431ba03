import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelfmark.llm import token_trees as T
from shelfmark.llm.common import tokenizer_file
from shelfmark.llm.units import encoder

PATH = tokenizer_file("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)


def brute(text):
    return len(LIB.encode(text, add_special_tokens=False).ids)


def applied(text, edits):
    out, p = [], 0
    for a, b, x in sorted(edits):
        out += [text[p:a], x]
        p = b
    return "".join([*out, text[p:]])


def check(text, edits):
    e = encoder(PATH)
    lengths, counts = T.leaves(text, e)
    sums = T.tree(counts)
    assert sums[1] == brute(text) and lengths.sum() == len(text)
    new, lengths, sums, encoded, _ = T.edited(text, lengths, sums, edits, e)
    assert new == applied(text, edits) and sums[1] == brute(new) and lengths.sum() == len(new)
    cap = len(sums) // 2
    assert (sums[1:cap] == sums[2 : 2 * cap : 2] + sums[3 : 2 * cap : 2]).all()
    at = 0
    for k, n in enumerate(lengths.tolist()):
        assert sums[cap + k] == brute(new[at : at + n]) and T.prefix_tokens(sums, k) == sums[cap : cap + k].sum()
        at += n
    return new, lengths, sums, encoded


@given(st.integers(0, 10**9))
@settings(max_examples=120, deadline=None)
def test_random_edits(seed):
    r = random.Random(seed)
    bits = ["the", " ", " ", "  ", "\n", "a'll", "12", "é", "...", " word", " x", "'s", "\t", "　"]
    text = "".join(r.choice(bits) for _ in range(r.randrange(400)))
    cuts = sorted(r.randrange(len(text) + 1) for _ in range(2 * r.randrange(5)))
    edits = [(a, b, "".join(r.choice(bits) for _ in range(r.randrange(r.choice([2, 6, 90]))))) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
    check(text, edits)


def test_repeated_edits_and_little_work():
    text = " ".join(f"word{i % 97}" for i in range(60_000))
    e = encoder(PATH)
    lengths, counts = T.leaves(text, e)
    sums = T.tree(counts)
    for at in (0, 5, 200_000, len(text) - 3):
        text, lengths, sums, encoded, nodes = T.edited(text, lengths, sums, [(at, at + 2, "Zq")], e)
        assert encoded < 1500 and nodes < 100
    assert sums[1] == brute(text)


def test_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "plain words here", 3), (3, "second row", 3), (None, "no id", 4), (4, "long text " * 20_000, 5)], "doc_id long, text string, sums int")
    edits = spark.createDataFrame([(1, 0, 0, "new"), (2, 5, 9, " end"), (3, 0, 5, None), (4, 7, 7, "!"), (4, 100_000, 100_001, "ab cd"), (9, 0, 1, "x"), (None, 0, 1, "x")], "doc_id long, start int, stop int, text string")
    state = T.build(docs, PATH)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text, r.n_tokens, r.n_edits) for r in T.totals(T.apply(T.with_edits(state, edits), PATH)).collect())
    long = applied("long text " * 20_000, [(7, 7, "!"), (100_000, 100_001, "ab cd")])
    want = [(1, "new", 1), (2, " end", 1), (3, " words here", 1), (3, "d row", 1), (4, long, 2)]
    assert got == sorted([(False, i, t, brute(t), n) for i, t, n in want] + [(True, 0, "no id", brute("no id"), 0)])
    assert T.apply(T.with_edits(state.limit(0), edits), PATH).count() == 0
    lap = spark.createDataFrame([(3, 0, 3, "a"), (3, 2, 4, "b")], edits.schema)
    assert {r.error for r in T.apply(T.with_edits(state, lap), PATH).where("doc_id = 3").collect()} == {"edits overlap"}


def test_documents(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = T.op2_token_counts(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        edits = T.redactions(docs[r.doc_id])
        new = applied(docs[r.doc_id], edits)
        assert (r.tokens_before, r.tokens_after, r.n_edits, r.n_chars) == (brute(docs[r.doc_id]), brute(new), len(edits), len(new))
    assert any(r.n_edits for r in rows) and np.mean([r.encoded_chars > 0 for r in rows]) < 0.6


def test_bad_edits_are_told_of(spark):
    rows = [(1, "one two three"), (2, "four five"), (3, "six seven"), (4, "eight"), (5, None)]
    edits = [(1, 0, 5, "x"), (1, 3, 7, "y"), (2, None, 4, "x"), (3, 4, 2, "x"), (4, 0, 99, None), (5, 0, None, "x"), (None, 0, 1, "x"), (9, 0, 1, "x")]
    state = T.build(spark.createDataFrame(rows, "doc_id long, text string"), PATH)
    got = {r.doc_id: r for r in T.totals(T.apply(T.with_edits(state, spark.createDataFrame(edits, "doc_id long, start int, stop int, text string")), PATH)).collect()}
    assert {i: r.error for i, r in got.items()} == {1: "edits overlap", 2: "an edit has a null place", 3: "an edit ends before it starts", 4: None, 5: "an edit has a null place"}
    assert [got[i].text for i in range(1, 6)] == ["one two three", "four five", "six seven", "", ""]
    assert all(got[i].n_tokens == brute(got[i].text) for i in got)
