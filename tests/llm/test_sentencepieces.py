import random
import zlib

import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm import pieces as P
from shelfmark.llm import sentencepieces as S
from shelfmark.llm.common import tokenizer_file

PATH = tokenizer_file("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
BITS = ["the", "The", "tion", "ing", " ", " ", "  ", "\n", "é", "日本", "😀", "x", "zq", "123", "...", "aaaa", "ab", "abab", "=", "====", "e", "n", "r", "▁", "   ", "<s>"]


def by_chunks(text, chunk):
    model, text = P.pieces(PATH), P.normal(text)
    n, reach = -(-len(text) // chunk), P.pieces(PATH).longest
    cuts = [(max(0, k * chunk - reach), k * chunk, min(len(text), (k + 1) * chunk)) for k in range(n)]
    parts = [(text[low : b + reach], a - low, b - low, k == 0, k == n - 1) for k, (low, a, b) in enumerate(cuts)]
    ms = [model.matrix(*p) for p in parts]
    left, right = S._scan(ms, np.zeros(1), np.zeros(1))
    assert all(((a + b) > -np.inf).sum() == 1 for a, b in zip(left, right, strict=True))  # one path
    best = [int(np.argmax(a + b)) for a, b in zip(left, right, strict=True)]
    return [i for k, p in enumerate(parts) for i in np.frombuffer(model.chunk_ids(*p, best[k], best[k + 1]), "<i4").tolist()]


@given(st.integers(0, 10**9), st.sampled_from([3, 5, 17, 40, 64]))
@settings(max_examples=200, deadline=None)
def test_chunks_equal_the_library(seed, chunk):
    r = random.Random(seed)
    text = "".join(r.choice(BITS[: r.choice([6, 26])]) for _ in range(r.randrange(1, 60)))
    if r.random() < 0.4:
        text = text.replace(" ", "").replace("▁", "") or "x"
    want = LIB.encode(text)
    assert by_chunks(text, chunk) == want
    model = P.pieces(PATH)
    assert np.frombuffer(model.encode_units(P.normal(text)), "<i4").tolist() == want
    assert P.pieces(PATH).decode_raw(np.array(want)).decode()[1:] == LIB.decode(want) or text.startswith((" ", "▁"))


def test_products_are_associative():
    rng = np.random.default_rng(0)
    a, b, c = (np.where(rng.random(s) < 0.3, -np.inf, rng.normal(size=s)) for s in ((3, 4), (4, 5), (5, 2)))
    assert np.allclose(P.times(P.times(a, b), c), P.times(a, P.times(b, c)))


def test_cases(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUP", 3)
    rows = [(1, None), (2, ""), (3, "short text"), (3, "short text"), (None, "no id " * 60), (4, "giant document, words " * 400), (4, "giant document, words " * 400), (5, "nospace" * 300), (6, " "), (7, "  two  blanks  "), (8, "日本語😀\x07" * 90)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, list(r.ids), r.text) for r in S.decode(S.encode(docs, PATH, 100), PATH).collect()), key=str)
    assert got == sorted(((i, LIB.encode(t or ""), t or "") for i, t in rows), key=str)
    fused = sorted(((r.doc_id, list(r.ids), r.text) for r in S.encode_and_decode(docs, PATH, 100).collect()), key=str)
    assert fused == got and S.encode(docs.limit(0), PATH).count() == 0


def test_documents(spark, sf, monkeypatch):
    monkeypatch.setattr(S.encode_and_decode, "__defaults__", (2000,))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = S.op8_sentencepiece(spark, sf).collect()
    assert len(rows) == len(docs) and any(r.n_chunks > 1 for r in rows)
    for r in rows:
        ids = LIB.encode(docs[r.doc_id])
        assert (r.n_pieces, r.ids_crc32, r.round_trip) == (len(ids), zlib.crc32(",".join(map(str, ids)).encode()), True)
