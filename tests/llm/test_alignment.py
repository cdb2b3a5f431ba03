import hashlib
from collections import Counter

import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from tokenizers.decoders import ByteLevel

from shelfmark.llm import alignment as A
from shelfmark.llm.common import tokenizer_file

PATH_A, PATH_B = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
WHITE = "\t\n\x0b\x0c\r \x85\xa0        　"
HARD = ["", " ", "  ", "\n", " \n x", "a;\r\nb);\r\n {\r x", "x ;\r", "tail \t", "it's I'LL 's", "<|endoftext|> a<s></s> <unk><0x0A>", "é😀𝒳 ﬁ́", "visible ▁ blank", "▁", "a" * 300, "日本語 テスト", "a\x00b \x1c c\x1f", "x" + WHITE + "y", *(f"word!{w}{w}?1{w}e" for w in WHITE), "word " * 3000]


def brute(rows):
    """Whole texts by both libraries, all links one by one."""
    a = Tokenizer.from_file(PATH_A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
    raw_a, raw_b = A.pair(PATH_A, PATH_B).raw_a, A.pair(PATH_A, PATH_B).raw_b
    docs, held = [], Counter()
    for i, text in rows:
        groups = []
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            whole = (" " + text).encode()
            if b"".join(raw_a[t] for t in x) == whole == b"".join(raw_b[t] for t in y):
                ends = [], []
                for ids, raw, out in ((x, raw_a, ends[0]), (y, raw_b, ends[1])):
                    at = 0
                    for t in ids:
                        at += len(raw[t])
                        out.append(at)
                cuts = sorted(set(ends[0]) & set(ends[1]))
                low = 0
                for c in cuts:
                    groups.append(([t for t, e in zip(x, ends[0], strict=True) if low < e <= c], [t for t, e in zip(y, ends[1], strict=True) if low < e <= c]))
                    low = c
        links = [(p, q) for g in groups for p in g[0] for q in g[1]]
        held.update(set(links))
        docs.append((i, groups, links))
    top = {}
    for (p, _), n in held.items():
        top[p] = max(n, top.get(p, 0))
    out = []
    for i, groups, links in docs:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(held[k] == top[k[0]] for k in links), sum(held[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=str), held


def test_packed():
    for arrays in ([[]], [[1, 2, 2**32 - 1], [], [0]], [np.arange(5000)]):
        assert [x.tolist() for x in A.unpacked(A.packed(*arrays))] == [list(map(int, x)) for x in arrays]


def test_bytes_of_tokens():
    a, p = Tokenizer.from_file(PATH_A), A.pair(PATH_A, PATH_B)
    for i in range(0, 50256, 97):
        assert ByteLevel().decode([a.id_to_token(i)]) == p.raw_a[i].decode("utf-8", "replace")
    assert p.raw_b[p.b.piece_to_id("<0x0A>")] == b"\n" and {";\r", ")\r"} <= p.joined and p.in_blocks


def same_as_whole(text):
    p = A.pair(PATH_A, PATH_B)
    parts = p.segments(text)
    assert "".join(parts) == " " + text
    found = list(p.encode(parts))
    assert [i for x, _ in found for i in x] == p.a.encode(" " + text, add_special_tokens=False).ids
    assert [i for _, y in found for i in y] == p.b.encode(text)


def test_segments_encode_as_whole_texts():
    for text in HARD:
        if text and "▁" not in text:
            same_as_whole(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*WHITE, *"a;.){}'\r\n 1é", "the", " in", "<s>", "😀", ",\r", "\n\n"]), max_size=30).map("".join))
def test_any_mixture_encodes_as_a_whole(text):
    if text:
        same_as_whole(text)


def test_cases(spark):
    rows = [(k, t) for k, t in enumerate(HARD)] + [(1000, None), (None, "no id here"), (7, "repeated row"), (7, "repeated row")]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, n_a int, segment string, chunk int")
    want, held = brute(rows)
    for parts, chars in ((1, 1 << 20), (3, 40)):
        out = A.align(docs.repartition(parts), PATH_A, PATH_B, with_groups=True, chunk_chars=chars)
        got = out.documents.collect()
        assert sorted([tuple(r)[:8] for r in got], key=str) == want
        assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in got if r.groups)
        assert {(r.pair >> 32, r.pair & 0xFFFFFFFF): r.docs for r in out.pairs.collect()} == held
    assert A.align(docs.limit(0), PATH_A, PATH_B).documents.collect() == []


def test_large_groups():
    """Long runs without a common end have one group, whose links are counted by id."""
    w = A._Words(np.array([0, 1, 3]), np.array([0, 300, 301, 303]), np.array([0, 200, 201, 202]), np.array([5, 6, 7] * 101), np.arange(202) % 3 + 1)
    links = Counter()
    for word, groups in ((0, (0,)), (1, (1, 2))):
        for g in groups:
            for x in w.ids_a[w.a[g] : w.a[g + 1]].tolist():
                for y in w.ids_b[w.b[g] : w.b[g + 1]].tolist():
                    links[word, x << 32 | y] += 1
    word, code, times = A._links(w)
    assert {(i, c): t for i, c, t in zip(word.tolist(), code.tolist(), times.tolist(), strict=True)} == links
    assert A.cuts([1, 2, 3], [3, 1, 2]) == ([2, 1], [1, 2]) and A.cuts([4], [1, 3]) == ([1], [2])


def test_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted([tuple(r) for r in A.op11_cross_tokenizer_alignment(spark, sf).collect()], key=str) == brute(rows)[0]
