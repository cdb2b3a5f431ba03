import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm import simhash
from shelfmark.llm.shingles import Words, xxh64

SCHEMA = "doc_id long, text string, rep string, below string"


def brute_fp(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def brute(rows):
    fps = [(i, brute_fp(t)) for i, t in rows]
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 4:
                parent[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    return sorted(((i, f"{f:016x}", low.get(find(k))) for k, (i, f) in enumerate(fps)), key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@given(st.lists(st.binary(max_size=90), max_size=20))
@settings(max_examples=60, deadline=None)
def test_hash_and_words(texts):
    w = Words(texts)
    for width in (1, 4):
        start, length, _, bounds = w.shingles(width)
        h = xxh64(w.buf, start, length)
        for d, t in enumerate(texts):
            s = t.lower().split()
            s = [b" ".join(s[i : i + width]) for i in range(len(s) - width + 1)] or ([b" ".join(s)] if s else [])
            assert h[bounds[d] : bounds[d + 1]].tolist() == [xxhash.xxh64_intdigest(x, 42) for x in s]


def test_against_brute_force(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    rows = [(1, base), (2, base.upper()), (3, None), (4, ""), (5, " \t\n"), (6, "a b"), (7, "A\nb"), (7, "A\nb"), (None, base), (8, base + " sixteen"), (9, "é É ß"), (None, "unlike any"), (10, "word " * 30_000)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    assert result(simhash.near_duplicates(df)) == brute(rows)
    assert result(simhash.near_duplicates(df.limit(0))) == []


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert result(simhash.op3_simhash(spark, sf)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_a_large_subtrie_is_copied_five_times(spark, monkeypatch):
    """Fingerprints with two blocks in common: copies stay linear in them, and no link is lost."""
    monkeypatch.setattr(simhash, "CHUNK", 64)
    rng = np.random.default_rng(4)
    top = 0x5A5A5A << 42
    n = 6000
    fps = np.unique(top & ((1 << 64) - 1) | rng.integers(0, 1 << 42, n, dtype=np.int64).astype(np.uint64))
    near = fps[:400] ^ np.uint64(0b1001000010001)  # four bits away
    fps = np.unique(np.concatenate([fps, near]))
    df = spark.createDataFrame([(int(f.view(np.int64)), i) for i, f in enumerate(fps)], "fp long, rep long")
    rows = simhash.tries(df)
    size = rows.groupBy("trie", "top").count().agg({"count": "max"}).first()[0]
    assert size >= n  # one subtrie holds all
    assert [sum(b for _, b in simhash._cuts(d)) for d in (42, 43, 44)] == [42, 43, 44]
    got = {r.node: r.component for r in simhash.components(simhash.links(df)).collect()}
    x = fps.astype(np.uint64)
    label = np.arange(len(x))
    for i in range(len(x)):
        close = np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 4)
        low = label[close].min()
        for other in set(label[close].tolist()):
            label[label == other] = low
    want = {i: int(c) for i, c in enumerate(label) if (label == c).sum() > 1}
    assert got == want and len(want) >= 700


def test_hot_subtries_are_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 16)
    monkeypatch.setattr(simhash, "FRONTIER", 64)
    rng = np.random.default_rng(1)
    near = [int(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False))) for _ in range(300)]
    far = [int(x) for x in rng.integers(0, 1 << 63, 50)]
    fps = list(dict.fromkeys(near + far))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, rep long")
    from shelfmark.llm.components import components

    got = {r.node: r.component for r in components(simhash.links(df)).collect()}
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for a in range(len(fps)):
            for b in range(a):
                if (fps[a] ^ fps[b]).bit_count() <= 4 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    assert all(got.get(i, i) == label[i] for i in range(len(fps)))


def near_texts():
    """Two texts whose fingerprints differ in 1 to 4 bits."""
    base = [f"t{k}" for k in range(400)]
    fp = brute_fp(" ".join(base))
    for k in range(400):
        other = [*base[:k], "new", *base[k + 1 :]]
        if 1 <= (brute_fp(" ".join(other)) ^ fp).bit_count() <= 4:
            return " ".join(base), " ".join(other)


def test_rows_without_an_id_link(spark):
    a, b = near_texts()
    for rows in ([(1, a), (None, b)], [(1, a), (5, b)], [(None, a), (None, b)], [(None, a), (4, b), (9, a), (9, a)]):
        df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
        assert result(simhash.near_duplicates(df)) == brute(rows)
        kept = simhash.one_of_each_group(df).collect()
        assert len(kept) == 1 and kept[0].doc_id == min((i for i, _ in rows if i is not None), default=None)
