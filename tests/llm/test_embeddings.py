import duckdb
import numpy as np
import pytest

from shelfmark.llm import embeddings as E
from shelfmark.llm.hnsw import Graph, audited

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, rep int"


def brute(rows, cosine=0.93):
    """(vec_id, n_links, component_id, kept) from all pairs."""

    def unit(e):
        if e is None or any(x is None or not np.isfinite(x) for x in e) or not any(e):
            return None
        e = np.array(e, np.float32).astype(np.float64)
        return e / np.linalg.norm(e)

    units = [unit(e) for _, e, _ in rows]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if units[a] is None or units[b] is None or None in (rows[a][0], rows[b][0], rows[a][2]) or rows[a][2] != rows[b][2] or len(units[a]) != len(units[b]):
                continue
            if units[a] @ units[b] >= cosine:
                n[a] += 1
                n[b] += 1
                root[find(a)] = find(b)
    low = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    return sorted(((i, n[k], low.get(find(k)), i is not None and i == low[find(k)]) for k, (i, _, _) in enumerate(rows)), key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    far = rng.normal(size=(300, 16))
    near = centres[rng.integers(0, 12, 500)] + rng.normal(size=(500, 16)) * 0.12
    hot = centres[0] + rng.normal(size=(300, 16)) * 0.05
    x = np.concatenate([far, near, hot]).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_graph_recall(clustered):
    x = clustered
    a, b, _ = audited(Graph(x), x, x, 0.93, 16, 64, 0.995)
    exact = np.argwhere(x @ x.T >= 0.93)
    got = set(zip(a.tolist(), b.tolist(), strict=True))
    assert len(got) == len(a) and got <= {tuple(p) for p in exact.tolist()}
    assert len(got) >= 0.99 * len(exact)
    for n in (0, 1, 2, 3):
        g = Graph(x[:n])
        assert len(audited(g, x[:n], x[:n], 0.93, 16, 64, 0.995)[0]) >= n


def test_against_brute_force(spark, clustered):
    rows = [(i, e.tolist(), i % 2) for i, e in enumerate(clustered[::3])]
    big = [float(v) for v in clustered[0] * 3]
    rows += [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [None, 1.0], 0), (1004, big, None), (None, big, 0), (1005, big, 0), (1006, big, 0), (1006, big, 0), (1007, [1.0, 0.0], 0), (1008, [1.0, 0.01], 0), (1009, [float("inf")] * 16, 0), (1010, [], 0), (-5, [1.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    want = brute(rows)
    assert result(E.near_duplicates(df)) == want
    assert result(E.near_duplicates(df, shard_rows=40, query_rows=60)) == want
    assert result(E.near_duplicates(df.limit(0))) == []


def test_embeddings(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = sorted(con.execute("select vec_id, n_links, component_id, kept from (" + E.ORACLE_SQL + ")").fetchall(), key=str)
    assert result(E.op10_embedding_dedup(spark, sf)) == want


class Weak:
    """Finds the pairs of the first vectors only, until its beam is wide."""

    def __init__(self, x, hot):
        self.x, self.hot = x, hot

    def within(self, q, floor, ef):
        a, b = np.nonzero(q @ self.x.T >= floor)
        keep = (b < self.hot) | (ef >= 64)
        return a[keep], b[keep]


def test_audit_asks_queries_with_neighbours_and_weighs_each_alike():
    rng = np.random.default_rng(6)
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    x, far = unit(rng.normal(size=(200, 32))), unit(rng.normal(size=(6000, 32)))
    for members in (True, False):  # few queries have a neighbour in the shard
        q = far.copy()
        at = rng.choice(6000, 40, replace=False)
        q[at] = x[:40] if members else unit(x[:40] + rng.normal(size=(40, 32)) * 0.01)
        of = np.isin(np.arange(6000), at) if members else None
        a, _, ef = audited(Weak(x, 0), x, q, 0.93, 32, 64, 0.995, of)
        assert ef == 64 and set(at) <= set(a.tolist())
    hot = unit(x[:1] + rng.normal(size=(20000, 32)) * 0.005)  # one query with 20,000 pairs and 63 with one
    y = np.concatenate([hot, x[1:64]])
    a, _, ef = audited(Weak(y, 20000), y, np.concatenate([hot[:1], x[1:64]]), 0.93, 32, 64, 0.995)
    assert ef == 64 and len(set(a.tolist())) == 64
    assert len(audited(Weak(x, 0), x, -x[:1] * 0, 0.93, 32, 64, 0.995)[0]) == 0
