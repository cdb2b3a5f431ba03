import zlib

import numpy as np

from shelfmark.llm import quality as Q


def test_linear_time_identity():
    rng = np.random.default_rng(3)
    m = Q.Machine(inputs=30, rank=4)
    m.w, m.w0 = rng.normal(size=30), 0.3
    idx, x = rng.choice(30, 9, replace=False), rng.normal(size=9)
    pairs = sum(float(m.v[idx[a]] @ m.v[idx[b]]) * x[a] * x[b] for a in range(9) for b in range(a))
    assert abs(m.raw(idx, x)[0] - (m.w0 + float(m.w[idx] @ x) + pairs)) < 1e-9


def test_pairs_are_learnt():
    """Exclusive or: no linear model tells these apart."""
    rows = [(np.array([a, 2 + b]), np.ones(2)) for a in (0, 1) for b in (0, 1)] * 50
    labels = [int(i[0] != i[1] - 2) for i, _ in rows]
    m = Q.Machine(inputs=4, rank=4).fit(rows, labels, epochs=40, rate=0.2)
    assert all((m.score(*r) > 0.5) == bool(y) for r, y in zip(rows, labels, strict=True))


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in Q.op7_quality(spark, sf).collect()}
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in rows.items())
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    held = [(rows[i].score, q) for i, q in labels if rows[i].held_out]
    assert np.mean([(s >= 0.7) == q for s, q in held]) >= 0.95
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([a > b for a in good for b in bad]) >= 0.97


def test_cases(spark):
    docs = spark.createDataFrame([(1, None, "z"), (2, "", "z"), (None, "text of no id", "z"), (3, "word " * 50_000, "z"), (3, "again", "z"), (4, "fine", "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (3, 0, 0), (4, None, 0), (None, 1, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")
    got = Q.scores(docs, Q.train(docs, labels)).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got) and [r.held_out for r in got if r.doc_id is None] == [False]
    none = Q.train(docs, labels.limit(0))
    assert all(r.score == 0.5 for r in Q.scores(docs, none).collect())
    assert Q.scores(docs.limit(0), none).count() == 0


def test_only_learns_from_rows_that_are_not_held_out(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = Q.training_rows(docs, labels).collect()
    assert got and all(zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in got)
    assert Q.training_rows(docs, labels, 5).count() == 5


def test_repeated_labels_and_texts(spark):
    """The majority of an id's labels counts, ties teach nothing, and the bound is on ids."""
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2][:4]
    a, b, c, d = ids
    labels = spark.createDataFrame([(a, 1), (a, 0), (a, 1), (b, 0), (b, 1), (c, 0), (c, 0), (c, 1), (d, None)], "doc_id long, quality int")
    docs = spark.createDataFrame([(a, "x"), (a, "w"), (b, "tie"), (c, "y"), (d, "z")], "doc_id long, text string")
    assert sorted(tuple(r) for r in Q.training_rows(docs, labels).collect()) == [(a, 1, "w"), (c, 0, "y")]
    assert Q.training_rows(docs, labels, 1).count() == 1
