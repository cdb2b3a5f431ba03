import math
from fractions import Fraction

import numpy as np
import pytest

from shelfmark.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=4):
    """By exact fractions: {vec_id: (n, deviation)}, the covariance, and the rows' offsets from the mean."""
    good = [(i, [math.floor(256 * float(np.float32(c))) for c in e]) for i, e in rows if e and all(c is not None and math.isfinite(c) for c in e)]
    fit = sorted({tuple(x) for _, x in good})
    n, d = len(fit), len(fit[0])
    s = [sum(x[i] for x in fit) for i in range(d)]
    far = np.array([[n * x[i] - s[i] for i in range(d)] for x in fit], object)
    cov = np.array([[float(Fraction(v, n**3)) for v in row] for row in far.T.dot(far)])
    return {i: (n, sum((n * x[k] - s[k]) ** 2 for k in range(d)), [float(Fraction(x[k]) - Fraction(s[k], n)) for k in range(d)]) for i, x in good}, cov


def check(rows, out, k=4):
    want, cov = brute(rows)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(k, sum(values > values.sum() * len(cov) * 2.3e-16))
    got = {}
    for r in out:
        got.setdefault(r.vec_id, {})[r.component] = r
    assert set(got) == set(want)
    signs = [None] * k
    for i, (n, deviation, far) in want.items():
        assert sorted(got[i]) == list(range(1, k + 1))
        for c, r in got[i].items():
            assert r.n == n and r.deviation_text == str(deviation) and r.deviation == (deviation if deviation < 2**63 else None)
            assert r.explained == pytest.approx(values[c - 1] / np.trace(cov), rel=1e-6)
            assert r.identity_error <= 1e-4
            w = float(np.array(far) @ vectors[:, c - 1] / math.sqrt(values[c - 1]))
            if abs(w) > 1e-4:
                signs[c - 1] = signs[c - 1] or math.copysign(1, w * r.whitened)
                assert r.whitened == pytest.approx(signs[c - 1] * w, rel=1e-6, abs=1e-7)


def test_limbs_and_digits_are_exact():
    rng = np.random.default_rng(0)
    edge = np.array([[-(2**63), 2**63 - 1, 0], [2**63 - 1, -1, 1], [-(2**63), -(2**63), 65536]], np.int64)
    for x in [rng.integers(-130, 130, (1000, 5)), rng.integers(-(2**40), 2**40, (500, 4)), rng.integers(-(2**63), 2**63 - 1, (300, 3)), edge, np.zeros((4, 2), np.int64)]:
        assert all((sum(int(p[i, j]) << (W.LIMB * k) for k, p in enumerate(W.limbs(x))) == int(x[i, j])) for i in range(len(x)) for j in range(x.shape[1]))
        d = x.shape[1]
        digits = np.zeros((W.DIGITS, d + 1, d + 1), np.int64)
        W.add_products(digits, x)
        W.add_products(digits, x)
        y = [[int(v) for v in row] + [1] for row in x]
        for i in range(d + 1):
            for j in range(d + 1):
                assert sum(int(digits[k, i, j]) << (W.LIMB * k) for k in range(W.DIGITS)) == 2 * sum(r[i] * r[j] for r in y)


def test_embeddings(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(rows, W.op13_embedding_whitening(spark, sf).collect())


def test_cases(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=6).round(3).tolist()) for k in range(60)]
    rows += [(100 + k, rows[0][1]) for k in range(300)]  # copies count once in the fit
    rows += [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (502, [math.nan] * 6), (503, [math.inf] + [0.0] * 5), (504, [-0.0] * 6), (505, [])]
    df = spark.createDataFrame([(i, e, 1) for i, e in rows], SCHEMA).selectExpr("*", "1 as x", "'c' as dim", "2 as n")
    out = W.whiten(df.repartition(5)).collect()
    check(rows, out)
    assert len(out) == 4 * 361
    assert W.whiten(df.limit(0)).collect() == []
    assert W.whiten(df.where("vec_id = 3")).collect() == []
    none = spark.createDataFrame([(None, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (1, [0.0, 2.0], 1)], SCHEMA)
    got = W.whiten(none).collect()
    assert [(r.vec_id, r.component) for r in sorted(got, key=str)] == [(1, 1), (None, 1), (None, 1)]


def test_large_numbers_and_lengths(spark):
    """Means that dwarf the spread, products beyond 64 bits, and vectors of two lengths."""
    rng = np.random.default_rng(4)
    big = [(k, (np.array([1e9, -3e12, 5e4, 0.0, 1.0]) + rng.normal(size=5) * [1e3, 1e6, 40, 9, 1]).tolist()) for k in range(40)]
    small = [(100 + k, rng.normal(size=3).tolist()) for k in range(30)]
    df = spark.createDataFrame([(i, e, None) for i, e in big + small], SCHEMA)
    out = W.whiten(df).collect()
    check(small, [r for r in out if r.vec_id >= 100])
    want, _ = brute(big)
    for r in (r for r in out if r.vec_id < 100):
        assert r.n == want[r.vec_id][0] and r.deviation_text == str(want[r.vec_id][1])
    parts = [W.MODEL_BYTES, W.HELD_BYTES]
    try:
        W.MODEL_BYTES = W.HELD_BYTES = 1
        again = W.whiten(df).collect()
    finally:
        W.MODEL_BYTES, W.HELD_BYTES = parts
    key = lambda r: (r.vec_id, r.component, r.n, r.deviation_text)
    assert sorted(map(key, again)) == sorted(map(key, out))
