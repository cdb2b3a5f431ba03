"""Operator 13: embedding whitening with exact sums of products from float64 matrix products.

Entries become integers x = floor(scale * c). Every distinct x counts once. A task cuts its integers
into limbs of 16 bits, so that products of limbs and their sums over a block of rows stay below 2^53
and a float64 BLAS product of the limb matrices is exact. Limb products of one weight add up to the
digits of the sums of products, which Spark sums over all tasks; digits of one entry then recombine
to a big integer. A column of ones beside the limbs makes the row count and the sums part of the same
product. The covariance (n * sum(x y) - sum(x) sum(y)) / n^2 is an exact fraction, rounded once, before
its eigenvectors are taken.

Vectors of different lengths lie in different spaces: each length has its own fit, so its own n,
components and identity_error.

Cases: rows whose vector is null or holds a null or non-finite entry are dropped, as are empty
vectors, which have no component. Null ids are kept, repeated rows each get their rows, other columns
are ignored, an empty table gives an empty result. Products beyond a long's range (scale * c over
2^63) stop at its ends, as Spark's floor does. A component needs a positive eigenvalue: a fit list of
one vector has none, so its rows give no rows; fewer dimensions than components give as many as there
are. A deviation beyond a long is null; ``deviation_text`` always has its digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

SCALE, COMPONENTS = 256, 4
LIMB, LIMBS = 16, 4  # four limbs hold any long
DIGITS = 2 * LIMBS + 4  # of limbs' size, for sums of over 2^63 products
BLOCK_ROWS, BLOCK_BYTES = 1 << 18, 32 << 20  # products of limbs are below 2^33, so sums below 2^51
HELD_BYTES = 256 << 20  # of digits in a task, over all lengths of vectors
MODEL_BYTES = 64 << 20  # of models that tasks get at once
SUMS = "dim int, i int, j int, " + ", ".join(f"d{k} long" for k in range(DIGITS))
MODEL = "dim int, n long, sums array<string>, vectors array<array<double>>, shares array<double>"


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, x) of the rows that count."""
    e = F.col("embedding")
    rows = vectors.select("vec_id", e.cast("array<double>").alias("embedding"))
    rows = rows.where(F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & (F.size(e) > 0))
    return rows.select("vec_id", F.transform(e, lambda c: F.floor(c * F.lit(float(scale)))).alias("x"))


def _matrices(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length in a column of lists of longs."""
    at = lists.offsets.to_numpy()
    flat, sizes = lists.values.to_numpy(), np.diff(at)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, flat[at[rows][:, None] + np.arange(d)]


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Float matrices l with x = sum(l[k] << LIMB k); only the last has signs."""
    out, rest = [], x
    while len(out) < LIMBS - 1 and (rest.min() < -(1 << LIMB) or rest.max() > 1 << LIMB):
        out.append((rest & ((1 << LIMB) - 1)).astype(np.float64))
        rest = rest >> LIMB
    return [*out, rest.astype(np.float64)]


def carried(digits: np.ndarray) -> np.ndarray:
    """The same numbers with digits in [0, 2^LIMB), but for the last."""
    for k in range(len(digits) - 1):
        digits[k + 1] += digits[k] >> LIMB
        digits[k] &= (1 << LIMB) - 1
    return digits


def add_products(digits: np.ndarray, x: np.ndarray) -> None:
    """Add the sums of products of the columns of x, and of ones, to their digits."""
    n, d = x.shape
    parts = limbs(x)
    wide = np.zeros((n, len(parts) * (d + 1)))
    for k, part in enumerate(parts):
        wide[:, k * (d + 1) : k * (d + 1) + d] = part
    wide[:, d] = 1
    product = (wide.T @ wide).astype(np.int64)  # exact: every partial sum is an integer below 2^53
    for a in range(len(parts)):
        for b in range(len(parts)):
            digits[a + b] += product[a * (d + 1) : (a + 1) * (d + 1), b * (d + 1) : (b + 1) * (d + 1)]
    carried(digits)


def products(fit: DataFrame) -> DataFrame:
    """Digits of the sums of products of every pair of dimensions i <= j; the last dimension is the ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for d, digits in held.items():
                i, j = np.triu_indices(d + 1)
                for k in range(0, len(i), 1 << 16):
                    a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                    cols = [np.full(len(a), d, np.int32), a.astype(np.int32), b.astype(np.int32), *(digits[m][a, b] for m in range(DIGITS))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)
            held.clear()

        names = [c.split()[0] for c in SUMS.split(", ")]
        for batch in batches:
            for _, x in _matrices(batch.column(0)):
                d = x.shape[1]
                if d not in held:
                    if sum(v.nbytes for v in held.values()) + 8 * DIGITS * (d + 1) ** 2 > HELD_BYTES:
                        yield from rows()
                    held[d] = np.zeros((DIGITS, d + 1, d + 1), np.int64)
                step = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * LIMBS * (d + 1))))
                for k in range(0, len(x), step):
                    add_products(held[d], x[k : k + step])
        yield from rows()

    parts = fit.select("x").mapInArrow(run, SUMS)
    return parts.groupBy("dim", "i", "j").agg(*(F.sum(f"d{k}").alias(f"d{k}") for k in range(DIGITS)))


def covariance(sums: list[list[int]]) -> tuple[int, list[int], np.ndarray]:
    """(n, sums, covariance) from the sums of products with a last row and column of ones; each entry is rounded once."""
    d = len(sums) - 1
    n, s = sums[d][d], sums[d][:d]
    return n, s, np.array([[(n * sums[i][j] - s[i] * s[j]) / (n * n) for j in range(d)] for i in range(d)])


def _model(components: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        d = int(part["dim"].iloc[0])
        sums: list[list[int]] = [[0] * (d + 1) for _ in range(d + 1)]
        columns = [part[f"d{k}"].tolist() for k in range(DIGITS)]
        for i, j, *digits in zip(part["i"].tolist(), part["j"].tolist(), *columns, strict=True):
            sums[i][j] = sums[j][i] = sum(v << (LIMB * k) for k, v in enumerate(digits))
        n, s, v = covariance(sums)
        values, vectors = np.linalg.eigh(v)
        total, order = np.trace(v), np.argsort(-values, kind="stable")[:components]
        order = [k for k in order if values[k] > total * d * np.finfo(float).eps]
        return pd.DataFrame({"dim": [d], "n": [n], "sums": [[str(x) for x in s]], "vectors": [[(vectors[:, k] / np.sqrt(values[k])).tolist() for k in order]], "shares": [[float(values[k] / total) for k in order]]})

    return run


def models(fit: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each length: n, sums, components over the roots of their eigenvalues, shares of the trace.

    A length's digits meet in one task: as many as its dimensions squared, however many rows.
    """
    return products(fit).groupBy("dim").applyInPandas(_model(components), MODEL)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums as exact integers: longs where they fit, else Python's."""
    if n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, sums)) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _whitener(model: dict):
    """Arrow function from (vec_id, x) to a row for each vector and component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _matrices(batch.column(1)):
                if x.shape[1] not in model:
                    continue
                n, sums, vectors, shares, identity = model[x.shape[1]]
                k = len(shares)
                if not k:
                    continue
                far = _centred(x, n, sums)
                small = far.dtype == np.int64 and float(np.abs(far).max()) ** 2 * x.shape[1] < 2**62
                deviation = (far * far).sum(axis=1) if small else (far.astype(object) ** 2).sum(axis=1)
                white = (far / n).astype(np.float64) @ np.array(vectors).T
                fits = [int(v) if v < 1 << 63 else None for v in deviation.tolist()]
                cols = [
                    batch.column(0).take(pa.array(np.repeat(rows, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                    pa.array(np.full(len(rows) * k, n, np.int64)),
                    pa.array([v for v in fits for _ in range(k)], pa.int64()),
                    pa.array(white.ravel()),
                    pa.array(np.tile(np.array(shares), len(rows))),
                    pa.array(np.full(len(rows) * k, identity)),
                    pa.array([t for v in deviation.tolist() for t in [str(v)] * k], pa.string()),
                    pa.array(np.full(len(rows) * k, x.shape[1], np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_text", "dim"])

    return run


WHITE = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string, dim int"


def _errors(fit: DataFrame, model: dict, components: int) -> dict[int, float]:
    """For each length, how far the covariance of the fit list's whitened rows is from the identity; one pass, centred as it goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in _matrices(batch.column(0)):
                if x.shape[1] not in model:
                    continue
                n, sums, vectors, shares, _ = model[x.shape[1]]
                white = np.full((len(x), components), np.nan)
                if shares:
                    white[:, : len(shares)] = (_centred(x, n, sums) / n).astype(np.float64) @ np.array(vectors).T
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), x.shape[1], np.int32)), *(pa.array(c) for c in white.T)], ["dim", *(f"w{k}" for k in range(components))])

    white = fit.select("x").mapInArrow(run, "dim int, " + ", ".join(f"w{k} double" for k in range(components)))
    pairs = [(a, b) for a in range(components) for b in range(a, components)]
    away = [F.abs(F.covar_pop(f"w{a}", f"w{b}") - (1.0 if a == b else 0.0)) for a, b in pairs]
    away = [F.when(F.isnan(x), None).otherwise(x) for x in away]
    worst = away[0] if len(away) == 1 else F.greatest(*away)
    return {r["dim"]: r["error"] for r in white.groupBy("dim").agg(worst.alias("error")).collect()}


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_text, dim).

    Tasks get models of at most ``MODEL_BYTES`` at once: (components + 2) numbers a dimension. More
    lengths of vectors than that take a pass over the rows for each such share of them.
    """
    rows = integers(vectors, scale)
    fit = written(rows.select("x").distinct(), "fit")
    made = written(models(fit, components), "models")
    dims, groups, size = sorted(r["dim"] for r in made.select("dim").collect()), [[]], 0
    for d in dims:
        size += 8 * d * (components + 2)
        if size > MODEL_BYTES and groups[-1]:
            groups.append([])
            size = 8 * d * (components + 2)
        groups[-1].append(d)
    schema = WHITE.format(rows.schema["vec_id"].dataType.simpleString())
    out = None
    for group in groups:
        model = {r["dim"]: (r["n"], [int(s) for s in r["sums"]], r["vectors"], r["shares"], None) for r in made.where(F.col("dim").isin(group)).collect()}
        errors = _errors(fit, model, components) if model else {}
        model = {d: (*m[:4], errors.get(d)) for d, m in model.items()}
        some = rows.mapInArrow(_whitener(model), schema)
        out = some if out is None else out.union(some)
    return out


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
