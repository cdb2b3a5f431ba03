"""Operator 7: quality classifier, a factorisation machine.

A text's inputs are its hashed words (values: square roots of word counts, scaled to length one), and statistics of its structure and
its metadata (text and line lengths), each cut into steps that are one input apiece. The score is
the logistic function of

    w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2],

the sum-of-squares form of all weighted pairs, so its cost is linear in the inputs. Labels, lang,
source and doc_id are never inputs.

The weights are learnt on the driver from a bounded sample: at most ``TRAIN_ROWS`` labelled rows,
those with the smallest hash of their id, whatever the input's size. Everything else covers all
rows. A scored row needs no shuffle.

Cases: a null text counts as empty; an empty text is scored like any other (it has the structure
inputs only); of several labels of an id the majority counts, a tie and null labels teach nothing; an
id with several texts teaches the least of them; without any usable label every score is 0.5; null ids are scored and are held out only by their remainder (never); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, with_id_and_text

WORD_INPUTS, STEPS, RANK = 1 << 13, 16, 6
TRAIN_ROWS, EPOCHS, LEVEL = 4000, 12, 0.7
_SPACE = re.compile(r"\s+")
N_STATS = 14
INPUTS = WORD_INPUTS + N_STATS * STEPS
_KNOWN_WORDS = 200_000


class Features:
    """Inputs of texts: (indices, values); keeps the hashes of words seen."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        from zlib import crc32

        words = text.split()
        known = self.known
        if len(known) > _KNOWN_WORDS:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = crc32(w.lower().encode()) % WORD_INPUTS
        ids, counts = np.unique(np.fromiter([known[w] for w in words], np.int64, len(words)), return_counts=True)
        values = np.sqrt(counts)
        norm = float(np.sqrt((values**2).sum())) or 1.0
        stats = np.clip(np.array(self.stats(text, words)) * STEPS, 0, STEPS - 1).astype(np.int64) + np.arange(N_STATS) * STEPS + WORD_INPUTS
        return np.concatenate([ids, stats]), np.concatenate([values / norm, np.full(N_STATS, 0.3)])

    @staticmethod
    def stats(text: str, words: list[str]) -> list[float]:
        """Statistics of structure, each brought to about 0 to 1."""
        raw = np.frombuffer(text.encode(), np.uint8)
        n = max(1, len(raw))
        kinds = np.bincount(raw, minlength=256)
        upper, lower, digit, high = kinds[65:91].sum(), kinds[97:123].sum(), kinds[48:58].sum(), kinds[128:].sum()
        space = kinds[9:14].sum() + kinds[32]
        stops = kinds[[33, 44, 46, 58, 59, 63]].sum()
        signs = n - upper - lower - digit - high - space - stops if len(raw) else 0
        lines = text.split("\n")
        nw, distinct = max(1, len(words)), len(set(words))
        pairs = len(set(zip(words, words[1:], strict=False)))
        return [
            np.log1p(len(raw)) / 14,
            np.log1p(len(lines)) / 9,
            min(1.0, len(raw) / nw / 20),
            upper / n * 2,
            digit / n * 4,
            signs / n * 4,
            stops / n * 8,
            kinds[33] / n * 8,
            distinct / nw,
            pairs / max(1, nw - 1),
            len(set(lines)) / len(lines),
            np.log1p(nw / len(lines)) / 7,
            kinds[124] / n * 8,
            high / n * 2,
        ]


def _crc(column: str) -> Column:
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(4))


class Machine:
    """Weights of a factorisation machine and its scores."""

    def __init__(self, inputs: int = INPUTS, rank: int = RANK, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w0, self.w = 0.0, np.zeros(inputs)
        self.v = rng.normal(0, 0.05, (inputs, rank))

    def raw(self, idx: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
        v = self.v[idx]
        s = x @ v
        return self.w0 + float(self.w[idx] @ x) + 0.5 * float((s**2).sum() - ((v * x[:, None]) ** 2).sum()), s

    def score(self, idx: np.ndarray, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(idx, x)[0], -30, 30))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = EPOCHS, rate: float = 0.08, decay: float = 1e-4, seed: int = 7) -> Machine:
        """AdaGrad over the logistic loss, one row at a time, in a fixed order."""
        if not rows:
            self.v[:] = 0
        rng = np.random.default_rng(seed)
        g0, gw, gv = 1e-8, np.full(len(self.w), 1e-8), np.full(self.v.shape, 1e-8)
        for _ in range(epochs):
            for r in rng.permutation(len(rows)):
                idx, x = rows[r]
                z, s = self.raw(idx, x)
                slope = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[r]
                d = slope * x + decay * self.w[idx]
                gw[idx] += d * d
                self.w[idx] -= rate * d / np.sqrt(gw[idx])
                v = self.v[idx]
                d = slope * x[:, None] * (s - v * x[:, None]) + decay * v
                gv[idx] += d * d
                self.v[idx] = v - rate * d / np.sqrt(gv[idx])
                g0 += slope * slope
                self.w0 -= rate * slope / np.sqrt(g0)
        return self


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, quality, text) of at most ``rows`` labelled documents that are not held out, one row an id."""
    some = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    some = some.where("doc_id is not null and quality in (0, 1)").where(_crc("doc_id") != 2)
    some = some.groupBy("doc_id").agg(F.avg("quality").alias("mean")).where("mean <> 0.5").select("doc_id", F.round("mean").cast("int").alias("quality"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    labelled = with_id_and_text(docs).join(F.broadcast(some), "doc_id")  # at most ``rows`` ids
    return labelled.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("text").alias("text"))  # one row an id


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """Learn from inputs made on the executors; the driver gets those of the bounded sample only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in slices(batches):
            made = [features(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([i.astype("<u2").tobytes() for i, _ in made], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in made], pa.binary())],
                ["doc_id", "quality", "idx", "x"],
            )

    made = training_rows(docs, labels, rows).select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, idx binary, x binary")
    got = sorted((r.doc_id, r.quality, bytes(r.idx), bytes(r.x)) for r in made.collect())
    inputs = [(np.frombuffer(i, "<u2").astype(np.int64), np.frombuffer(x, "<f4").astype(np.float64)) for _, _, i, x in got]
    return Machine().fit(inputs, [q for _, q, _, _ in got])


def scores(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, features = shared.value, Features()
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([machine.score(*features(t)) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    scored = with_id_and_text(docs).mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(_crc("doc_id") == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= LEVEL).cast("int").alias("predicted"))


def kept(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of docs that the machine predicts to be good, with all their columns; each is decided by its text."""
    shared, place = docs.sparkSession.sparkContext.broadcast(machine), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, features = shared.value, Features()
        for batch in slices(batches):
            yield batch.filter(pa.array([machine.score(*features(t or "")) >= LEVEL for t in batch.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scores(docs, train(docs, table(spark, sf_dir, "labels")))
