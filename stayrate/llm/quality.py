"""Quality classifier: random Fourier features, ridge by normal equations, isotonic scores.

A Gaussian kernel over standardized document statistics is approximated by random cosine
features. Every partition sums its share of the normal equations, so the fit is one
aggregation whose size depends on the number of features alone. Ridge scores of training
rows that were left out of the sums are turned into probabilities by isotonic regression.
"""

from __future__ import annotations

import math
import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.llm.common import map_arrow, numbered, pick, slices, stored, utf8, with_fields

# Labelled rows that a fit uses at most; more are sampled by a hash of their id.
MAX_FIT_ROWS = 200_000
FEATURES, RIDGE, SEED = 256, 1e-3, 7
# Calibration works on sums per score bin.
BINS = 512
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_UPPER, _DIGIT, _HIGH = slice(65, 91), slice(48, 58), slice(128, 256)
_SENTENCE, _SPACE = [33, 46, 63], [9, 10, 11, 12, 13, 32]


def statistics(text: bytes) -> list[float]:
    """Figures of a whole text; all zero where it is empty."""
    n = len(text)
    if not n:
        return [0.0] * 20
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters, high, space = seen[_LETTER].sum(), seen[_HIGH].sum(), seen[_SPACE].sum()
    marks = n - letters - high - space - seen[_DIGIT].sum()
    share = seen[seen > 0] / n
    words = text.lower().split()
    w = len(words)
    sizes = np.fromiter(map(len, words), np.int64, w)
    kinds = len(set(words))
    again = sum(map(operator.eq, words, words[1:]))
    lines = text.split(b"\n")
    return [float(x) for x in (
        math.log1p(n), math.log1p(w), (letters + high) / n, high / n, seen[_UPPER].sum() / n,
        seen[_DIGIT].sum() / n, marks / n, space / n, seen[_SENTENCE].sum() / max(w, 1),
        seen[44] / max(w, 1), (marks - seen[44] - seen[_SENTENCE].sum()) / max(w, 1),
        seen[33] / max(w, 1), seen[124] / max(w, 1), -(share * np.log(share)).sum(),
        sizes.mean() if w else 0, math.log1p(sizes.max()) if w else 0,
        math.log(kinds / w) if w else 0, again / max(w - 1, 1),
        len(set(lines)) / len(lines), math.log1p(w / len(lines)))]


@dataclass
class Model:
    """A fitted scorer; its size depends on the number of features alone."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return fourier(stats, self.mean, self.scale) @ self.weights

    def scores(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.knots, self.values)


def fourier(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random cosine features of standardized statistics, and a constant."""
    x = np.clip((stats - mean) / scale, -8, 8)
    rng = np.random.default_rng(SEED)
    omega = rng.standard_normal((x.shape[1], FEATURES)) / (0.75 * math.sqrt(x.shape[1]))
    phase = rng.uniform(0, 2 * math.pi, FEATURES)
    out = np.ones((len(x), FEATURES + 1))
    out[:, :-1] = math.sqrt(2 / FEATURES) * np.cos(x @ omega + phase)
    return out


def measured(documents: DataFrame) -> DataFrame:
    """(doc_id, stats) of every row, written once: texts are read in one pass and need no
    shuffle to meet their labels."""
    rows = pick(documents, "doc_id", "text")
    schema = with_fields(rows.select("doc_id"), "stats array<double>")

    def measure(batches):
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([statistics(t) for t in utf8(part)],
                                                 pa.list_(pa.float64()))], ["doc_id", "stats"])

    return stored(rows.transform(map_arrow, measure, schema), "measured")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("stats").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def isotonic(bins: np.ndarray, total: np.ndarray, count: np.ndarray):
    """Knots and values of the non-decreasing fit to sums per bin, by pooling neighbours
    that violate the order. A virtual row of each label holds the ends at 0 and 1."""
    order = np.argsort(bins)
    pools: list[list[float]] = []
    for x, s, n in zip([0.0, *bins[order], 1.0], [0.0, *total[order], 1.0],
                       [1.0, *count[order], 1.0]):
        pools.append([x * n, s, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top)]
    return (np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools]))


def fit(stats: DataFrame, labels: DataFrame, max_fit_rows: int = MAX_FIT_ROWS) -> Model:
    """A model from ``stats`` (doc_id, stats) and ``labels`` (doc_id, y). Labels of one id
    are averaged, null ones and ids left out. With no usable label every score is one half."""
    known = (labels.where("doc_id is not null and y is not null")
             .groupBy("doc_id").agg(F.avg("y").alias("y")))
    count = known.count()
    if count > max_fit_rows:
        share = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
        known = known.where(share < max_fit_rows / count)
    rows = stored(stats.join(known, "doc_id"), "labelled")

    figures = (rows.select(F.posexplode("stats").alias("i", "x")).groupBy("i")
               .agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("i").collect())
    if not figures:
        return Model(np.zeros(20), np.ones(20), np.zeros(FEATURES + 1), np.zeros(1), np.full(1, 0.5))
    mean = np.array([f.m for f in figures])
    scale = np.array([f.s if f.s and f.s > 1e-9 else 1.0 for f in figures])
    left_out = F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(5)) == 0
    upper = np.triu_indices(FEATURES + 1)

    def sums(batches):
        gram, right = np.zeros((FEATURES + 1,) * 2), np.zeros(FEATURES + 1)
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                z = fourier(_matrix(part), mean, scale)
                gram += z.T @ z
                right += z.T @ part.column("y").to_numpy(zero_copy_only=False)
        if gram.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array([np.concatenate([gram[upper], right])], pa.list_(pa.float64()))], ["v"])

    added = (rows.where(~left_out).transform(map_arrow, sums, "v array<double>")
             .select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
             .orderBy("i").collect())
    if not added:
        return Model(mean, scale, np.zeros(FEATURES + 1), np.zeros(1), np.full(1, 0.5))
    values = np.array([r.x for r in added])
    gram = np.zeros((FEATURES + 1,) * 2)
    gram[upper] = values[:len(upper[0])]
    gram += np.triu(gram, 1).T
    penalty = np.eye(FEATURES + 1) * RIDGE * gram[-1, -1]
    penalty[-1, -1] = 1e-9
    weights = np.linalg.solve(gram + penalty, values[len(upper[0]):])
    model = Model(mean, scale, weights, np.zeros(1), np.full(1, 0.5))

    def binned(batches):
        for batch in batches:
            at = np.floor(np.clip(model.raw(_matrix(batch)), 0, 1) * BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("y")], ["bin", "y"])

    bins = (rows.where(left_out).transform(map_arrow, binned, "bin bigint, y double").groupBy("bin")
            .agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n")).collect())  # BINS + 1 at most
    at = np.array([(r.bin + 0.5) / (BINS + 1) for r in bins])
    model.knots, model.values = isotonic(
        at, np.array([r.s for r in bins], float), np.array([r.n for r in bins], float))
    return model


def quality_labels(labels: DataFrame) -> DataFrame:
    return pick(labels, "doc_id", "quality").withColumnRenamed("quality", "y")


def score_table(documents: DataFrame, labels: DataFrame, threshold: float = 0.7,
                max_fit_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Labels are learned where crc32(doc_id) mod 4 is not 2. A null text scores like an empty
    one; a null doc_id is not held out. Repeated rows score alike; an empty table gives an
    empty result.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    stats = measured(documents)
    model = fit(stats, quality_labels(labels).where(~held), max_fit_rows)
    model = documents.sparkSession.sparkContext.broadcast(model)
    schema = with_fields(stats.select("doc_id"), "score double")

    def score(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(model.value.scores(_matrix(part)))],
                    ["doc_id", "score"])

    return stats.transform(map_arrow, score, schema).select(
        "doc_id", held.alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(documents: DataFrame, labels: DataFrame, threshold: float = 0.7,
             max_fit_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """The rows that score at least the threshold, with all columns. Learns from all labels."""
    model = fit(measured(documents), quality_labels(labels), max_fit_rows)
    model = documents.sparkSession.sparkContext.broadcast(model)
    plain, names, at = numbered(documents)
    schema = with_fields(plain, "score double")

    def score(batches):
        for part in slices(batches, at["text"]):
            stats = np.array([statistics(t) for t in utf8(part, at["text"])])
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(model.value.scores(stats))], schema.names)

    return (plain.transform(map_arrow, score, schema).where(F.col("score") >= threshold)
            .drop("score").toDF(*names))
