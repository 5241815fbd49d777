"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import WordTable, as_lists, discard, labelled_sample, materialize, portions, split_words, sums

#: Most labelled rows that are fitted.
MAX_TRAIN_ROWS = 20_000
#: Weight of the pooled covariance in each class's, then of the mean variance in the result.
POOL, RIDGE = 0.10, 0.02
#: Statistics are held within so many standard deviations.
CLIP = 6.0
STATISTICS = ("log_words", "word_length", "word_length_spread", "types", "repeats", "capitals", "capital_words", "symbols", "symbol_words", "exclamations", "stops", "digits", "lines", "same_lines", "density")


def statistics(limit: int = 300_000):
    """Texts -> rows of STATISTICS, as a function with a memory of words. Empty and null texts have zeros."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1).compress
    marks = frozenset("#*$%&|<>@^~_=+\\/{}[]")

    def measure(word: str) -> tuple:
        letters = sum(map(str.isalpha, word))
        upper = sum(map(str.isupper, word))
        symbols = sum(c in marks for c in word)
        n = len(word)
        return n, letters, upper, letters > 1 and upper == letters, symbols, symbols > 0, word.count("!"), word.endswith((".", "?", "…")), sum(map(str.isdigit, word)), n * n

    table = WordTable(measure, 10, limit)

    def rate(k: np.ndarray, base: np.ndarray) -> np.ndarray:
        return np.log((k + 0.25) / (base + 0.5))

    def some(texts: pa.Array) -> np.ndarray:
        words, at, bounds = split_words(texts)
        n = np.diff(bounds)
        doc = np.repeat(np.arange(len(n)), n)
        s = sums(table.of(words)[at], bounds)
        types = np.bincount(np.unique(doc * max(1, len(words)) + at) // max(1, len(words)), minlength=len(n))
        again = np.bincount(doc[1:][(at[1:] == at[:-1]) & (doc[1:] == doc[:-1])], minlength=len(n))
        whole = np.array([_whole(x, press) for x in texts.to_pylist()]).reshape(len(n), 3)
        one = np.maximum(n, 1)
        mean = s[:, 0] / one
        columns = [
            np.log1p(n), mean, np.log1p(np.sqrt(np.maximum(s[:, 9] / one - mean**2, 0))), np.log(np.maximum(types, 1)) / np.log(one + 1), rate(again, n), rate(s[:, 2], np.maximum(1, s[:, 1])),
            rate(s[:, 3], n), rate(s[:, 4], n), rate(s[:, 5], n), rate(s[:, 6], n), rate(s[:, 7], n), rate(s[:, 8], n), rate(whole[:, 0], n), rate(whole[:, 1], whole[:, 0]), whole[:, 2],
        ]
        return np.where(n[:, None] > 0, np.stack(columns, axis=1), 0.0)

    def run(texts: pa.Array) -> np.ndarray:
        return np.concatenate([np.zeros((0, len(STATISTICS))), *(some(texts[part]) for part in portions(texts, 512, 4 << 20))])

    return run


def _whole(text: str | None, press) -> tuple[int, int, float]:
    """(lines with words, those that repeat an earlier one, log of the compressed share) of a text."""
    if not text:
        return 0, 0, 0.0
    lines = [x for x in text.split("\n") if x.strip()]
    raw = text.encode()
    return len(lines), len(lines) - len(set(lines)), math.log(len(press(raw)) / len(raw))


def statistics_udf():
    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = statistics()
        for texts in batches:
            yield as_lists(of(texts))

    return run


class Gauss(NamedTuple):
    """A class: its mean, the Cholesky factor of its covariance and the log of the factor's determinant, kept for all texts."""

    mean: np.ndarray
    factor: np.ndarray
    log_det: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """Of rows, up to a constant: half the squared Mahalanobis distance and the log-determinant, both negative."""
        z = (x - self.mean).T
        for i, row in enumerate(self.factor):  # forward substitution: the factor is triangular
            z[i] = (z[i] - row[:i] @ z[:i]) / row[i]
        return -0.5 * np.sum(z * z, axis=0) - self.log_det


class QualityModel(NamedTuple):
    center: np.ndarray
    scale: np.ndarray
    good: Gauss | None
    bad: Gauss | None
    slope: float
    offset: float

    def difference(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.center) / self.scale, -CLIP, CLIP)
        return self.good.log_density(z) - self.bad.log_density(z)

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.good is None:
            return np.full(len(x), 1 / (1 + math.exp(-self.offset)))
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.offset, -500, 500)))

    def score(self, docs: DataFrame, text: str = "text", threshold: float = 0.3) -> DataFrame:
        """``docs`` with ``score`` (that the label is 1) and ``predicted``. Each text is judged whole and alone; columns with these names are replaced."""
        model = self

        @F.arrow_udf("double")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            of = statistics()
            for texts in batches:
                yield pa.array(model.probability(of(texts)))

        out = docs.withColumn("score", run(F.col(text)))
        return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sums and sums of products of each label's rows, added up by Spark."""
    d = len(STATISTICS)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = [F.col("x")[i] for i in range(d)]
    sums = rows.groupBy("label").agg(F.count("*").alias("n"), F.array(*map(F.sum, x)).alias("first"), F.array(*(F.sum(x[i] * x[j]) for i, j in pairs)).alias("second"))
    out = {}
    for r in sums.collect():
        square = np.zeros((d, d))
        for (i, j), v in zip(pairs, r["second"]):
            square[i, j] = square[j, i] = v
        out[r["label"]] = (float(r["n"]), np.array(r["first"]), square)
    return out


def _covariance(n: float, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mean = first / n
    return second / n - np.outer(mean, mean)


def _gauss(mean: np.ndarray, own: np.ndarray, pooled: np.ndarray, pool: float, ridge: float) -> Gauss:
    mixed = (1 - pool) * own + pool * pooled
    mixed = (1 - ridge) * mixed + ridge * max(1e-6, np.trace(mixed) / len(mixed)) * np.eye(len(mixed))
    factor = np.linalg.cholesky(mixed)
    return Gauss(mean, factor, float(np.log(np.diag(factor)).sum()))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve, with a little pull to slope 0.1."""
    w = np.array([0.1, math.log((y.sum() + 1) / (len(y) - y.sum() + 1))])
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (y - p) - np.array([1e-2 * (w[0] - 0.1), 0])
        weights = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve(design.T @ (design * weights[:, None]) + np.diag([1e-2, 1e-6]), gradient)
        w = w + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-7:
            break
    return max(1e-3, float(w[0])), float(w[1])


def fit_quality(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS, label: str = "quality", doc_id: str = "doc_id", text: str = "text", pool: float = POOL, ridge: float = RIDGE) -> QualityModel:
    """Learn from at most about ``max_train_rows`` labelled documents that are not held out.

    A hash of the text keeps a quarter of them for the calibration. From the rest
    Spark adds up each class's moments; the two covariances, shrunk to the pooled one
    and to a sphere, are factored once. A logistic curve over the log-density
    differences of the other rows turns them into probabilities. With no labels, or
    labels of one kind, every text gets the labels' smoothed mean; rows too few to be
    split serve both ends.
    """
    sample = labelled_sample(docs, labels, label, max_train_rows, doc_id, text)
    rows = materialize(sample.select("label", (F.pmod(F.xxhash64("text"), F.lit(4)) == 0).alias("later"), statistics_udf()(F.col("text")).alias("x")), "quality-statistics")
    first, later = rows.where("not later"), rows.where("later")
    raw = _moments(first)
    if len(raw) < 2 or min(m[0] for m in raw.values()) < 2:
        first = later = rows
        raw = _moments(rows)
    n = sum(m[0] for m in raw.values())
    d = len(STATISTICS)
    if len(raw) < 2 or min(m[0] for m in raw.values()) < 2:
        ones = raw.get(1, (0.0,))[0]
        return QualityModel(np.zeros(d), np.ones(d), None, None, 0.0, math.log((ones + 1) / (n - ones + 1)))
    whole = tuple(sum(m[k] for m in raw.values()) for k in range(3))
    center = whole[1] / n
    scale = np.sqrt(np.maximum(np.diag(_covariance(*whole)), 1e-9))
    model = QualityModel(center, scale, None, None, 0.0, 0.0)
    limits = [(float(center[i]), float(scale[i])) for i in range(d)]
    held = F.array(*(F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), (F.col("x")[i] - c) / s)) for i, (c, s) in enumerate(limits)))
    moments = _moments(first.select("label", held.alias("x")))
    covariances = {k: _covariance(*m) for k, m in moments.items()}
    pooled = sum(m[0] * covariances[k] for k, m in moments.items()) / n
    gauss = {k: _gauss(m[1] / m[0], covariances[k], pooled, pool, ridge) for k, m in moments.items()}
    model = model._replace(good=gauss[1], bad=gauss[0])
    known = later.collect()  # a part of at most about max_train_rows rows of numbers
    if len({r["label"] for r in known}) < 2:
        known = rows.collect()
    discard(sample, rows)
    slope, offset = _logistic(model.difference(np.array([r["x"] for r in known])), np.array([r["label"] for r in known], dtype=float))
    return model._replace(slope=slope, offset=offset)
