"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import WordTable, as_lists, discard, fresh, labelled_sample, materialize, portions, split_words, sums

#: Most labelled rows that are fitted.
MAX_TRAIN_ROWS = 20_000
STRONG, MILD = 3.5, 2.0
STEMS = (4, 5, 6)
#: Words that address a reader, in the languages of the texts. Fixed values.
SECOND_PERSON = frozenset("you your yours yourself u ur ye thou du dich dir dein deine deiner deinem deinen ihr euch euer eure tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro vuestra".split())
#: What characters stand for in disguised words. Fixed values.
LEET = str.maketrans({"0": "o", "1": "i", "!": "i", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t", "+": "t", "|": "l", "*": "", ".": "", "-": "", "_": "", ",": ""})
ENDS = ".,;:!?\"'()[]{}<>«»„“”‘’…|*#$%&"
NEAR = 8

FEATURES = (
    "strong_density", "strong_count", "mild_density", "stem_density", "stem_count", "near_second_person", "second_person_density", "capital_letters", "capital_words",
    "exclamations", "questions", "punctuation", "obfuscated_density", "obfuscated_hits", "n_words",
)


def plain(word: str) -> str:
    return word.strip(ENDS).lower()


def revealed(word: str) -> str:
    """The word under its disguise: look-alike characters read as letters, letters said three times or more as one."""
    return re.sub(r"(.)\1{2,}", r"\1", word.strip(".,;:?\"'()").lower().translate(LEET))


def terms_of(word: str) -> list[str]:
    """The word, and its stems with a mark."""
    w = plain(word)
    return [w, *(f"{w[:n]}~" for n in STEMS if len(w) > n)] if w else []


def term_counts(sample: DataFrame) -> DataFrame:
    """(term, ones, zeros): how many texts of each label hold each term."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: dict[tuple[str, int], int] = {}
            for text, label in zip(batch["text"], batch["label"]):
                for t in {t for w in set(text.split()) for t in terms_of(w)}:
                    counts[t, label] = counts.get((t, label), 0) + 1
            yield pd.DataFrame({"term": [t for t, _ in counts], "label": [x for _, x in counts], "n": list(counts.values())})

    rows = sample.select("text", "label").mapInPandas(run, "term string, label int, n long")
    of = lambda label: F.coalesce(F.sum(F.when(F.col("label") == label, F.col("n"))), F.lit(0))
    return rows.groupBy("term").agg(of(1).alias("ones"), of(0).alias("zeros"))


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Terms and their log-odds of being in a text labelled 1 rather than in one labelled 0, by documents.

    All terms count that 1 in 200 of the texts labelled 1 hold, and 3 at least, if
    their odds are MILD or more. What reaches the driver is bounded by the sample:
    each such term is in many of its texts.
    """
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    ones, zeros = sizes.get(1, 0), sizes.get(0, 0)
    if not ones or not zeros:
        return {}
    odds = F.log((F.col("ones") + 0.5) / (ones + 1)) - F.log((F.col("zeros") + 0.5) / (zeros + 1))
    rows = term_counts(sample).where(F.col("ones") >= max(3, round(0.005 * ones))).select("term", odds.alias("odds")).where(F.col("odds") >= MILD)
    return {r["term"]: r["odds"] for r in rows.collect()}


def toxicity_features(lexicon: dict[str, float]):
    """An Arrow UDF: text -> FEATURES as an array. Null and empty texts have zeros."""

    @F.arrow_udf("array<double>")
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        marks = re.compile(r"[^\w\s]")
        disguise = re.compile(r"[a-z][0-9@$*!|+]+[a-z]|^[@$0-9*]+[a-z]{2}|(?:[a-z][.\-_*]){3}|([a-z])\1{2,}")

        def measure(word: str) -> tuple:
            w = plain(word)
            own = lexicon.get(w, 0.0)
            stem = max((lexicon.get(f"{w[:n]}~", 0.0) for n in STEMS if len(w) > n), default=0.0)
            letters = sum(map(str.isalpha, word))
            upper = sum(map(str.isupper, word))
            hidden = bool(disguise.search(word.lower().strip(".,;:?!\"'()")))
            bare = revealed(word) if hidden else ""
            behind = hidden and bool(lexicon.get(bare, 0.0) >= MILD or any(lexicon.get(f"{bare[:n]}~", 0.0) >= STRONG for n in STEMS if len(bare) > n))
            return (
                own >= STRONG, MILD <= own < STRONG, stem >= STRONG, w in SECOND_PERSON, letters, upper, letters > 2 and upper == letters,
                word.count("!"), word.count("?"), len(marks.findall(word)), hidden, behind, own >= MILD or stem >= STRONG or behind,
            )

        table = WordTable(measure, 13)

        def near(hits: np.ndarray, you: np.ndarray) -> float:
            """The share of telling words with a second person within NEAR words."""
            place = np.searchsorted(you, hits)
            gap = np.minimum(np.abs(hits - you[np.minimum(place, len(you) - 1)]), np.abs(hits - you[np.maximum(place - 1, 0)]))
            return float(np.mean(gap <= NEAR))

        for batch in batches:
            out = [np.zeros((0, len(FEATURES)))]
            for some in portions(batch, 512, 4 << 20):
                words, at, bounds = split_words(batch[some])
                rows = table.of(words)[at]
                s, n = sums(rows, bounds), np.maximum(np.diff(bounds), 1)
                close = np.zeros(len(n))
                for i in np.flatnonzero((s[:, 12] > 0) & (s[:, 3] > 0)):
                    own = rows[bounds[i] : bounds[i + 1]]
                    close[i] = near(np.flatnonzero(own[:, 12]), np.flatnonzero(own[:, 3]))
                columns = [
                    s[:, 0] / n, np.log1p(s[:, 0]), s[:, 1] / n, s[:, 2] / n, np.log1p(s[:, 2]), close, s[:, 3] / n, s[:, 5] / np.maximum(1, s[:, 4]), s[:, 6] / n,
                    s[:, 7] / n, s[:, 8] / n, s[:, 9] / n, s[:, 10] / n, np.log1p(s[:, 11]), np.log1p(np.diff(bounds)),
                ]
                out.append(np.stack(columns, axis=1))
            yield as_lists(np.concatenate(out))

    return features


class ToxicityModel:
    """A lexicon, boosted trees and a calibration; ``score`` adds columns to any frame with texts."""

    def __init__(self, lexicon, trees, calibration, prior: float):
        self.lexicon, self.trees, self.calibration, self.prior = lexicon, trees, calibration, prior

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with ``score`` and ``predicted``. Each text is judged whole and alone; columns with these names are replaced, others stay."""
        if self.trees is None:
            out = docs.withColumn("score", F.lit(float(self.prior)))
            return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
        features, raw, chance, guess, margin, calm = helpers = fresh(docs, "_features", "_raw", "_chance", "_guess", "_margin", "_calm")
        out = docs.withColumn(features, array_to_vector(toxicity_features(self.lexicon)(F.col(text))))
        trees = self.trees.copy().setFeaturesCol(features).setRawPredictionCol(raw).setProbabilityCol(chance).setPredictionCol(guess)
        out = trees.transform(out).withColumn(margin, vector_to_array(raw)[1])
        out = self.calibration.copy().setFeaturesCol(margin).setPredictionCol(calm).transform(out)
        # Isotonic steps give many texts equal scores; a thousandth of the margin's own order parts them.
        out = out.withColumn("score", 0.999 * F.col(calm) + 0.001 / (1 + F.exp(-2 * F.col(margin))))
        return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).drop(*helpers)


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", seed: int = 7) -> ToxicityModel:
    """Learn from at most about ``max_train_rows`` labelled documents that are not held out.

    A hash of the text deals them out. A quarter is for the calibration alone: neither
    the lexicon nor the trees see it. Of the rest, the trees see each half through a
    lexicon learned from the other one, so that no row's features know its own label;
    texts are scored with the lexicon of both. With no labels, or labels of one kind,
    the model gives every text the labels' mean (0 without labels).
    """
    sample = labelled_sample(docs, labels, label, max_train_rows, doc_id, text)
    known = sample.agg(F.avg("label").alias("mean"), F.min("label").alias("least"), F.max("label").alias("most")).first()
    if known["mean"] is None or known["least"] == known["most"]:
        return ToxicityModel({}, None, None, known["mean"] or 0.0)
    part = F.pmod(F.xxhash64("text"), F.lit(8))
    halves = [sample.where(part < 3), sample.where((part >= 3) & (part < 6))]
    lexicon = learn_lexicon(halves[0].union(halves[1]))
    seen = lambda rows, words: rows.select(array_to_vector(toxicity_features(words)(F.col("text"))).alias("features"), F.col("label").cast("double").alias("label"))
    crossed = seen(halves[0], learn_lexicon(halves[1])).union(seen(halves[1], learn_lexicon(halves[0])))
    rows = materialize(crossed, "toxic-features")
    if rows.select("label").distinct().count() < 2:
        return ToxicityModel({}, None, None, known["mean"])
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=20, maxDepth=3, stepSize=0.2, minInstancesPerNode=5, seed=seed).fit(rows.coalesce(4))
    later = materialize(trees.transform(seen(sample.where(part >= 6), lexicon)).select(vector_to_array("rawPrediction")[1].alias("margin"), "label"), "toxic-margins")
    calibration = IsotonicRegression(featuresCol="margin", labelCol="label").fit(later.coalesce(4))
    discard(sample, rows, later)
    return ToxicityModel(lexicon, trees, calibration, known["mean"])
