"""Scores of findings against expected verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.names import plain_name
from docketry.functions.text import blank_to_null, cite_key, ratio

# Labels of expected verdicts, and the verdict that means each.
LABELS = ["real", "fabricated", "miscited"]


def predicted_label(verdict: Column) -> Column:
    return F.when(verdict == "verified", "real").otherwise(verdict)


def expected_rows(fixtures: DataFrame) -> DataFrame:
    """(doc_id, entry, key, name, expected, citation): one row per expected citation of a fixture."""
    rows = fixtures.select(F.col("id").alias("doc_id"), F.posexplode("expected").alias("entry", "x"))
    return rows.select("doc_id", "entry", cite_key("x.volume", "x.reporter", "x.page").alias("key"), blank_to_null(plain_name("x.case_name")).alias("name"), F.col("x.verdict").alias("expected"), F.col("x.citation_verbatim").alias("citation"))


def match_expected(expected: DataFrame, findings: DataFrame) -> DataFrame:
    """``expected`` with the finding it meets: by key, else by name; of several findings of one key or name the first.

    Adds ``idx``, ``predicted``, ``error_class`` and ``confidence``, null where nothing was found.
    """
    got = findings.select("doc_id", "idx", F.col("cite_key").alias("key"), blank_to_null(plain_name("case_name")).alias("name"), F.struct("idx", predicted_label(F.col("verdict")).alias("predicted"), "error_class", "confidence").alias("_f"))
    first = lambda by: got.where(F.col(by).isNotNull()).groupBy("doc_id", by).agg(F.min("_f").alias(f"_{by}"))
    out = expected.join(first("key"), ["doc_id", "key"], "left").join(first("name"), ["doc_id", "name"], "left")
    return out.withColumn("_f", F.coalesce("_key", "_name")).select(*expected.columns, "_f.*")


def missed_expected(matches: DataFrame) -> DataFrame:
    return matches.where("idx is null").select("doc_id", "entry", "citation", "expected")


def unmatched_findings(findings: DataFrame, matches: DataFrame) -> DataFrame:
    """Findings that no expected citation met."""
    return findings.join(matches.where("idx is not null").select("doc_id", "idx"), ["doc_id", "idx"], "left_anti")


def detection_metrics(matches: DataFrame, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """(label, true_positive, false_positive, false_negative, precision, recall, f1) of each label against the rest.

    Ratios to four digits, null without a denominator; F1 is of the rounded
    ratios, 0 if either is 0, null if either is null. Rows without a prediction don't count;
    without any row each label has zeros.
    """
    base = matches.sparkSession.createDataFrame([(x,) for x in LABELS], "label string")
    labels = F.explode(F.array(*map(F.lit, LABELS))).alias("label")
    rows = matches.where(F.col(predicted).isNotNull()).groupBy(F.col(expected).alias("_e"), F.col(predicted).alias("_p")).count().select("*", labels)
    is_e, is_p = F.col("_e") == F.col("label"), F.col("_p") == F.col("label")
    total = lambda c: F.sum(F.when(c, F.col("count"))).cast("bigint")
    out = rows.groupBy("label").agg(total(is_e & is_p).alias("true_positive"), total(~is_e & is_p).alias("false_positive"), total(is_e & ~is_p).alias("false_negative"))
    return with_rates(base.join(F.broadcast(out), "label", "left").na.fill(0))


def with_rates(counts: DataFrame) -> DataFrame:
    tp, fp, fn = (F.col(f"{x}") for x in ("true_positive", "false_positive", "false_negative"))
    out = counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p.isNotNull() & r.isNotNull(), F.when((p == 0) | (r == 0), 0.0).otherwise(F.bround(2 * p * r / (p + r), 4))))


def confusion_matrix(matches: DataFrame, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """One row per label: how many of it were predicted as each label, undecided or unverifiable."""
    base = matches.sparkSession.createDataFrame([(x,) for x in LABELS], "label string")
    got = matches.groupBy(F.col(expected).alias("label")).pivot(predicted, [*LABELS, "undecided", "unverifiable"]).count()
    return base.join(got, "label", "left").na.fill(0)


def summary(matches: DataFrame, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """One row: expected, found, missed, correct, decided and unverifiable citations, and accuracies."""
    found, right, open_ = F.col(predicted).isNotNull(), F.col(expected) == F.col(predicted), F.col(predicted) == "unverifiable"
    out = matches.agg(
        F.count("*").alias("citations_expected"), F.count_if(found).alias("citations_found"), F.count_if(~found).alias("citations_missed"),
        F.count_if(found & right).alias("correct_verdicts"), F.count_if(found & ~open_).alias("citations_decided"), F.count_if(open_).alias("citations_unverifiable"),
    )
    return out.withColumns({"verdict_accuracy": ratio("correct_verdicts", "citations_found"), "verdict_accuracy_of_decided": ratio("correct_verdicts", "citations_decided")})


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The newest row of each key: what an upsert leaves. Of equally new ones that of the greatest other columns."""
    order = Window.partitionBy(key).orderBy(F.desc(at), *(F.desc(c) for c in rows.columns if c not in (key, at)))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
