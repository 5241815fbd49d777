"""Runs over benchmark fixtures: documents whose citations' verdicts are known, audited and scored."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators import benchmark as B
from docketry.plans.audit import audit
from docketry.sources.shared import stage


class FixtureRun(NamedTuple):
    """``matches``: expected citations with what was found; the rest as in ``operators.benchmark``; ``documents``: a row of counts each."""

    matches: DataFrame
    missed: DataFrame
    unmatched: DataFrame
    metrics: DataFrame
    confusion: DataFrame
    summary: DataFrame
    documents: DataFrame


def run_fixtures(fixtures: DataFrame, cases: DataFrame | None = None, replies: DataFrame | None = None) -> FixtureRun:
    """Audit the texts of ``fixtures`` (see ``sources.files.read_fixtures``) and score the verdicts."""
    done = audit(fixtures.select(F.col("id").alias("doc_id"), "text"), cases, replies)
    matches = stage(B.match_expected(B.expected_rows(fixtures), done.findings), "matches")
    right = (F.col("expected") == F.col("predicted")).cast("int")
    documents = matches.groupBy("doc_id").agg(F.count("*").alias("expected"), F.count("predicted").alias("found"), F.coalesce(F.sum(right), F.lit(0)).alias("correct"))
    documents = documents.join(done.reports.select("doc_id", "total", "integrity_score", "check_coverage"), "doc_id", "left")
    return FixtureRun(matches, B.missed_expected(matches), B.unmatched_findings(done.findings, matches), B.detection_metrics(matches), B.confusion_matrix(matches), B.summary(matches), documents)


RESULTS = (
    "summary struct<citations_expected:bigint,citations_found:bigint,citations_missed:bigint,correct_verdicts:bigint,citations_decided:bigint,citations_unverifiable:bigint,verdict_accuracy:double,verdict_accuracy_of_decided:double>, "
    "metrics array<struct<label:string,true_positive:bigint,false_positive:bigint,false_negative:bigint,precision:double,recall:double,f1:double>>, "
    "confusion array<struct<label:string,real:bigint,fabricated:bigint,miscited:bigint,undecided:bigint,unverifiable:bigint>>"
)


def write_results(run: FixtureRun, path: str) -> None:
    """The whole run's scores as one JSON row under ``path``/results, a JSON row for each document and for each match beside it. A later run replaces them."""
    gathered = lambda df, name: df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name))  # noqa: E731  three rows, one a label
    whole = run.summary.select(F.struct("*").alias("summary")).crossJoin(gathered(run.metrics, "metrics")).crossJoin(gathered(run.confusion, "confusion"))
    for name, df in (("results", whole), ("documents", run.documents), ("matches", run.matches)):
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{name}")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """One row: ``available`` and, if a run was written under ``path``, its RESULTS; else nulls."""
    try:
        return spark.read.schema(RESULTS).json(f"{path}/results").select(F.lit(True).alias("available"), "*")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([(False, None, None, None)], f"available boolean, {RESULTS}")
