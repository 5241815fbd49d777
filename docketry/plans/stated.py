"""Citations as the derived briefs state them, their verdicts, and the SQL of both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators.search import corpus_search
from docketry.operators.verdicts import findings
from docketry.plans import derived as D
from docketry.sources.shared import stage


def stated_citations(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """Citation rows as the briefs' sentences state them, without reading the sentences. ``orders``: ``order_rows``, if they are at hand."""
    rows = D.brief_citations(spark, sf_dir, orders)
    ids = F.map_from_arrays(F.array(*(F.lit(w) for w, _ in D.COURTS)), F.array(*(F.lit(i) for _, i in D.COURTS)))
    told = F.when(F.col("reporter") == "U.S.", "scotus")
    return rows.select(
        "doc_id", F.col("o_orderkey").cast("int").alias("idx"), "way", "matched_text", "volume", "reporter", "page", F.coalesce("court", told).alias("court"),
        F.coalesce(F.when(F.col("court").isNotNull(), F.element_at(ids, F.col("court"))), told).alias("court_id"), F.when(F.col("court").isNotNull(), "document").when(told.isNotNull(), "reporter").alias("court_source"),
        "year", "case_name", "cite_key", F.lit(None).cast("array<string>").alias("extraction_notes"),
    )


def verdict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Orders meet customers and the orders that lend to them once; citations and cases are made of the same narrow rows wherever they are read.
    orders = stage(D.order_rows(spark, sf_dir), "orders")
    cited = stated_citations(spark, sf_dir, orders)
    results, status = corpus_search(cited, D.cases(spark, sf_dir, orders))
    return findings(cited, results, status)


#: What the way that a citation is made means for it, by rules of its own.
JUDGED = f"""WITH {D.CASES_SQL},
  j AS (
    SELECT b.*, {D.KEY_SQL.format('b.')} AS cite_key, concat_ws(' ', b.volume, b.reporter, b.page) AS matched_text, o.case_name AS own_name, o.court AS own_court, concat_ws(' ', o.volume, o.reporter, o.page) AS own_cite,
      CASE WHEN b.way < 2 THEN 'D3' WHEN b.way = 2 THEN 'D10' WHEN b.way = 3 THEN 'D8' WHEN b.way = 4 THEN 'D4' WHEN b.way = 5 AND b.court_id LIKE 'ca%' THEN 'D5' WHEN b.way = 5 THEN 'D6' WHEN b.way = 6 THEN 'D1' ELSE 'D7' END AS rule
    FROM bc b JOIN oc o USING (o_orderkey)),
  v AS (
    SELECT *, CASE WHEN rule IN ('D1', 'D3') THEN 'verified' WHEN rule IN ('D4', 'D6') THEN 'miscited' WHEN rule = 'D7' THEN 'unverifiable' ELSE 'fabricated' END AS verdict,
      CASE rule WHEN 'D1' THEN 'none' WHEN 'D3' THEN 'none' WHEN 'D4' THEN 'wrong_slot' WHEN 'D6' THEN 'wrong_court' WHEN 'D7' THEN 'not_checked' WHEN 'D8' THEN 'fabricated_case_name' ELSE 'fabricated_cite' END AS error_class,
      CASE rule WHEN 'D1' THEN 0.75 WHEN 'D3' THEN 0.95 WHEN 'D4' THEN 0.85 WHEN 'D6' THEN 0.8 WHEN 'D7' THEN 0.0 WHEN 'D10' THEN CASE WHEN reporter = 'WL' THEN 0.7 ELSE 0.9 END ELSE 0.9 END::DOUBLE AS confidence,
      CASE WHEN rule IN ('D8', 'D10') THEN NULL ELSE o_orderkey END AS resolved, CASE rule WHEN 'D4' THEN partner WHEN 'D8' THEN o_orderkey END AS owner,
      CASE WHEN rule IN ('D4', 'D6') THEN own_name || ', ' || own_cite END AS suggestion
    FROM j)"""
