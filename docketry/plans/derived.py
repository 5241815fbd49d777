"""A case-law corpus and briefs made from the star schema, whose verdicts are known from how they are made.

Each order is a case: its number and its customer's name the parties, its key the
volume and page, its priority the reporter, its customer's nation the court. One
brief cites 16 orders; an order's key modulo 8 says what is wrong with its citation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.text import cite_key

REPORTERS = ["U.S.", "F.3d", "F. Supp. 2d", "WL", "F.2d"]
COURTS = [("1st Cir.", "ca1"), ("5th Cir.", "ca5"), ("9th Cir.", "ca9"), ("11th Cir.", "ca11"), ("S.D.N.Y.", "nysd"), ("D.D.C.", "dcd"), ("N.D. Cal.", "cand"), ("S.D. Fla.", "flsd")]
PER_BRIEF = 16
#: How far before an order the case lies whose citation it borrows: in another brief, where it is cited rightly.
PARTNER = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _letters(key: Column, letters: str = "abcdefghij") -> Column:
    return F.initcap(F.translate((key + 1_000_000).cast("string"), "0123456789", letters))


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, o_custkey, o_orderdate, c_nationkey, reporter, lends, lent): orders with what other rows say of them, a few numbers and short words; their cases' texts are made of these where they are needed.

    ``lends``: whether the order is of way 4 and the one before it, whose citation it borrows, is there; ``lent`` is that one's reporter.
    """
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate").join(customers.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select("o_orderkey", "o_custkey", "o_orderdate", "c_nationkey", _pick(REPORTERS, F.substring("o_orderpriority", 1, 1).cast("int")).alias("reporter"))
    # Only orders of way 4 borrow a citation, so only they and those before them are dealt by key.
    slots = rows.where((F.col("o_orderkey") + PARTNER) % 8 == 4).select((F.col("o_orderkey") + PARTNER).alias("o_orderkey"), F.lit(True).alias("lends"), F.col("reporter").alias("lent"))
    own = rows.where("o_orderkey % 8 <> 4").withColumns({"lends": F.lit(None).cast("boolean"), "lent": F.lit(None).cast("string")})
    return own.unionByName(rows.where("o_orderkey % 8 = 4").join(slots, "o_orderkey", "left"))


def order_cases(rows: DataFrame) -> DataFrame:
    """One row for each of ``order_rows`` with all that its case and its citation need."""
    return rows.select(
        "o_orderkey",
        "lends",
        "lent",
        F.concat(_letters(F.col("o_orderkey")), F.lit(" v. "), _letters(F.col("o_custkey"))).alias("case_name"),
        F.concat(_letters(F.col("o_orderkey"), "klmnopqrst"), F.lit(" v. "), _letters(F.col("o_custkey"), "klmnopqrst")).alias("other_name"),
        (F.col("o_orderkey") % 900 + 1).cast("string").alias("volume"),
        "reporter",
        (F.expr("o_orderkey div 900") + 1).cast("string").alias("page"),
        _pick([w for w, _ in COURTS], F.col("c_nationkey")).alias("court"),
        _pick([i for _, i in COURTS], F.col("c_nationkey")).alias("court_id"),
        _pick([w for w, _ in COURTS], F.col("c_nationkey") + 1).alias("other_court"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_filed"),
    )


def cases(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """A case for each order; ``rows``: ``order_rows``, if they are at hand."""
    rows = order_cases(order_rows(spark, sf_dir) if rows is None else rows)
    return rows.select(
        F.col("o_orderkey").cast("bigint").alias("cluster_id"), "case_name", F.array(F.concat_ws(" ", "volume", "reporter", "page")).alias("citations"), "court", "court_id", "date_filed",
        F.concat(F.lit("/opinion/"), F.col("o_orderkey").cast("string"), F.lit("/")).alias("absolute_url"), F.lit(None).cast("string").alias("snippet"),
    )


def brief_citations(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """(doc_id, o_orderkey, way, written): each order's citation as a sentence. ``way`` is the key modulo 8. ``rows``: ``order_rows``, if they are at hand."""
    rows = order_cases(order_rows(spark, sf_dir) if rows is None else rows).withColumn("way", (F.col("o_orderkey") % 8).cast("int")).where("way <> 4 or lends")
    lender = F.col("o_orderkey") - PARTNER
    unused = F.col("way").isin(2, 5, 7)
    volume = F.when(F.col("way") == 4, (lender % 900 + 1).cast("string")).when(unused, (F.col("o_orderkey") % 50 + 901).cast("string")).otherwise(F.col("volume"))
    reporter, page = F.when(F.col("way") == 4, F.col("lent")).otherwise(F.col("reporter")), F.when(F.col("way") == 4, (F.expr(f"(o_orderkey - {PARTNER}) div 900") + 1).cast("string")).otherwise(F.col("page"))
    name = F.when(F.col("way").isin(2, 3), F.col("other_name")).when(F.col("way") != 6, F.col("case_name"))
    court = F.when(F.col("way") == 5, F.col("other_court")).when(~F.col("way").isin(6, 7), F.col("court"))
    year = F.substring("date_filed", 1, 4)
    rows = rows.select("o_orderkey", "way", volume.alias("volume"), reporter.alias("reporter"), page.alias("page"), name.alias("case_name"), court.alias("court"), year.alias("year"))
    cite = F.concat_ws(" ", "volume", "reporter", "page")
    paren = F.concat(F.lit(" ("), F.concat_ws(" ", "court", "year"), F.lit(")."))
    written = F.concat(F.coalesce(F.concat("case_name", F.lit(", ")), F.lit("See ")), cite, paren)
    return rows.withColumns({"doc_id": F.expr(f"cast(o_orderkey div {PER_BRIEF} as string)"), "matched_text": cite, "cite_key": cite_key("volume", "reporter", "page"), "written": written})


def briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, title, text): a sentence per cited order."""
    rows = brief_citations(spark, sf_dir).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "written"))).alias("_all"))
    text = F.array_join(F.transform("_all", lambda x: x["written"]), " ")
    return rows.select("doc_id", F.concat(F.lit("Brief "), F.col("doc_id")).alias("title"), text.alias("text"))


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


#: The same rows as order_cases and brief_citations in SQL.
CASES_SQL = f"""
  oc AS (
    SELECT o_orderkey,
      concat(upper(left(translate((o_orderkey + 1000000)::VARCHAR, '0123456789', 'abcdefghij'), 1)), substr(translate((o_orderkey + 1000000)::VARCHAR, '0123456789', 'abcdefghij'), 2), ' v. ',
             upper(left(translate((o_custkey + 1000000)::VARCHAR, '0123456789', 'abcdefghij'), 1)), substr(translate((o_custkey + 1000000)::VARCHAR, '0123456789', 'abcdefghij'), 2)) AS case_name,
      concat(upper(left(translate((o_orderkey + 1000000)::VARCHAR, '0123456789', 'klmnopqrst'), 1)), substr(translate((o_orderkey + 1000000)::VARCHAR, '0123456789', 'klmnopqrst'), 2), ' v. ',
             upper(left(translate((o_custkey + 1000000)::VARCHAR, '0123456789', 'klmnopqrst'), 1)), substr(translate((o_custkey + 1000000)::VARCHAR, '0123456789', 'klmnopqrst'), 2)) AS other_name,
      (o_orderkey % 900 + 1)::VARCHAR AS volume,
      {_sql_list(REPORTERS)}[(left(o_orderpriority, 1)::INT % 5 + 1)::INT] AS reporter,
      (o_orderkey // 900 + 1)::VARCHAR AS page,
      {_sql_list(w for w, _ in COURTS)}[(c_nationkey % 8 + 1)::INT] AS court,
      {_sql_list(i for _, i in COURTS)}[(c_nationkey % 8 + 1)::INT] AS court_id,
      {_sql_list(w for w, _ in COURTS)}[((c_nationkey + 1) % 8 + 1)::INT] AS other_court,
      {_sql_list(i for _, i in COURTS)}[((c_nationkey + 1) % 8 + 1)::INT] AS other_court_id,
      strftime(o_orderdate, '%Y-%m-%d') AS date_filed
    FROM orders JOIN customer ON o_custkey = c_custkey),
  bc AS (
    SELECT o.o_orderkey, o.o_orderkey % 8 AS way, (o.o_orderkey // {PER_BRIEF})::VARCHAR AS doc_id,
      CASE WHEN o.o_orderkey % 8 = 4 THEN p.volume WHEN o.o_orderkey % 8 IN (2, 5, 7) THEN (o.o_orderkey % 50 + 901)::VARCHAR ELSE o.volume END AS volume,
      CASE WHEN o.o_orderkey % 8 = 4 THEN p.reporter ELSE o.reporter END AS reporter,
      CASE WHEN o.o_orderkey % 8 = 4 THEN p.page ELSE o.page END AS page,
      CASE WHEN o.o_orderkey % 8 IN (2, 3) THEN o.other_name WHEN o.o_orderkey % 8 <> 6 THEN o.case_name END AS case_name,
      CASE WHEN o.o_orderkey % 8 = 5 THEN o.other_court WHEN o.o_orderkey % 8 NOT IN (6, 7) THEN o.court END AS court,
      CASE WHEN o.o_orderkey % 8 = 5 THEN o.other_court_id WHEN o.o_orderkey % 8 NOT IN (6, 7) THEN o.court_id END AS court_id,
      left(o.date_filed, 4) AS year, p.o_orderkey AS partner
    FROM oc o LEFT JOIN oc p ON o.o_orderkey = p.o_orderkey + {PARTNER}
    WHERE o.o_orderkey % 8 <> 4 OR p.o_orderkey IS NOT NULL)"""
KEY_SQL = "replace(replace(replace(lower(concat({0}volume, {0}reporter, {0}page)), ' ', ''), '.', ''), ',', '')"
