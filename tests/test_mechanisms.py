"""Queries over derived corpora against their SQL, on the smallest tables; and what they stand on."""

import duckdb
import pytest
from pyspark.sql import functions as F

from docketry.plans import corpora

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["common_name_evidence", "name_readings", "verdict_rollup", "client_counters", "streamed_job_states", "citations_by_sql", "phrase_quote_checks", "reply_store"])
def test_query_against_sql(spark, name):
    db = duckdb.connect()
    for t in ("orders", "customer", "events", "documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = corpora.QUERIES[name](spark, SF)
    expected = db.execute(f"SELECT {', '.join(got.columns)} FROM ({corpora.ORACLES[name]})").fetchall()
    rows = list(map(tuple, got.collect()))
    assert sorted(map(repr, rows)) == sorted(map(repr, expected)) and rows


def test_jobs_over_several_batches_and_expiry(spark, tmp_path):
    from docketry.sources.store import stored
    from docketry.streaming.jobs import job_states

    kind = "doc_id string, at timestamp, kind string, fraction double"
    day = lambda d: f"2024-01-{d:02d} 00:00:00"
    batches = [
        [("a", day(1), "start", None), ("b", day(1), "progress", 0.9), ("c", day(1), "start", 0.1)],
        [("a", day(2), "progress", 0.8), ("a", day(2), "progress", 0.3), ("b", day(2), "start", 0.2)],
        [("d", day(20), "start", 2.0), ("c", day(20), "fail", None)],
        [("a", day(21), "progress", 1.0), ("d", day(21), "progress", None)],
    ]
    source = str(tmp_path / "in")
    for k, rows in enumerate(batches):
        parsed = spark.createDataFrame(rows, "doc_id string, at string, kind string, fraction double").withColumn("at", F.to_timestamp("at"))
        parsed.select("doc_id", "at", "kind", "fraction").coalesce(1).write.mode("append").parquet(source)
        reports = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source)
        job_states(reports, str(tmp_path / "jobs"), str(tmp_path / "ck"), expiry="7 days").awaitTermination(120)
    got = {r.doc_id: (r.fraction, r.status) for r in stored(spark, str(tmp_path / "jobs")).collect()}
    # a was heard of on the 2nd last, and had expired by the 21st; b's first report came before its start; d's fraction is cut at 1.
    assert got["a"] == (0.8, "checking") and got["b"] == (0.2, "verifying") and got["d"] == (1.0, "done") and got["c"][0] == 0.1


def test_table_functions(spark):
    from docketry.functions.tables import register

    register(spark)
    rows = spark.sql("SELECT c.* FROM VALUES ('See  A v. B, 5 F.3d 7. Id. at 8.'), (NULL), ('') t(x), LATERAL extract_citations(x) c").collect()
    assert [(r.pos, r.s, r.form, r.matched_text) for r in rows] == [(0, 12, "full", "5 F.3d 7"), (1, 22, "id", "Id. at 8")]
    said = spark.sql("SELECT s.sentence FROM VALUES ('One. Two!  Three'), ('') t(x), LATERAL split_sentences(x) s").collect()
    assert [r.sentence for r in said] == ["One.", "Two!", "Three"]
