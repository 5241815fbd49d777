"""Stores by key: merges, lookups of one bucket, reports and replies."""

from pyspark.sql import functions as F

from docketry.functions.text import request_key
from docketry.sources.files import cache_replies, merge_replies
from docketry.sources.shared import scratch, shared_dir, stage
from docketry.sources.store import BUCKET, merge, of_key, stored


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_merge_replaces_a_row_and_no_other(spark, tmp_path):
    path = str(tmp_path / "s")
    merge(spark.createDataFrame([(f"d{k}", k) for k in range(40)] + [(None, 1)], "id string, x int"), path, "id", buckets=8)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "s").rglob("*.parquet")}
    merge(spark.createDataFrame([("d3", -3), ("new", 7)], "id string, x int"), path, "id")
    assert rows_of(stored(spark, path).select("id", "x")) == rows_of(spark.createDataFrame([(f"d{k}", k) for k in range(40) if k != 3] + [("d3", -3), ("new", 7)], "id string, x int"))
    kept = [f for f, t in before.items() if f.exists() and f.stat().st_mtime_ns == t]
    assert len(kept) >= len(before) - 2  # two buckets at most were written
    assert stored(spark, path).select(BUCKET).distinct().count() <= 8


def test_lookup_reads_one_bucket(spark, tmp_path):
    path = str(tmp_path / "s")
    merge(spark.range(100).select(F.col("id").cast("string").alias("key"), F.col("id").alias("x")), path, "key", buckets=16)
    found = of_key(stored(spark, path), "key", "17")
    assert rows_of(found) == [("17", 17)]
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scan
    files = found.select(F.input_file_name().alias("f")).distinct().collect()
    read = spark.read.parquet(path).where(F.col(BUCKET) == F.pmod(F.xxhash64(F.lit("17")), F.col("of")))
    assert len(files) == 1 and read.rdd.getNumPartitions() == 1


def test_newest_reply_stays_in_any_order(spark, tmp_path):
    kind = "key string, status int, body string, created_at double"
    first = spark.createDataFrame([("a", 200, "1", 10.0), ("b", 200, "2", 10.0), ("a", 200, "0", 5.0)], kind)
    second = spark.createDataFrame([("a", 200, "3", 8.0), ("b", 500, "4", 11.0), ("c", 200, "x{", 1.0)], kind)
    for order in ((first, second), (second, first), (first, second, second, first)):
        path = str(tmp_path / str(len(list(tmp_path.iterdir()))))
        for batch in order:
            merge_replies(batch, path, buckets=4)
        assert rows_of(stored(spark, path).select("key", "status", "body")) == [("a", 200, "1"), ("b", 500, "4"), ("c", 200, "x{")]


def test_replies_too_old_or_unreadable_are_missing(spark):
    asked = spark.createDataFrame([("GET", u, "") for u in ("/new", "/old", "/bad", "/none")], "method string, url string, body string")
    replies = spark.createDataFrame([("/new", "1", 95.0), ("/old", "1", 50.0), ("/bad", "{", 99.0)], "url string, body string, created_at double")
    known = replies.select(request_key(F.lit("GET"), "url", F.lit("")).alias("key"), F.lit(200).alias("status"), "body", "created_at")
    hits, misses = cache_replies(asked, known, max_age=10.0, now=100.0)
    assert [r.url for r in hits.collect()] == ["/new"] and sorted(r.url for r in misses.collect()) == ["/bad", "/none", "/old"]
    assert sorted(r.url for r in cache_replies(asked, known)[0].collect()) == ["/new", "/old"]


def test_scratch_leaves_kept_tables_only(spark):
    from pathlib import Path

    there = lambda df: Path(df._staged_at).exists()
    with scratch() as outer:
        a = stage(spark.range(3), "a")
        with scratch() as keep:
            b, c = stage(spark.range(3), "b"), keep(stage(spark.range(4), "c"))
        assert (there(a), there(b), there(c)) == (True, False, True) and c.count() == 4
        d = outer(stage(spark.range(2), "d"))
    assert (there(a), there(c), there(d)) == (False, False, True) and shared_dir(spark)
