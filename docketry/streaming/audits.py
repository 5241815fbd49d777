"""Audits of documents as they arrive, and counters over a stream of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docketry.functions.text import request_key
from docketry.operators.corpus import Corpus, corpus_of
from docketry.plans.audit import audit
from docketry.sources.shared import scratch


def audit_stream(documents: DataFrame, cases: DataFrame | Corpus, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Audit each batch of a stream of (doc_id, text) against ``cases``, or a kept corpus; findings and reports go under ``path``, by batch.

    A batch that is run again replaces its own output, so no document is counted
    twice. The index of a table of cases is made once, before the first batch; what
    a batch stages is deleted at its end.
    """
    corpus = cases if isinstance(cases, Corpus) else corpus_of(cases)

    def run(batch: DataFrame, number: int) -> None:
        with scratch():
            found = audit(batch, corpus)
            for name, df in (("findings", found.findings), ("reports", found.reports)):
                df.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    query = documents.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if available_now else query).start()


def read_arrivals(spark: SparkSession, path: str, schema: str = "doc_id string, text string", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def first_requests(requests: DataFrame, at: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """A stream of (method, url, body, at) without repeats of a request within ``delay``."""
    return requests.withWatermark(at, delay).withColumn("key", request_key("method", "url", "body")).dropDuplicatesWithinWatermark(["key"])


def request_counts(requests: DataFrame, at: str = "ts", width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Requests of a stream by window and kind of outcome; late ones within ``delay`` still count."""
    return requests.withWatermark(at, delay).groupBy(F.window(at, width).alias("window"), "outcome").agg(F.count("*").alias("requests"))


def progress_status(fraction: Column) -> Column:
    """What a job is doing at a fraction of its way."""
    return F.when(fraction >= 1.0, "done").when(fraction > 0.7, "checking").otherwise("verifying")
