"""Counters of a search client, gathered while its requests pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from docketry.functions.text import retry_after

# The status that asks a client to wait, and the counters.
TOO_MANY = 429
COUNTERS = ["requests", "cache_hits", "throttle_waits", "throttle_seconds", "retries", "errors"]


def observed(attempts: DataFrame, name: str = "client") -> tuple[DataFrame, Observation]:
    """(attempts, counters): what passes is counted by the job that reads it, without a pass of its own.

    ``attempts``: (cached, status, attempt, header), a row per request and try; a
    cached one is no request. A wait is a status of 429, as long as its header says;
    a retry is any try after the first; an error any other status from 400 on.
    ``counters.get`` waits for that job and has COUNTERS.
    """
    sent = ~F.coalesce(F.col("cached"), F.lit(False))
    waits = sent & (F.col("status") == TOO_MANY)
    seen = Observation(name)
    counts = [
        F.count_if(sent).alias("requests"), F.count_if(~sent).alias("cache_hits"), F.count_if(waits).alias("throttle_waits"), F.coalesce(F.bround(F.sum(F.when(waits, retry_after("header"))), 2), F.lit(0.0)).alias("throttle_seconds"),
        F.count_if(sent & (F.col("attempt") > 1)).alias("retries"), F.count_if(sent & (F.col("status") >= 400) & (F.col("status") != TOO_MANY)).alias("errors"),
    ]
    return attempts.observe(seen, *counts), seen
