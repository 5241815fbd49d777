"""Where each job of a stream of progress reports stands."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from docketry.sources.store import merge
from docketry.streaming.audits import progress_status

#: A job's state: how far it is, whether it has failed, and when it was last heard of.
STATE = "fraction double, failed boolean, at timestamp"


class Jobs(StatefulProcessor):
    """Keeps the furthest fraction of each job that has been started. Reports of jobs that were not, or that have expired, are ignored."""

    def __init__(self, expiry_ms: int):
        self.expiry_ms = expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.state.get() if self.state.exists() else None
        for r in pd.concat(rows).sort_values(["at", "kind", "fraction"]).itertuples():
            if held is None and r.kind != "start":
                continue
            fraction, failed, _ = held or (0.0, False, None)
            held = (max(fraction, min(1.0, 0.0 if pd.isna(r.fraction) else r.fraction)), failed or r.kind == "fail", r.at)
        if held is None:
            return
        self.state.update(held)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(pd.Timestamp(held[2]).timestamp() * 1000) + self.expiry_ms)
        yield pd.DataFrame({"doc_id": [key[0]], "fraction": [held[0]], "failed": [held[1]], "at": [held[2]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def job_states(reports: DataFrame, path: str, checkpoint: str, delay: str = "1 hour", expiry: str = "7 days", available_now: bool = True) -> StreamingQuery:
    """Follow a stream of (doc_id, at, kind, fraction) and keep the newest state of each job in the store at ``path``: (doc_id, fraction, failed, at, status).

    ``kind`` is start, progress or fail. A job is known from its start on; what
    comes for others is ignored. A fraction never falls. The state of a job that is
    not heard of for ``expiry`` is dropped, its row in the store stays. A batch that
    is run again leaves the same rows.
    """
    reports.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    known = reports.where("doc_id is not null and at is not null").select("doc_id", "at", "kind", "fraction").withWatermark("at", delay)
    jobs = Jobs(int(pd.Timedelta(expiry).total_seconds() * 1000))
    states = known.groupBy("doc_id").transformWithStateInPandas(jobs, f"doc_id string, {STATE}", "Update", "EventTime")
    status = F.when(F.col("failed"), "failed").otherwise(progress_status(F.col("fraction")))

    def run(batch: DataFrame, number: int) -> None:
        merge(batch.withColumn("status", status), path, "doc_id", at="at")

    query = states.writeStream.foreachBatch(run).outputMode("update").option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if available_now else query).start()
