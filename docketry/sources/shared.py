"""Tables that a plan writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a local master gets a temporary folder, and a cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="docketry-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_open = threading.local()


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """``with scratch() as keep``: tables staged inside are deleted at its end, but for those given to ``keep``.

    So what is returned from inside has to read kept tables alone. A kept table
    belongs to the scratch around this one, if there is one.
    """
    own: dict[str, DataFrame] = {}
    kept: dict[str, DataFrame] = {}
    around = getattr(_open, "tables", None)

    def keep(df: DataFrame) -> DataFrame:
        kept[df._staged_at] = own.pop(df._staged_at, df)
        return df

    _open.tables = own
    try:
        yield keep
    finally:
        _open.tables = around
        if around is not None:
            around.update(kept)
        discard(*own.values())


def stage(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """``df`` written as Parquet and read again: computed once for all that follows, and safe from the loss of executors.

    ``narrow``: rows of a few numbers, which are written as four files a core at most.
    """
    path = f"{shared_dir(df.sparkSession)}/docketry/{name}-{uuid.uuid4().hex}"
    (df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism) if narrow else df).write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    if getattr(_open, "tables", None) is not None:
        _open.tables[path] = out
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stage`` returned, once nothing that is still to be computed reads them."""
    for df in tables:
        if getattr(_open, "tables", None) is not None:
            _open.tables.pop(df._staged_at, None)
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
