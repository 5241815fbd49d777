"""Tables of rows by key, kept as Parquet in buckets by a hash of the key: merged into, and looked up, a bucket at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators.benchmark import latest
from docketry.sources.shared import discard, stage

#: Buckets of a new store; so many that one holds some hundred megabytes at most.
BUCKETS = 64
#: Partition columns: how many buckets there are, and which one it is.
OF, BUCKET = "of", "bucket"


def bucket_of(key: Column, buckets: Column | int) -> Column:
    """The bucket of a key. A null key has one, too."""
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets) if isinstance(buckets, int) else buckets).cast("int")


def exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(there)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All rows, with their bucket."""
    return spark.read.parquet(path)


def of_key(rows: DataFrame, key: str, value) -> DataFrame:
    """The rows of one key: a filter on its bucket, so that no other is read."""
    return rows.where((F.col(BUCKET) == bucket_of(F.lit(value), F.col(OF))) & (F.col(key) == F.lit(value))).drop(OF, BUCKET)


def merge(rows: DataFrame, path: str, key: str, at: str | None = None, buckets: int = BUCKETS) -> None:
    """Put ``rows`` into the store at ``path``, one row a key: what is merged last replaces what was there.

    With ``at``, the row of the greatest ``at`` stays instead, whichever came
    first, and of equal ones that of the greatest other columns; so batches may come
    in any order, and again. Within ``rows`` several rows of a key go by that rule,
    too. Rows without a key are left out. Only buckets that rows fall into are read
    and written, each by one task; readers of others are not disturbed. A store has
    one writer at a time and keeps the number of buckets that it began with.
    """
    spark = rows.sparkSession
    old = stored(spark, path) if exists(spark, path) else None
    many = buckets if old is None else old.select(OF).first()[0]
    known = rows.where(F.col(key).isNotNull())
    order = at or "_none"
    one = lambda df: latest(df.withColumn("_none", F.lit(0)), key, order).drop("_none")
    new = stage(one(known).withColumns({OF: F.lit(many), BUCKET: bucket_of(F.col(key), many)}), "arrived")
    touched = [r[0] for r in new.select(BUCKET).distinct().collect()]
    both = new
    if old is not None:
        here = old.where(F.col(BUCKET).isin(touched))
        both = here.unionByName(new, allowMissingColumns=True) if at else here.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)
        both = one(both) if at else both
    # Written apart first: what is read must not be what is overwritten.
    ready = stage(both.repartition(BUCKET), "merged")
    ready.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(OF, BUCKET).parquet(path)
    discard(new, ready)
