"""A corpus of cases as tables by the keys that searches use: made for one search, or kept as bucketed tables that grow."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.names import name_parts
from docketry.functions.text import court_token, reporter_key
from docketry.sources.shared import stage

#: Buckets of a kept corpus; a search reads a table of it with so many tasks.
BUCKETS = 64


class Corpus(NamedTuple):
    names: DataFrame | None  # (found_name, parts): each distinct name of a case, taken apart once; None where pairs of names are taken apart as they are compared
    tokens: DataFrame  # (token, found_name)
    vocabulary: DataFrame  # (token, n): how many names hold a token, in parts that add up
    records: DataFrame  # (found_name, rec, of_court)
    slots: DataFrame  # (cite_key, rec, of_court): each case under every citation that it lists


#: The column by which each table is bucketed.
KEYS = {"names": "found_name", "tokens": "token", "vocabulary": "token", "records": "found_name", "slots": "cite_key"}


def case_names(cases: DataFrame) -> DataFrame:
    """(found_name, parts) of cases. Cases without an id give none."""
    names = cases.where("cluster_id is not null").groupBy(F.coalesce("case_name", F.lit("")).alias("found_name")).agg(F.lit(1).alias("_n")).select("found_name")
    return names.withColumn("parts", name_parts(F.col("found_name")))


def name_tokens(names: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    every = F.array_distinct(F.concat("parts.all", F.coalesce("parts.left", none), F.coalesce("parts.right", none)))
    return names.select(F.explode(every).alias("token"), "found_name")


def token_counts(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("token").agg(F.count("*").alias("n"))


def case_records(cases: DataFrame) -> DataFrame:
    """(cluster_id, found_name, rec, of_court)."""
    record = F.struct("cluster_id", "case_name", "citations", "court", "date_filed", "absolute_url", "snippet")
    known = cases.where("cluster_id is not null")
    return known.select("cluster_id", F.coalesce("case_name", F.lit("")).alias("found_name"), record.alias("rec"), F.coalesce("court_id", court_token("court")).alias("of_court"))


def case_slots(records: DataFrame) -> DataFrame:
    """(cite_key, rec, of_court): each record under each key that its citations have."""
    keys = F.array_distinct(F.transform("rec.citations", reporter_key))
    return records.select(F.explode(keys).alias("cite_key"), "rec", "of_court").where("cite_key <> ''")


def corpus_of(cases: DataFrame, names_only: bool = False) -> Corpus:
    """The tables of ``cases``, for the searches of one audit: tokens are staged, records are read from the cases themselves.

    Names in parts are many times the names: they are neither written nor exchanged.
    """
    tokens = stage(name_tokens(case_names(cases)), "name-tokens")
    vocabulary = stage(token_counts(tokens), "vocabulary")
    records = None if names_only else case_records(cases)
    return Corpus(None, tokens, vocabulary, None if records is None else records.drop("cluster_id"), None if records is None else case_slots(records))


def _table(name: str, part: str) -> str:
    return f"{name}_{part}"


def keep_corpus(cases: DataFrame, name: str, path: str | None = None, buckets: int = BUCKETS) -> Corpus:
    """Add ``cases``, of ids that are not in it yet, to the corpus ``name``, which is made if need be. Repeated names are kept once.

    Its tables are bucketed by the key that searches use, so a search exchanges what
    it asks and never the corpus. They lie in the warehouse or under ``path``. An
    addition reads the names that are there, and appends to every table.
    """
    spark = cases.sparkSession
    grows = spark.catalog.tableExists(_table(name, "names"))
    names = case_names(cases)
    if grows:
        names = names.join(spark.table(_table(name, "names")).select("found_name"), "found_name", "left_anti")
    names = stage(names, "new-names")
    tokens = stage(name_tokens(names), "new-tokens")
    records = stage(case_records(cases), "new-records")
    new = Corpus(names, tokens, token_counts(tokens), records.drop("cluster_id"), case_slots(records))
    for part, df in new._asdict().items():
        # Dealt by the bucket's key, a bucket is one file of an addition.
        writer = df.repartition(buckets, KEYS[part]).write.format("parquet").mode("append").bucketBy(buckets, KEYS[part]).sortBy(KEYS[part])
        (writer.option("path", f"{path}/{part}") if path and not grows else writer).saveAsTable(_table(name, part))
    return open_corpus(spark, name)


def open_corpus(spark: SparkSession, name: str, path: str | None = None, buckets: int = BUCKETS) -> Corpus:
    """The kept corpus ``name``. With ``path``, a catalogue that does not know its tables is told of those that lie there."""
    for part, key in KEYS.items() if path and not spark.catalog.tableExists(_table(name, "names")) else ():
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/{part}").schema.fields)
        spark.sql(f"CREATE TABLE `{_table(name, part)}` ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}/{part}'")
    return Corpus(*(spark.table(_table(name, part)) for part in KEYS))


def drop_corpus(spark: SparkSession, name: str) -> None:
    for part in KEYS:
        spark.sql(f"DROP TABLE IF EXISTS `{_table(name, part)}`")
