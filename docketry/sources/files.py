"""Readers and writers of documents, fixtures, replies and reports."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import fixed
from docketry.functions.schemas import FIXTURE
from docketry.functions.text import request_key
from docketry.sources.store import BUCKETS, merge, of_key, stored

_TRIM = f"^{fixed.SPACE}+|{fixed.SPACE}+$"


def admitted(documents: DataFrame, text: str = "text", longest: int = fixed.LONGEST_DOCUMENT) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) documents; the rejected have ``reason``: empty or too long, by the length without white space at the ends."""
    size = F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), _TRIM, ""))
    reason = F.when(size == 0, "empty").when(size > longest, "too long")
    judged = documents.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def title_of(path: Column) -> Column:
    """A file's name without folder and ending, with spaces for _ and -."""
    name = F.regexp_extract(F.regexp_replace(path, "^.*/", ""), r"^(.*?)(?:\.[^.]*)?$", 1)
    return F.translate(name, "_-", "  ")


def decoded(content: Column) -> Column:
    """Bytes as UTF-8, or as Latin-1 where they are not."""
    return F.when(F.is_valid_utf8(F.decode(content, "ISO-8859-1")) & F.try_validate_utf8(content.cast("string")).isNotNull(), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def read_texts(spark: SparkSession, path: str, glob: str = "*.txt", strict: bool = False) -> DataFrame:
    """(id, title, text) of text files. ``strict``: a file that is no UTF-8 ends the job, instead of being read as Latin-1."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    text = F.validate_utf8(F.col("content").cast("string")) if strict else decoded(F.col("content"))
    return files.select(F.regexp_extract(F.regexp_replace("path", "^.*/", ""), r"^(.*?)(?:\.[^.]*)?$", 1).alias("id"), title_of(F.col("path")).alias("title"), text.alias("text"))


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, text) of the text files of a folder, in order of their names."""
    return read_texts(spark, path).orderBy("id")


def docx_text(content: bytes, tables: bool) -> str | None:
    """Paragraphs outside tables, and then, if asked for, table rows as cells parted by tabs. None for what is no such file."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    try:
        body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{w}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None

    def said(node) -> str:
        return "".join(x.text or "" if x.tag == f"{w}t" else "\t" if x.tag == f"{w}tab" else "\n" for x in node.iter() if x.tag in (f"{w}t", f"{w}tab", f"{w}br"))

    lines = [said(p) for p in body.findall(f"{w}p")]
    if tables:
        for row in (r for t in body.findall(f"{w}tbl") for r in t.iter(f"{w}tr")):
            lines.append("\t".join("\n".join(said(p) for p in cell.findall(f"{w}p")) for cell in row.findall(f"{w}tc")))
    return "\n".join(lines)


def read_docx(spark: SparkSession, path: str, tables: bool = True) -> DataFrame:
    """(path, title, text) of .docx files; text is null for broken ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "text": [docx_text(x, tables) for x in batch["content"]]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, text string").select("path", title_of(F.col("path")).alias("title"), "text")


def read_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark fixtures: one JSON file each. results.json and files without text or expected citations are left out; an id may come from the file's name."""
    files = spark.read.schema(FIXTURE).option("multiLine", True).option("pathGlobFilter", "*.json").json(path).withColumn("_file", F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", ""))
    files = files.where("_file <> 'results' and text is not null and expected is not null")
    return files.withColumn("id", F.coalesce("id", "_file")).drop("_file")


def write_json_reports(reports: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Reports (doc_id, json) into the store at ``path``; a later one of a document replaces its own and no other's."""
    merge(reports.select("doc_id", "json"), path, "doc_id", buckets=buckets)


def read_json_reports(spark: SparkSession, path: str, schema: str, doc_id: str | None = None) -> DataFrame:
    """Stored reports; of one document from its bucket alone."""
    rows = stored(spark, path)
    rows = rows if doc_id is None else of_key(rows, "doc_id", doc_id)
    return rows.select(F.from_json("json", schema).alias("_r"), "doc_id").select("_r.*", "doc_id")


def write_markdown(markdown: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Reports (doc_id, markdown) into the store at ``path``; other documents' stay."""
    merge(markdown.select("doc_id", "markdown"), path, "doc_id", buckets=buckets)


def read_markdown(spark: SparkSession, path: str, doc_id: str | None = None) -> DataFrame:
    rows = stored(spark, path)
    return (rows if doc_id is None else of_key(rows, "doc_id", doc_id)).select("doc_id", "markdown")


def sync_examples(fixtures: DataFrame, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(name, text) of example files made from fixtures, with a head of three lines; and names of ``existing`` that no fixture makes."""
    made = fixtures.select(F.col("id").alias("name"), F.concat_ws("\n", F.coalesce("title", F.lit("")), F.concat(F.lit("Source: "), F.coalesce("source_url", F.lit(""))), F.lit(""), "text").alias("text"))
    return made, None if existing is None else existing.select("name").join(made, "name", "left_anti")


def cache_replies(requests: DataFrame, stored: DataFrame, max_age: float | None = None, now: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of (method, url, body) requests in a table of replies (key, status, body, created_at).

    Replies that are no JSON count as missing, and with ``max_age`` those older
    than so many seconds at ``now``.
    """
    asked = requests.withColumn("key", request_key("method", "url", "body"))
    known = stored.where(F.try_parse_json("body").isNotNull())
    if max_age is not None:
        known = known.where(F.lit(now) - F.col("created_at") <= max_age)
    known = known.select("key", "status", F.col("body").alias("reply"), "created_at")
    return asked.join(known, "key"), asked.join(known, "key", "left_anti")


def merge_replies(replies: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Replies (key, status, body, created_at) into the cache at ``path``: the newest of a key stays."""
    merge(replies.select("key", "status", "body", "created_at"), path, "key", at="created_at", buckets=buckets)
