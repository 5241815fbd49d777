"""Line deduplication with DataFrame functions only: lines whose key many documents share go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import BROADCAST_ROWS, discard, fresh, materialize

SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """A line without white space at its ends, ASCII letters lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def key_hash(key: Column) -> Column:
    """128 bits of a key as two differently seeded 64-bit hashes."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(7), key).alias("b"))


def hits_of(keys: DataFrame, common: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``keys`` that are common. Beyond ``limit`` common keys, those found most often are still broadcast: at most ``limit`` keys can have one of ``limit`` parts of all rows."""
    key = ["_a", "_b"]
    held = lambda some: keys.join(some, key, "left_semi").select(keys.columns)
    if common.count() <= limit:
        return held(F.broadcast(common.select(key)))
    often = F.col("_docs") * limit > keys.count()
    return held(F.broadcast(common.where(often).select(key))).union(held(common.where(~often).select(key)))


def line_keys(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(_id, _text, _row, _at, _a, _b): each line with a key, at its place from 0.

    ``_text`` is a hash of the whole text, so that rows of one id are told apart;
    ``_row`` counts as part of the id where that is null.
    """
    rows = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_text"), F.when(F.col(doc_id).isNull(), F.monotonically_increasing_id()).otherwise(0).alias("_row"), F.col(text).alias("_whole"))
    lines = rows.select("_id", "_text", "_row", F.posexplode(F.split("_whole", "\n", -1)).alias("_at", "_line"))
    keyed = lines.select("_id", "_text", "_row", "_at", line_key(F.col("_line")).alias("_key")).where("_key <> ''")
    return keyed.select("_id", "_text", "_row", "_at", F.xxhash64("_key").alias("_a"), F.xxhash64(F.lit(7), "_key").alias("_b"))


def common_lines(keys: DataFrame, min_docs: int) -> DataFrame:
    """The rows of ``keys`` (staged) whose key ``min_docs`` distinct documents have.

    Most keys are found in fewer rows than that and go at once. Rows of the others
    are made distinct by document, so a line in every document is spread by
    document, and summed before they meet by key.
    """
    often = materialize(keys.groupBy("_a", "_b").agg(F.count("*").alias("_docs")).where(F.col("_docs") >= min_docs), "often-found")
    some = materialize(hits_of(keys, often), "often-found-lines")
    common = some.groupBy("_a", "_b", "_id", "_row").agg(F.lit(1).alias("_one")).groupBy("_a", "_b").agg(F.count("*").alias("_docs"))
    common = materialize(common.where(F.col("_docs") >= min_docs), "common-lines")
    discard(often)
    return hits_of(some, common)


def drop_common_lines(docs: DataFrame, min_docs: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the lines found in ``min_docs`` distinct documents or more, plus ``n_lines`` and ``n_dropped``.

    Rows of one id are one document; each row without an id is a document of its
    own. A null or empty text is one empty line and comes back as an empty text.
    Empty keys are never dropped. Lines keep their order and their own form. An
    input column named ``n_lines`` or ``n_dropped`` is replaced. An empty table
    stays empty.

    Each line is hashed once, and the hashes are kept with the line's place. The
    places of common lines come back to their document, which is put together from
    its other places in order: time and memory grow with a document's lines. The
    texts themselves move once, in that last join, whatever the size: the places
    grow with the documents, so a broadcast of them would end at some size.
    """
    keys = materialize(line_keys(docs, doc_id, text), "line-keys")
    own = docs.drop("n_lines", "n_dropped")
    key, text_hash, drop, all_, left = fresh(docs, "_id", "_text", "_drop", "_lines", "_kept")
    places = F.collect_set("_at").alias(drop)
    hits = materialize(common_lines(keys, min_docs).groupBy(F.col("_id").alias(key), F.col("_text").alias(text_hash)).agg(places), "places")
    discard(keys)
    joined = own.join(hits.hint("shuffle_hash"), own[doc_id].eqNullSafe(hits[key]) & (F.xxhash64(own[text]) == hits[text_hash]), "left").withColumn(all_, F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1))
    # Sets of numbers are hashed, so this takes a step a line; a search in an array would take a step a line and common line.
    stay = F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col(drop))
    out = joined.withColumn(left, F.when(F.col(drop).isNotNull(), stay))
    whole = F.when(F.col(left).isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(F.transform(left, lambda at: F.get(F.col(all_), at)), "\n"))
    columns = [whole.alias(c) if c == text else F.col(c) for c in own.columns]
    return out.select(*columns, F.size(all_).cast("long").alias("n_lines"), F.when(F.col(drop).isNull(), 0).otherwise(F.size(all_) - F.size(left)).cast("long").alias("n_dropped"))
