"""Search for phrases: an index of words with their places, and its intersection from a phrase's rarest word on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.functions.text import comparable_quote, is_distinctive
from docketry.operators.quotes import KEY, quote_phrase
from docketry.sources.shared import discard, stage

PLACE = ["token", "source_id", "at"]
#: Folders of an index, by a hash of the word; a search reads those of its words.
SHARDS = 64
#: Parts of a folder, by a hash of the text, so that a word of every text is spread over as many tasks.
SLICES = 16
#: Most distinct words of a search, or places that it asks for, that are broadcast; beyond it, the same join shuffles.
MOST_WORDS = 200_000


def _shard(token: str = "token", shards: int = SHARDS):
    return F.pmod(F.xxhash64(token), F.lit(shards)).cast("int")


def word_places(texts: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(shard, token, source_id, at): each word of ``texts`` (id, text) in comparable form, at its place from 0."""
    words = texts.where("text is not null").select(F.col("id").alias("source_id"), F.posexplode(F.split(comparable_quote("text"), " ")).alias("at", "token"))
    return words.where("token <> ''").select(_shard(shards=shards).alias("shard"), "token", "source_id", "at")


def add_to_index(texts: DataFrame, path: str) -> None:
    """Add ``texts`` (id, text), of ids that are not in it yet, to the index at ``path``; what is there is neither read nor written.

    Rows are dealt by folder and a hash of the text, so that a word of every text is
    spread over ``SLICES`` tasks, and lie in order, so that a word's rows are read
    without the others of its folder. Ranges of words would have to be sampled: all
    texts would be read and taken apart twice.
    """
    part = F.pmod(F.xxhash64("source_id"), F.lit(SLICES))
    rows = word_places(texts).repartition(F.col("shard"), part).sortWithinPartitions("shard", "token", "source_id", "at")
    rows.write.mode("append").partitionBy("shard").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def places_due(places: DataFrame, due: DataFrame) -> DataFrame:
    """Those of ``places`` that ``due`` (staged) asks for: frequent words have most of all places, and are exchanged only if more than ``MOST_WORDS`` places are asked for."""
    asked = due.select(*PLACE).distinct()
    return places.join(F.broadcast(asked), PLACE, "left_semi") if due.count() <= MOST_WORDS else places


def phrase_matches(phrases: DataFrame, index: DataFrame) -> DataFrame:
    """(phrase_id, source_id) of the texts that hold a phrase: its words in order, side by side. ``phrases``: (id, text).

    A phrase looks up its rarest word; where that stands tells where the phrase
    would begin. The second rarest word is asked for at its place there, then all
    others. So a frequent word is met only where rarer ones have been found. Phrases
    without a word are in nothing.
    """
    words = phrases.select(F.col("id").alias("phrase_id"), F.posexplode(F.split(comparable_quote("text"), " ")).alias("offset", "token")).where("token <> ''")
    words = stage(words, "phrase-words")
    wanted = stage(words.select("token").distinct().withColumn("shard", _shard()), "wanted")
    shards = [r.shard for r in wanted.select("shard").distinct().collect()]
    asked = F.broadcast(wanted.select("token")) if wanted.count() <= MOST_WORDS else wanted.select("token")
    places = stage(index.where(F.col("shard").isin(shards)).select("token", "source_id", "at").join(asked, "token", "left_semi"), "places")
    counts = places.groupBy("token").agg(F.count("*").alias("_n"))
    order = Window.partitionBy("phrase_id").orderBy("_n", "token", "offset")
    ranked = words.join(counts, "token", "left").withColumn("_n", F.coalesce("_n", F.lit(0))).withColumn("_at", F.row_number().over(order))
    # A word that no text has leaves its phrase without a match.
    missing = ranked.where("_n = 0").select("phrase_id").distinct()
    ranked = stage(ranked.join(missing, "phrase_id", "left_anti").drop("_n"), "ranked-words")
    starts = ranked.where("_at = 1").join(places, "token").select("phrase_id", "source_id", (F.col("at") - F.col("offset")).alias("begin")).where("begin >= 0")
    for more in (F.col("_at") == 2, F.col("_at") > 2):
        # At each beginning, all words of this step have to stand where they belong.
        step = ranked.where(more)
        needed = step.groupBy("phrase_id").agg(F.count("*").alias("_words"))
        due = stage(starts.join(step, "phrase_id").select("phrase_id", "source_id", "begin", "token", (F.col("begin") + F.col("offset")).alias("at")), "due")
        met = due.join(places_due(places, due), PLACE, "left_semi").groupBy("phrase_id", "source_id", "begin").agg(F.count("*").alias("_met"))
        ended = starts.join(needed, "phrase_id", "left_anti")
        starts = stage(met.join(needed, "phrase_id").where("_met = _words").select("phrase_id", "source_id", "begin").union(ended), "beginnings")
    found = stage(starts.select("phrase_id", "source_id").distinct(), "phrase-matches")
    discard(words, wanted, places, ranked)
    return found


def phrase_hits(phrases: DataFrame, index: DataFrame) -> DataFrame:
    """(phrase_id, hits, first): how many texts hold each phrase that is found, and the smallest id of them."""
    return phrase_matches(phrases, index).groupBy("phrase_id").agg(F.count("*").alias("hits"), F.min("source_id").alias("first"))


def quotation_hits(findings: DataFrame, index: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, idx, hits, matched_case, error) for ``check_quotes``: what the index has of each quotation long enough to be searched for.

    ``names``: (id, case_name) of the indexed texts. Equal phrases are searched for once.
    """
    quoted = findings.where(is_distinctive("parenthetical")).select(*KEY, quote_phrase(F.col("parenthetical")).alias("text"))
    asked = stage(quoted.select("text").distinct().withColumn("id", F.sha2("text", 256)), "phrases")
    found = phrase_hits(asked, index).join(names.select(F.col("id").alias("first"), F.col("case_name").alias("matched_case")), "first", "left")
    out = quoted.withColumn("phrase_id", F.sha2("text", 256)).join(found, "phrase_id")
    return out.select(*KEY, F.col("hits").cast("bigint").alias("hits"), "matched_case", F.lit(None).cast("string").alias("error"))
