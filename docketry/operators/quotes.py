"""Quotations and passages: whether an opinion holds a quotation, and which paragraphs speak to a sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import fixed
from docketry.functions.text import blank_to_null, comparable_quote, is_distinctive, word_count
from docketry.sources.shared import stage

KEY = ["doc_id", "idx"]


def closest_words(source: Column, quote: Column) -> Column:
    """As many words of a source as the quotation has, from where its first six words, or else its first four, are found; else null.

    Both are comparable forms. Quotations of under five words and shorter sources have none.
    """
    words = F.split(quote, " ")
    start = lambda n: F.instr(source, F.array_join(F.slice(words, 1, n), " "))
    at = F.when(start(6) > 0, start(6)).otherwise(start(4))
    window = F.array_join(F.slice(F.split(F.ltrim(F.substring(source, at, F.length(source))), " "), F.lit(1), F.size(words)), " ")
    return F.when((F.size(words) >= 5) & (word_count(source) >= F.size(words)) & (at > 0), blank_to_null(window))


def quote_phrase(parenthetical: Column) -> Column:
    """What is searched for: the quotation's first twelve words as they stand."""
    bare = F.regexp_replace(F.trim(parenthetical), '^["“”]+|["“”]+$', "")
    return F.array_join(F.slice(F.split(F.trim(F.regexp_replace(bare, f"{fixed.SPACE}+", " ")), " "), 1, 12), " ")


def check_quotes(findings: DataFrame, texts: DataFrame | None, phrase_hits: DataFrame | None = None) -> DataFrame:
    """``findings`` with ``quote_check`` (text, status, hits, matched_case), null where nothing is quoted.

    ``texts``: (cluster_id, full_text) of cases that can be read. ``phrase_hits``:
    (doc_id, idx, hits, matched_case, error) of searches for the phrase, for
    quotations whose case cannot be read. Without a row the phrase is found nowhere.
    """
    quote = comparable_quote("parenthetical")
    out = findings.withColumn("_quote", F.when(F.col("parenthetical").isNotNull(), blank_to_null(quote)))
    read = F.lit(None).cast("string")
    if texts is not None:
        sources = texts.select(F.col("cluster_id").alias("_cluster"), comparable_quote("full_text").alias("_source"))
        out = out.join(sources, F.col("resolved.cluster_id") == F.col("_cluster"), "left")
        read = F.col("_source")
    hits, case, error = F.lit(None).cast("bigint"), F.lit(None).cast("string"), F.lit(None).cast("string")
    if phrase_hits is not None:
        out = out.join(phrase_hits.select(*KEY, F.col("hits").alias("_hits"), F.col("matched_case").alias("_case"), F.col("error").alias("_error")), KEY, "left")
        hits, case, error = F.col("_hits"), F.col("_case"), F.col("_error")
    status = (
        F.when(F.col("_quote").isNull(), None)
        .when(~is_distinctive("parenthetical"), F.lit("skipped"))
        .when(F.contains(read, F.col("_quote")), F.lit("verbatim"))
        .when(closest_words(read, F.col("_quote")).isNotNull(), F.lit("variant"))
        .when(read.isNotNull(), F.lit("not_found"))
        .when(error.isNotNull(), F.lit("skipped"))
        .when(F.coalesce(hits, F.lit(0)) == 0, F.lit("corpus_miss"))
        .otherwise(F.lit("corpus_hit"))
    )
    out = out.withColumn("_status", status)
    in_case = F.col("_status").isin("verbatim", "variant", "not_found")
    check = F.struct(
        F.col("parenthetical").alias("text"),
        F.col("_status").alias("status"),
        F.when(F.col("_status").isin("corpus_hit", "corpus_miss"), F.coalesce(hits, F.lit(0))).alias("hits"),
        F.when(in_case, F.col("resolved.case_name")).when(F.col("_status") == "corpus_hit", case).alias("matched_case"),
        F.when(F.col("_status") == "variant", closest_words(read, F.col("_quote"))).alias("detail"),
    )
    out = out.withColumn("quote_check", F.when(F.col("_status").isNotNull(), check))
    return out.drop(*(c for c in out.columns if c.startswith("_")))


def word_runs(texts: DataFrame, words: str, width: int) -> DataFrame:
    """One row for each run of ``width`` words of the array column ``words``, hashed as ``run``, with the other columns."""
    names = [f"_w{k}" for k in range(width)]
    shifted = F.arrays_zip(*(F.slice(words, k + 1, F.greatest(F.size(words) - k, F.lit(0))).alias(n) for k, n in enumerate(names)))
    rows = texts.select(*(c for c in texts.columns if c != words), F.explode(shifted).alias("_run")).where(F.col(f"_run.{names[-1]}").isNotNull())
    return rows.select(*(c for c in texts.columns if c != words), F.xxhash64(*(f"_run.{n}" for n in names)).alias("run"))


def brief_key(words: Column, at: Column | int, n: Column, i: Column, j: Column) -> Column:
    """The run of ``n`` words from ``at`` (from 0), with ``i`` letters of its first word's end and ``j`` of its last word's beginning."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.concat_ws(" ", F.right(F.get(words, at), i), F.slice(words, at + 2, F.greatest(n - 2, F.lit(0))), F.left(F.get(words, at + n - 1), j))


def keys_of_shape(words: Column, n: int, i: int, j: int) -> Column:
    """All keys of one shape that a source has, as an array."""
    if n == 1:
        long_enough = F.filter(F.array_distinct(words), lambda w: F.length(w) >= i)
        return F.flatten(F.transform(long_enough, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - i + 1), lambda k: F.substring(w, k, F.lit(i)))))
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda k: brief_key(words, k, F.lit(n), F.lit(i), F.lit(j)))
    return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>"))


def brief_pairs(q: DataFrame, s: DataFrame, most_keys: int = 200_000) -> DataFrame:
    """(quote_id, source_id) that may match, for quotations of a few words.

    A quotation may begin and end within a word of its source. One word is looked
    up by its first three letters, wherever they are in a word; more words by the
    last three letters of the first, the whole words between, and the first three of
    the last. Shorter words are looked up whole, so quotations have at most a few
    dozen shapes (words, letters at both ends). A source is read once and gives its
    distinct keys of all shapes; those that no quotation asks for are dropped where
    they are made, if the keys asked for are at most ``most_keys``, which are broadcast then.
    """
    words, edge = F.col("_words"), lambda w: F.least(F.length(w), F.lit(3))
    looked = q.select("quote_id", F.split("_quote", " ").alias("_words")).select("quote_id", "_words", F.size("_words").alias("n"), edge(F.get("_words", F.lit(0))).alias("i"), edge(F.element_at("_words", -1)).alias("j"))
    own_key = F.when(F.col("n") == 1, F.left(F.get(words, F.lit(0)), F.col("i"))).otherwise(brief_key(words, 0, F.col("n"), F.col("i"), F.col("j")))
    looked = stage(looked.select("quote_id", "n", "i", "j", F.xxhash64("n", own_key).alias("_key")), "brief-keys")
    shapes = looked.select("n", "i", "j").distinct().collect()
    hashed = lambda x: F.transform(F.array_distinct(keys_of_shape(words, x.n, x.i, x.j)), lambda key: F.xxhash64(F.lit(x.n), key))
    read = s.select("source_id", F.split("_source", " ").alias("_words")).select("source_id", F.explode(F.array_distinct(F.flatten(F.array(*map(hashed, shapes))))).alias("_key"))
    asked = looked.select("_key").distinct()
    found = read.join(F.broadcast(asked) if asked.count() <= most_keys else asked, "_key", "left_semi")
    return found.join(looked.select("quote_id", "_key"), "_key").select("quote_id", "source_id").distinct()


def contained_quotes(quotes: DataFrame, sources: DataFrame, width: int = 4, most_runs: int = 200_000) -> DataFrame:
    """(quote_id, source_id) of the comparable quotations that a source holds.

    ``quotes`` and ``sources`` have (id, text). A quotation looks up its rarest run
    of ``width`` words among the sources' runs, hashed; only sources that have it
    are searched. Its first and last word may be parts of a source's words, so they
    are in no such run; quotations too short to have one look up ``brief_pairs``.
    Null and empty ones are in nothing; one of a letter or a frequent word is in nearly
    every source, and has a row for each. Sources are cut into runs once; runs of
    quotations are broadcast if they are at most ``most_runs``, else both are shuffled.
    """
    q = stage(quotes.select(F.col("id").alias("quote_id"), comparable_quote("text").alias("_quote")).where("_quote <> ''"), "quotes")
    read = sources.select(F.col("id").alias("source_id"), "text").where("text is not null")
    is_brief = word_count("_quote") < width + 2
    inner = q.where(~is_brief).select("quote_id", F.split("_quote", " ").alias("_words")).select("quote_id", F.slice("_words", F.lit(2), F.size("_words") - 2).alias("_words"))
    held = stage(word_runs(inner, "_words", width).distinct(), "quote-runs")
    wanted = stage(held.select("run").distinct(), "runs-wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= most_runs else wanted
    words = read.select("source_id", F.split(comparable_quote("text"), " ").alias("_words"))
    found = stage(word_runs(words, "_words", width).join(wanted, "run").select("source_id", "run").distinct(), "runs-found")
    counts = found.groupBy("run").agg(F.count("*").alias("_n"))
    order = Window.partitionBy("quote_id").orderBy("_n", "run")
    # A run that no source has leaves its quotation without a match.
    rarest = held.join(counts, "run", "left").withColumn("_n", F.coalesce("_n", F.lit(0))).withColumn("_at", F.row_number().over(order)).where("_at = 1")
    pairs = rarest.select("quote_id", "run").join(found, "run").select("quote_id", "source_id").distinct()
    brief = q.where(is_brief)
    if brief.limit(1).count():
        pairs = pairs.union(brief_pairs(brief, read.select("source_id", comparable_quote("text").alias("_source")))).distinct()
    # Sources are read again, but made comparable only where a quotation may be in them.
    both = pairs.join(q, "quote_id").join(read, "source_id")
    return both.where(F.contains(comparable_quote("text"), F.col("_quote"))).select("quote_id", "source_id")


def content_terms(x: Column) -> Column:
    """Distinct words of three letters or more, lower-cased, without stopwords."""
    words = F.transform(F.regexp_extract_all(x, F.lit(r"([A-Za-z][A-Za-z'\-]{2,})"), F.lit(1)), F.lower)
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, fixed.STOPWORDS)))


def best_passage(full_text: Column, sentence: Column, longest: int = fixed.LONGEST_PASSAGE) -> Column:
    """The three paragraphs that share most terms with a sentence, in the text's order, cut at ``longest``.

    A text of one paragraph goes by sentences. Short paragraphs and those without a
    shared term don't count; if none counts, the text's beginning is taken. Null for
    an empty text.
    """
    terms = content_terms(sentence)
    filled = lambda parts: F.filter(parts, lambda p: F.trim(p) != "")
    paragraphs = filled(F.split(full_text, r"\n{2,}"))
    parts = F.when(F.size(paragraphs) >= 2, paragraphs).otherwise(filled(F.split(full_text, r"(?<=[.!?])\s+")))
    scored = F.transform(parts, lambda p, i: F.struct((-F.size(F.array_intersect(terms, content_terms(p)))).alias("score"), i.alias("at"), F.trim(p).alias("text"), F.length(p).alias("n")))
    fit = F.filter(scored, lambda x: (x["n"] >= fixed.SHORTEST_PARAGRAPH) & (x["score"] < 0))
    top = F.array_sort(F.transform(F.slice(F.array_sort(fit), 1, 3), lambda x: F.struct(x["at"].alias("at"), x["text"].alias("text"))))
    chosen = F.when((F.size(terms) > 0) & (F.size(fit) > 0), F.array_join(F.transform(top, lambda x: x["text"]), "\n\n")).otherwise(full_text)
    return F.substring(blank_to_null(chosen), 1, longest)


def rank_passages(parts: DataFrame, most: int = 3) -> DataFrame:
    """(doc_id, rank, at, overlap): the ``most`` passages of a text that share most terms with a sentence, the earlier first.

    ``parts``: (doc_id, at, passage, sentence). Short passages and those without a shared term don't count.
    """
    rows = parts.where(F.length("passage") >= fixed.SHORTEST_PARAGRAPH).withColumn("_terms", content_terms(F.col("sentence"))).where(F.size("_terms") > 0)
    rows = rows.withColumn("overlap", F.size(F.array_intersect(content_terms(F.col("passage")), F.col("_terms")))).where("overlap > 0")
    top = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("overlap"), "at"))
    return rows.withColumn("rank", top).where(F.col("rank") <= most).select("doc_id", "rank", "at", "overlap")


def snippet_passage(findings: DataFrame, hits: DataFrame) -> DataFrame:
    """(doc_id, idx, passage): the snippet of the first result that is the resolved case itself. ``hits``: (doc_id, idx, rank, rec).

    Both sides grow with the citations, and Spark takes a side of few columns for
    small; so both are dealt by citation, as the grouping after them needs, too.
    """
    own = findings.select(*KEY, F.col("resolved.cluster_id").alias("_cluster")).where("_cluster is not null")
    told = hits.where(blank_to_null("rec.snippet").isNotNull()).select(*KEY, "rank", F.col("rec.cluster_id").alias("_found"), F.col("rec.snippet").alias("passage"))
    rows = own.hint("merge").join(told, KEY).where("_found = _cluster")
    return rows.groupBy(*KEY).agg(F.min(F.struct("rank", "passage")).alias("_m")).select(*KEY, "_m.passage")


def snippet_query(case_name: Column, context: Column) -> Column:
    """The search for a case's own snippet: its name and the first eight of the sentence's telling words."""
    words = F.array_distinct(F.regexp_extract_all(context, F.lit(r"([A-Za-z][A-Za-z'\-]{2,})"), F.lit(1)))
    words = F.filter(words, lambda w: ~F.array_contains(F.array(*map(F.lit, fixed.STOPWORDS)), F.lower(w)))
    return F.trim(F.concat(F.lit('"'), case_name, F.lit('" '), F.array_join(F.slice(F.array_sort(words), 1, 8), " ")))
