"""Search providers: where a citation's search results come from.

``corpus_search`` joins citations with tables of cases; ``replay_search`` looks
up stored replies. Both give (results, status) for ``verdicts.findings``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import fixed
from docketry.functions.names import name_parts, parts_similarity
from docketry.functions.schemas import OVERALL
from docketry.functions.text import blank_to_null, court_token, lists_key, reporter_key, year_in
from docketry.operators.corpus import Corpus, corpus_of
from docketry.operators.records import case_citations, record_of
from docketry.operators.verdicts import NAMED
from docketry.sources.shared import stage

KEY = ["doc_id", "idx"]
#: Results of one search that are carried on: those that decide come first, and ``found`` counts all.
PAGE = 20
#: Most rows of one word that are broadcast; beyond it, the same join shuffles.
MOST_BROADCAST = 200_000


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """``df``, a side of a join that has about ``rows``: beyond ``MOST_BROADCAST`` both sides are dealt by key. Spark goes by bytes, which columns of few values keep small at any number of rows."""
    return df.hint("merge") if rows > MOST_BROADCAST else df


def match_distinct_names(cited: DataFrame, corpus: Corpus, threshold: float = fixed.NAME_MATCH) -> DataFrame:
    """(case_name, found_name, sim): the names of ``corpus`` that fit those of ``cited`` (case_name, parts).

    Of n tokens on a side a match has ceil(threshold n) at least, so a match that
    may lack m tokens has one of any m + 1. Each cited name looks up the m + 1 that
    fewest names hold. An abbreviated token stands for all that begin with it: those
    come from the list of distinct tokens, and their names count as its own. What is
    asked goes to the corpus' tables by their keys. Names are exchanged as they are
    written and taken apart where they meet: in parts they are many times as wide.
    """
    lacks = lambda s: F.coalesce(F.size(f"parts.{s}") - F.ceil(F.size(f"parts.{s}") * threshold - 1e-9), F.lit(0))
    may_lack = F.greatest(lacks("all"), lacks("left") + lacks("right"))
    # The word between the parties is asked for only by names that have too few others.
    others = F.filter("parts.all", lambda t: t != "v")
    asks = F.when(F.size(others) > may_lack, others).otherwise(F.col("parts.all"))
    tokens = cited.select("case_name", may_lack.alias("_lack"), "parts.short", F.explode(asks).alias("asked")).withColumn("is_short", F.array_contains("short", F.col("asked"))).drop("short")
    tokens = stage(tokens, "cited-tokens")
    asks = tokens.count()
    # The parts of a kept corpus' vocabulary add up; that of one search is in one part.
    counts = corpus.vocabulary if corpus.names is None else corpus.vocabulary.groupBy("token").agg(F.sum("n").alias("n"))
    begun = stage(tokens.where("is_short").select("asked").distinct(), "begun")
    begun = F.broadcast(begun) if begun.count() <= MOST_BROADCAST else begun
    beginnings = counts.select("token", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("token")), lambda k: F.substring("token", F.lit(1), k))).alias("asked"))
    stands_for = stage(beginnings.join(begun, "asked").select("asked", "token", "n"), "beginnings")
    ranked = dealt(tokens, asks).where("not is_short").join(counts.withColumnRenamed("token", "asked"), "asked", "left")
    ranked = ranked.union(tokens.where("is_short").join(stands_for.groupBy("asked").agg(F.sum("n").alias("n")), "asked", "left"))
    ranked = ranked.withColumn("_n", F.coalesce("n", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("case_name").orderBy("_n", "asked"))
    lookups = stage(ranked.withColumn("_at", place).where((F.col("_at") <= F.col("_lack") + 1) & (F.col("_n") > 0)).select("case_name", "asked", "is_short"), "lookups")
    exact = lookups.where("not is_short").select("case_name", F.col("asked").alias("token"))
    longer = lookups.where("is_short").join(stands_for.select("asked", "token"), "asked").select("case_name", "token")
    asked = exact.union(longer)
    pairs = dealt(asked, asks).join(unasked_left_out(corpus, counts, asked), "token").select("case_name", "found_name")
    if corpus.names is None:
        # Dealt by the found name, pairs are made distinct and meet its records without being dealt again.
        both = pairs.repartition("found_name").distinct().withColumn("found", name_parts(F.col("found_name")))
    else:
        both = pairs.distinct().join(corpus.names.select("found_name", F.col("parts").alias("found")), "found_name")
    both = both.withColumn("cited", name_parts(F.col("case_name")))
    # A filter would be pushed below the parts, which it would then work out once for each of their uses.
    fitting = F.filter(F.array(parts_similarity(F.col("cited"), F.col("found"))), lambda sim: sim >= threshold)
    return both.select("case_name", "found_name", F.explode(fitting).alias("sim"))


def unasked_left_out(corpus: Corpus, counts: DataFrame, asked: DataFrame) -> DataFrame:
    """The tokens of a corpus without those of a thousandth of its rows or more that none of ``asked`` (token) is: they would be exchanged for nothing. A kept corpus is not exchanged."""
    if corpus.names is not None:
        return corpus.tokens
    frequent = stage(counts.where(F.col("n") * 1000 >= corpus.tokens.count()), "frequent")
    unasked = stage(frequent.select("token").join(asked.select("token").join(F.broadcast(frequent), "token", "left_semi").distinct(), "token", "left_anti"), "unasked")
    return corpus.tokens.join(F.broadcast(unasked), "token", "left_anti")


def cited_names(citations: DataFrame) -> DataFrame:
    """(case_name, parts): each distinct cited name, taken apart."""
    names = citations.where(blank_to_null("case_name").isNotNull()).select("case_name").distinct()
    return names.withColumn("parts", name_parts(F.col("case_name")))


def match_names(citations: DataFrame, cases: DataFrame, threshold: float = fixed.NAME_MATCH) -> DataFrame:
    """(doc_id, idx, cluster_id, sim): all cases whose names fit the cited ones by ``threshold`` > 0.

    Distinct names are matched once for all citations and cases that have them.
    """
    found = match_distinct_names(cited_names(citations), corpus_of(cases, names_only=True), threshold)
    named = cases.where("cluster_id is not null").select("cluster_id", F.coalesce("case_name", F.lit("")).alias("found_name"))
    return citations.select(*KEY, "case_name").join(found, "case_name").join(named, "found_name").select(*KEY, "cluster_id", "sim")


def match_slots(citations: DataFrame, cases: DataFrame) -> DataFrame:
    """(doc_id, idx, cluster_id): the cases that list the cited reporter citation, by key."""
    asked = citations.where(blank_to_null("cite_key").isNotNull()).select(*KEY, "cite_key")
    return asked.join(case_citations(cases), "cite_key").select(*KEY, "cluster_id")


def fetch_cases(asked: DataFrame, cases: DataFrame) -> DataFrame:
    """The cases whose ``cluster_id`` is asked for, each once; ids that no case has give no row."""
    return cases.join(asked.select("cluster_id").distinct(), "cluster_id", "left_semi")


def with_scores(pairs: DataFrame) -> DataFrame:
    """``pairs`` (case_name, rec, cite_key ...) with ``sim``, how well the record's name fits, and ``lists``, whether it has the citation.

    Pairs are scored where they are, as records are wide; those without a name have 0.
    """
    both = blank_to_null("case_name").isNotNull() & blank_to_null("rec.case_name").isNotNull()
    apart = pairs.withColumns({"_cited": F.when(both, name_parts(F.col("case_name"))), "_found": F.when(both, name_parts(F.col("rec.case_name")))})
    sim = F.when(F.col("_cited").isNotNull(), parts_similarity(F.col("_cited"), F.col("_found")))
    return apart.withColumns({"sim": F.coalesce(sim, F.lit(0.0)), "lists": lists_key("rec.citations", "cite_key")}).drop("_cited", "_found")


def name_totals(named: DataFrame, page: int, most: int = NAMED) -> DataFrame:
    """(case_name, overall) of names with more than ``page`` records: over all of them the number, the best score and its record, and their first citations and courts in order of text.

    Names with fewer records have them all on their page. Citations and courts are
    made distinct before they are ranked, so a name's many cases never meet as one array.
    """
    counts = named.groupBy("case_name").agg(F.count("*").cast("int").alias("found")).where(F.col("found") > page)
    some = named.join(counts, "case_name")
    first = F.struct(-F.col("sim"), blank_to_null("rec.court").isNull(), F.col("rec.cluster_id"))
    out = some.groupBy("case_name").agg(F.max("found").alias("found"), F.max("sim").alias("sim"), F.min_by("rec", first).alias("rec"))
    for name, values in (("citations", some.select("case_name", F.explode("rec.citations").alias("x"))), ("courts", some.select("case_name", blank_to_null("rec.court").alias("x")))):
        place = F.row_number().over(Window.partitionBy("case_name").orderBy("x"))
        least = values.where("x is not null").distinct().withColumn("_n", place).where(F.col("_n") <= most + 1)
        out = out.join(least.groupBy("case_name").agg(F.array_sort(F.collect_list("x")).alias(name)), "case_name", "left")
    none = F.array().cast("array<string>")
    return out.select("case_name", F.struct("found", "sim", "rec", F.coalesce("citations", none).alias("citations"), F.coalesce("courts", none).alias("courts")).alias("overall"))


def named_records(asked: DataFrame, named: DataFrame, page: int) -> DataFrame:
    """(doc_id, idx, strategy, rank, rec, sim, lists, found, overall): the first ``page`` records of each cited name.

    ``overall`` (``name_totals``) says what all records of the name are, where they
    are more than a page; it comes with the first record.

    Records that list the citation come first, then those of the court and the year
    that the document writes, then those that tell a court, each by name score and
    id. So no verdict depends on what lies beyond the page. The best of a name, of a
    name in a court, in a year and in both are found once for all citations of the
    name: a name that many cases have costs each citation some pages, not all cases.

    ``asked``: citations; ``named``: (case_name, rec, sim, court, year) of cases.
    """
    counts = named.groupBy("case_name").agg(F.count("*").cast("int").alias("found"))
    wanted = asked.select(*KEY, "case_name", "cite_key", F.when((F.col("court_source") == "document") & blank_to_null("court").isNotNull(), court_token("court")).alias("court"), blank_to_null("year").alias("year"))
    wanted = wanted.where(blank_to_null("case_name").isNotNull())
    best = [F.desc(blank_to_null("rec.court").isNotNull()), F.desc("sim"), F.col("rec.cluster_id")]
    many = stage(counts.where(F.col("found") > page), "many-records")
    has_many = many.limit(1).count() > 0
    # A name with a page of records or fewer has all of them there: they are dealt by name once, and only their order is left to be found.
    few = (named.join(many, "case_name", "left_anti") if has_many else named).select("case_name", "rec", "sim")
    by_name, by_id = Window.partitionBy("case_name"), Window.partitionBy("case_name", "rec.cluster_id").orderBy("sim")
    few = few.withColumn("found", F.count("*").over(by_name).cast("int")).withColumn("_n", F.row_number().over(by_id)).where("_n = 1")
    rows = wanted.join(few.select("case_name", "rec", "sim", "found"), "case_name").select(*KEY, "cite_key", "court", "year", "rec", "sim", "found")
    if has_many:
        some = named.join(many.select("case_name"), "case_name", "left_semi")
        listed = some.withColumn("cite_key", F.explode(F.array_distinct(F.transform("rec.citations", reporter_key))))
        pages = wanted.join(listed.select("case_name", "cite_key", "rec", "sim"), ["case_name", "cite_key"]).select(*KEY, "rec", "sim")
        for within in ([], ["court"], ["year"], ["court", "year"]):
            first = F.row_number().over(Window.partitionBy("case_name", *within).orderBy(*best))
            top = some.withColumn("_n", first).where(F.col("_n") <= page).select("case_name", *within, "rec", "sim")
            pages = pages.union(wanted.join(top, ["case_name", *within]).select(*KEY, "rec", "sim"))
        once = pages.groupBy(*KEY, F.col("rec.cluster_id").alias("_id")).agg(F.min_by(F.struct("rec", "sim"), "sim").alias("_r")).select(*KEY, "_r.*")
        rows = rows.unionByName(once.join(wanted, KEY).join(many, "case_name").select(*rows.columns))
    fits = F.when(F.coalesce(F.col("court") == court_token("rec.court"), F.lit(False)), 2).otherwise(0) + F.when(F.coalesce(F.col("year") == year_in("rec.date_filed"), F.lit(False)), 1).otherwise(0)
    rows = rows.select(*KEY, "rec", "sim", lists_key("rec.citations", "cite_key").alias("lists"), "found", fits.alias("_fits"))
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("lists"), F.desc("_fits"), *best))
    ranked = rows.withColumn("rank", place).where(F.col("rank") <= page)
    if has_many:
        totals = wanted.join(name_totals(named, page), "case_name").select(*KEY, F.lit(1).alias("rank"), "overall")
        ranked = ranked.join(totals, [*KEY, "rank"], "left")
    else:
        ranked = ranked.withColumn("overall", F.lit(None).cast(OVERALL))
    return ranked.select(*KEY, F.lit("name").alias("strategy"), "rank", "rec", "sim", "lists", "found", "overall")


def slot_records(held: DataFrame, page: int) -> DataFrame:
    """(doc_id, idx, strategy, rank, rec, sim, lists, found): the first ``page`` records that list each citation, of any court and of the court asked for, in one pass. ``held``: (doc_id, idx, rec, sim, of_court, court_id)."""
    here = F.coalesce(F.col("of_court") == F.col("court_id"), F.lit(False))
    every = Window.partitionBy(*KEY)
    order = every.orderBy(F.desc("sim"), F.col("rec.cluster_id"))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = held.select(*KEY, "rec", "sim", here.alias("_here"))
    rows = rows.withColumns({"_rank": F.row_number().over(order), "_rank_here": F.count_if("_here").over(so_far).cast("int"), "_found": F.count("*").over(every).cast("int"), "_found_here": F.count_if("_here").over(every).cast("int")})
    one = lambda strategy, rank, found: F.struct(F.lit(strategy).alias("strategy"), F.col(rank).alias("rank"), F.col(found).alias("found"))
    asks = F.array_compact(F.array(F.when(F.col("_rank") <= page, one("cite", "_rank", "_found")), F.when(F.col("_here") & (F.col("_rank_here") <= page), one("court", "_rank_here", "_found_here"))))
    rows = rows.select(*KEY, "rec", "sim", F.explode(asks).alias("_s"))
    return rows.select(*KEY, "_s.strategy", "_s.rank", "rec", "sim", F.lit(True).alias("lists"), "_s.found")


def corpus_search(citations: DataFrame, cases: DataFrame | Corpus, threshold: float = fixed.NAME_MATCH, page: int = PAGE) -> tuple[DataFrame, None]:
    """Results of the three searches against ``cases``: columns of a record and ``court_id``, or a corpus that is kept. No search fails.

    The order within a search is ours: see ``named_records``; records that list the
    citation go by name score and id. ``found`` counts all results, those beyond the page too.
    """
    asked = citations.select(*KEY, "case_name", "cite_key", "court", "court_id", "court_source", "year")
    corpus = cases if isinstance(cases, Corpus) else corpus_of(cases)
    asks = citations.count()
    matches = match_distinct_names(cited_names(citations), corpus, threshold)
    named = dealt(matches, asks).join(corpus.records, "found_name").select("case_name", "rec", "sim", court_token("rec.court").alias("court"), year_in("rec.date_filed").alias("year"))
    by_name = named_records(dealt(asked, asks), stage(named, "named"), page)
    held = dealt(asked, asks).where(blank_to_null("cite_key").isNotNull()).join(corpus.slots, "cite_key")
    by_cite = slot_records(with_scores(held), page)
    return by_name.unionByName(by_cite.withColumn("overall", F.lit(None).cast(OVERALL)).select(*by_name.columns)), None


def replay_search(citations: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results from stored replies: (query, court, rank, failing, record).

    Queries are the quoted name or citation. One that ends in ``*`` answers all
    that begin so; an exact one goes before it, and one for the same court before
    one for any. A query that nothing answers has no results and no error.
    """
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    asks = [("name", "case_name", None), ("cite", "matched_text", None), ("court", "matched_text", "court_id")]
    asked = None
    for strategy, column, court in asks:
        some = citations.where(blank_to_null(column).isNotNull() & (blank_to_null("cite_key").isNotNull() if strategy != "name" else F.lit(True)))
        some = some.where("court_id is not null") if court else some
        some = some.select(*KEY, F.lit(strategy).alias("strategy"), quoted(column).alias("query"), (F.col(court) if court else F.lit(None).cast("string")).alias("court"))
        asked = some if asked is None else asked.union(some)
    stored = replies.select(F.col("query").alias("_query"), F.col("court").alias("_court"), F.col("rank").alias("_rank"), "failing", "record")
    exact = asked.join(stored.where(~F.col("_query").endswith("*")), F.col("query") == F.col("_query"))
    stems = stored.where(F.col("_query").endswith("*")).withColumn("_stem", F.regexp_replace("_query", r"\*$", ""))
    # Stems are few and typed by hand; they meet queries by their first eight characters.
    begun = asked.withColumn("_head", F.substring("query", 1, 8)).join(stems.withColumn("_head", F.substring("_stem", 1, 8)), "_head")
    begun = begun.where(F.col("query").startswith(F.col("_stem"))).drop("_head", "_stem")
    answered = exact.withColumn("_kind", F.lit(0)).unionByName(begun.withColumn("_kind", F.lit(1)))
    answered = answered.where(F.col("_court").isNull() | F.col("_court").eqNullSafe(F.col("court")))
    answered = answered.withColumn("_prefer", F.struct("_kind", F.col("_court").isNull(), -F.length("_query"), "_query"))
    best = F.min("_prefer").over(Window.partitionBy(*KEY, "strategy"))
    answered = answered.withColumn("_least", best).where("_prefer = _least")
    some = answered.where("record is not null and not coalesce(failing, false)").select(*KEY, "strategy", "_rank", record_of(F.col("record")).alias("rec"))
    known = with_scores(some.join(citations.select(*KEY, "case_name", "cite_key"), KEY))
    by = Window.partitionBy(*KEY, "strategy")
    ranked = known.withColumn("rank", F.row_number().over(by.orderBy("_rank"))).withColumn("found", F.count("*").over(by).cast("int"))
    status = answered.where("failing").select(*KEY, "strategy", F.lit("the search failed").alias("error")).distinct()
    return ranked.select(*KEY, "strategy", "rank", "rec", "sim", "lists", "found"), status
