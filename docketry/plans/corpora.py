"""Queries over corpora that have what the derived briefs lack: names of many cases, stored indexes and reports, dense spans, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from docketry.functions.tables import register
from docketry.functions.text import request_key
from docketry.operators import phrases as P
from docketry.operators import reports as R
from docketry.operators.corpus import drop_corpus, keep_corpus
from docketry.operators.extract import citation_mentions, scan_documents
from docketry.operators.phrases import add_to_index, read_index
from docketry.operators.quotes import check_quotes, quote_phrase
from docketry.operators.requests import COUNTERS, observed
from docketry.operators.search import corpus_search
from docketry.operators.verdicts import findings
from docketry.plans import derived as D
from docketry.plans.audit import audit
from docketry.plans.derived import _letters, _pick, table
from docketry.plans.stated import JUDGED, verdict_rows
from docketry.sources.files import cache_replies, merge_replies, read_json_reports, read_markdown, write_json_reports, write_markdown
from docketry.sources.shared import shared_dir, stage
from docketry.sources.store import stored
from docketry.streaming.audits import request_counts
from docketry.streaming.jobs import job_states

# -- names that many cases have --------------------------------------------------------------------------------------

#: Distinct names that all orders share, a few hundred cases each.
NAMES = 40
_FULL = "{} Alder Birch Cedar Dogwood v. {}"


def _shared_name(k):
    """The cited name, of five words and one."""
    return F.concat(_letters(k), F.lit(" Alder Birch Cedar Dogwood v. "), _letters(k, "klmnopqrst"))


def common_name_cases(spark, sf_dir):
    """A case for each order: one in 37 has all words of its name, the others lack one and fit by four fifths."""
    k = F.col("o_custkey") % NAMES
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", _shared_name(k).alias("full"))
    name = F.when(F.col("o_orderkey") % 37 == 0, F.col("full")).otherwise(F.replace("full", F.lit(" Dogwood"), F.lit("")))
    court = [_pick([x[i] for x in D.COURTS], F.col("o_orderkey")) for i in (0, 1)]
    return rows.select(
        F.col("o_orderkey").cast("bigint").alias("cluster_id"), name.alias("case_name"), F.array(F.format_string("%d F.3d %d", "o_orderkey", "o_custkey")).alias("citations"), court[0].alias("court"), court[1].alias("court_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_filed"), F.lit(None).cast("string").alias("absolute_url"), F.lit(None).cast("string").alias("snippet"),
    )


def common_name_evidence(spark, sf_dir):
    """What is said of names that hundreds of cases have, in a court that some are of, and in one that none is of."""
    cases = stage(common_name_cases(spark, sf_dir), "cases")
    k = (F.col("c_custkey") % NAMES).cast("int")
    names = table(spark, sf_dir, "customer").select(k.alias("k")).distinct()
    cited = names.crossJoin(F.broadcast(spark.createDataFrame([(0, "1st Cir.", "ca1"), (1000, "S.D. Tex.", "txsd")], "more int, court string, court_id string")))
    cited = cited.select(
        F.lit("n").alias("doc_id"), (F.col("k") + F.col("more")).alias("idx"), _shared_name(F.col("k")).alias("case_name"), F.lit("999").alias("volume"), F.lit("F.2d").alias("reporter"), F.col("k").cast("string").alias("page"),
        F.format_string("999 F.2d %d", "k").alias("matched_text"), F.format_string("999f2d%d", "k").alias("cite_key"), "court", "court_id", F.lit("document").alias("court_source"), F.lit("1995").alias("year"), F.lit(None).cast("array<string>").alias("extraction_notes"),
    )
    cited = stage(cited, "cited")
    results, status = corpus_search(cited, cases)
    e = F.col("evidence")[0]
    rows = findings(cited, stage(results, "results"), status)
    return rows.select("idx", "rule", e["result_count"].alias("found"), e["matched"].alias("matched"), e["top"]["cluster_id"].alias("top"), e["note"].alias("note"), "explanation")


COMMON_NAME_SQL = f"""
    WITH c AS (
      SELECT o_orderkey AS id, o_custkey % {NAMES} AS k, o_orderkey % 37 = 0 AS whole, {D._sql_list(w for w, _ in D.COURTS)}[(o_orderkey % 8 + 1)::INT] AS court, year(o_orderdate) AS year, concat(o_orderkey, ' F.3d ', o_custkey) AS cite FROM orders),
    a AS (SELECT x.k, t.more, t.court FROM (SELECT DISTINCT c_custkey % {NAMES} AS k FROM customer) x, (VALUES (0, '1st Cir.'), (1000, 'S.D. Tex.')) t(more, court)),
    r AS (
      SELECT a.k, a.more, a.court AS asked, c.*, row_number() OVER (PARTITION BY a.k, a.more ORDER BY (CASE WHEN c.court = a.court THEN 2 ELSE 0 END + CASE WHEN c.year = 1995 THEN 1 ELSE 0 END) DESC, c.whole DESC, c.id) AS rank
      FROM a JOIN c ON a.k = c.k),
    g AS (
      SELECT k, more, any_value(asked) AS asked, count(*) AS found, bool_or(whole) AS any_full, coalesce(bool_or(whole) FILTER (rank <= 20), false) AS page_full, min(id) FILTER (whole) AS best_full,
             arg_min(id, rank) FILTER (whole) AS page_best_full, arg_min(id, rank) AS first_id, bool_or(court = asked) AS of_court, list_sort(list(DISTINCT cite)) AS cites, list_sort(list(DISTINCT court)) AS courts
      FROM r GROUP BY k, more)
    SELECT (k + more)::INT AS idx, CASE WHEN of_court THEN 'D7' ELSE 'D6' END AS rule, found::INT AS found, true AS matched,
           CASE WHEN page_full THEN page_best_full WHEN any_full THEN best_full ELSE first_id END AS top, 'best name score ' || CASE WHEN any_full THEN '1.00' ELSE '0.80' END AS note,
           CASE WHEN of_court THEN 'This case exists; its records (' || found || ') list ' ELSE 'All records of this case are of other courts (' || array_to_string(courts[1:20], ', ') || '), not of ' || asked || '; it is recorded under ' END
           || array_to_string(cites[1:20], ', ') || CASE WHEN len(cites) > 20 THEN ' and more' ELSE '' END
           || CASE WHEN of_court THEN ' and neither confirm nor rule out 999 F.2d ' || k || '.' ELSE '.' END AS explanation
    FROM g"""

# -- stores and indexes ----------------------------------------------------------------------------------------------


def _new_path(spark, name: str) -> str:
    return f"{shared_dir(spark)}/docketry/{name}-{uuid.uuid4().hex}"


def report_store(spark, sf_dir):
    """Reports of all documents, those of a third written again, read back from the store, JSON and Markdown."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").alias("n"), F.length("text").alias("size"))
    made = lambda version: F.to_json(F.struct(F.lit(version).alias("version"), "size"), {"ignoreNullFields": "false"})
    path, other = _new_path(spark, "reports"), _new_path(spark, "markdown")
    for version, some in ((1, docs), (2, docs.where("n % 3 = 0"))):
        write_json_reports(some.select("doc_id", made(version).alias("json")), path, buckets=8)
        write_markdown(some.select("doc_id", F.format_string("# Version %d", F.lit(version)).alias("markdown")), other, buckets=8)
    reports = read_json_reports(spark, path, "version int, size int")
    return reports.join(read_markdown(spark, other), "doc_id").select("doc_id", "version", "size", "markdown")


def reply_store(spark, sf_dir):
    """Replies of all events merged in two batches, the later one first; what is found for each user then, if not older than a day."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.expr("cast(cast(ts - timestamp_ntz'1970-01-01 00:00:00' as interval second) as decimal(18, 6))").cast("double").alias("at"))
    url = F.concat(F.lit("/u/"), F.col("user_id").cast("string"))
    replies = e.select("event_id", request_key(F.lit("GET"), url, F.lit("")).alias("key"), F.lit(200).alias("status"), F.format_string('{"event": %d}', "event_id").alias("body"), F.col("at").alias("created_at"))
    path = _new_path(spark, "replies")
    for half in (1, 0):
        merge_replies(replies.where(F.col("event_id") % 2 == half), path, buckets=8)
    last = e.agg(F.max("at")).first()[0]
    asked = e.select("user_id").distinct().select("user_id", F.lit("GET").alias("method"), url.alias("url"), F.lit("").alias("body"))
    hits, misses = cache_replies(asked, stored(spark, path), max_age=86_400.0, now=last)
    return hits.select("user_id", F.get_json_object("reply", "$.event").cast("long").alias("event_id")).union(misses.select("user_id", F.lit(None).cast("long")))


def stored_corpus_audit(spark, sf_dir):
    """All briefs against a corpus kept as bucketed tables, made of half the cases and then given the others."""
    cases, name = stage(D.cases(spark, sf_dir), "cases"), f"cases_{uuid.uuid4().hex}"
    path = _new_path(spark, "corpus")
    for half in (0, 1):
        corpus = keep_corpus(cases.where(F.col("cluster_id") % 2 == half), name, path, buckets=8)
    done = audit(D.briefs(spark, sf_dir), corpus)
    drop_corpus(spark, name)
    return done.findings.groupBy("rule", "verdict", "error_class").agg(F.count("*").alias("n"), F.count("resolved").alias("resolved"))


def _document_index(spark, sf_dir):
    """An index of all documents, made in two additions."""
    docs, path = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), _new_path(spark, "words")
    for half in (0, 1):
        add_to_index(docs.where(F.col("id") % 2 == half), path)
    return read_index(spark, path)


def phrase_hits(spark, sf_dir):
    """The first twelve words of each benchmark passage, searched for in the index of all documents."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), quote_phrase(F.col("text")).alias("text"))
    found = P.phrase_hits(items, _document_index(spark, sf_dir))
    return items.join(found, F.col("id") == F.col("phrase_id"), "left").select(F.col("id").alias("item_id"), F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"), F.col("first").alias("first_doc"))


def phrase_quote_checks(spark, sf_dir):
    """Quotations whose case cannot be read, checked by the index alone; of every fourth the words are turned around."""
    words = F.split(F.trim(F.regexp_replace("text", "[ \\t-\\r]+", " ")), " ")
    said = F.when(F.col("item_id") % 4 == 3, F.array_join(F.reverse(words), " ")).otherwise(F.array_join(words, " "))
    found = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("doc_id"), F.lit(0).alias("idx"), F.concat(F.lit('"'), said, F.lit('"')).alias("parenthetical"), F.lit(None).cast("struct<cluster_id:bigint,case_name:string>").alias("resolved"))
    names = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.format_string("Document %d", "doc_id").alias("case_name"))
    hits = P.quotation_hits(found, _document_index(spark, sf_dir), names)
    return check_quotes(found, None, hits).select("doc_id", "quote_check.status", "quote_check.hits", "quote_check.matched_case")


_PLAIN = "lower(trim(regexp_replace(regexp_replace(replace(translate(coalesce({0}, ''), '“”‘’\"''…', '       '), '...', ' '), '\\[[^\\]]*\\]', ' ', 'g'), '[^A-Za-z0-9]+', ' ', 'g')))"
_SPACED = "trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ')"
_TWELVE = "array_to_string(string_split({0}, ' ')[1:12], ' ')"
#: Phrases p (id, phrase), held against every document.
_HELD = f"""d AS (SELECT doc_id, ' ' || {_PLAIN.format('text')} || ' ' AS t FROM documents),
      h AS (SELECT id, count(*) AS hits, min(doc_id) AS first_doc FROM p JOIN d ON phrase <> '' AND contains(t, ' ' || phrase || ' ') GROUP BY id)"""

# -- names in several ways -------------------------------------------------------------------------------------------


def _named_texts(spark, sf_dir):
    """A citation for each customer, whose name is written in one of seven ways."""
    k = F.col("c_custkey")
    own = _letters(k)
    ways = [
        F.concat(F.lit("It was held in "), own, F.lit(" Co. v. Birch")), F.concat(F.lit("El Rio "), own, F.lit(" v. Birch Bank")), F.concat(F.lit("It was said. Alpha (USA) "), own, F.lit(" v. Delta (UK) Lines")),
        F.concat(own, F.lit(" argued, yet "), own, F.lit(" Corp. vs. Birch")), F.concat(F.lit("See Bros. of Mt. "), own, F.lit(" v. Pine St. Co.")), F.concat(F.lit("AB v. "), own), F.concat(F.lit("the firm v. "), own),
    ]
    text = F.element_at(F.array(*ways), (k % 7 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(k.cast("string").alias("doc_id"), F.concat(text, F.lit(", 5 F.3d "), (k + 1).cast("string"), F.lit(" (9th Cir. 1999).")).alias("text"))


def name_readings(spark, sf_dir):
    """the name of each citation, how it was found, and whether a first reading of its parties differs."""
    rows = citation_mentions(scan_documents(_named_texts(spark, sf_dir)))
    return rows.select("doc_id", "case_name", "name_source", "name_note", "verbatim")


def extraction_advisories(spark, sf_dir):
    """V1, V4: what was noted when names were read, and names that only nearly fit the case that has the citation, as advisories of findings."""
    k = F.col("c_custkey")
    page = (k + 1).cast("string")
    c = table(spark, sf_dir, "customer").select(k)
    name = F.when(k % 2 == 0, F.concat(F.lit("El Rio "), _letters(k), F.lit(" v. Birch"))).otherwise(F.concat(_letters(k), F.lit(" Alder v. Birch")))
    texts = c.select(k.cast("string").alias("doc_id"), F.concat(name, F.lit(", 5 F.3d "), page, F.lit(" (9th Cir. 1999).")).alias("text"))
    record = [k.cast("bigint").alias("cluster_id"), F.lit("Rio Cedar Alder v. Birch").alias("case_name"), F.array(F.concat(F.lit("5 F.3d "), page)).alias("citations"), F.lit("9th Cir.").alias("court"), F.lit("ca9").alias("court_id")]
    cases = c.select(*record, F.lit("1999-01-01").alias("date_filed"), F.lit(None).cast("string").alias("absolute_url"), F.lit(None).cast("string").alias("snippet"))
    done = audit(texts, stage(cases, "cases"))
    return done.findings.select("doc_id", "rule", F.array_join("advisories", "; ").alias("advisories"))


_OWN = "upper(left({0}, 1)) || substr({0}, 2)".format("translate((c_custkey + 1000000)::VARCHAR, '0123456789', 'abcdefghij')")
_NAMED_SQL = f"""WITH c AS (SELECT c_custkey AS k, c_custkey % 7 AS way, {_OWN} AS own FROM customer),
      n AS (
        SELECT *, [own || ' Co. v. Birch', 'Rio ' || own || ' v. Birch Bank', own || ' v. Delta (UK) Lines', own || ' Corp. v. Birch', 'Bros. of Mt. ' || own || ' v. Pine St. Co.', 'AB v. ' || own, NULL][way + 1] AS name,
               ['anchor', 'anchor', 'anchor', 'parties', 'anchor', 'pattern', NULL][way + 1] AS name_source,
               CASE way WHEN 1 THEN 'the parties were first read as ''El Rio ' || own || ' v. Birch Bank''; the text has ''Rio ' || own || ' v. Birch Bank'', which is used' END AS name_note FROM c)"""

# -- totals, counters, streams, table functions ----------------------------------------------------------------------


def verdict_rollup(spark, sf_dir):
    """A1-A5 over all documents: verdicts by court, reporter and verdict, with all totals."""
    return R.corpus_report(verdict_rows(spark, sf_dir).select("court", "reporter", "verdict"))


def _attempts(spark, sf_dir):
    """Events as tries of requests: errors of small value are told to wait, those of great value fail, others of a user after the first are cached."""
    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    again = F.coalesce(F.lag("event_type").over(order) == "error", F.lit(False))
    status = F.when((F.col("event_type") == "error") & (F.col("value") < 10), 429).when(F.col("event_type") == "error", 500).otherwise(200)
    rows = e.select("event_id", status.alias("status"), F.when(again, 2).otherwise(1).alias("attempt"), F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 7).cast("string")).alias("header"), ((F.row_number().over(order) > 1) & (F.col("event_type") != "error") & ~again).alias("cached"))
    return rows


def client_counters(spark, sf_dir):
    """The six counters of a client, observed while its replies are written."""
    passed, counters = observed(_attempts(spark, sf_dir))
    stage(passed, "attempts")
    return spark.createDataFrame([tuple(counters.get[c] for c in COUNTERS)], "requests long, cache_hits long, throttle_waits long, throttle_seconds double, retries long, errors long")


def _event_stream(spark, sf_dir):
    """The events as they arrive, of a table that is one file or many."""
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, as a stream's path may be no file otherwise


def streamed_request_counts(spark, sf_dir):
    """§2.11, A16: requests of a stream of all events by window of a day and outcome."""
    stream = _event_stream(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), F.coalesce("event_type", F.lit("none")).alias("outcome"))
    counts, path = request_counts(stream, width="1 day"), _new_path(spark, "counts")

    def run(batch, number):
        batch.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "outcome", "requests").write.mode("overwrite").parquet(path)

    counts.writeStream.foreachBatch(run).outputMode("complete").option("checkpointLocation", _new_path(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)


def streamed_job_states(spark, sf_dir):
    """K11, §2.11: users as jobs, known from their first view on, followed through a stream of all events."""
    stream = _event_stream(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("doc_id"), F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "error", "fail").otherwise("progress").alias("kind"), (F.col("value") / 100).alias("fraction")
    )
    path = _new_path(spark, "jobs")
    job_states(stream, path, _new_path(spark, "checkpoint"), expiry="3650 days").awaitTermination()
    return stored(spark, path).select("doc_id", F.bround("fraction", 6).alias("fraction"), "status")


def citations_by_sql(spark, sf_dir):
    """P1, F17-F21, §2.12: briefs scanned by table functions in SQL."""
    register(spark)
    name = f"briefs_{uuid.uuid4().hex}"
    D.briefs(spark, sf_dir).createOrReplaceTempView(name)
    return spark.sql(f"""
        SELECT b.doc_id, c.matched_text, c.volume, c.reporter, c.page, c.s AS start, n.sentences
        FROM {name} b, LATERAL extract_citations(b.text) c
        JOIN (SELECT doc_id, CAST(count(*) AS INT) AS sentences FROM {name}, LATERAL split_sentences(text) GROUP BY doc_id) n ON b.doc_id = n.doc_id
        WHERE c.form = 'full'""")


def empty_reports(spark, sf_dir):
    """Reports of texts of which two thirds cite nothing, against a corpus without cases."""
    k = F.col("c_custkey")
    text = F.when(k % 3 == 0, "No authority is cited here.").when(k % 3 == 1, F.lit(None)).otherwise(F.concat(_letters(k), F.lit(" v. Birch, 5 F.3d 7 (9th Cir. 1999).")))
    docs = table(spark, sf_dir, "customer").select(k.cast("string").alias("doc_id"), text.alias("text"))
    done = audit(docs, D.cases(spark, sf_dir).limit(0))
    return done.reports.select("doc_id", "fabricated", "total", "integrity_score", "check_coverage", "other_citations")


QUERIES = {f.__name__: f for f in (common_name_evidence, report_store, reply_store, stored_corpus_audit, phrase_hits, phrase_quote_checks, name_readings, extraction_advisories, verdict_rollup, client_counters, streamed_request_counts, streamed_job_states, citations_by_sql, empty_reports)}
ORACLES = {
    "common_name_evidence": COMMON_NAME_SQL,
    "name_readings": f"{_NAMED_SQL} SELECT k::VARCHAR AS doc_id, name AS case_name, name_source, name_note, coalesce(name || ', ', '') || '5 F.3d ' || (k + 1) || ' (9th Cir. 1999)' AS verbatim FROM n",
    "extraction_advisories": f"""WITH c AS (SELECT c_custkey AS k, {_OWN} AS own FROM customer), n AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'Rio ' || own ELSE own || ' Alder' END || ' v. Birch' AS name FROM c)
      SELECT k::VARCHAR AS doc_id, 'D3' AS rule, CASE WHEN k % 2 = 0 THEN 'the parties were first read as ''El ' || name || '''; the text has ''' || name || ''', which is used; ' ELSE '' END
             || 'the name given, ''' || name || ''', differs from the recorded ''Rio Cedar Alder v. Birch''' AS advisories FROM n""",
    "verdict_rollup": f"""{JUDGED}, r AS (SELECT coalesce(court, CASE reporter WHEN 'U.S.' THEN 'scotus' END) AS court, reporter, verdict FROM v)
      SELECT court, reporter, verdict, grouping_id(court, reporter, verdict)::BIGINT AS grouping_id, count(*) AS citations, count(*) FILTER (verdict IN ('fabricated', 'miscited')) AS wrong
      FROM r GROUP BY GROUPING SETS ((), (court), (reporter), (verdict), (court, verdict), (reporter, verdict), (court, reporter, verdict))""",
    "client_counters": """
    WITH o AS (SELECT *, coalesce(lag(event_type) OVER w = 'error', false) AS again, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      a AS (SELECT *, event_type = 'error' AS bad, coalesce(event_type = 'error' AND value < 10, false) AS wait, coalesce(n > 1 AND event_type <> 'error' AND NOT again, false) AS cached FROM o)
    SELECT count(*) FILTER (NOT cached) AS requests, count(*) FILTER (cached) AS cache_hits, count(*) FILTER (wait) AS throttle_waits,
           coalesce(sum(CASE WHEN wait THEN CASE WHEN event_id % 3 = 0 THEN 36.0 ELSE greatest(0.5, event_id % 7) END END), 0)::DOUBLE AS throttle_seconds,
           count(*) FILTER (NOT cached AND again) AS retries, count(*) FILTER (bad AND NOT wait) AS errors FROM a""",
    "streamed_request_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, coalesce(event_type, 'none') AS outcome, count(*) AS requests FROM events GROUP BY ALL",
    "streamed_job_states": """
    WITH s AS (SELECT user_id, min(ts) AS began FROM events WHERE event_type = 'view' GROUP BY user_id),
      e AS (SELECT user_id, round_even(greatest(0.0, max(least(1.0, coalesce(value, 0) / 100))), 6)::DOUBLE AS fraction, bool_or(event_type = 'error') AS failed FROM events JOIN s USING (user_id) WHERE ts >= began GROUP BY user_id)
    SELECT user_id::VARCHAR AS doc_id, fraction, CASE WHEN failed THEN 'failed' WHEN fraction >= 1 THEN 'done' WHEN fraction > 0.7 THEN 'checking' ELSE 'verifying' END AS status FROM e""",
    "citations_by_sql": f"""{JUDGED}, w AS (SELECT *, coalesce(case_name || ', ', 'See ') AS lead, matched_text || ' (' || concat_ws(' ', court, year) || ')' AS tail FROM j)
      SELECT doc_id, matched_text, volume, reporter, page, (coalesce(sum(length(lead) + length(tail) + 2) OVER (d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(lead))::INT AS "start", (count(*) OVER (PARTITION BY doc_id))::INT AS sentences
      FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY o_orderkey)""",
    "empty_reports": """SELECT c_custkey::VARCHAR AS doc_id, (c_custkey % 3 = 2)::BIGINT AS fabricated, (c_custkey % 3 = 2)::BIGINT AS total, CASE WHEN c_custkey % 3 = 2 THEN 0.0 END::DOUBLE AS integrity_score,
      CASE WHEN c_custkey % 3 = 2 THEN 100.0 END::DOUBLE AS check_coverage, 0::BIGINT AS other_citations FROM customer""",
    "report_store": "SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END::INT AS version, length(text)::INT AS size, '# Version ' || CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS markdown FROM documents",
    "reply_store": """
    WITH r AS (SELECT user_id, event_id, epoch_us(ts) AS micros, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) DESC, '{"event": ' || event_id || '}' DESC) AS n FROM events)
    SELECT user_id, CASE WHEN (SELECT max(epoch_us(ts)) FROM events) - micros <= 86400000000 THEN event_id END AS event_id FROM r WHERE n = 1""",
    "stored_corpus_audit": f"{JUDGED} SELECT rule, verdict, error_class, count(*) AS n, count(resolved) AS resolved FROM v GROUP BY ALL",
    "phrase_hits": f"""WITH p AS (SELECT item_id AS id, {_PLAIN.format(_TWELVE.format(_SPACED))} AS phrase FROM benchmark), {_HELD}
      SELECT id AS item_id, coalesce(hits, 0) AS hits, first_doc FROM p LEFT JOIN h USING (id)""",
    "phrase_quote_checks": f"""
    WITH q AS (SELECT item_id AS id, CASE WHEN item_id % 4 = 3 THEN array_to_string(list_reverse(string_split({_SPACED}, ' ')), ' ') ELSE {_SPACED} END AS said FROM benchmark),
      p AS (SELECT id, {_PLAIN.format('said')} AS quote, {_PLAIN.format(_TWELVE.format('said'))} AS phrase FROM q), {_HELD},
      s AS (SELECT p.id, CASE WHEN quote = '' THEN NULL WHEN length(quote) < 40 OR len(string_split(quote, ' ')) < 6 THEN 'skipped' WHEN hits IS NULL THEN 'corpus_miss' ELSE 'corpus_hit' END AS status, hits, first_doc FROM p LEFT JOIN h USING (id))
    SELECT id::VARCHAR AS doc_id, status, CASE status WHEN 'corpus_hit' THEN hits WHEN 'corpus_miss' THEN 0 END::BIGINT AS hits, CASE WHEN status = 'corpus_hit' THEN 'Document ' || first_doc END AS matched_case FROM s""",
}
