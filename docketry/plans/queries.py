"""Queries over the driver's tables, one or more for each group of operators, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docketry.functions import fixed
from docketry.functions import names as N
from docketry.functions import text as X
from docketry.operators import benchmark as B
from docketry.operators import quotes as Q
from docketry.operators import reports as R
from docketry.operators.extract import attribute_short_forms, citation_mentions, extract_citations, scan_documents
from docketry.operators.search import match_names, match_slots
from docketry.operators.support import clean_reply, parse_reply
from docketry.operators.verdicts import slot_note
from docketry.plans import derived as D
from docketry.plans.audit import audit
from docketry.plans.checks import ADVISORY_SQL, EVIDENCE_SQL
from docketry.plans.checks import ORACLES as CHECKED
from docketry.plans.checks import QUERIES as CHECKS
from docketry.plans.corpora import ORACLES as OF_CORPORA
from docketry.plans.corpora import QUERIES as CORPORA
from docketry.plans.derived import table
from docketry.plans.stated import JUDGED, stated_citations, verdict_rows
from docketry.sources.files import admitted
from docketry.sources.shared import stage

ASCII_SPACE = "[ \\t\\n\\x0B\\f\\r]"


def normalize_documents(spark, sf_dir):
    """White space."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.normalized("text")).alias("text_md5"), F.length(X.normalized("text")).alias("n"))


def admitted_documents(spark, sf_dir):
    """Texts by the reason to reject them."""
    accepted, rejected = admitted(table(spark, sf_dir, "documents").select("text"))
    return accepted.withColumn("reason", F.lit("accepted")).union(rejected).groupBy("reason").agg(F.count("*").alias("n"))


def cite_key_lookup(spark, sf_dir):
    """Stated citations joined with the cases that list them."""
    return match_slots(stated_citations(spark, sf_dir), D.cases(spark, sf_dir))


def case_name_similarity(spark, sf_dir):
    """Names of customers against names of suppliers and parts."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("The "), F.replace("c_name", F.lit("#"), F.lit(" ")), F.lit(" Co. v. "), F.col("c_mktsegment")).alias("cited"))
    s = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).alias("c_custkey"), F.concat(F.upper(F.replace("c_name", F.lit("#"), F.lit(" "))), F.lit(", Inc. v "), F.col("c_mktsegment")).alias("candidate"))
    both = c.join(s, "c_custkey")
    return both.select("c_custkey", F.bround(N.name_similarity("cited", "candidate"), 4).alias("sim"), N.plain_name("cited").alias("plain"))


def name_match_top1(spark, sf_dir):
    """The best case by name of each stated citation."""
    cited = stage(stated_citations(spark, sf_dir), "stated")
    best = F.row_number().over(Window.partitionBy("doc_id", "idx").orderBy(F.desc("sim"), "cluster_id"))
    return match_names(cited, stage(D.cases(spark, sf_dir), "cases")).withColumn("_n", best).where("_n = 1").select("doc_id", "idx", "cluster_id", "sim")


def slot_owner_unrelated(spark, sf_dir):
    """Citations whose slot other cases hold only."""
    rows = verdict_rows(spark, sf_dir).where("slot_owner is not null")
    return rows.select("doc_id", "idx", "error_class", F.col("slot_owner.cluster_id").alias("owner"))


def verdict_findings(spark, sf_dir):
    """D1-D10 over all stated citations."""
    return verdict_rows(spark, sf_dir).select("doc_id", "idx", "rule", "verdict", "error_class", "confidence", F.col("resolved.cluster_id").alias("resolved"), F.col("slot_owner.cluster_id").alias("owner"), "suggestion")


def audit_report(spark, sf_dir):
    """A1-A5: briefs read from their text, checked and counted."""
    done = audit(D.briefs(spark, sf_dir), stage(D.cases(spark, sf_dir), "cases"))
    return done.reports.select("doc_id", "verified", "fabricated", "miscited", "unverifiable", "checkable", "total", "integrity_score", "check_coverage", "other_citations")


def verdict_counts(spark, sf_dir):
    """The flagship: verdicts of all briefs, read from text, by rule."""
    done = audit(D.briefs(spark, sf_dir), stage(D.cases(spark, sf_dir), "cases"))
    return done.findings.groupBy("rule", "verdict", "error_class").agg(F.count("*").alias("n"), F.bround(F.avg("confidence"), 4).alias("confidence"))


_EXPECTED = {0: "real", 1: "real", 2: "fabricated", 3: "fabricated", 4: "miscited", 5: "miscited", 6: "real", 7: "real"}


def _stated_matches(spark, sf_dir):
    rows = verdict_rows(spark, sf_dir)
    expected = F.element_at(F.create_map(*(x for k, v in _EXPECTED.items() for x in (F.lit(k), F.lit(v)))), F.col("way"))
    return rows.select("doc_id", "idx", expected.alias("expected"), B.predicted_label(F.col("verdict")).alias("predicted"))


def benchmark_metrics(spark, sf_dir):
    """Precision and recall of the labels that the briefs are made to have."""
    return B.detection_metrics(_stated_matches(spark, sf_dir))


def benchmark_summary(spark, sf_dir):
    """A15."""
    return B.summary(_stated_matches(spark, sf_dir))


def confusion_matrix(spark, sf_dir):
    """A14."""
    return B.confusion_matrix(_stated_matches(spark, sf_dir))


def expected_matching(spark, sf_dir):
    """Expected citations met by key or by name, and those missed."""
    found = verdict_rows(spark, sf_dir).where("way <> 6").select("doc_id", "idx", "cite_key", "case_name", "verdict", "error_class", "confidence")
    stated = stated_citations(spark, sf_dir)
    expected = stated.select("doc_id", F.col("idx").alias("entry"), F.when(F.col("idx") % 3 != 0, F.col("cite_key")).alias("key"), X.blank_to_null(N.plain_name("case_name")).alias("name"), F.lit("real").alias("expected"), F.col("matched_text").alias("citation"))
    met = B.match_expected(expected, found)
    return met.select("doc_id", "entry", F.col("idx").alias("met"), "predicted")


def extracted_citations(spark, sf_dir):
    """Citations read from the briefs' text."""
    rows = extract_citations(D.briefs(spark, sf_dir))
    return rows.select("doc_id", "idx", "matched_text", "cite_key", "case_name", "plaintiff", "defendant", "court", "court_id", "court_source", "year", "verbatim", F.col("spans")[0]["s"].alias("start"))


def _repeating(spark, sf_dir):
    """Texts that cite an authority again, in full, short and by Id."""
    rows = D.brief_citations(spark, sf_dir).select("doc_id", "o_orderkey", "case_name", "volume", "reporter", "page", "written", "matched_text")
    again = F.concat(F.lit("As shown in "), F.col("volume"), F.lit(" "), F.col("reporter"), F.lit(", at "), F.col("page"), F.lit(", this holds. "), F.lit("Id. at 7. "), F.lit("Compare "), F.col("matched_text"), F.lit(". "))
    rows = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", F.concat("written", F.lit(" "), again).alias("t")))).alias("_all"))
    return rows.select("doc_id", F.array_join(F.transform("_all", lambda x: x["t"]), "").alias("text"))


def merged_authorities(spark, sf_dir):
    """Authorities with all their mentions."""
    rows = extract_citations(_repeating(spark, sf_dir).where("length(text) > 0"))
    return rows.select("doc_id", "idx", "cite_key", "occurrence_count", "case_name")


def short_form_targets(spark, sf_dir):
    """What each short form and Id. repeats."""
    rows = attribute_short_forms(citation_mentions(scan_documents(_repeating(spark, sf_dir))))
    return rows.select("doc_id", "pos", "form", F.col("target"))


def turn_carry(spark, sf_dir):
    """J9 over conversations, read as documents: user turns as full citations, others as Id., which repeat the latest of them."""
    rows = table(spark, sf_dir, "conversations").where("role is not null").select(
        "conv_id", F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.col("turn").alias("s"), F.when(F.col("role") == "user", "full").otherwise("id").alias("form"),
        F.lit("case").alias("kind"), F.lit(None).cast("string").alias("cite_key"), F.lit(None).cast("string").alias("reporter"),
    )
    return attribute_short_forms(rows).select("conv_id", F.col("pos").alias("turn"), "form", "target")


def court_normalize(spark, sf_dir):
    """Courts given and recorded, in comparable form."""
    rows = verdict_rows(spark, sf_dir)
    return rows.select("doc_id", "idx", X.court_token("court").alias("given"), X.court_token("resolved.court").alias("recorded"), F.exists("advisories", lambda a: a.startswith("court given")).alias("differs"))


def year_advisory(spark, sf_dir):
    """Years read from dates written in several ways."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("undated")
    return rows.select("o_orderkey", X.year_in(text).alias("year"), (X.year_in(text) != (F.col("o_orderkey") % 7 + 1992).cast("string")).alias("differs"))


def slot_reliability(spark, sf_dir):
    """Citations whose absence says little."""
    rows = stated_citations(spark, sf_dir).withColumn("volume", F.when(F.col("idx") % 11 == 0, F.lit("2013")).otherwise(F.col("volume"))).withColumn("cite_key", F.when(F.col("idx") % 13 != 0, F.col("cite_key")))
    note = slot_note()
    return rows.select("doc_id", "idx", note.isNull().alias("reliable"), F.substring(note, 1, 12).alias("why"))


def quote_containment(spark, sf_dir):
    """Which documents hold which benchmark passages."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return Q.contained_quotes(items, docs).select(F.col("quote_id").alias("item_id"), F.col("source_id").alias("doc_id"))


def distinctive_quotes(spark, sf_dir):
    """F11, P9, O6."""
    t = table(spark, sf_dir, "benchmark")
    return t.select("item_id", X.is_distinctive("text").alias("distinctive"), F.length(X.comparable_quote("text")).alias("n"), X.comparable_quote(Q.quote_phrase(F.col("text"))).alias("phrase"))


def quote_variant(spark, sf_dir):
    """the words that a document has where a passage begins."""
    items, docs = table(spark, sf_dir, "benchmark").select("item_id", "text"), table(spark, sf_dir, "documents").select("doc_id", "text")
    held = Q.contained_quotes(items.select(F.col("item_id").alias("id"), "text"), docs.select(F.col("doc_id").alias("id"), "text"))
    rows = held.join(items.withColumnRenamed("text", "quote"), F.col("quote_id") == F.col("item_id")).join(docs, F.col("source_id") == F.col("doc_id"))
    return rows.select("item_id", "doc_id", F.md5(Q.closest_words(X.comparable_quote("text"), X.comparable_quote("quote"))).alias("words_md5"))


def passage_top3(spark, sf_dir):
    """Lines of documents that share most terms with a document's first line, scored and ranked."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("_lines"))
    parts = docs.select("doc_id", F.get("_lines", F.lit(0)).alias("sentence"), F.posexplode("_lines").alias("at", "passage"))
    return Q.rank_passages(parts.where("at > 0"))


def best_passages(spark, sf_dir):
    """F30 as an expression: the passage of a page for its own title."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), X.without_markup("html").alias("body"))
    return pages.select("page_id", F.md5(Q.best_passage(F.col("body"), F.col("title"))).alias("passage_md5"))


def strip_html(spark, sf_dir):
    """F13."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(X.without_markup("html")).alias("text_md5"))


def sentence_context(spark, sf_dir):
    """Sentences of briefs, and the context of each citation."""
    scanned = scan_documents(D.briefs(spark, sf_dir))
    rows = citation_mentions(scanned).join(scanned.select("doc_id", F.size("ends").alias("sentences")), "doc_id")
    return rows.select("doc_id", "pos", "sentences", F.length("context").alias("n"))


def severity_order(spark, sf_dir):
    """The gravest finding of each brief."""
    rows = verdict_rows(spark, sf_dir)
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(R.severity(F.col("verdict")), "idx"))
    return rows.withColumn("_n", first).where("_n = 1").select("doc_id", "idx", "verdict")


def span_segments(spark, sf_dir):
    """Briefs cut at their citations."""
    mentions = scan_documents(D.briefs(spark, sf_dir)).select("doc_id", "text", F.transform("mentions", lambda m, i: F.struct(m["s"].alias("s"), m["e"].alias("e"), i.alias("id"))).alias("spans"))
    cut = mentions.select("doc_id", F.length("text").alias("n"), R.span_segments(F.col("text"), F.col("spans")).alias("seg"))
    return cut.select("doc_id", "n", F.size("seg").alias("segments"), F.size(F.filter("seg", lambda s: s["id"].isNotNull())).alias("highlighted"))


def request_cache_stats(spark, sf_dir):
    """Events as requests: distinct ones, and hits of those asked before."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", X.request_key(F.lit("GET"), F.concat(F.lit("/u/"), F.col("user_id").cast("string")), F.col("event_type")).alias("key"))
    hit = F.row_number().over(Window.partitionBy("key").orderBy("ts", "event_id")) > 1
    return e.withColumn("hit", hit).groupBy(F.substring("key", 1, 1).alias("shard")).agg(F.count("*").alias("requests"), F.count_if("hit").alias("hits"), F.count_distinct("key").alias("stored"))


def latest_replies(spark, sf_dir):
    """The newest event of each user."""
    return B.latest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), "user_id", "ts").select("user_id", "event_id")


def report_markdown(spark, sf_dir):
    """Reports as Markdown."""
    done = audit(D.briefs(spark, sf_dir), stage(D.cases(spark, sf_dir), "cases"))
    out = R.to_markdown(done.reports, done.findings, D.briefs(spark, sf_dir).select("doc_id", "title"))
    return out.select("doc_id", F.length("markdown").alias("n"), F.md5("markdown").alias("markdown_md5"))


def report_exit_codes(spark, sf_dir):
    """K6."""
    return R.any_wrong(verdict_rows(spark, sf_dir))


def model_reply_parse(spark, sf_dir):
    """replies in several forms, made from part rows."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    body = F.format_string('{"support": "%s", "confidence": %d.5, "rationale": "r", "passage": "%s"}', F.element_at(F.array(F.lit("Not Supported"), F.lit("partial"), F.lit("maybe")), (F.col("p_partkey") % 3 + 1).cast("int")), F.col("p_size") % 3 - 1, F.col("p_name"))
    reply = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("Sure: "), body, F.lit(" Done."))).when(F.col("p_partkey") % 4 == 2, body).otherwise("no")
    said = clean_reply(parse_reply(reply), F.concat(F.col("p_name"), F.lit(" and more")))
    return p.select("p_partkey", said["support"].alias("support"), said["confidence"].alias("confidence"), said["passage"].alias("passage"))


def label_metrics(spark, sf_dir):
    """A12-A14 over labels: quality against a rule on length."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    named = rows.select(F.when(F.col("quality") == 1, "real").otherwise("fabricated").alias("expected"), F.when(F.col("n_chars") >= 800, "real").otherwise("fabricated").alias("predicted"))
    return B.detection_metrics(named)


QUERIES = {
    f.__name__: f
    for f in (
        verdict_counts, normalize_documents, admitted_documents, cite_key_lookup, case_name_similarity, name_match_top1, slot_owner_unrelated, verdict_findings, audit_report, benchmark_metrics, benchmark_summary,
        confusion_matrix, expected_matching, extracted_citations, merged_authorities, short_form_targets, turn_carry, court_normalize, year_advisory, slot_reliability, quote_containment, distinctive_quotes,
        quote_variant, passage_top3, best_passages, strip_html, sentence_context, severity_order, span_segments, request_cache_stats, latest_replies, report_markdown, report_exit_codes, model_reply_parse, label_metrics,
    )
}
QUERIES |= CHECKS | CORPORA

_PREDICTED = "CASE verdict WHEN 'verified' THEN 'real' ELSE verdict END"
_WAYS = "CASE WHEN way IN (0, 1, 6, 7) THEN 'real' WHEN way IN (2, 3) THEN 'fabricated' ELSE 'miscited' END"
_METRICS = """, labels3 AS (SELECT unnest(['real', 'fabricated', 'miscited']) AS label),
  k AS (SELECT label, count(*) FILTER (e = label AND p = label) AS true_positive, count(*) FILTER (e <> label AND p = label) AS false_positive, count(*) FILTER (e = label AND p <> label) AS false_negative FROM m, labels3 GROUP BY label),
  pr AS (SELECT *, round_even(true_positive / nullif(true_positive + false_positive, 0), 4) AS precision, round_even(true_positive / nullif(true_positive + false_negative, 0), 4) AS recall FROM k)
  SELECT *, CASE WHEN precision = 0 OR recall = 0 THEN 0.0 ELSE round_even(2 * precision * recall / (precision + recall), 4) END AS f1 FROM pr"""
_WS = "'[ \\t\\n\\x0B\\f\\r]+'"
_QUOTE = "lower(trim(regexp_replace(regexp_replace(replace(translate(coalesce({0}, ''), '“”‘’\"''…', '       '), '...', ' '), '\\[[^\\]]*\\]', ' ', 'g'), '[^A-Za-z0-9]+', ' ', 'g')))"
_TERMS = "list_distinct(list_filter(list_transform(regexp_extract_all({0}, '[A-Za-z][A-Za-z''\\-]{{2,}}'), lambda w: lower(w)), lambda w: NOT list_contains([" + ", ".join(f"'{w}'" for w in fixed.STOPWORDS) + "], w)))"
_STRIPPED = """trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), chr(13) || chr(10), chr(10)), chr(13), chr(10)),
      '[ \\t\\f\\x0B]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"""
_REPEATING = f"""WITH {D.CASES_SQL}, r AS (SELECT *, {D.KEY_SQL.format('')} AS cite_key FROM bc)"""

ORACLES = {
    "verdict_counts": f"{JUDGED} SELECT rule, verdict, error_class, count(*) AS n, round_even(avg(confidence), 4) AS confidence FROM v GROUP BY ALL",
    "normalize_documents": f"SELECT doc_id, md5(trim(regexp_replace(coalesce(text, ''), {_WS}, ' ', 'g'))) AS text_md5, length(trim(regexp_replace(coalesce(text, ''), {_WS}, ' ', 'g')))::INT AS n FROM documents",
    "admitted_documents": """SELECT CASE WHEN n = 0 THEN 'empty' WHEN n > 400000 THEN 'too long' ELSE 'accepted' END AS reason, count(*) AS n
      FROM (SELECT length(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS n FROM documents) GROUP BY 1""",
    "cite_key_lookup": f"{JUDGED} SELECT j.doc_id, j.o_orderkey::INT AS idx, o.o_orderkey AS cluster_id FROM j JOIN oc o ON {D.KEY_SQL.format('o.')} = j.cite_key",
    "case_name_similarity": """
      SELECT a.c_custkey, CASE WHEN a.c_mktsegment = b.c_mktsegment THEN 0.5 ELSE 0.0 END::DOUBLE AS sim, lower(concat('the ', replace(a.c_name, '#', ' '), ' co v ', a.c_mktsegment)) AS plain
      FROM customer a JOIN customer b ON a.c_custkey = b.c_custkey + 1""",
    "name_match_top1": f"{JUDGED} SELECT doc_id, o_orderkey::INT AS idx, o_orderkey AS cluster_id, 1.0::DOUBLE AS sim FROM j WHERE way NOT IN (2, 3, 6)",
    "slot_owner_unrelated": f"{JUDGED} SELECT doc_id, o_orderkey::INT AS idx, error_class, owner FROM v WHERE owner IS NOT NULL",
    "verdict_findings": f"{JUDGED} SELECT doc_id, o_orderkey::INT AS idx, rule, verdict, error_class, confidence, resolved, owner, suggestion FROM v",
    "audit_report": f"""{JUDGED}, c AS (
      SELECT doc_id, count(*) FILTER (verdict = 'verified') AS verified, count(*) FILTER (verdict = 'fabricated') AS fabricated, count(*) FILTER (verdict = 'miscited') AS miscited,
             count(*) FILTER (verdict = 'unverifiable') AS unverifiable FROM v GROUP BY doc_id)
      SELECT *, verified + fabricated + miscited AS checkable, verified + fabricated + miscited + unverifiable AS total, round_even(100.0::DOUBLE * verified / nullif(verified + fabricated + miscited, 0), 1) AS integrity_score,
             round_even(100.0::DOUBLE * (verified + fabricated + miscited) / (verified + fabricated + miscited + unverifiable), 1) AS check_coverage, 0::BIGINT AS other_citations FROM c""",
    "benchmark_metrics": f"{JUDGED}, m AS (SELECT {_WAYS} AS e, {_PREDICTED} AS p FROM v) {_METRICS}",
    "benchmark_summary": f"""{JUDGED}, m AS (SELECT {_WAYS} AS e, {_PREDICTED} AS p FROM v)
      SELECT count(*) AS citations_expected, count(*) AS citations_found, 0::BIGINT AS citations_missed, count(*) FILTER (e = p) AS correct_verdicts, count(*) FILTER (p <> 'unverifiable') AS citations_decided,
             count(*) FILTER (p = 'unverifiable') AS citations_unverifiable, round_even(count(*) FILTER (e = p) / count(*), 4) AS verdict_accuracy,
             round_even(count(*) FILTER (e = p) / count(*) FILTER (p <> 'unverifiable'), 4) AS verdict_accuracy_of_decided FROM m""",
    "confusion_matrix": f"""{JUDGED}, m AS (SELECT {_WAYS} AS label, {_PREDICTED} AS p FROM v)
      SELECT label, count(*) FILTER (p = 'real') AS real, count(*) FILTER (p = 'fabricated') AS fabricated, count(*) FILTER (p = 'miscited') AS miscited, 0::BIGINT AS undecided, count(*) FILTER (p = 'unverifiable') AS unverifiable FROM m GROUP BY label""",
    "expected_matching": f"""{JUDGED}, f AS (SELECT * FROM v WHERE way <> 6), b AS (SELECT e.doc_id, e.o_orderkey, min(f.o_orderkey) AS x FROM v e JOIN f ON e.doc_id = f.doc_id AND e.o_orderkey % 3 <> 0 AND e.cite_key = f.cite_key GROUP BY ALL),
      n AS (SELECT e.doc_id, e.o_orderkey, min(f.o_orderkey) AS x FROM v e JOIN f ON e.doc_id = f.doc_id AND e.case_name = f.case_name GROUP BY ALL)
      SELECT e.doc_id, e.o_orderkey::INT AS entry, coalesce(b.x, n.x)::INT AS met, CASE f.verdict WHEN 'verified' THEN 'real' ELSE f.verdict END AS predicted
      FROM v e LEFT JOIN b USING (doc_id, o_orderkey) LEFT JOIN n USING (doc_id, o_orderkey) LEFT JOIN f ON f.o_orderkey = coalesce(b.x, n.x)""",
    "extracted_citations": f"""{JUDGED}, w AS (
        SELECT *, coalesce(case_name || ', ', 'See ') AS lead, matched_text || ' (' || concat_ws(' ', court, year) || ')' AS tail FROM j),
      p AS (SELECT *, coalesce(sum(length(lead) + length(tail) + 2) OVER (PARTITION BY doc_id ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w)
      SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY o_orderkey) - 1)::INT AS idx, matched_text, cite_key, case_name, split_part(case_name, ' v. ', 1) AS plaintiff, split_part(case_name, ' v. ', 2) AS defendant,
        coalesce(court, CASE reporter WHEN 'U.S.' THEN 'scotus' END) AS court, coalesce(court_id, CASE reporter WHEN 'U.S.' THEN 'scotus' END) AS court_id,
        CASE WHEN court IS NOT NULL THEN 'document' WHEN reporter = 'U.S.' THEN 'reporter' END AS court_source, year, coalesce(case_name || ', ', '') || tail AS verbatim, (before + length(lead))::INT AS "start" FROM p""",
    "merged_authorities": f"{_REPEATING} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY o_orderkey) - 1)::INT AS idx, cite_key, 4 AS occurrence_count, case_name FROM r",
    "short_form_targets": f"""{_REPEATING}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o_orderkey) - 1 AS k FROM r)
      SELECT doc_id, (4 * k + f.i)::INT AS pos, f.form, (4 * k + f.t)::INT AS target FROM n, (VALUES (0, 'full', 0), (1, 'short', 0), (2, 'id', 0), (3, 'full', 3)) f(i, form, t)""",
    "turn_carry": """SELECT conv_id, turn, CASE role WHEN 'user' THEN 'full' ELSE 'id' END AS form,
      CASE WHEN role = 'user' THEN turn ELSE last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS target FROM conversations WHERE role IS NOT NULL""",
    "court_normalize": f"""{JUDGED}, t AS (
        SELECT *, coalesce(court, CASE reporter WHEN 'U.S.' THEN 'scotus' END, '') AS g, CASE WHEN resolved IS NULL THEN '' ELSE own_court END AS r FROM v),
      n AS (SELECT *, replace(replace(lower(g), '.', ''), ' ', '') AS g1, replace(replace(lower(r), '.', ''), ' ', '') AS r1 FROM t),
      k AS (SELECT *, CASE WHEN regexp_matches(g1, '^[0-9]+(st|th)cir') THEN 'ca' || regexp_extract(g1, '^([0-9]+)', 1) ELSE g1 END AS given, CASE WHEN regexp_matches(r1, '^[0-9]+(st|th)cir') THEN 'ca' || regexp_extract(r1, '^([0-9]+)', 1) ELSE r1 END AS recorded FROM n)
      SELECT doc_id, o_orderkey::INT AS idx, given, recorded, court IS NOT NULL AND verdict <> 'unverifiable' AND recorded <> '' AND given <> recorded AS differs FROM k""",
    "year_advisory": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%Y') END AS year, CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%Y') END <> (o_orderkey % 7 + 1992)::VARCHAR AS differs FROM orders""",
    "slot_reliability": f"""{JUDGED} SELECT doc_id, o_orderkey::INT AS idx, o_orderkey % 13 <> 0 AND reporter <> 'WL' AND o_orderkey % 11 <> 0 AS reliable,
      CASE WHEN o_orderkey % 13 = 0 THEN 'no reporter ' WHEN reporter = 'WL' THEN 'WL citations' WHEN o_orderkey % 11 = 0 THEN left('''' || matched_text || ''' is a public', 12) END AS why FROM j""",
    "quote_containment": f"""WITH q AS (SELECT item_id, {_QUOTE.format('text')} AS q FROM benchmark), s AS (SELECT doc_id, {_QUOTE.format('text')} AS s FROM documents)
      SELECT item_id, doc_id FROM q JOIN s ON q <> '' AND contains(s, q)""",
    "distinctive_quotes": f"""WITH q AS (SELECT item_id, text, {_QUOTE.format('text')} AS q FROM benchmark),
      w AS (SELECT *, array_to_string(list_slice(string_split(trim(regexp_replace(regexp_replace(trim(text), '^["“”]+|["“”]+$', '', 'g'), {_WS}, ' ', 'g')), ' '), 1, 12), ' ') AS ph FROM q)
      SELECT item_id, length(q) >= 40 AND len(string_split(q, ' ')) >= 6 AS distinctive, length(q)::INT AS n, {_QUOTE.format('ph')} AS phrase FROM w""",
    "quote_variant": f"""WITH q AS (SELECT item_id, {_QUOTE.format('text')} AS q FROM benchmark), s AS (SELECT doc_id, {_QUOTE.format('text')} AS s FROM documents),
      h AS (SELECT *, string_split(q, ' ') AS qw, instr(s, array_to_string(list_slice(string_split(q, ' '), 1, 6), ' ')) AS pos FROM q JOIN s ON q <> '' AND contains(s, q))
      SELECT item_id, doc_id, CASE WHEN len(qw) >= 5 THEN md5(array_to_string(list_slice(string_split(ltrim(substr(s, pos)), ' '), 1, len(qw)), ' ')) END AS words_md5 FROM h""",
    "passage_top3": f"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
      x AS (SELECT doc_id, {_TERMS.format('ls[1]')} AS terms, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS "at" FROM d),
      o AS (SELECT doc_id, "at", len(list_intersect({_TERMS.format('line')}, terms)) AS overlap FROM x WHERE length(line) >= 60 AND "at" > 0 AND len(terms) > 0)
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY overlap DESC, "at")::INT AS rank, "at"::INT AS "at", overlap::INT AS overlap FROM o WHERE overlap > 0
      QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY overlap DESC, "at") <= 3""",
    "strip_html": f"SELECT page_id, md5({_STRIPPED}) AS text_md5 FROM pages",
    "severity_order": f"""{JUDGED} SELECT doc_id, o_orderkey::INT AS idx, verdict FROM v
      QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CASE verdict WHEN 'fabricated' THEN 0 WHEN 'miscited' THEN 1 WHEN 'unverifiable' THEN 2 ELSE 3 END, o_orderkey) = 1""",
    "request_cache_stats": """WITH e AS (SELECT event_id, ts, sha256('GET' || chr(10) || '/u/' || user_id || chr(10) || coalesce(event_type, '')) AS key FROM events),
      h AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) > 1 AS hit FROM e)
      SELECT left(key, 1) AS shard, count(*) AS requests, count(*) FILTER (hit) AS hits, count(DISTINCT key) AS stored FROM h GROUP BY 1""",
    "latest_replies": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "report_exit_codes": f"{JUDGED} SELECT doc_id, bool_or(verdict IN ('fabricated', 'miscited'))::INT AS exit_code FROM v GROUP BY doc_id",
    "label_metrics": f"""WITH m AS (SELECT CASE quality WHEN 1 THEN 'real' ELSE 'fabricated' END AS e, CASE WHEN n_chars >= 800 THEN 'real' ELSE 'fabricated' END AS p FROM labels JOIN documents USING (doc_id)) {_METRICS}""",
    "best_passages": f"""WITH b AS (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, {_STRIPPED} AS body FROM pages),
      p AS (SELECT *, list_filter(regexp_split_to_array(body, '\\n{{2,}}'), lambda x: trim(x, ' ') <> '') AS ps, {_TERMS.format('title')} AS terms FROM b),
      s AS (SELECT *, CASE WHEN len(ps) >= 2 THEN ps ELSE list_filter(string_split(regexp_replace(body, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ') <> '') END AS parts FROM p),
      u AS (SELECT page_id, terms, unnest(parts) AS part, generate_subscripts(parts, 1) AS "at" FROM s),
      o AS (SELECT page_id, "at", part, len(list_intersect({_TERMS.format('part')}, terms)) AS overlap FROM u WHERE length(part) >= 60),
      r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY overlap DESC, "at") AS n FROM o WHERE overlap > 0),
      c AS (SELECT page_id, string_agg(trim(part, ' '), chr(10) || chr(10) ORDER BY "at") AS chosen FROM r WHERE n <= 3 GROUP BY page_id)
      SELECT page_id, md5(left(nullif(coalesce(chosen, body), ''), 3500)) AS passage_md5 FROM s LEFT JOIN c USING (page_id)""",
    "sentence_context": f"""{JUDGED}, w AS (SELECT doc_id, o_orderkey, length(coalesce(case_name || ', ', 'See ') || matched_text || ' (' || concat_ws(' ', court, year) || ').') AS n FROM j)
      SELECT doc_id, (row_number() OVER d - 1)::INT AS pos, (count(*) OVER (PARTITION BY doc_id))::INT AS sentences, (n + coalesce(lag(n) OVER d + 1, 0))::INT AS n FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY o_orderkey)""",
    "span_segments": f"""{JUDGED}, w AS (SELECT doc_id, length(coalesce(case_name || ', ', 'See ') || matched_text || ' (' || concat_ws(' ', court, year) || ').') AS n FROM j)
      SELECT doc_id, (sum(n) + count(*) - 1)::INT AS n, (2 * count(*) + 1)::INT AS segments, count(*)::INT AS highlighted FROM w GROUP BY doc_id""",
    "report_markdown": f"""{JUDGED}, evidence AS ({EVIDENCE_SQL}), advisory AS ({ADVISORY_SQL}),
      asked AS (SELECT o_orderkey, string_agg('`' || query || '`: ' || result_count || ' (' || note || ')', '; ' ORDER BY place) AS asked FROM evidence GROUP BY o_orderkey),
      noted AS (SELECT o_orderkey, string_agg(advisory, '; ' ORDER BY place) AS noted FROM advisory GROUP BY o_orderkey),
      t AS (
        SELECT v.*, coalesce(v.case_name || ', ', '') || v.matched_text || ' (' || concat_ws(' ', v.court, v.year) || ')' AS verbatim, p.case_name AS partner_name, asked, noted,
          own_name || '; ' || own_cite || '; ' || own_court || '; ' || o.date_filed || '; /opinion/' || o_orderkey || '/' AS record, array_to_string(list_sort(list_distinct([own_cite, v.matched_text])), ', ') AS both_cites,
          CASE verdict WHEN 'verified' THEN 'Verified' WHEN 'fabricated' THEN 'Not found' WHEN 'miscited' THEN 'Miscited' ELSE 'Not checked' END AS shown,
          CASE error_class WHEN 'none' THEN 'none' WHEN 'fabricated_cite' THEN 'the reporter citation does not exist' WHEN 'fabricated_case_name' THEN 'the case name does not exist' WHEN 'wrong_slot' THEN 'the reporter citation belongs to another case'
            WHEN 'wrong_court' THEN 'court does not match the record' ELSE 'not checked' END AS reason, printf('%.2f', confidence) AS conf,
          CASE verdict WHEN 'fabricated' THEN 0 WHEN 'miscited' THEN 1 WHEN 'unverifiable' THEN 2 ELSE 3 END AS grave
        FROM v JOIN oc o USING (o_orderkey) LEFT JOIN oc p ON p.o_orderkey = partner AND way = 4 LEFT JOIN asked USING (o_orderkey) LEFT JOIN noted USING (o_orderkey)),
      x AS (
        SELECT *, coalesce(case_name, verbatim) AS title, CASE rule
          WHEN 'D1' THEN matched_text || ' belongs to ' || own_name || '; without a case name only the citation was checked.' WHEN 'D3' THEN 'A record of this case lists ' || matched_text || '.'
          WHEN 'D4' THEN 'This case exists, but ' || matched_text || ' belongs to ' || partner_name || '; the case is recorded under ' || both_cites || '.' WHEN 'D5' THEN 'This case exists in another court, and ' || matched_text || ' was not found in the court given.'
          WHEN 'D6' THEN 'All records of this case are of other courts (' || own_court || '), not of ' || court || '; it is recorded under ' || own_cite || '.' WHEN 'D7' THEN 'This case exists; its records (1) list ' || own_cite || ' and neither confirm nor rule out ' || matched_text || '.'
          WHEN 'D8' THEN 'No case is named ' || chr(39) || case_name || chr(39) || ', and ' || matched_text || ' belongs to ' || own_name || '.' ELSE 'No case is named ' || chr(39) || case_name || chr(39) || ', and none holds ' || matched_text || '.' END AS said FROM t),
      l AS (
        SELECT doc_id, grave, o_orderkey, verdict, '| ' || shown || ' | ' || title || ' | ' || matched_text || ' | ' || reason || ' | ' || conf || ' |' AS line,
          concat_ws(chr(10), '### ' || title || ': ' || matched_text, '', '**' || shown || '** (' || reason || '), confidence ' || conf || '. ' || said, 'Written as `' || verbatim || '`.', CASE WHEN rule NOT IN ('D8', 'D10') THEN 'Record: ' || record END,
            CASE rule WHEN 'D4' THEN 'The citation is that of ' || partner_name || '.' WHEN 'D8' THEN 'The citation is that of ' || own_name || '.' END, 'Perhaps meant: ' || suggestion || '.', 'Noted: ' || noted || '.', 'Asked: ' || asked || '.', '') AS paragraph FROM x),
      g AS (
        SELECT doc_id, count(*) AS n, count(*) FILTER (verdict = 'verified') AS v, count(*) FILTER (verdict = 'miscited') AS m, count(*) FILTER (verdict = 'fabricated') AS f, count(*) FILTER (verdict = 'unverifiable') AS u,
          string_agg(line, chr(10) ORDER BY grave, o_orderkey) AS lines, string_agg(paragraph, chr(10) ORDER BY grave, o_orderkey) AS paragraphs FROM l GROUP BY doc_id),
      w AS (
        SELECT doc_id, concat_ws(chr(10), '# Brief ' || doc_id || ': citations checked', '', n || ' case citations: ' || v || ' verified, ' || m || ' miscited, ' || f || ' not found, ' || u || ' not checked.',
          'Of ' || (v + m + f) || ' decided ones ' || round_even(100.0::DOUBLE * v / nullif(v + m + f, 0), 1) || ' % are right.', round_even(100.0::DOUBLE * (v + m + f) / n, 1) || ' % could be decided.', '', '## By gravity', '',
          '| Verdict | Case | Citation | Reason | Confidence |', '|-|-|-|-|-|', lines, '', '## One by one', '', paragraphs, '## Limits', '', '- A citation that was not found need not be invented: the corpus does not hold every opinion.') || chr(10) AS markdown FROM g)
      SELECT doc_id, length(markdown)::INT AS n, md5(markdown) AS markdown_md5 FROM w""",
    "model_reply_parse": """SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN 'unknown' WHEN p_partkey % 3 = 0 THEN 'not_supported' WHEN p_partkey % 3 = 1 THEN 'partial' ELSE 'unknown' END AS support,
      CASE WHEN p_partkey % 4 <> 3 THEN CASE p_size % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 ELSE 1.0 END END::DOUBLE AS confidence, CASE WHEN p_partkey % 4 <> 3 THEN p_name END AS passage FROM part""",
}
ORACLES |= CHECKED | OF_CORPORA
