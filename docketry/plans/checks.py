"""Queries over evidence, quotations, support, stored replies and records, made from the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from docketry.functions import fixed
from docketry.functions import names as N
from docketry.functions import text as X
from docketry.functions.schemas import RAW_RECORD, RECORD
from docketry.operators import benchmark as B
from docketry.operators import quotes as Q
from docketry.operators import records, reports, support
from docketry.operators.extract import attribute_short_forms, citation_mentions, extract_citations, extraction_notes, scan_documents
from docketry.operators.search import fetch_cases, match_names, replay_search
from docketry.operators.verdicts import findings
from docketry.plans import derived as D
from docketry.plans.audit import audit
from docketry.plans.derived import _letters, table
from docketry.plans.stated import JUDGED, stated_citations, verdict_rows
from docketry.sources.files import cache_replies
from docketry.sources.shared import stage


def evidence_rows(spark, sf_dir):
    """What each search was asked and what it found."""
    rows = verdict_rows(spark, sf_dir).select("doc_id", "idx", F.posexplode("evidence").alias("at", "e"))
    return rows.select("doc_id", "idx", "at", "e.strategy", "e.query", "e.result_count", "e.matched", F.col("e.top.cluster_id").alias("top"), "e.note")


def advisory_rows(spark, sf_dir):
    """V1-V6: what is noted beside the verdicts."""
    return verdict_rows(spark, sf_dir).select("doc_id", "idx", F.posexplode("advisories").alias("at", "advisory"))


def expected_missed(spark, sf_dir):
    """Expected citations that no finding meets."""
    return B.missed_expected(_matches(spark, sf_dir)[1]).select("doc_id", "entry", "citation", "expected")


def findings_unmatched(spark, sf_dir):
    """Findings that no expected citation meets."""
    return B.unmatched_findings(*_matches(spark, sf_dir)).select("doc_id", "idx", "verdict")


def _matches(spark, sf_dir):
    """Findings of all ways but 6, and expected citations of all orders but each fifth."""
    found = stage(verdict_rows(spark, sf_dir).where("way <> 6").select("doc_id", "idx", "cite_key", "case_name", "verdict", "error_class", "confidence"), "found")
    stated = stated_citations(spark, sf_dir).where("idx % 5 <> 0")
    expected = stated.select("doc_id", F.col("idx").alias("entry"), F.col("cite_key").alias("key"), X.blank_to_null(N.plain_name("case_name")).alias("name"), F.lit("real").alias("expected"), F.col("matched_text").alias("citation"))
    return found, B.match_expected(expected, found)


def report_json(spark, sf_dir):
    """K1: reports as JSON, read back."""
    done = audit(D.briefs(spark, sf_dir), stage(D.cases(spark, sf_dir), "cases"))
    out = reports.to_json(done.reports, done.findings)
    said = lambda path: F.get_json_object("json", path)
    return out.select("doc_id", said("$.verified").cast("long").alias("verified"), said("$.total").cast("long").alias("total"), said("$.findings[0].verdict").alias("first_verdict"), said("$.findings[0].matched_text").alias("first_citation"))


# -- replies ---------------------------------------------------------------------------------------------------------


def _asked(spark, sf_dir):
    """A citation an order, of seven kinds by its key: see REPLAYED."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", _letters(k).alias("L"), (k % 7).alias("kind"))
    bare = F.col("kind") == 1
    rows = rows.withColumns(
        {"case_name": F.when(~bare, F.concat("L", F.lit(" Stone v. "), "L", F.lit("son Rivers"))), "volume": F.when(bare, F.lit("2013")).otherwise((k % 90 + 1).cast("string")), "reporter": F.when(bare, F.lit("IL App (1st)")).otherwise(F.lit("F.3d")), "page": k.cast("string")}
    )
    text = F.concat_ws(" ", "volume", "reporter", "page")
    return rows.select(
        F.lit("d").alias("doc_id"), k.cast("int").alias("idx"), "kind", "L", text.alias("matched_text"), "volume", "reporter", "page", F.when(~bare, F.lit("9th Cir.")).alias("court"), F.when(~bare, F.lit("ca9")).alias("court_id"),
        F.when(~bare, F.lit("document")).alias("court_source"), F.lit("1999").alias("year"), "case_name", X.cite_key("volume", "reporter", "page").alias("cite_key"), F.lit(None).cast("array<string>").alias("extraction_notes"),
    )


def replayed_verdicts(spark, sf_dir):
    """D2, D3, D7-D10, J3, O2, O4, S8, Q-1: verdicts from stored replies, also where searches fail, records tie or only the court's search confirms."""
    asked = stage(_asked(spark, sf_dir), "asked")
    own = F.col("case_name")

    def reply(kind, query, court, rank, failing, name=own, cites=None, at="9th Cir."):
        number = F.col("idx").cast("long") * 10 + rank + 1
        record = F.struct(
            number, name, F.lit(None).cast("string"), cites if cites is not None else F.array(F.lit("1 F.2d 1")), F.lit(at), F.lit(None).cast("string"), F.lit("1999-05-01"), F.lit(None).cast("string"), F.lit(None).cast("array<struct<snippet:string>>")
        ).cast(RAW_RECORD)
        told = F.lit(None).cast(RAW_RECORD) if failing else record
        return asked.where(F.col("kind") == kind).select(F.concat(F.lit('"'), query, F.lit('"')).alias("query"), F.lit(court).cast("string").alias("court"), F.lit(rank).alias("rank"), F.lit(failing).alias("failing"), told.alias("record"))

    lists = F.array(F.lit("2 F.2d 2"), F.col("matched_text"))
    rows = [
        reply(0, own, None, 0, True), reply(0, F.col("matched_text"), None, 0, True),
        reply(2, own, None, 0, False), reply(2, F.col("matched_text"), "ca9", 1, False, cites=lists),
        reply(3, own, None, 0, False, at="2d Cir."), reply(3, own, None, 1, False), reply(3, own, None, 2, False),
        reply(4, own, None, 0, True),
        reply(5, F.col("matched_text"), None, 0, False, F.concat("L", F.lit(" Hill v. "), "L", F.lit("son Rivers")), lists),
        reply(6, F.col("matched_text"), None, 0, False, F.lit("Other v. Else"), lists),
    ]
    stored = rows[0]
    for more in rows[1:]:
        stored = stored.union(more)
    results, status = replay_search(asked, stage(stored, "replies"))
    results, status = stage(results, "results"), stage(status, "status")
    strict = findings(asked, results, status, strict=True).select("doc_id", "idx", F.col("rule").alias("strict_rule"))
    out = findings(asked, results, status).join(strict, ["doc_id", "idx"])
    return out.select("idx", "rule", "strict_rule", "verdict", F.col("resolved.cluster_id").alias("resolved"), F.col("slot_owner.cluster_id").alias("owner"), F.size("advisories").alias("advisories"), F.size("evidence").alias("evidence"))


def cached_replies(spark, sf_dir):
    """Requests looked up among stored replies; those that are no JSON count as missing."""
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    url = F.concat(F.lit("/e/"), F.col("event_id").cast("string"))
    requests = e.select("event_id", F.lit("GET").alias("method"), url.alias("url"), F.lit(None).cast("string").alias("body"))
    stored = e.where("event_id % 2 = 0").select(X.request_key(F.lit("GET"), url, F.lit("")).alias("key"), F.lit(200).alias("status"), F.when(F.col("event_id") % 4 == 0, '{"results": []}').otherwise("<html>").alias("body"), F.col("ts").alias("created_at"))
    hits, misses = cache_replies(requests, stored)
    return hits.select("event_id", F.lit(True).alias("hit")).union(misses.select("event_id", F.lit(False)))


def retry_waits(spark, sf_dir):
    """F32: seconds to wait by a header."""
    header = F.element_at(F.array(F.lit("0"), F.lit("12.5"), F.lit("soon"), F.lit(None).cast("string")), (F.col("p_size") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", X.retry_after(header).alias("seconds"))


def record_projection(spark, sf_dir):
    """Records from loose replies as JSON."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    cite = F.when(F.col("p_partkey") % 2 == 0, F.format_string('"%d F.3d 1"', "p_partkey")).otherwise(F.format_string('["%d F.3d 1", "2 U.S. 2"]', "p_partkey"))
    body = F.concat(F.lit('{"results": [{"cluster_id": '), F.col("p_partkey").cast("string"), F.lit(', "caseName": " '), "p_name", F.lit(' ", "caseNameFull": "", "citation": '), cite, F.lit(', "court": "ca9", "absolute_url": "/o/1/", "opinions": [{"snippet": "a \\n b"}]}]}'))
    rows = p.select("p_partkey", F.get(records.parsed_reply(body), F.lit(0)).alias("raw"))
    r = records.record_of(F.col("raw"), "https://site")
    return rows.select("p_partkey", r["cluster_id"].alias("cluster_id"), r["case_name"].alias("case_name"), F.array_join(r["citations"], ";").alias("citations"), r["court"].alias("court"), r["absolute_url"].alias("url"), r["snippet"].alias("snippet"))


# -- quotations, passages, support -----------------------------------------------------------------------------------


def quote_checks(spark, sf_dir):
    """Quotations made from the words of documents, held against them."""
    words = F.split(X.comparable_quote("text"), " ")
    docs = stage(table(spark, sf_dir, "documents").select("doc_id", "text", words.alias("w")), "quoted")
    kind = F.col("doc_id") % 6
    first = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    quote = F.when(kind.isin(0, 5), first(3, 10)).when(kind == 1, F.concat(first(1, 6), F.lit(" zq1 zq2 zq3 zq4 of another hand"))).when(kind == 2, F.concat(F.lit("No opinion holds these words about number "), F.col("doc_id").cast("string"))).when(kind == 3, F.lit("too short"))
    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(0).alias("idx"), F.concat(F.lit('"'), quote, F.lit('"')).alias("parenthetical"), F.when(kind != 5, F.struct(F.col("doc_id").cast("long").alias("cluster_id"), F.lit("A v. B").alias("case_name"))).alias("resolved"))
    texts = docs.select(F.col("doc_id").cast("long").alias("cluster_id"), F.col("text").alias("full_text"))
    hits = docs.where("doc_id % 12 = 5").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(0).alias("idx"), F.lit(3).cast("long").alias("hits"), F.lit("C v. D").alias("matched_case"), F.lit(None).cast("string").alias("error"))
    out = Q.check_quotes(found, texts, hits)
    return out.select("doc_id", "quote_check.status", "quote_check.hits", "quote_check.matched_case", F.md5("quote_check.detail").alias("detail_md5"))


def snippet_passages(spark, sf_dir):
    """The first snippet of the resolved case itself."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    found = o.select(F.lit("d").alias("doc_id"), F.col("o_orderkey").cast("int").alias("idx"), F.when(F.col("o_orderkey") % 5 != 0, F.struct(F.col("o_orderkey").cast("long").alias("cluster_id"))).alias("resolved"))
    rec = lambda cluster, snippet: F.struct(cluster.cast("long"), F.lit("n"), F.array().cast("array<string>"), F.lit(None), F.lit(None), F.lit(None), snippet).cast(RECORD)
    k = F.col("o_orderkey")
    first = F.when(k % 3 != 0, F.concat(F.lit("first "), k.cast("string")))
    rows = [(0, rec(k + 1, F.lit("other"))), (1, rec(k, first)), (2, rec(k, F.concat(F.lit("second "), k.cast("string"))))]
    hits = o.select(F.lit("d").alias("doc_id"), k.cast("int").alias("idx"), F.inline(F.array(*(F.struct(F.lit(n).alias("rank"), r.alias("rec")) for n, r in rows))))
    return Q.snippet_passage(found, hits).select("idx", "passage")


def snippet_queries(spark, sf_dir):
    """The search for a case's own snippet, by all words of a text."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(Q.snippet_query(F.lit("A v. B"), F.col("text"))).alias("query_md5"))


def opinion_full_texts(spark, sf_dir):
    """The first four opinions of a case."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey")
    plain = F.when(F.col("l_linenumber") % 3 != 0, F.concat(F.lit("part "), F.col("l_partkey").cast("string")))
    opinions = rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("opinion_id"), F.col("l_orderkey").alias("cluster_id"), (F.col("l_linenumber") - 1).alias("ord"), plain.alias("plain_text"), F.lit("").alias("html_with_citations"),
        F.concat(F.lit("<p>flag  <b>"), "l_returnflag", F.lit("</b></p>")).alias("html"), F.lit("never").alias("html_lawbox"), F.lit(None).cast("string").alias("xml_harvard"),
    )
    return records.opinion_texts(opinions, fixed.MOST_OPINIONS, fixed.LONGEST_OPINION)


def support_checks(spark, sf_dir):
    """Support check, F35, F36: replies of a model that runs on executors, by a rule of its own."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    k = F.col("c_custkey")
    found = c.select(k.cast("string").alias("doc_id"), F.lit(0).alias("idx"), F.col("c_mktsegment").alias("context"), F.lit("Cited v. Name").alias("case_name"), F.lit("1 F.3d 1").alias("matched_text"), F.when(k % 3 != 0, F.struct(k.cast("long").alias("cluster_id"), F.col("c_name").alias("case_name"))).alias("resolved"))
    passages = c.where(k % 4 != 0).select(k.cast("string").alias("doc_id"), F.lit(0).alias("idx"), F.concat("c_name", F.lit(" pays.")).alias("passage"), F.lit("opinion").alias("origin"))

    def model(rows):
        return [json.dumps({"support": "Supported" if len(r["sentence"]) % 2 else "CONTRADICTED", "confidence": 1.5, "rationale": r["citation"], "passage": r["case_name"] if len(r["sentence"]) % 2 else "not in it"}) for r in rows]

    out = support.check_support(found, passages, model, "rule")
    return out.select("doc_id", "fidelity.support", "fidelity.confidence", "fidelity.rationale", "fidelity.passage", "fidelity.model")


# -- extraction and names --------------------------------------------------------------------------------------------


def other_citations(spark, sf_dir):
    """A5, A8, K, P3-P5: statutes and journals in texts, counted beside cases."""
    k = F.col("c_custkey")
    n = (k + 1).cast("string")
    statute, rule, journal = F.concat(F.lit("Under 42 U.S.C. § "), n, F.lit(" the claim fails. ")), F.concat(F.lit("So says 17 C.F.R. "), n, F.lit(".5 too. ")), F.concat(F.lit("See 12 Harv. L. Rev. "), n, F.lit(" (1999). "))
    text = F.concat(F.when(k % 2 == 0, statute).otherwise(""), F.when(k % 3 == 0, rule).otherwise(""), F.when(k % 5 == 0, journal).otherwise(""), F.concat(F.lit("Ash v. Oak, 9 F.3d "), n, F.lit(" (9th Cir. 1999).")))
    docs = table(spark, sf_dir, "customer").select(k.cast("string").alias("doc_id"), text.alias("text"))
    cited = stage(extract_citations(docs), "cited")
    judged = cited.where("kind = 'case'").withColumn("verdict", F.lit("unverifiable"))
    return reports.audit_reports(docs, judged, cited.where("kind <> 'case'")).select("doc_id", "total", "check_coverage", "other_citations", "other_kinds")


def extraction_note_rows(spark, sf_dir):
    """What extraction notes of a text: short forms without a full one, supra, repeats."""
    k = F.col("c_custkey")
    full = "Ash v. Oak, 9 F.3d 7 (9th Cir. 1999). "
    text = F.concat(F.when(k % 2 == 0, "See 999 F.2d at 5. ").otherwise(""), F.repeat(F.lit(full), (k % 4).cast("int")), F.when(k % 3 == 0, "See supra at 3. Supra no more. See supra.").otherwise(""), F.lit("End."))
    docs = table(spark, sf_dir, "customer").select(k.cast("string").alias("doc_id"), text.alias("text"))
    notes = extraction_notes(attribute_short_forms(citation_mentions(scan_documents(docs))))
    return notes.select("doc_id", F.array_join("notes", "; ").alias("notes"))


def abbreviated_names(spark, sf_dir):
    """Names with abbreviations, and the cases they fit."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    k = F.col("c_custkey")
    other = lambda x: _letters(x, "klmnopqrst")
    cases = c.select(k.cast("long").alias("cluster_id"), F.concat(_letters(k), F.lit(" Transportation v. "), other(k), F.lit(" Industries, Inc.")).alias("case_name"))
    cited = F.when(k % 3 == 0, F.concat(_letters(k), F.lit(" Transp. v. "), other(k), F.lit(" Indus."))).when(k % 3 == 1, F.concat(F.left(_letters(k), F.lit(5)), F.lit(". Transp. Co. v. "), other(k), F.lit(" Indus., Inc."))).otherwise(F.concat(_letters(k), F.lit(" Transp. v. "), other(k + 1), F.lit(" Indus.")))
    citations = c.select(F.lit("d").alias("doc_id"), k.cast("int").alias("idx"), cited.alias("case_name"))
    return match_names(citations, cases).select("idx", "cluster_id", "sim")


def party_names(spark, sf_dir):
    """Whether the lines of a text read as names."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"), "lang")
    return docs.select("doc_id", "at", N.is_plausible_party("line").alias("line_fits"), N.is_plausible_party(F.concat(F.initcap("lang"), F.lit(" Co. of the (Ünion), "), F.col("doc_id").cast("string"), F.lit(" & Sons"))).alias("made_fits"))


def fetched_cases(spark, sf_dir):
    """Cases by cluster id."""
    asked = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("cluster_id")).union(table(spark, sf_dir, "customer").select((-F.col("c_custkey") - 1).cast("long")))
    return fetch_cases(asked, D.cases(spark, sf_dir)).select("cluster_id", "case_name", F.array_join("citations", "; ").alias("citations"))


def table_cells(spark, sf_dir):
    """text for cells of a table."""
    p = table(spark, sf_dir, "pages").select("page_id", F.concat("url", F.lit(" |\n"), "html").alias("x"))
    return p.select("page_id", F.md5(X.table_cell("x")).alias("cell_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        evidence_rows, advisory_rows, expected_missed, findings_unmatched, report_json, replayed_verdicts, cached_replies, retry_waits, record_projection, quote_checks, snippet_passages, snippet_queries, opinion_full_texts, support_checks,
        other_citations, extraction_note_rows, abbreviated_names, party_names, fetched_cases, table_cells,
    )
}

_COMPARABLE = "lower(trim(regexp_replace(regexp_replace(replace(translate(coalesce({0}, ''), '“”‘’\"''…', '       '), '...', ' '), '\\[[^\\]]*\\]', ' ', 'g'), '[^A-Za-z0-9]+', ' ', 'g')))"
_STOPPED = "[" + ", ".join(f"'{w}'" for w in fixed.STOPWORDS) + "]"
_CONNECTED = "[" + ", ".join(f"'{w}'" for w in fixed.CONNECTORS) + "]"
_NAMED = "way NOT IN (2, 3)"
_SLOT = "way NOT IN (2, 5, 7)"


def _letters_sql(key: str, letters: str = "abcdefghij") -> str:
    made = f"translate(({key} + 1000000)::VARCHAR, '0123456789', '{letters}')"
    return f"(upper(left({made}, 1)) || substr({made}, 2))"


def _party_sql(x: str) -> str:
    bare = "regexp_replace(regexp_replace(t, '^[,.;:()\\[\\]&''’]+', ''), '[,.;:()\\[\\]&''’]+$', '')"
    line = f"trim(regexp_replace(coalesce({x}, ''), '[ \\t\\n\\x0B\\f\\r\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'), ' ')"
    tokens = f"string_split({line}, ' ')"
    fits = f"len(list_filter({tokens}, lambda t: NOT ({bare} = '' OR regexp_matches({bare}, '^[\\p{{Lu}}\\p{{Nd}}]') OR list_contains({_CONNECTED}, lower({bare}))))) = 0"
    return f"({line} <> '' AND len({tokens}) <= 20 AND {fits})"


_MET = f"{JUDGED}, f AS (SELECT *, o_orderkey::INT AS idx FROM v WHERE way <> 6), e AS (SELECT *, o_orderkey::INT AS entry FROM j WHERE o_orderkey % 5 <> 0)"

#: Rows of JUDGED's citations: what each search was asked and found, and what is noted.
EVIDENCE_SQL = f"""
        SELECT doc_id, o_orderkey, 0 AS place, 'case_name_search' AS strategy, '"' || case_name || '"' AS query, ({_NAMED})::INT AS result_count, {_NAMED} AS matched, CASE WHEN {_NAMED} THEN o_orderkey END AS top,
               CASE WHEN {_NAMED} THEN 'best name score 1.00' ELSE 'no results' END AS note FROM v WHERE case_name IS NOT NULL
        UNION ALL SELECT doc_id, o_orderkey, 1, 'reporter_citation_search', '"' || matched_text || '"', ({_SLOT})::INT, {_SLOT}, CASE WHEN way = 4 THEN partner WHEN {_SLOT} THEN o_orderkey END,
               CASE WHEN {_SLOT} THEN '1 record(s) list this citation' ELSE 'no record of either search lists this citation' END FROM v
        UNION ALL SELECT v.doc_id, v.o_orderkey, 2, 'reporter_citation_search_in_court', '"' || matched_text || '" court=' || cid, (p.o_orderkey IS NOT NULL)::INT, false, p.o_orderkey, 'not found in this court'
          FROM (SELECT *, coalesce(court_id, CASE reporter WHEN 'U.S.' THEN 'scotus' END) AS cid FROM v) v LEFT JOIN oc p ON way = 4 AND p.o_orderkey = partner AND p.court_id = cid WHERE way IN (4, 5, 7) AND cid IS NOT NULL"""
ADVISORY_SQL = """
        SELECT doc_id, o_orderkey, 0 AS place, 'WL citations are indexed only in part; the case name is the main evidence' AS advisory FROM v WHERE reporter = 'WL'
        UNION ALL SELECT doc_id, o_orderkey, 1, 'no case name is given, so only the reporter citation was checked' FROM v WHERE case_name IS NULL
        UNION ALL SELECT doc_id, o_orderkey, 2, 'court given ' || court || ', recorded ' || rtrim(own_court, '.') FROM v WHERE way = 5"""

ORACLES = {
    "evidence_rows": f"""{JUDGED}, e AS ({EVIDENCE_SQL})
      SELECT doc_id, o_orderkey::INT AS idx, (row_number() OVER (PARTITION BY o_orderkey ORDER BY place) - 1)::INT AS "at", strategy, query, result_count, matched, top, note FROM e""",
    "advisory_rows": f"""{JUDGED}, a AS ({ADVISORY_SQL})
      SELECT doc_id, o_orderkey::INT AS idx, (row_number() OVER (PARTITION BY o_orderkey ORDER BY place) - 1)::INT AS "at", advisory FROM a""",
    "expected_missed": f"{_MET} SELECT e.doc_id, entry, matched_text AS citation, 'real' AS expected FROM e WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = e.doc_id AND (f.cite_key = e.cite_key OR f.case_name = e.case_name))",
    "findings_unmatched": f"{_MET} SELECT doc_id, idx, verdict FROM f WHERE idx % 5 = 0",
    "report_json": f"""{JUDGED} SELECT doc_id, count(*) FILTER (verdict = 'verified') AS verified, count(*) AS total, arg_min(verdict, o_orderkey) AS first_verdict, arg_min(matched_text, o_orderkey) AS first_citation FROM v GROUP BY doc_id""",
    "replayed_verdicts": """WITH k AS (SELECT o_orderkey::INT AS idx, (o_orderkey % 7)::INT + 1 AS kind FROM orders)
      SELECT idx, ['D2', 'D9', 'D3', 'D7', 'D10', 'D3', 'D8'][kind] AS rule, ['D2', 'D9', 'D3', 'D7', 'D2', 'D3', 'D8'][kind] AS strict_rule,
        ['unverifiable', 'unverifiable', 'verified', 'unverifiable', 'fabricated', 'verified', 'fabricated'][kind] AS verdict,
        CASE WHEN kind IN (3, 4) THEN idx::BIGINT * 10 + 2 WHEN kind = 6 THEN idx::BIGINT * 10 + 1 END AS resolved, CASE WHEN kind = 7 THEN idx::BIGINT * 10 + 1 END AS owner,
        [0, 2, 0, 0, 0, 1, 0][kind]::INT AS advisories, [2, 1, 3, 3, 2, 2, 2][kind]::INT AS evidence FROM k""",
    "cached_replies": "SELECT event_id, event_id % 4 = 0 AS hit FROM events",
    "retry_waits": "SELECT p_partkey, [0.5, 12.5, 36.0, 36.0][p_size % 4 + 1]::DOUBLE AS seconds FROM part",
    "record_projection": """SELECT p_partkey, p_partkey AS cluster_id, p_name AS case_name, p_partkey || ' F.3d 1' || CASE WHEN p_partkey % 2 = 1 THEN ';2 U.S. 2' ELSE '' END AS citations, 'ca9' AS court, 'https://site/o/1/' AS url, 'a b' AS snippet FROM part""",
    "quote_checks": f"""WITH d AS (SELECT doc_id, {_COMPARABLE.format('text')} AS t, string_split({_COMPARABLE.format('text')}, ' ') AS w FROM documents),
      q AS (SELECT *, CASE WHEN doc_id % 6 IN (0, 5) THEN array_to_string(list_slice(w, 3, 12), ' ') WHEN doc_id % 6 = 1 THEN array_to_string(list_slice(w, 1, 6), ' ') || ' zq1 zq2 zq3 zq4 of another hand'
          WHEN doc_id % 6 = 2 THEN 'no opinion holds these words about number ' || doc_id WHEN doc_id % 6 = 3 THEN 'too short' END AS quote FROM d),
      s AS (SELECT *, CASE WHEN coalesce(quote, '') = '' THEN NULL WHEN length(quote) < 40 OR len(string_split(quote, ' ')) < 6 THEN 'skipped' WHEN doc_id % 12 = 5 THEN 'corpus_hit' WHEN doc_id % 6 = 5 THEN 'corpus_miss'
          WHEN contains(t, quote) THEN 'verbatim' WHEN doc_id % 6 = 1 AND len(w) >= len(string_split(quote, ' ')) THEN 'variant' ELSE 'not_found' END AS status FROM q)
      SELECT doc_id::VARCHAR AS doc_id, status, CASE status WHEN 'corpus_hit' THEN 3 WHEN 'corpus_miss' THEN 0 END::BIGINT AS hits, CASE WHEN status = 'corpus_hit' THEN 'C v. D' WHEN status IN ('verbatim', 'variant', 'not_found') THEN 'A v. B' END AS matched_case,
        CASE WHEN status = 'variant' THEN md5(array_to_string(list_slice(w, 1, 13), ' ')) END AS detail_md5 FROM s""",
    "snippet_passages": "SELECT o_orderkey::INT AS idx, CASE WHEN o_orderkey % 3 = 0 THEN 'second ' ELSE 'first ' END || o_orderkey AS passage FROM orders WHERE o_orderkey % 5 <> 0",
    "snippet_queries": f"""WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '[A-Za-z][A-Za-z''\\-]{{2,}}')) AS w FROM documents)
      SELECT doc_id, md5(trim('"A v. B" ' || array_to_string(list_slice(list_sort(list_filter(w, lambda x: NOT list_contains({_STOPPED}, lower(x)))), 1, 8), ' '), ' ')) AS query_md5 FROM d""",
    "opinion_full_texts": """WITH o AS (SELECT *, CASE WHEN l_linenumber % 3 <> 0 THEN 'part ' || l_partkey ELSE 'flag ' || l_returnflag END AS t FROM lineitem WHERE l_linenumber <= 4)
      SELECT l_orderkey AS cluster_id, string_agg(t, chr(10) || chr(10) ORDER BY l_linenumber, t) AS full_text FROM o GROUP BY l_orderkey""",
    "support_checks": """WITH c AS (SELECT *, length(c_mktsegment) % 2 = 1 AS odd FROM customer)
      SELECT c_custkey::VARCHAR AS doc_id, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 4 = 0 THEN 'unknown' WHEN odd THEN 'supported' ELSE 'contradicted' END AS support, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 4 <> 0 THEN 1.0 END::DOUBLE AS confidence,
        CASE WHEN c_custkey % 3 = 0 THEN 'no case record was resolved' WHEN c_custkey % 4 = 0 THEN 'there was no passage of the case to read' ELSE '1 F.3d 1 (Passage source: opinion.)' END AS rationale,
        CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 4 <> 0 AND odd THEN c_name END AS passage, 'rule' AS model FROM c""",
    "other_citations": """SELECT c_custkey::VARCHAR AS doc_id, 1::BIGINT AS total, 0.0::DOUBLE AS check_coverage, (c_custkey % 2 = 0)::BIGINT + (c_custkey % 3 = 0)::BIGINT + (c_custkey % 5 = 0)::BIGINT AS other_citations,
      nullif(concat_ws(', ', CASE WHEN c_custkey % 5 = 0 THEN 'journal' END, CASE WHEN c_custkey % 2 = 0 OR c_custkey % 3 = 0 THEN 'statute' END), '') AS other_kinds FROM customer""",
    "extraction_note_rows": """SELECT c_custkey::VARCHAR AS doc_id, concat_ws('; ', CASE WHEN c_custkey % 2 = 0 THEN '1 short form(s) without a full citation' END, CASE WHEN c_custkey % 3 = 0 THEN '2 supra reference(s) counted' END,
      CASE WHEN c_custkey % 4 > 1 THEN (c_custkey % 4 - 1) || ' repeated citation(s) merged' END) AS notes FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0 OR c_custkey % 4 > 0""",
    "abbreviated_names": "SELECT c_custkey::INT AS idx, c_custkey AS cluster_id, 1.0::DOUBLE AS sim FROM customer WHERE c_custkey % 3 < 2",
    "party_names": f"""WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS "at", upper(left(lang, 1)) || lower(substr(lang, 2)) || ' Co. of the (Ünion), ' || doc_id || ' & Sons' AS made FROM documents)
      SELECT doc_id, "at", {_party_sql('line')} AS line_fits, {_party_sql('made')} AS made_fits FROM d""",
    "fetched_cases": f"{JUDGED} SELECT o_orderkey AS cluster_id, case_name, concat_ws(' ', volume, reporter, page) AS citations FROM oc WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)",
    "table_cells": """SELECT page_id, md5(trim(replace(replace(coalesce(url || ' |' || chr(10) || html, ''), '|', '\\|'), chr(10), ' '), ' ')) AS cell_md5 FROM pages""",
}
