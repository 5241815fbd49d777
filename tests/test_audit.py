"""Extraction and verdicts on single documents, from text and stored replies to findings."""

import json
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from docketry.functions.schemas import FIXTURE, RAW_RECORD
from docketry.operators.benchmark import detection_metrics
from docketry.operators.extract import attribute_short_forms, citation_mentions, extract_citations, extraction_notes, scan_citations, scan_documents, sentence_ends
from docketry.operators.quotes import check_quotes, contained_quotes
from docketry.operators.reports import to_json, to_markdown
from docketry.plans import queries
from docketry.plans.audit import audit
from docketry.plans.fixtures import read_results, run_fixtures, write_results
from docketry.sources.files import catalogue, read_fixtures, read_json_reports, read_markdown, read_texts, sync_examples, write_json_reports, write_markdown

TEXTS = {
    "years": "In Marlowe v. Harbor Freight Lines Co., 431 U.S. 118, 129 (1977), the Court settled it. See also Delgado v. Pampas Rail Co., 871 F.3d 1502, 1511 (11th Cir. 2017) (\"a carrier answers for delay\").",
    "comma": "Okafor v. Summit Ferry Lines, Inc., 2018 WL 2290417 (Tex. App. May 3, 2018).",
    "long": "See Marlowe Ex Rel. Estate of Finch v. Harbor Freight Lines Co., 431 U.S. 118 (1977).",
    "break": "Brant v. Coyle, 412 F. Supp. 2d\n905 (S.D. Ga. 2006).",
    "spans": "First line.\n\n\nSecond   line cites 431 U.S. 118.",
    "short": "Marlowe v. Harbor Freight Lines Co., 431 U.S. 118, 129 (1977). That Court said no. Id. at 131. See 431 U.S. at 132.",
    "again": "Marlowe v. Harbor Freight Lines Co., 431 U.S. 118 (1977), governs here. What was said in Marlowe v. Harbor Freight Lines Co., 431 U.S. 118 (1977), binds all.",
    "kinds": "Under 42 U.S.C. § 1983 and Marlowe v. Harbor Freight Lines Co., 431 U.S. 118 (1977), no claim is left.",
    "neutral": "Nakamura v. Delta Barge, 2014 IL App (1st) 120458-U (Ill. App. Ct. 2014).",
    "prose": "Carriers read it otherwise. Castellan v. Union Tramways, Inc., 203 F.3d 415, 419-20 (2d Cir. 2000), is plain. See supra at 5.",
    "empty": "   \n  ",
    "none": "Nothing is cited here.",
}


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([*TEXTS.items(), ("null", None)], "doc_id string, text string")
    out = {}
    for r in extract_citations(docs).orderBy("doc_id", "idx").collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_extraction(found):
    a, b = found["years"]
    assert (a.year, b.year, a.case_name, b.case_name) == ("1977", "2017", "Marlowe v. Harbor Freight Lines Co.", "Delgado v. Pampas Rail Co.")
    assert (a.parenthetical, b.parenthetical, a.pin_cite, b.pin_cite) == (None, '"a carrier answers for delay"', "129", "1511")
    assert (a.court_source, a.court_id, b.court_source, b.court, b.court_id) == ("reporter", "scotus", "document", "11th Cir.", "ca11")
    (c,) = found["comma"]
    assert (c.case_name, c.court, c.year, c.cite_key) == ("Okafor v. Summit Ferry Lines, Inc.", "Tex. App.", "2018", "2018wl2290417")
    assert found["long"][0].case_name == "Marlowe Ex Rel. Estate of Finch v. Harbor Freight Lines Co." and found["break"][0].matched_text == "412 F. Supp. 2d 905"
    (s,) = found["spans"]
    assert "First line. Second line cites 431 U.S. 118."[s.spans[0].s : s.spans[0].e] == "431 U.S. 118" and s.case_name is None
    assert [r.occurrence_count for r in found["short"]] == [3] and [r.occurrence_count for r in found["again"]] == [2]
    assert {r.kind for r in found["kinds"]} == {"statute", "case"}
    n = found["neutral"][0]
    assert (n.volume, n.reporter, n.page) == ("2014", "IL App (1st)", "120458-U")
    p = found["prose"][0]
    assert (p.case_name, p.court_id, p.pin_cite) == ("Castellan v. Union Tramways, Inc.", "ca2", "419-20")
    assert p.verbatim == "Castellan v. Union Tramways, Inc., 203 F.3d 415, 419-20 (2d Cir. 2000)"
    assert not {"empty", "none", "null"} & found.keys()


def test_sentences_and_scan():
    text = "Delta Air Lines, Inc. won. See 431 U.S. 118. Why? Because J. Doe said so."
    assert [text[a:b].strip() for a, b in zip([0, *sentence_ends(text)], sentence_ends(text))] == ["Delta Air Lines, Inc. won.", "See 431 U.S. 118.", "Why?", "Because J. Doe said so."]
    assert scan_citations(None) == [] and sentence_ends("") == [0]
    assert [x[2] for x in scan_citations("550 U.S., at 556; Id.; supra; 550 U.S. 544")] == ["short", "id", "supra", "full"]


def test_notes(spark):
    docs = spark.createDataFrame([("a", TEXTS["again"]), ("p", TEXTS["prose"]), ("s", "See 999 F.3d at 5.")], "doc_id string, text string")
    notes = {r.doc_id: r.notes for r in extraction_notes(attribute_short_forms(citation_mentions(scan_documents(docs)))).collect()}
    assert "merged" in notes["a"][0] and "supra" in notes["p"][0] and "short" in notes["s"][0]


def case(cluster, name, cites, court="Supreme Court", filed="1977-01-16"):
    return (cluster, name, None, cites, court, None, filed, f"/opinion/{cluster}/", None)


Z = "Marlowe v. Harbor Freight Lines Co."
M = "Garrick v. Board of Water Supply"
E = "Sorensen v. Plains Airways, Inc."
MI = "Castellan v. Union Tramways, Inc."
CASES = {
    # name: (text, replies by query (and court), verdict, error class, check of the finding)
    "nowhere": ("See Delgado v. Pampas Rail Co., 871 F.3d 1502 (11th Cir. 2017).", {}, "fabricated", "fabricated_cite", lambda f: f.confidence == 0.9),
    "slot of another": ("Lindqvist v. Aral Air, 733 F. Supp. 2d 64 (D.D.C. 2010).", {("733 F. Supp. 2d 64", None): [case(1, "United States v. Tidal Dock Works, Inc.", ["733 F. Supp. 2d 64"])]}, "fabricated", "fabricated_case_name", lambda f: "Tidal Dock" in f.slot_owner.case_name),
    "agrees": (f"{Z}, 431 U.S. 118 (1977).", {(Z, None): [case(1, Z, ["431 U.S. 118", "97 S. Ct. 2044"])]}, "verified", "none", lambda f: f.confidence == 0.95),
    "another record": (f"{Z}, 431 U.S. 118 (1977).", {(Z, None): [case(1, Z, ["88 F.3d 402"])], ("431 U.S. 118", None): [case(2, Z, ["431 U.S. 118"])]}, "verified", "none", lambda f: "431 U.S. 118" in f.resolved.citations),
    "in its court": (f"{M}, 447 U.S. 903, 931 (1980).", {(M, None): [case(1, M, ["440 U.S. 1020"])], ("447 U.S. 903", None): [case(2, "Ibarra v. Doe", ["702 F.3d 218"])], ("447 U.S. 903", "scotus"): [case(3, M, ["447 U.S. 903"])]}, "verified", "none", lambda f: f.resolved.cluster_id == 3 and len(f.evidence) == 3),
    "bare": ("See 431 U.S. 118 (1977).", {("431 U.S. 118", None): [case(1, Z, ["431 U.S. 118"])]}, "verified", "none", lambda f: f.confidence == 0.75 and f.advisories),
    "wrong slot": (f"{E}, 412 F. Supp. 2d 905 (S.D. Ga. 2006).", {(E, None): [case(1, E, ["318 F.3d 277"], "2d Cir.")], ("412 F. Supp. 2d 905", None): [case(2, "BRANT v. Coyle", ["412 F. Supp. 2d 905"])]}, "miscited", "wrong_slot", lambda f: "318 F.3d 277" in f.suggestion),
    "wrong court": (f"{E}, 412 F. Supp. 2d 905 (S.D. Ga. 2006).", {(E, None): [case(1, E, ["318 F.3d 277"], "2d Cir.")]}, "miscited", "wrong_court", lambda f: f.suggestion),
    "circuit": (f"{MI}, 203 F.3d 415, 419-20 (2d Cir. 2000).", {(MI, None): [case(1, MI, ["203 Cal. App. 3d 611"], "Cal. Ct. App.")], ("203 F.3d 415", None): [case(2, "Ashby v. Morrow", ["203 F.3d 401"])]}, "fabricated", "fabricated_cite", lambda f: f.rule == "D5"),
    "other record only": (f"{M}, 447 U.S. 903 (1980).", {(M, None): [case(1, M, ["440 U.S. 1020"])]}, "unverifiable", "not_checked", lambda f: f.resolved.cluster_id == 1),
    "both fail": (f"{Z}, 431 U.S. 118 (1977).", {(Z, None): None, ("431 U.S. 118", None): None}, "unverifiable", "not_checked", lambda f: f.rule == "D2"),
    "public domain": (TEXTS["neutral"], {}, "fabricated", "fabricated_cite", lambda f: f.confidence == 0.7 and any("public-domain" in a for a in f.advisories)),
    "year differs": (f"{Z}, 431 U.S. 118 (1999).", {(Z, None): [case(1, Z, ["431 U.S. 118"])]}, "verified", "none", lambda f: any("year" in a for a in f.advisories)),
    "stem": (f"{Z}, 431 U.S. 118 (1977).", {("Marlowe v.*", None): [case(1, Z, ["431 U.S. 118"])]}, "verified", "none", lambda f: True),
}


@pytest.mark.parametrize("name", CASES)
def test_verdicts(spark, name):
    text, replies, verdict, error, check = CASES[name]
    rows = []
    for (query, court), cases in replies.items():
        asked = f'"{query}' if query.endswith("*") else f'"{query}"'
        rows += [(asked, court, i, False, c) for i, c in enumerate(cases)] if cases is not None else [(asked, court, 0, True, None)]
    stored = spark.createDataFrame(rows, f"query string, court string, rank int, failing boolean, record {RAW_RECORD}")
    done = audit(spark.createDataFrame([("d", text)], "doc_id string, text string"), replies=stored)
    (f,) = done.findings.collect()
    assert (f.verdict, f.error_class) == (verdict, error) and check(f)


def test_strict_takes_circuits_for_circuits_only(spark):
    """The id of a district of California begins like a circuit's."""
    docs = spark.createDataFrame([("d", f"{E}, 412 F. Supp. 2d 905 (N.D. Cal. 2006).")], "doc_id string, text string")
    stored = spark.createDataFrame([(f'"{E}"', None, 0, False, case(1, E, ["318 F.3d 277"], "2d Cir."))], f"query string, court string, rank int, failing boolean, record {RAW_RECORD}")
    assert [audit(docs, replies=stored, strict=s).findings.first().rule for s in (False, True)] == ["D5", "D6"]


def test_reports(spark):
    docs = spark.createDataFrame([("a", CASES["agrees"][0] + " " + TEXTS["kinds"]), ("b", "No citation."), ("c", CASES["nowhere"][0])], "doc_id string, text string")
    cases = spark.createDataFrame([(1, Z, ["431 U.S. 118"], "Supreme Court", "scotus", "1977-01-16", None, None)], "cluster_id long, case_name string, citations array<string>, court string, court_id string, date_filed string, absolute_url string, snippet string")
    done = audit(docs, cases)
    got = {r.doc_id: r for r in done.reports.collect()}
    assert (got["a"].verified, got["a"].integrity_score, got["a"].other_citations, got["a"].other_kinds) == (1, 100.0, 1, "statute")
    assert (got["b"].total, got["b"].integrity_score, got["b"].check_coverage) == (0, None, None) and got["c"].integrity_score == 0.0
    text = {r.doc_id: r.markdown for r in to_markdown(done.reports, done.findings).collect()}
    assert "| Verified | Marlowe v. Harbor Freight Lines Co. | 431 U.S. 118 | none | 0.95 |" in text["a"] and "It cites no case." in text["b"] and "Asked: `" in text["c"]
    extra = done.findings.where("doc_id = 'a'").withColumns(
        {
            "quote_check": F.struct(F.lit("q").alias("text"), F.lit("variant").alias("status"), F.lit(2).cast("long").alias("hits"), F.lit("A v. B").alias("matched_case"), F.lit("near words").alias("detail")),
            "fidelity": F.struct(F.lit("partial").alias("support"), F.lit(0.5).alias("confidence"), F.lit("because").alias("rationale"), F.lit("one\ntwo").alias("passage"), F.lit("m").alias("model")),
        }
    )
    (more,) = [r.markdown for r in to_markdown(done.reports.where("doc_id = 'a'"), extra).collect()]
    assert 'Quotation: similar wording only (2 matches, in A v. B, there: "near words").' in more and "(0.50). because" in more and "> one\n> two" in more
    assert all('"verified"' in r.json for r in to_json(done.reports, done.findings).collect())


RECORDS = "cluster_id long, case_name string, citations array<string>, court string, court_id string, date_filed string, absolute_url string, snippet string"


def test_filters_on_findings_plan_soon(spark):
    docs = spark.createDataFrame([("a", CASES["agrees"][0]), ("c", CASES["nowhere"][0])], "doc_id string, text string")
    found = audit(docs, spark.createDataFrame([(1, Z, ["431 U.S. 118"], "Supreme Court", "scotus", "1977-01-16", None, None)], RECORDS)).findings
    began = time.time()
    for condition, rows in (("verdict = 'fabricated'", 1), ("verdict is not null", 2), ("slot_owner is not null", 0), ("rule = 'D3' and resolved.cluster_id = 1 and suggestion is null", 1), ("size(advisories) > 0 or explanation like '%record%'", 1)):
        assert found.where(condition).count() == rows, condition
    assert time.time() - began < 60


def test_a_page_never_decides(spark):
    """Of 50 cases of one name, the one that lists the citation, or is of the court, is found; ``found`` counts all."""
    many = [(i, Z, [f"{i} F.2d 1"], "Other Court", None, "1950-01-01", None, None) for i in range(1, 51)]
    listing, court = (99, Z, ["431 U.S. 118"], "Z Court", None, "1950-01-01", None, None), (98, Z, ["7 F.2d 7"], "9th Cir.", "ca9", "1950-01-01", None, None)
    docs = spark.createDataFrame([("a", f"{Z}, 431 U.S. 118 (1977)."), ("b", f"{Z}, 500 F.3d 9 (9th Cir. 1977).")], "doc_id string, text string")
    got = {r.doc_id: r for r in audit(docs, spark.createDataFrame([*many, listing, court], RECORDS)).findings.collect()}
    assert (got["a"].rule, got["a"].resolved.cluster_id, got["a"].evidence[0].result_count) == ("D3", 99, 52)
    assert (got["b"].rule, got["b"].resolved.cluster_id) == ("D7", 98)
    without = audit(docs.where("doc_id = 'b'"), spark.createDataFrame(many, RECORDS)).findings.first()
    assert without.rule == "D5"


def test_fixtures_from_files_to_results(spark, tmp_path):
    expected = [{"citation_verbatim": "x", "case_name": Z, "volume": "431", "reporter": "U.S.", "page": "118", "verdict": "real"}, {"citation_verbatim": "y", "case_name": "No v. Such", "verdict": "fabricated"}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one.json").write_text(json.dumps({"title": "t", "text": CASES["agrees"][0] + " " + CASES["nowhere"][0], "expected": expected}))
    (tmp_path / "in/results.json").write_text("{}")
    fixtures = read_fixtures(spark, str(tmp_path / "in"))
    run = run_fixtures(fixtures, spark.createDataFrame([(1, Z, ["431 U.S. 118"], "Supreme Court", "scotus", "1977-01-16", None, None)], RECORDS))
    assert [r.citation for r in run.missed.collect()] == ["y"] and [r.verdict for r in run.unmatched.collect()] == ["fabricated"]
    assert read_results(spark, str(tmp_path / "out")).first().available is False
    write_results(run, str(tmp_path / "out"))
    (got,) = read_results(spark, str(tmp_path / "out")).collect()
    assert got.available and (got.summary.citations_expected, got.summary.correct_verdicts, got.summary.verdict_accuracy) == (2, 1, 1.0)
    assert {m.label: (m.true_positive, m.recall) for m in got.metrics} == {"real": (1, 1.0), "fabricated": (0, None), "miscited": (0, None)}
    assert {c.label: c.real for c in got.confusion} == {"real": 1, "fabricated": 0, "miscited": 0}
    (doc,) = run.documents.collect()
    assert (doc.doc_id, doc.expected, doc.found, doc.correct, doc.total) == ("one", 2, 1, 1, 2)
    empty = detection_metrics(run.matches.limit(0)).collect()
    assert sorted((r.label, r.true_positive, r.precision) for r in empty) == [("fabricated", 0, None), ("miscited", 0, None), ("real", 0, None)]


def test_stored_reports_and_files(spark, tmp_path):
    docs = spark.createDataFrame([("a", CASES["agrees"][0]), ("b", "No citation.")], "doc_id string, text string")
    done = audit(docs, spark.createDataFrame([(1, Z, ["431 U.S. 118"], "Supreme Court", "scotus", "1977-01-16", None, None)], RECORDS))
    path = str(tmp_path / "reports")
    write_json_reports(to_json(done.reports, done.findings), path)
    write_json_reports(to_json(done.reports.where("doc_id = 'a'"), done.findings), path)
    schema = "verified long, total long, findings array<struct<verdict:string>>"
    assert {(r.doc_id, r.verified, r.total) for r in read_json_reports(spark, path, schema).collect()} == {("a", 1, 1), ("b", 0, 0)}
    assert [r.findings[0].verdict for r in read_json_reports(spark, path, schema, "a").collect()] == ["verified"]
    made = to_markdown(done.reports, done.findings)
    for one in ("a", "b"):
        write_markdown(made.where(F.col("doc_id") == one), str(tmp_path / "md"))
    assert {r.doc_id: r.markdown for r in read_markdown(spark, str(tmp_path / "md")).collect()} == {r.doc_id: r.markdown for r in made.collect()}
    assert "It cites no case." in read_markdown(spark, str(tmp_path / "md"), "b").first().markdown
    fixtures = spark.createDataFrame([("one", "T", "u", None, "body", None)], FIXTURE)
    made, stale = sync_examples(fixtures, spark.createDataFrame([("one",), ("old",)], "name string"))
    assert [tuple(r) for r in made.collect()] == [("one", "T\nSource: u\n\nbody")] and [r.name for r in stale.collect()] == ["old"]
    (tmp_path / "texts").mkdir()
    for name, raw in (("b_two.txt", "zwei ü".encode()), ("a-one.txt", "eins".encode())):
        (tmp_path / "texts" / name).write_bytes(raw)
    assert [tuple(r) for r in catalogue(spark, str(tmp_path / "texts")).collect()] == [("a-one", "a one", "eins"), ("b_two", "b two", "zwei ü")]
    assert read_texts(spark, str(tmp_path / "texts"), strict=True).count() == 2
    (tmp_path / "texts/c.txt").write_bytes("drei ü".encode("latin-1"))
    assert {r.text for r in read_texts(spark, str(tmp_path / "texts")).collect()} == {"eins", "zwei ü", "drei ü"}
    with pytest.raises(Exception, match="UTF"):
        read_texts(spark, str(tmp_path / "texts"), strict=True).collect()


def test_quotes(spark):
    body = "Opinion. The treaty governs every claim for damages that arises from an accident on board. End."
    quotes = {1: "The treaty governs every claim for damages that arises", 2: "The treaty governs every claim for loss of goods at sea and on land", 3: "Words which no opinion anywhere has ever held in such an order", 4: "too short", 5: None}
    rows = [("d", i, q and f'"{q}"', (7, "A v. B") if i != 3 else None) for i, q in quotes.items()]
    f = spark.createDataFrame(rows, "doc_id string, idx int, parenthetical string, resolved struct<cluster_id:bigint,case_name:string>")
    texts = spark.createDataFrame([(7, body)], "cluster_id long, full_text string")
    got = {r.idx: r.quote_check and r.quote_check.status for r in check_quotes(f, texts).collect()}
    assert got == {1: "verbatim", 2: "variant", 3: "corpus_miss", 4: "skipped", 5: None}
    hits = spark.createDataFrame([("d", 3, 2, "C v. D", None)], "doc_id string, idx int, hits long, matched_case string, error string")
    assert {r.quote_check.hits for r in check_quotes(f, None, hits).where("idx = 3").collect()} == {2}
    held = contained_quotes(spark.createDataFrame([(1, quotes[1]), (2, quotes[2]), (3, "the end"), (4, None), (5, "board end")], "id int, text string"), spark.createDataFrame([(9, body), (8, None)], "id int, text string"))
    assert sorted((r.quote_id, r.source_id) for r in held.collect()) == [(1, 9), (5, 9)]


def test_all_short_quotes_are_searched(spark):
    r = random.Random(3)
    words = ["".join(r.choice("abcde") for _ in range(r.randrange(1, 7))) for _ in range(60)]
    sources = [(i, " ".join(r.choice(words) for _ in range(80))) for i in range(25)]
    quotes = []
    for i in range(3200):
        text, n = r.choice(sources)[1].split(), 1 + i % 8
        at = r.randrange(len(text) - n)
        run = " ".join(text[at : at + n])
        # As it stands, cut within its first and last word, or with a word of another place.
        cut = run[r.randrange(2) : len(run) - r.randrange(2)].strip() or run
        quotes.append((i, (run, cut, f"{run} {r.choice(words)}")[i % 3]))
    found = contained_quotes(spark.createDataFrame(quotes, "id int, text string"), spark.createDataFrame(sources, "id int, text string")).collect()
    expected = [(i, j) for i, q in quotes for j, text in sources if q in text]
    assert sorted((x.quote_id, x.source_id) for x in found) == sorted(expected)


def test_passages_of_all_languages(spark, tmp_path):
    body = "The carrier pays damages.\nNothing.\n" + "Every carrier is bound to pay the damages that a passenger shows." + " So it is." * 3
    rows = [(1, body, "en"), (2, body, "es"), (3, body, None), (4, None, "de"), (5, "The carrier.", "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, queries.passage_top3(spark, str(tmp_path)).collect())) == [(i, 1, 2, 2) for i in (1, 2, 3)]


def test_documents_are_too_long_beyond_the_limit(spark, tmp_path):
    rows = [("x" * 20_001,), ("x" * 400_000,), (" \n" + "x" * 400_000 + " ",), ("x" * 400_001,), (" \t",), (None,)]
    spark.createDataFrame(rows, "text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert dict(map(tuple, queries.admitted_documents(spark, str(tmp_path)).collect())) == {"accepted": 3, "too long": 1, "empty": 2}


@pytest.mark.parametrize("name", ["merged_authorities", "short_form_targets"])
def test_repeated_citations_of_all_ways(spark, name):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("orders", "customer"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    whole = queries.ORACLES[name]
    got = queries.QUERIES[name](spark, sf)
    expected = db.execute(f"SELECT {', '.join(got.columns)} FROM ({whole})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))


def test_streamed_audit(spark, tmp_path):
    from docketry.streaming.audits import audit_stream, first_requests, progress_status, read_arrivals, request_counts

    spark.createDataFrame([("a", CASES["nowhere"][0])], "doc_id string, text string").write.parquet(str(tmp_path / "in"))
    cases = spark.createDataFrame([(1, Z, ["431 U.S. 118"], "Supreme Court", "scotus", "1977-01-16", None, None)], "cluster_id long, case_name string, citations array<string>, court string, court_id string, date_filed string, absolute_url string, snippet string")
    audit_stream(read_arrivals(spark, str(tmp_path / "in")), cases, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert [r.verdict for r in spark.read.parquet(str(tmp_path / "out/findings")).collect()] == ["fabricated"]
    spark.createDataFrame([("GET", "/a", "", "2024-01-01 00:00:00", "hit"), ("GET", "/a", "", "2024-01-01 00:01:00", "miss"), ("GET", "/b", "", "2024-01-01 00:02:00", "hit")], "method string, url string, body string, t string, outcome string").withColumn("ts", F.to_timestamp("t")).write.parquet(str(tmp_path / "req"))
    asked = spark.readStream.schema("method string, url string, body string, t string, outcome string, ts timestamp").parquet(str(tmp_path / "req"))
    for name, df, mode in (("firsts", first_requests(asked), "append"), ("counts", request_counts(asked), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("firsts").count() == 2 and spark.table("counts").agg(F.sum("requests")).first()[0] == 3
    assert spark.range(1).select(progress_status(F.lit(0.8))).first()[0] == "checking"
