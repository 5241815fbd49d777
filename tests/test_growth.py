"""What a query needs stays bounded while its tables grow: plans, batches and bytes; and values that only large tables have."""

from pyspark.sql import functions as F

from docketry.functions.schemas import RECORD
from docketry.operators import quotes as Q
from docketry.operators.extract import scan_citations, scan_documents, scanned_in_steps


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_snippets_are_never_broadcast(spark):
    """Spark takes the citations' side, a few columns, for small whatever it holds: at 9,000,000 citations its broadcast ended the driver."""
    k = F.col("id")
    found = spark.range(50).select(F.lit("d").alias("doc_id"), k.cast("int").alias("idx"), F.when(k % 5 != 0, F.struct(k.alias("cluster_id"))).alias("resolved"))
    rec = lambda n, snippet: F.struct(n, F.lit("n"), F.array().cast("array<string>"), F.lit(None), F.lit(None), F.lit(None), snippet).cast(RECORD)
    rows = [(0, rec(k + 1, F.lit("other"))), (1, rec(k, F.when(k % 2 == 0, F.lit("")))), (2, rec(k, k.cast("string"))), (3, rec(k, F.lit("late")))]
    hits = spark.range(50).select(F.lit("d").alias("doc_id"), k.cast("int").alias("idx"), F.inline(F.array(*(F.struct(F.lit(n).alias("rank"), r.alias("rec")) for n, r in rows))))
    out = Q.snippet_passage(found, hits)
    assert "Broadcast" not in plan_of(out)
    assert sorted((r.idx, r.passage) for r in out.collect()) == [(n, str(n)) for n in range(50) if n % 5]


def test_sections_of_statutes_are_read_whole():
    """Sections beyond 99,999, which only tables of 100,000 rows and more make, were no citations."""
    text = "Under 42 U.S.C. § 100000 the claim fails. So says 17 C.F.R. 1234567.5 too. See 42 U.S.C. § 1983a-2 and 42 U.S.C. § 99999."
    assert [(m[3], m[6], m[8]) for m in scan_citations(text)] == [
        ("42 U.S.C. § 100000", "100000", "statute"), ("17 C.F.R. 1234567.5", "1234567.5", "statute"), ("42 U.S.C. § 1983a-2", "1983a-2", "statute"), ("42 U.S.C. § 99999", "99999", "statute"),
    ]


def test_scans_hand_back_what_they_hold(spark):
    """A step's texts come in by thousands, and what stands around their citations is many times as much."""
    texts = ["Ash v. Oak, 9 F.3d 7 (9th Cir. 1999). Id. at 8. " * n for n in (0, 1, 30, 2, 0, 400, 1)] + [None]
    held = lambda df: sum(len(v) for ms in df["mentions"] for m in ms for v in m.values() if isinstance(v, str))
    (whole,), steps = scanned_in_steps(texts, 1 << 40), list(scanned_in_steps(texts, 20_000))
    assert [x for df in steps for x in df["mentions"]] == list(whole["mentions"]) and [x for df in steps for x in df["ends"]] == list(whole["ends"])
    assert len(steps) >= 3 and sum(held(df) <= 20_000 for df in steps) >= len(steps) - 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    count = lambda most: sorted((r.doc_id, len(r.mentions), r.ends) for r in scan_documents(docs, most_held=most).collect())
    assert count(2_000) == count(1 << 40)


def test_decided_rows_hold_each_record_once(spark):
    """A record was stored up to eight times a row."""
    from docketry.operators.search import corpus_search
    from docketry.operators.verdicts import decided_rows, explain_verdicts

    k = F.col("id")
    name, cite = F.format_string("Birch%d Ash v. Oak", k), F.format_string("%d F.3d 7", k + 1)
    cases = spark.range(40).select(k.alias("cluster_id"), name.alias("case_name"), F.array(cite).alias("citations"), F.lit("9th Cir.").alias("court"), F.lit("ca9").alias("court_id"), F.lit("1999-01-01").alias("date_filed"), F.lit(None).cast("string").alias("absolute_url"), F.lit(None).cast("string").alias("snippet"))
    cited = spark.range(40).select(
        F.lit("d").alias("doc_id"), k.cast("int").alias("idx"), name.alias("case_name"), cite.alias("matched_text"), F.format_string("%df3d7", k + 1).alias("cite_key"), (k + 1).cast("string").alias("volume"), F.lit("F.3d").alias("reporter"), F.lit("7").alias("page"),
        F.lit("9th Cir.").alias("court"), F.lit("ca9").alias("court_id"), F.lit("document").alias("court_source"), F.lit("1999").alias("year"), F.lit(None).cast("array<string>").alias("extraction_notes"),
    )
    results, _ = corpus_search(cited, cases)
    decided = decided_rows(cited, results)
    assert not {"name_results", "cite_results", "court_results", "overall"} & set(decided.columns)
    assert {len(r._records) for r in decided.collect()} == {1}
    for r in explain_verdicts(decided).collect():
        assert (r.rule, r.resolved.cluster_id, [e.top.cluster_id for e in r.evidence]) == ("D3", r.idx, [r.idx, r.idx])


def test_names_are_exchanged_as_written_and_taken_apart_where_they_meet(spark):
    """Names in parts were written for both sides and exchanged twice; the word between the parties was looked up and exchanged by every name."""
    from docketry.functions.names import name_similarity
    from docketry.operators.corpus import corpus_of
    from docketry.operators.search import cited_names, match_distinct_names

    names = ["V", "v. v. v.", "In re V", "Ash v. Oak", "Ash Elm v. Oak", "ASH v OAK", "Elm", "V. Elm v. Oak", "Vine v. Oak", "Ash Elm Fir Gorse Hazel v. Oak", "Ash Elm Fir Gorse v. Oak", "", "The v. Co.", "A. v. B."]
    names += [f"Birch{chr(97 + k)} v. Oak{chr(97 + k % 3)}" for k in range(26)]
    cases = spark.createDataFrame([(k, n, [f"{k} F.3d 1"], None, None, None, None, None) for k, n in enumerate(names)], "cluster_id long, case_name string, citations array<string>, court string, court_id string, date_filed string, absolute_url string, snippet string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = match_distinct_names(cited_names(cases), corpus_of(cases))
        assert plan_of(found).count("SortMergeJoin") == 2  # beginnings of words, and tokens
        got = sorted(map(tuple, found.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    a, b = cases.where("case_name <> ''").select("case_name"), cases.select(F.col("case_name").alias("found_name"))
    every = a.crossJoin(b).select("case_name", "found_name", name_similarity("case_name", "found_name").alias("sim")).where("sim >= 0.8")
    assert got == sorted(map(tuple, every.collect())) and len(got) > len(names)


def test_mentions_are_dealt_by_document_once(spark):
    """Each window and each grouping dealt all that stands around the mentions anew."""
    from docketry.operators.extract import attribute_short_forms, citation_mentions, merge_authorities
    from docketry.sources.shared import stage

    text = "Ash v. Oak, 9 F.3d 7 (9th Cir. 1999). Id. at 8. See Elm v. Fir, 3 F.2d 5 (9th Cir. 1950). Compare 9 F.3d, at 9. Then 9 F.3d 7 (9th Cir. 1999). Id."
    found = attribute_short_forms(citation_mentions(scan_documents(spark.createDataFrame([(1, text), (2, text)], "doc_id int, text string"))))
    mentions = stage(found, "mentions")
    merged = merge_authorities(mentions)
    assert [plan_of(df).count("Exchange hashpartitioning") for df in (found, merged)] == [1, 1]
    at = lambda r: [text[s.s : s.e] for s in r.spans]
    assert [(r.doc_id, r.idx, r.cite_key, at(r)) for r in merged.orderBy("doc_id", "idx").collect()] == [
        (d, *row) for d in "12" for row in ((0, "9f3d7", ["9 F.3d 7", "Id. at 8", "9 F.3d, at 9", "9 F.3d 7", "Id."]), (1, "3f2d5", ["3 F.2d 5"]))
    ]


def _cited_cases(spark):
    """40 cases and a citation of each."""
    k = F.col("id")
    name, cite = F.format_string("Birch%d Ash v. Oak", k), F.format_string("%d F.3d 7", k + 1)
    cases = spark.range(40).select(k.alias("cluster_id"), name.alias("case_name"), F.array(cite).alias("citations"), F.lit("9th Cir.").alias("court"), F.lit("ca9").alias("court_id"), F.lit("1999-01-01").alias("date_filed"), F.lit(None).cast("string").alias("absolute_url"), F.lit(None).cast("string").alias("snippet"))
    cited = spark.range(40).select(F.lit("d").alias("doc_id"), k.cast("int").alias("idx"), name.alias("case_name"), F.format_string("%df3d7", k + 1).alias("cite_key"), F.lit("9th Cir.").alias("court"), F.lit("ca9").alias("court_id"), F.lit("document").alias("court_source"), F.lit("1999").alias("year"))
    return cited, cases


def test_searches_deal_citations_by_key_from_a_number_of_rows_on(spark, monkeypatch):
    """Spark broadcast a side of 900,000 citations, as its columns take few bytes, and dealt it at 9,000,000: what is shuffled grew faster than the rows."""
    from docketry.operators import search

    cited, cases = _cited_cases(spark)
    rows, plans = [], []
    for most in (200_000, 10):
        monkeypatch.setattr(search, "MOST_BROADCAST", most)
        results, _ = search.corpus_search(cited, cases)
        plans.append(plan_of(results))
        rows.append(sorted((r.idx, r.strategy, r["rank"], r.rec.cluster_id, r.sim, r.found) for r in results.collect()))
    assert "BroadcastHashJoin" in plans[0] and "BroadcastHashJoin" not in plans[1] and plans[1].count("SortMergeJoin") == 2  # by name and by citation
    assert rows[0] == rows[1] and len(rows[0]) == 120


def test_pairs_of_names_meet_records_where_they_are_made_distinct(spark):
    """Pairs were dealt by both names, written, and dealt again by the found one."""
    from docketry.operators.corpus import corpus_of
    from docketry.operators.search import cited_names, match_distinct_names

    cited, cases = _cited_cases(spark)
    corpus = corpus_of(cases)
    found = match_distinct_names(cited_names(cited), corpus).hint("merge").join(corpus.records, "found_name")
    dealt = [line for line in plan_of(found).split("\n") if "Exchange hashpartitioning" in line and "name" in line]
    assert len(dealt) == 2 and all("hashpartitioning(found_name" in line for line in dealt)  # pairs and records
    assert found.count() == 40


def test_orders_meet_customers_once_for_citations_and_cases(spark, monkeypatch):
    from docketry.plans import derived, stated

    read, table = [], derived.table
    monkeypatch.setattr(derived, "table", lambda spark, sf_dir, name: read.append(name) or table(spark, sf_dir, name))
    assert stated.verdict_rows(spark, "/root/testdata/sf0.001").count() > 0
    assert sorted(read) == ["customer", "orders"]


def test_phrases_exchange_no_places_but_those_asked_for(spark, monkeypatch, tmp_path):
    """All places of the words of all phrases were exchanged twice; and an index was made of texts read twice, as ranges of words are sampled."""
    from docketry.operators import phrases as P

    texts = spark.range(60).select("id", F.concat(F.lit("the of the rare"), F.col("id") % 7, F.lit(" of the end")).alias("text"))
    read = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda x: read.add(1) or x, "long")
    P.add_to_index(texts.select(counted("id").alias("id"), "text"), str(tmp_path / "i"))
    assert read.value == 60
    places = P.read_index(spark, str(tmp_path / "i")).select(*P.PLACE)
    due = spark.createDataFrame([("p", 3, 0, "the", 0), ("p", 3, 0, "of", 1), ("q", 3, 0, "the", 0), ("q", 5, 1, "of", 2)], "phrase_id string, source_id long, begin int, token string, at int")
    near = P.places_due(places, due)
    assert sorted(map(tuple, near.collect())) == [("of", 3, 1), ("the", 3, 0)] and "BroadcastHashJoin" in plan_of(near)
    asked = spark.createDataFrame([(1, "the of the rare3"), (2, "rare3 of the end"), (3, "of rare3")], "id long, text string")
    rows = []
    for most in (200_000, 0):
        monkeypatch.setattr(P, "MOST_WORDS", most)
        rows.append(sorted(map(tuple, P.phrase_matches(asked, P.read_index(spark, str(tmp_path / "i"))).collect())))
    assert rows[0] == rows[1] == [(p, k) for p in (1, 2) for k in range(3, 60, 7)]


def test_names_and_courts_are_worked_out_once(spark):
    """A name was put in lower case nine times to be taken apart, and a court several times for its form."""
    from docketry.functions import names as N
    from docketry.functions import text as X

    name = F.concat(F.lit("The Ash Co. v. "), F.col("id").cast("string"))
    times = lambda x, what: spark.range(1).select(x.alias("x"))._jdf.queryExecution().optimizedPlan().toString().count(what)
    assert times(N.name_parts(name), "[^a-z0-9]+") == 3  # of all, and of each side
    assert times(X.court_token(name), "translate(") == 1
    assert times(N.is_plausible_party(name), "split(") == 1
    courts = spark.createDataFrame([("11th Cir.",), ("2d Cir.",), ("11th Cir.\nx",), ("U.S.",), ("S.D.N.Y.",), (None,)], "c string")
    assert [tuple(r) for r in courts.select(X.court_token("c"), X.court_token("c", strict=True)).collect()] == [("ca11", "ca11"), ("2dcir", "ca2"), ("ca11", "ca11"), ("scotus", "scotus"), ("sdny", "sdny"), ("", "")]
    odd = spark.createDataFrame([("a  b",), ("a\x85b\x1c\u3000c ",), (" a b",), ("",), (None,)], "t string")
    assert [r[0] for r in odd.select(X.one_line("t")).collect()] == ["a b", "a b c ", " a b", "", None]


def test_what_reporters_tell_is_remembered_whatever_the_page():
    """Each page was a new question to forty patterns, since the text after a reporter holds it."""
    from docketry.operators.extract import told_by

    told_by.cache_clear()
    found = [m for n in range(1000) for m in scan_citations(f"{n + 1} U.S. {n + 7} and 9 A.D.2d {n + 1}, 9 Cal. {n + 3}")]
    assert {m[9] for m in found} == {"scotus", "nyappdiv", "cal"} and len(found) == 3000
    assert told_by.cache_info().misses < 50
