import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from docketry.functions import names as N
from docketry.functions import text as X
from docketry.operators import quotes as Q
from docketry.operators import reports as R
from docketry.operators.benchmark import LABELS, confusion_matrix, detection_metrics, latest, summary
from docketry.operators.records import opinion_texts, parsed_reply, record_of
from docketry.operators.support import check_support, clean_reply, parse_reply
from docketry.sources.files import admitted, cache_replies, decoded, docx_text, read_fixtures, title_of


def one(spark, **columns):
    """The first row of expressions over no table."""
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def each(spark, values, expression):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").select("i", expression(F.col("x")).alias("y"))
    return [r.y for r in rows.orderBy("i").collect()]


def test_white_space_is_pythons(spark):
    samples = ["a" + chr(c) + "b" for c in (*range(1, 0x300), *range(0x1680, 0x1690), *range(0x1FF0, 0x2070), 0x3000)] + [None, "", "  a \n b  "]
    got = each(spark, samples, X.normalized)
    assert got == [re.sub(r"\s+", " ", s or "").strip() for s in samples]


def test_keys(spark):
    assert each(spark, ["733 F. Supp. 2d 64", "733 F.Supp.2d 64", "733 f supp 2d, 64", None, ""], X.reporter_key) == ["733fsupp2d64"] * 3 + ["", ""]
    lit = F.lit
    assert one(spark, a=X.cite_key(lit("431"), lit("U.S."), lit("118")), b=X.cite_key(lit("431"), lit(None), lit("118")), c=X.cite_key(lit(""), lit("U.S."), lit("1")))[:] == ("431us118", None, None)


@pytest.mark.parametrize(
    ("cited", "candidate", "score"),
    [
        ("Marlowe v. Harbor Freight Lines Co.", "Marlowe Ex Rel. Estate of Finch v. Harbor Freight Lines Co.", 1.0),
        ("Okafor v. Summit Ferry Lines", "Lind v. Summit Ferry Lines", 0.0),
        ("Norr Atl. Corp. v. Quine", "NORR ATLANTIC CORPORATION v. Quine", 1.0),
        ("Norr Atl v. Quine", "Norr Atlantic v. Quine", 0.5),
        ("In re Smith", "Smith v. Jones", 1.0),
        (None, "Smith v. Jones", 0.0),
        ("The Co. v. Estate", "The Co. v. Estate", 1.0),
        ("A & B v Doe", "A and B vs. Doe", 0.75),
    ],
)
def test_name_similarity(spark, cited, candidate, score):
    assert one(spark, s=N.name_similarity(F.lit(cited).cast("string"), F.lit(candidate)))[0] == score


def test_party_names(spark):
    assert each(spark, ["Smith v. Jones", "Smith v Jones", "Smith V. Jones v. Doe", "Smith", None], N.sides) == [["Smith", "Jones"], ["Smith", "Jones"], ["Smith", "Jones v. Doe"], None, None]
    names = ["Castellan v. Union Tramways, Inc.", "See also Smith", "court held", "El Rio Norte", "A " * 21, "", "(In re) Smith & Co."]
    assert each(spark, names, N.is_plausible_party) == [True, False, False, True, False, False, True]


def test_quotes(spark):
    assert each(spark, ["“The  ‘law’ … is [sic] clear”...", None], X.comparable_quote) == ["the law is clear", ""]
    long_ = "one two three four five six seven eight nine"
    assert each(spark, [long_, "one two three", "incomprehensibilities and counterrevolutionaries"], X.is_distinctive) == [True, False, False]
    lit = F.lit
    source = "we hold that the treaty governs every claim for damages arising on board"
    assert one(spark, a=Q.closest_words(lit(source), lit("the treaty governs every claim for injury")), b=Q.closest_words(lit(source), lit("the treaty governs every passenger claim")), c=Q.closest_words(lit(source), lit("no such words stand here at all")))[:] == (
        "the treaty governs every claim for damages", "the treaty governs every claim for", None)


def test_courts_years_markup(spark):
    assert each(spark, ["11th Cir.", "2d Cir.", "Supreme Court", "U.S.", "ca9", None, "S.D.N.Y."], X.court_token) == ["ca11", "2dcir", "scotus", "scotus", "ca9", "", "sdny"]
    assert each(spark, ["2d Cir."], lambda c: X.court_token(c, strict=True)) == ["ca2"]
    assert each(spark, ["1977-01-16", "16/01/2003", "1850", None], X.year_in) == ["1977", "2003", None, None]
    assert each(spark, ["Tex. App. Apr. 11,", "2d Cir.,", "Jan.", "D.C. Cir. May 3", ""], X.court_written) == ["Tex. App.", "2d Cir.", None, "D.C. Cir.", None]
    assert each(spark, ["<p>a  b</p>\r\n\r\n\r\n<p>c\td</p>"], X.without_markup) == ["a b\n\nc d"]


def test_numbers(spark):
    lit = F.lit
    assert one(spark, a=X.percent(lit(1), lit(16)), b=X.percent(lit(0), lit(0)), c=X.ratio(lit(2), lit(3)), d=X.retry_after(lit("x")), e=X.retry_after(lit("0.1")))[:] == (6.2, None, 0.6667, 36.0, 0.5)


def test_passages(spark):
    body = "\n\n".join([f"Paragraph {w} says something on {w} at length, with words enough to count here." for w in ("treaty", "baggage", "weather", "treaty baggage")] + ["short treaty"])
    got = one(spark, p=Q.best_passage(F.lit(body), F.lit("The treaty and the baggage")), none=Q.best_passage(F.lit("abc def"), F.lit("xyzzy")), empty=Q.best_passage(F.lit(""), F.lit("x")))
    assert [p.split(" says")[0] for p in got.p.split("\n\n")] == ["Paragraph treaty", "Paragraph baggage", "Paragraph treaty baggage"] and got.none == "abc def" and got.empty is None


def test_records(spark):
    reply = {"results": [{"cluster_id": 1, "caseName": "A v. B", "citation": "1 U.S. 1", "court": "scotus", "absolute_url": "/o/1/", "opinions": [{"snippet": "x\n y"}]}, {"cluster_id": 2, "caseNameFull": "C v. D", "citation": ["2 U.S. 2", "3 F.3d 3"]}]}
    rows = spark.createDataFrame([(json.dumps(reply),), ("broken",)], "p string").select(F.explode(parsed_reply(F.col("p"))).alias("r")).select(record_of(F.col("r"), "https://x").alias("c")).select("c.*").collect()
    got = {r.case_name: (r.citations, r.court, r.absolute_url, r.snippet) for r in rows}
    assert got["A v. B"] == (["1 U.S. 1"], "scotus", "https://x/o/1/", "x y") and got["C v. D"][1:] == (None, None, None)
    ops = spark.createDataFrame([(1, 5, k, None, f"<b>t{k}</b>", None, None, None) for k in range(6)] + [(2, 5, 0, None, "", None, None, None), (3, 6, 0, None, None, None, None, None)], "opinion_id long, cluster_id long, ord int, plain_text string, html_with_citations string, html string, html_lawbox string, xml_harvard string")
    assert {r.cluster_id: r.full_text.replace(" ", "") for r in opinion_texts(ops.where("html_with_citations <> '' or cluster_id = 6"), 4, 100).collect()} == {5: "t0\n\nt1\n\nt2\n\nt3"}


def test_model_replies(spark):
    replies = ['{"support": "Not Supported", "confidence": 7, "rationale": "r", "passage": "the law"}', '```json\n{"support": "partial"}\n```', 'Sure {"support": "odd", "confidence": -1} ok', "[1]", "no", None]
    got = each(spark, replies, lambda x: clean_reply(parse_reply(x), F.lit("So the “law” is")))
    assert [r.support for r in got] == ["not_supported", "partial", "unknown", "unknown", "unknown", "unknown"]
    assert [r.confidence for r in got][:3] == [1.0, None, 0.0] and got[0].passage == "the law"


def test_support_asks_only_with_passages(spark):
    f = spark.createDataFrame([("d", 0, "s", "A v. B", "1 U.S. 1", (1, "A v. B")), ("d", 1, "s", "C v. D", "2 U.S. 2", None), ("d", 2, "s", "E v. F", "3 U.S. 3", (3, "E v. F"))],
                              "doc_id string, idx int, context string, case_name string, matched_text string, resolved struct<cluster_id:bigint,case_name:string>")
    p = spark.createDataFrame([("d", 0, "the passage", "the text"), ("d", 1, "another", "the text")], "doc_id string, idx int, passage string, origin string")
    got = {r.idx: r.fidelity for r in check_support(f, p, lambda rows: ['{"support": "supported", "confidence": 0.9}'] * len(rows), "m").collect()}
    assert [got[i].support for i in range(3)] == ["supported", "unknown", "unknown"] and got[0].rationale == "Passage source: the text."
    assert check_support(f, p, None).where("fidelity is null").count() == 3


def test_metrics(spark):
    rows = [("real", "real")] * 19 + [("fabricated", "fabricated")] * 7 + [("fabricated", "miscited")] + [("miscited", "miscited")] * 2 + [("real", None), ("real", "unverifiable")]
    m = spark.createDataFrame(rows, "expected string, predicted string")
    got = {r.label: (r.true_positive, r.false_positive, r.false_negative, r.precision, r.recall, r.f1) for r in detection_metrics(m).collect()}
    assert got["fabricated"] == (7, 0, 1, 1.0, 0.875, 0.9333) and got["miscited"] == (2, 1, 0, 0.6667, 1.0, 0.8)
    assert {r.label: r.unverifiable for r in confusion_matrix(m).collect()} == {"real": 1, "fabricated": 0, "miscited": 0} and len(LABELS) == 3
    s = summary(m).first()
    assert (s.citations_expected, s.citations_found, s.correct_verdicts, s.citations_decided, s.verdict_accuracy) == (31, 30, 28, 29, 0.9333)


def test_spans_and_order(spark):
    spans = F.expr("array(named_struct('s', 8, 'e', 99, 'id', 3), named_struct('s', -2, 'e', 2, 'id', 1), named_struct('s', 1, 'e', 4, 'id', 2), named_struct('s', 5, 'e', 5, 'id', 4))")
    got = one(spark, x=R.span_segments(F.lit("0123456789"), spans)).x
    assert [(p.s, p.e, p.id) for p in got] == [(0, 2, 1), (2, 8, None), (8, 10, 3)]
    assert each(spark, ["verified", "fabricated", "miscited", "unverifiable"], R.severity) == [3, 0, 1, 2]


def greedy(n, spans):
    """Segments by a loop over the spans in order."""
    at, out = 0, []
    clamp = lambda x: min(max(x, 0), n)
    for s, e, i in sorted(((clamp(s), clamp(e), i) for s, e, i in spans), key=lambda x: (x[0], -x[1], x[2])):
        if e > s >= at:
            out += ([(at, s, None)] if s > at else []) + [(s, e, i)]
            at = e
    return out + ([(at, n, None)] if at < n else [])


def test_many_spans_of_one_document(spark):
    r = random.Random(4)
    n = 1_000_000
    cases = [[(s, s + r.randrange(40), k) for k in range(50_000) for s in [r.randrange(-5, n)]], [(3, 9, 1), (3, 12, 2), (12, 12, 3)], []]
    cases += [[(s, s + 1, s) for s in range(m)] for m in (255, 256, 257, 512, 513)]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(cases)], "k int, spans array<struct<s:int,e:int,id:int>>")
    began = time.time()
    got = {x.k: [tuple(p) for p in x.seg] for x in rows.select("k", R.span_segments(F.repeat(F.lit("x"), n), F.col("spans")).alias("seg")).collect()}
    assert got == {k: greedy(n, x) for k, x in enumerate(cases)}
    assert time.time() - began < 60


def test_sources(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x"), (2, " \n"), (3, None), (4, " " + "y" * 30 + " ")], "id int, text string")
    good, bad = admitted(docs, longest=20)
    assert [r.id for r in good.collect()] == [1] and {r.id: r.reason for r in bad.collect()} == {2: "empty", 3: "empty", 4: "too long"}
    assert each(spark, ["/a/b/my_brief-2.final.txt"], title_of)[0] in ("my brief 2", "my brief 2.final")
    b = spark.createDataFrame([(bytearray("é".encode()),), (bytearray(b"\xe9"),)], "c binary").select(decoded(F.col("c")).alias("t"))
    assert [r.t for r in b.collect()] == ["é", "é"]
    (tmp_path / "a.json").write_text(json.dumps({"title": "t", "text": "x", "expected": [{"volume": "1"}]}))
    (tmp_path / "results.json").write_text("{}")
    (tmp_path / "c.json").write_text(json.dumps({"id": "c", "text": "x"}))
    assert [r.id for r in read_fixtures(spark, str(tmp_path)).collect()] == ["a"]
    assert docx_text(b"no zip", True) is None
    stored = spark.createDataFrame([("GET", "/a", "", '{"x": 1}'), ("GET", "/b", "", "bad")], "m string, u string, b string, body string").select(X.request_key("m", "u", "b").alias("key"), F.lit(200).alias("status"), "body", F.lit(0).alias("created_at"))
    hits, misses = cache_replies(spark.createDataFrame([("GET", "/a", ""), ("GET", "/b", ""), ("GET", "/c", "")], "method string, url string, body string"), stored)
    assert [r.url for r in hits.collect()] == ["/a"] and sorted(r.url for r in misses.collect()) == ["/b", "/c"]
    assert [r.v for r in latest(spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "k int, t int, v string"), "k", "t").collect()] == ["b"]


def test_docx(tmp_path):
    import io
    import zipfile

    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    xml = f"<w:document {ns}><w:body>{p('one')}<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>{p('two')}</w:body></w:document>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    assert docx_text(out.getvalue(), True) == "one\ntwo\na\tb" and docx_text(out.getvalue(), False) == "one\ntwo"
