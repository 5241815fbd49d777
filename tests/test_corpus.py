"""Kept corpora: no exchange of their tables, additions, audits without the raw cases; phrase indexes."""

import random
import re

from pyspark.sql import functions as F

from docketry.operators import phrases as P
from docketry.operators.corpus import KEYS, drop_corpus, keep_corpus, open_corpus
from docketry.operators.search import cited_names, corpus_search, match_distinct_names
from docketry.plans.audit import audit

CASES = "cluster_id long, case_name string, citations array<string>, court string, court_id string, date_filed string, absolute_url string, snippet string"


def some_cases(spark):
    words = "Alder Birch Cedar Dogwood Elm Fir Gorse Hazel".split()
    rows = [(k, f"{words[k % 8]}{k % 50} {words[k % 3]} v. {words[k % 5]} Co.", [f"{k} F.3d {k + 1}"], "9th Cir.", "ca9", "1999-01-02", None, None) for k in range(200)]
    return spark.createDataFrame([*rows, (None, "No Id v. Case", [], None, None, None, None, None)], CASES)


def exchanges_over(df, name):
    """Scans of tables with ``name`` in their name, each with the exchanges between it and the nearest join above it."""
    above, out = [], []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(re.match(r"[ :+\-|]*", line)[0])
        while above and above[-1][0] >= depth:
            above.pop()
        if "FileScan" in line and name in line:
            nearest = []
            for _, node in reversed(above):
                if "Join" in node:
                    break
                nearest.append(node)
            out.append([n for n in nearest if "Exchange" in n])
        above.append((depth, line))
    return out


def test_searches_never_exchange_a_kept_corpus(spark, tmp_path):
    cases = some_cases(spark)
    path = f"file:{tmp_path}/c"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for half in (0, 1):
            corpus = keep_corpus(cases.where(F.coalesce(F.col("cluster_id") % 2, F.lit(0)) == half), "kept_a", path, buckets=4)
        cited = cases.where("cluster_id < 60").select(F.lit("d").alias("doc_id"), F.col("cluster_id").cast("int").alias("idx"), "case_name", F.lit("x").alias("cite_key"))
        found = match_distinct_names(cited_names(cited), corpus)
        scans = exchanges_over(found, "kept_a_")
        assert len(scans) == 2 and not any(scans)
        by_name = found.join(corpus.records, "found_name")
        assert len(exchanges_over(by_name, "kept_a_records[")) == 1 and not any(exchanges_over(by_name, "kept_a_records["))
        by_slot = cited.join(corpus.slots, "cite_key")
        assert exchanges_over(by_slot, "kept_a_slots[") == [[]]
        expected = match_distinct_names(cited_names(cited), keep_corpus(cases, "kept_b", f"file:{tmp_path}/d", buckets=2))
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect())) and found.count() >= 60
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
        drop_corpus(spark, "kept_a")
        drop_corpus(spark, "kept_b")


def test_audit_reads_no_raw_case_and_leaves_no_table(spark, tmp_path):
    from docketry.sources.shared import shared_dir

    raw = f"{tmp_path}/raw"
    some_cases(spark).write.parquet(raw)
    keep_corpus(spark.read.parquet(raw), "kept_c", f"file:{tmp_path}/e", buckets=4)
    drop_corpus(spark, "kept_c")  # the files stay, and another session's catalogue is told of them
    corpus = open_corpus(spark, "kept_c", f"file:{tmp_path}/e", buckets=4)
    docs = spark.createDataFrame([("d", "Birch1 Birch v. Birch Co., 1 F.3d 2 (9th Cir. 1999). Nobody v. Noone, 999 F.3d 1 (9th Cir. 1999).")], "doc_id string, text string")
    spark.createDataFrame([(1,)], "x int").write.mode("overwrite").parquet(raw)  # no case is left to be read
    folder = f"{shared_dir(spark)}/docketry"
    from pathlib import Path

    before = {p.name for p in Path(folder).iterdir()} if Path(folder).exists() else set()
    done = audit(docs, corpus)
    assert {r.case_name: r.rule for r in done.findings.collect()} == {"Birch1 Birch v. Birch Co.": "D3", "Nobody v. Noone": "D10"}
    assert done.reports.count() == 1
    done.discard()
    assert {p.name for p in Path(folder).iterdir()} == before
    assert sorted(KEYS) == sorted(p.name for p in (tmp_path / "e").iterdir())
    drop_corpus(spark, "kept_c")


def test_searches_of_a_corpus_that_grew(spark, tmp_path):
    cases = some_cases(spark).where("cluster_id is not null")
    for part in (cases.where("cluster_id < 70"), cases.where("cluster_id >= 70"), cases.limit(0)):
        corpus = keep_corpus(part, "kept_d", f"file:{tmp_path}/f", buckets=4)
    asked = cases.select(F.lit("d").alias("doc_id"), F.col("cluster_id").cast("int").alias("idx"), "case_name", F.format_string("%df3d%d", "cluster_id", F.col("cluster_id") + 1).alias("cite_key"), "court", "court_id", F.lit("document").alias("court_source"), F.lit("1999").alias("year"))
    rows = [sorted((r.idx, r.strategy, r["rank"], r.rec.cluster_id, r.sim, r.found) for r in corpus_search(asked, c)[0].collect()) for c in (corpus, cases)]
    assert rows[0] == rows[1] and len(rows[0]) >= 600
    drop_corpus(spark, "kept_d")


def test_phrases_against_a_search_of_every_text(spark, tmp_path):
    r = random.Random(6)
    text = lambda n: " ".join(r.choice(["the", "the", "of", "a", "rare", "Rare.", "b-c", "[x]", "", "é"]) for _ in range(n))
    texts = [(k, text(r.randrange(40))) for k in range(80)] + [(90, None), (91, ""), (92, "the " * 500)]
    phrases = [(k, text(r.randrange(1, 6))) for k in range(60)] + [(70, None), (71, ""), (72, "the the the"), (73, "never seen"), (74, "the of"), (75, "the of")]
    for part in (texts[:40], texts[40:]):
        P.add_to_index(spark.createDataFrame(part, "id long, text string"), str(tmp_path / "i"))
    index = P.read_index(spark, str(tmp_path / "i"))
    got = sorted(map(tuple, P.phrase_matches(spark.createDataFrame(phrases, "id long, text string"), index).collect()))

    def plain(x):
        x = re.sub(r"\[[^\]]*\]", " ", re.sub(r"\.\.\.", " ", x or ""))
        return re.sub("[^A-Za-z0-9]+", " ", x).strip().lower()

    assert got == sorted((p, t) for p, x in phrases for t, y in texts if plain(x) and f" {plain(x)} " in f" {plain(y)} ")
    assert P.phrase_hits(spark.createDataFrame([(1, "nothing of it")], "id long, text string"), index).count() == 0
