import hashlib
import json
import math
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docketry.llm import chat_format as chat
from docketry.llm import near_dedup as near
from docketry.llm import quality_qda, toxicity
from docketry.llm.compression_rules import BANDS, compression_rules, repeated_words
from docketry.llm.line_dedup import drop_common_lines, hits_of
from docketry.llm.packing import Encoder, Packer, pack_documents
from docketry.llm.quality_qda import fit_quality
from docketry.llm.queries import SITE_RULES, tokenizer_path
from docketry.llm.source_mixing import mix_sources
from docketry.llm.topk_search import top_k
from docketry.llm.toxicity import fit_toxicity
from docketry.llm.url_filter import PATTERNS, filter_urls, host_of, match_rules, path_of, pattern_rule, rule_index, rules_of

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n=60):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use themselves."""
    long_ = " ".join(f"w{i}" for i in range(30_000))
    rows = [
        (1, None, "en", "src1"), (2, "", None, None), (3, " \t\n ", "en", "src2"), (None, "some words here", "de", "src3"), (None, None, None, None),
        (4, prose(1), "en", "src1"), (4, prose(1), "en", "src1"), (5, long_, "fr", "web"), (6, "one", "en", "src1"), (7, "\n\n", "en", "src9"),
    ]
    extra = ["kept", "n_lines", "score", "class_id", "epoch", "domain", "host", "rank", "_id", "size", "label", "bucket", "__features"]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("own") for c in extra})


# -- 1: compression bands --------------------------------------------------------------------------------------------


def measures(text):
    text = text or ""
    words = [w for w in "".join(c if c not in " \t\n\v\f\r" else " " for c in text).split(" ") if w]
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    counts = Counter(grams)
    covered = {k + j for k, g in enumerate(grams) if counts[g] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_compression_base_measures(spark):
    docs = documents(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in compression_rules(docs).collect():
        own = measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == own
        failed = own[0] < 10 or 100 * own[4] > 20 * own[0]
        assert r.base_failed == failed and (not failed or not r.kept)


def test_compression_bands_reject(spark):
    pick = random.Random(2).choice
    noise = "".join(pick("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(9000))
    noise = " ".join(noise[k : k + 9] for k in range(0, 9000, 9))
    flat = " ".join(f"{'ab' * 40}{i % 3}{i}" for i in range(100))
    rows = spark.createDataFrame([(1, prose(1, 400)), (2, noise), (3, flat)], "doc_id long, text string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in compression_rules(rows).collect()}
    assert got == {1: (False, True), 2: (False, False), 3: (False, False)}


def brute_kept(text):
    import zstandard

    raw = (text or "").encode()
    n_words, _, _, _, again = measures(text)
    if n_words < 10 or 100 * again > 20 * n_words:
        return False

    def fits(piece):
        low, high = [(low, high) for least, low, high in BANDS if least <= len(piece)][-1]
        return low <= len(zstandard.ZstdCompressor(level=3).compress(piece)) / len(piece) <= high

    bad = sum(len(raw[k : k + 2048]) for k in range(0, len(raw), 2048) if not fits(raw[k : k + 2048]))
    return fits(raw) and bad <= 0.34 * len(raw)


def test_compression_verdicts_against_brute_force(spark):
    r = random.Random(6)
    texts = [x.text for x in documents(spark).collect()]
    for n in (40, 300, 1100, 2047, 2048, 2049, 2100, 2900, 5000, 9000, 40_000):
        texts += [" ".join(r.choice(WORDS) for _ in range(n // 6)), "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789     ") for _ in range(n)), prose(n, n // 8), (prose(n, n // 16) + " ") + "".join(r.choice("ABCDEF0123456789 ") for _ in range(n // 2))]
    got = compression_rules(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert {x.doc_id: x.kept for x in got} == {i: brute_kept(t) for i, t in enumerate(texts)} and {True, False} == {x.kept for x in got}


def test_compression_odd_rows(spark, odd):
    out = compression_rules(odd)
    assert out.count() == odd.count() and dict(out.dtypes)["kept"] == "boolean"
    assert not out.where("text is null or trim(text) = ''").where("kept").count()
    assert compression_rules(odd.limit(0)).count() == 0
    assert repeated_words(list("abcdeabcde")) == 10 and repeated_words([]) == 0 and repeated_words(list("aaaaaa")) == 6


# -- 2: mixing -------------------------------------------------------------------------------------------------------


def test_mixing_moves_shortages_to_siblings_first(spark):
    rows = [(i, "a b c d e f g h i j", "en", s) for s, n in (("src0", 2), ("src4", 100), ("src1", 100)) for i in range(n)]
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    out = mix_sources(spark.createDataFrame(rows, DOCS), share_percent=50, max_epochs=1)
    got = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    # Half of 2020 tokens, 505 a domain: src0 (web) has 20, so its sibling src4 takes the other 485.
    assert got["src0"] == 2 and got["src4"] == math.ceil(48.5) and got["src1"] == math.ceil(50.5)


def test_mixing_epochs_and_seed(spark):
    rows = [(i, "a b c d e", "en", "src0" if i < 10 else "src1") for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    weights = {"domain": {"web": 9, "forum": 1}}
    out = mix_sources(docs, share_percent=40, max_epochs=3, weights=weights).collect()
    web = [(r.doc_id, r.epoch) for r in out if r.domain == "web"]
    assert len(web) == len(set(web)) and 20 <= len(web) <= 30 and {e for _, e in web} == {0, 1, 2}
    again = mix_sources(docs.repartition(7), share_percent=40, max_epochs=3, weights=weights).collect()
    assert sorted((r.doc_id, r.epoch) for r in out) == sorted((r.doc_id, r.epoch) for r in again)
    other = mix_sources(docs, share_percent=40, max_epochs=3, weights=weights, seed=12).collect()
    assert sorted((r.doc_id, r.epoch) for r in out) != sorted((r.doc_id, r.epoch) for r in other)


def test_mixing_odd_rows(spark, odd):
    out = mix_sources(odd, share_percent=100, max_epochs=1)
    assert out.count() == odd.where("length(trim(translate(coalesce(text, ''), '\n\t', '  '))) > 0").count()
    assert dict(out.dtypes)["epoch"] == "int" and "kept" in out.columns
    named = ["_full", "_lang", "_place", "_domain", "_source", "_name", "_part", "_last", "_before", "_in", "_tokens", "_spent", "bucket", "until"]
    clash = mix_sources(odd.withColumns({c: F.lit("own") for c in named}), share_percent=40, max_epochs=2)
    assert {tuple(x) for x in clash.select(*named).collect()} == {("own",) * len(named)}
    # Rows of one id and equal token counts are told apart by their texts, in whatever order they come.
    same = [(7, f"a b c d {i}", "en", "src0") for i in range(40)]
    taken = [sorted(r.text for r in mix_sources(spark.createDataFrame(rows, DOCS).repartition(3), share_percent=50, max_epochs=1).collect()) for rows in (same, same[::-1])]
    assert taken[0] == taken[1] and len(taken[0]) == 20
    assert mix_sources(odd.limit(0)).count() == 0


# -- 3: packing ------------------------------------------------------------------------------------------------------


def test_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    texts = ["a\x1cb c\x85d e\u2003f g", "<|endoftext|> x<|startoftext|>y", "İstanbul ΣΑΣ ς. é \u0301x don't DON'T it's, ,, .. a.. 12.5, x1. ½.", "", "  \n", "ＡＢＣ ﬁ ǅ. ß. ẞ, 中文。", "'s ,s .t ' ."]
    texts += [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet'").fetchall()]
    ids, bounds = Encoder(tokenizer_path()).encode(pa.array([*texts, None]))
    whole = Tokenizer.from_file(tokenizer_path())
    for text, a, b in zip([*texts, ""], bounds, bounds[1:]):
        assert ids[a:b].tolist() == whole.encode(text, add_special_tokens=False).ids


def test_encoder_hands_the_tokenizer_some_words_at_once():
    """All words that are not plain went in one call, each of which gives an object of many lists."""
    encoder, sizes = Encoder(tokenizer_path()), []
    whole, _ = encoder.encode(pa.array(["".join(f"{k}-x " for k in range(2500)) + "plain words"]))
    fresh_, alone = Encoder(tokenizer_path()), Encoder._alone
    fresh_._alone = lambda words: sizes.append(len(words)) or alone(fresh_, words)
    again, _ = fresh_.encode(pa.array(["".join(f"{k}-x " for k in range(2500)) + "plain words"]))
    assert sizes == [1000, 1000, 500]
    assert list(whole) == list(again) == encoder.tokenizer.encode("".join(f"{k}-x " for k in range(2500)) + "plain words", add_special_tokens=False).ids


def test_packing_takes_small_batches_and_its_encoders_go_with_the_next_operator(spark, monkeypatch):
    """Workers held encoders beside all later stages of a pipeline, and batches of 10,000 texts, as their executor did."""
    from docketry.llm import common, packing

    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(name)
    monkeypatch.setattr(packing, "materialize", lambda df, what: seen.append((what, spark.conf.get(name))) or common.materialize(df, what))
    pack_documents(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), tokenizer_path()).count()
    assert ("packed", "2048") in seen and spark.conf.get(name) == before

    made = []
    own = common.tidy(keeps="some")(lambda x: iter(made.append(len(common.worker_memory("some"))) or [common.worker_memory("some").setdefault(x, x)]))
    other = common.tidy(lambda: iter([0]))
    assert [list(own(1)), list(own(2)), list(other()), list(own(3))] and made == [0, 1, 0]


def test_encoder_forgets_words_and_no_token():
    texts = [prose(k, 40) for k in range(60)]
    whole, _ = Encoder(tokenizer_path()).encode(pa.array(texts))
    small_ = Encoder(tokenizer_path(), limit=300)
    found, sizes = [], []
    for k in range(0, 60, 3):
        found.append(small_.encode(pa.array(texts[k : k + 3]))[0])
        sizes.append(len(small_.known))
    assert np.array_equal(np.concatenate(found), whole)
    assert max(sizes) <= 300 + 120 and any(0 < b < a for a, b in zip(sizes, sizes[1:]))


def test_encoder_holds_no_more_bytes_of_words_than_it_may():
    """Words were kept as a dict of texts, many times their bytes, and long ones without a bound."""
    texts = [" ".join(f"{chr(97 + k)}{x}" * 500 for x in WORDS) for k in range(20)]
    whole, _ = Encoder(tokenizer_path()).encode(pa.array(texts))
    small_, found = Encoder(tokenizer_path(), limit=300), []
    for k in range(20):
        found.append(small_.encode(pa.array(texts[k : k + 1]))[0])
        assert small_.known.nbytes <= 300 * Encoder.WORD_BYTES + 2 * len(texts[k])
    assert np.array_equal(np.concatenate(found), whole)


def check_packing(rows, lengths, size):
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= size
    for doc, parts in by_doc.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == lengths[doc]
    assert by_doc.keys() == lengths.keys()
    return sum(size - sum(n for _, n in parts) for parts in by_sequence.values())


def test_packing_places_every_id_once(spark):
    from tokenizers import Tokenizer

    docs = documents(spark).repartition(5)
    whole = Tokenizer.from_file(tokenizer_path())
    ids = {r.doc_id: [*whole.encode(r.text, add_special_tokens=False).ids, 1] for r in docs.collect()}
    rows = pack_documents(docs, tokenizer_path(), fan_in=2, keep_ids=True).collect()
    padding = check_packing(rows, {k: len(v) for k, v in ids.items()}, 2048)
    assert padding <= 0.03 * sum(map(len, ids.values()))
    for r in rows:
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(own) and bytes(r.ids) == own and r.doc_tokens == len(ids[r.doc_id])


def test_packing_odd_rows(spark, odd):
    rows = pack_documents(odd.where("doc_id is not null").dropDuplicates(["doc_id"]), tokenizer_path()).collect()
    assert {r.doc_id: r.doc_tokens for r in rows if r.doc_id < 4} == {1: 1, 2: 1, 3: 1}
    assert sum(r.length for r in pack_documents(odd, tokenizer_path()).collect()) > sum(r.length for r in rows)
    assert pack_documents(odd.limit(0), tokenizer_path()).count() == 0


def test_texts_of_20_megabytes(spark):
    """Steps are bounded by bytes: texts that would be one step of 60 MB are three, and come out as if each stood alone."""
    long_ = [" ".join(f"word{k % 977}x{i}" for k in range(1_800_000)) for i in range(3)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(long_)] + [(9, "one word")], "doc_id long, text string").coalesce(1)
    pieces = pack_documents(df, tokenizer_path()).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("of"), F.max(F.col("start") + F.col("length")).alias("end")).collect()
    assert len(pieces) == 4 and all(r.n == r.of == r.end for r in pieces)
    rows = pa.array([x[:5_000_000] for x in long_] + ["one word"] * 3)
    measure = quality_qda.statistics()
    assert np.array_equal(measure(rows), np.concatenate([measure(rows[k : k + 1]) for k in range(len(rows))]))


def test_packer_is_best_fit_and_bounded():
    out = []
    p = Packer(lambda pieces, is_open: out.append((sum(len(x[2]) // 4 for x in pieces), is_open)), 10, 2, 3)
    for i, n in enumerate((6, 7, 3, 2)):
        p.add(i, 0, bytes(4 * n), n)
    assert out == [(10, False)] and p.order[0][0] == 8  # 3 went to 7, 2 to 6
    p.add(9, 0, bytes(4 * 9), 9)
    p.add(10, 0, bytes(4 * 9), 9)
    assert len(p.order) <= 2
    p.close()
    assert sum(n for n, _ in out) == 36


# -- 4: top-k --------------------------------------------------------------------------------------------------------


def brute_top(rows, k, step=50):
    v = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, q in v:
        if i % step == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in v if j != i and len(c) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    return sorted(out)


def test_top_k_against_brute_force(spark):
    r = random.Random(5)
    rows = [(i, [r.choice((-0.5, 0.0, 0.25, 0.7)) for _ in range(6)]) for i in range(400)]
    rows += [(400, None), (401, []), (1000, []), (402, [0.1]), (450, [float("nan")] * 6), (500, [None] + [0.1] * 5), (550, [float("inf")] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(x.vec_id, x.embedding) for x in df.collect()]
    for options in ({}, {"query_tile": 3, "row_tile": 7, "fan_in": 2}):
        got = top_k(df, lambda v: v % 50 == 0, **options).collect()
        assert sorted((x.query_id, x.rank, x.vec_id, x.score) for x in got) == brute_top(rows, 5)


def test_top_k_tiles_grow_with_the_queries(spark, monkeypatch):
    from docketry.llm import topk_search

    assert topk_search.query_tile_of(1000, 64) == 8192 and topk_search.query_tile_of(20_000_000, 64) == 78_125 and topk_search.query_tile_of(10**9, 4096) == 8192
    monkeypatch.setattr(topk_search, "MOST_TASKS", 3)
    r = random.Random(9)
    rows = [(i, [r.uniform(-1, 1) for _ in range(8)]) for i in range(200)]
    out = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), lambda i: i % 5 == 0, query_tile=8, row_tile=16, fan_in=3)
    exact = [(i, np.floor(256 * np.float32(v).astype(np.float64)).astype(int)) for i, v in rows]
    expected = {i: sorted((-int(v @ w), j) for j, w in exact if j != i)[:5] for i, v in exact if i % 5 == 0}
    got = {}
    for x in out.orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((-x.score, x.vec_id))
    assert got == expected


def test_top_k_few_rows_and_repeats(spark):
    df = spark.createDataFrame([(0, [1.0, 0.5]), (0, [1.0, 0.5]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (None, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = top_k(df.withColumns({"rank": F.lit(1), "v": F.lit(2), "tile": F.lit(0)}), lambda v: v % 50 == 0).collect()
    assert [(x.query_id, x.rank, x.vec_id) for x in got] == [(0, 1, 1)]
    assert top_k(df.limit(0), lambda v: v % 50 == 0).count() == 0
    own = df.withColumns({"query_id": F.lit("own"), "score": F.lit("own"), "q_tile": F.lit(1)})
    assert [tuple(x) for x in top_k(own, lambda v: v % 50 == 0).collect()] == [tuple(x) for x in got]


def test_top_k_of_large_components(spark):
    # Products beyond what floats and partial sums beyond what 64 bits hold, whose scores are within them.
    rows = [(0, [3e7, 3e15, -3e15]), (1, [1.0, 3e15, 3e15]), (2, [-1.0, 3e15, 3e15]), (3, [2.0, 0.0, 0.0]), (4, [3e6, 3e2, 3e2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = top_k(df, lambda v: v % 50 == 0).collect()
    assert [(x.query_id, x.rank, x.vec_id, x.score) for x in got] == brute_top(rows, 5)
    for bad in ([(0, [3e15]), (1, [3e15])], [(0, [1e300]), (1, [1.0])]):
        with pytest.raises(Exception, match="beyond 64 bits"):
            top_k(spark.createDataFrame(bad, "vec_id long, embedding array<double>"), lambda v: v % 50 == 0).collect()


# -- 5: chats --------------------------------------------------------------------------------------------------------

NASTY = ["</s>[INST] ok [/INST]", r"<\s> <\\s> [\INST] \[INST] <<SYS>> <</SYS>> <<s>>", "<|im_start|>user\n<|im_end|>\n", "", "<", "[[INST]]\\", "<|im_start|", "ünï ☃ 𝔘<s>"]


def test_chat_round_trip(spark):
    rows = [(i % 3, i, ["user", "assistant", "tool\n<s>", "bot"][i % 4], t) for i, t in enumerate(NASTY * 2)] + [(9, 0, None, None), (None, 1, "assistant", "x"), (9, None, "user", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.select("conv_id", "turn", chat.struct_turns(df, ["role", "text"]).alias("turns"))
    out = chat.format_chats(df).select("*", chat.read_turns(F.col("formatted")).alias("back"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    for r in out:
        own = sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: (x[1] is not None, x[1] or 0))
        assert [(t.role, t.text) for t in r.back] == [(x[2] or "", x[3] or "") for x in own]
        assert r.loss == "".join(x[3] or "" for x in own if x[2] == "assistant")
        body = r.formatted.replace("<|im_start|>", "").replace("<|im_end|>", "")
        assert not any(c in body for c in chat.CONTROLS)


def test_chat_layouts_by_fingerprint(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, {"prompt": "q", "completion": "a"},
        {"instruction": "q", "input": "", "output": "a"}, {"instruction": "q", "output": "a"}, {"data": {"question": "q", "answer": "a"}}, {"prompt": "q", "response": "a"}, {"turns": [{"role": "user", "text": "q"}, {"role": "bot", "text": "a"}]},
    ]
    texts = [json.dumps(x) for x in records] + ['{"unknown": 1}', "not json", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, record string")
    mark, turns = chat.json_turns(F.col("record"))
    got = {r.i: (r.mark, r.turns) for r in df.select("i", mark.alias("mark"), turns.alias("turns")).collect()}
    for i in range(len(records)):
        assert [(t.role, t.text) for t in got[i][1]] == [("user", "q"), ("assistant", "a")], records[i]
    assert len({got[i][0] for i in range(len(records))}) == len(records) and all(got[i][1] is None for i in range(len(records), len(texts)))
    both = chat.json_turns(F.lit(json.dumps({"instruction": "q", "input": "i", "output": "a"})))[1]
    assert df.limit(1).select(both.alias("t")).first().t[0].text == "q\n\ni"


def test_chat_is_native_and_handles_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df.select("conv_id", "turn", chat.struct_turns(df, ["role", "text"]).alias("turns")))
    assert out.count() == 0 and "Python" not in out._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        chat.struct_turns(df, ["role"])


# -- 6, 9: classifiers -----------------------------------------------------------------------------------------------


def labelled(spark, n=600):
    r = random.Random(3)
    rows = []
    for i in range(n):
        bad, rude = i % 6 == 0, i % 5 == 0
        words = [r.choice(WORDS) + str(r.randrange(40)) for _ in range(r.randrange(20, 120))]
        if rude:
            for _ in range(5):
                words.insert(r.randrange(len(words)), r.choice(("blorkish", "zanfool", "grumpet")) + r.choice(("", "!", ",")))
        rows.append((i, " ".join(w.upper() + "!!" if bad else w for w in words), int(not bad), int(rude)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "quality", "toxic")


@pytest.mark.parametrize(("fit", "label"), [(fit_toxicity, "toxic"), (fit_quality, "quality")])
def test_classifier_on_held_out_rows(spark, fit, label):
    docs, labels = labelled(spark)
    got = {r.doc_id: r for r in fit(docs, labels).score(docs).collect()}
    known = {r.doc_id: r[label] for r in labels.collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum(got[i].predicted == known[i] for i in held) / len(held)
    assert len(held) > 60 and right > 0.95 and all(0 <= r.score <= 1 for r in got.values())


def brute_toxicity(text, lexicon):
    words = (text or "").split()
    rows = []
    for word in words:
        w = toxicity.plain(word)
        own = lexicon.get(w, 0)
        stem = max([lexicon.get(w[:n] + "~", 0) for n in (4, 5, 6) if len(w) > n], default=0)
        low = word.lower().strip(".,;:?!\"'()")
        hidden = bool(re.search(r"[a-z][0-9@$*!|+]+[a-z]|^[@$0-9*]+[a-z]{2}|(?:[a-z][.\-_*]){3}|([a-z])\1{2,}", low))
        bare = toxicity.revealed(word) if hidden else ""
        behind = hidden and (lexicon.get(bare, 0) >= 2 or any(lexicon.get(bare[:n] + "~", 0) >= 3.5 for n in (4, 5, 6) if len(bare) > n))
        letters = [c for c in word if c.isalpha()]
        rows.append((own >= 3.5, 2 <= own < 3.5, stem >= 3.5, w in toxicity.SECOND_PERSON, len(letters), sum(map(str.isupper, letters)), len(letters) > 2 and all(map(str.isupper, letters)), hidden, behind, own >= 2 or stem >= 3.5 or behind, word))
    n, total = max(1, len(rows)), lambda k: sum(r[k] for r in rows)
    hits, you = [i for i, r in enumerate(rows) if r[9]], [i for i, r in enumerate(rows) if r[3]]
    near_ = sum(any(abs(i - j) <= 8 for j in you) for i in hits) / len(hits) if hits and you else 0
    signs = lambda f: sum(map(f, words)) / n
    return [
        total(0) / n, math.log1p(total(0)), total(1) / n, total(2) / n, math.log1p(total(2)), near_, total(3) / n, total(5) / max(1, total(4)), total(6) / n,
        signs(lambda w: w.count("!")), signs(lambda w: w.count("?")), signs(lambda w: len(re.findall(r"[^\w\s]", w))), total(7) / n, math.log1p(total(8)), math.log1p(len(rows)),
    ]


def test_toxicity_features_against_brute_force(spark):
    lexicon = {"blorkish": 4.0, "zanf~": 3.6, "grump~": 2.5, "nasty": 2.2, "du": 0.1}
    texts = ["You BLORKISH zanfool, n4sty gr.u.m.p!! hey", "b10rkish you you " + "word " * 20 + "nasty", "zaaanfool Du!", "", None, " \n", "ALL CAPS? no-o-o-o", "x" * 9000 + " nasty"]
    r = random.Random(2)
    bits = ["you", "BLORKISH!", "zanfool", "grumpet", "nasty?", "plain", "n@sty", "Ünï", "d.u.m.b", "sooo", "$hit", "it's", "…", "100"]
    texts += [" ".join(r.choice(bits) for _ in range(r.randrange(60))) for _ in range(80)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for x in df.select("i", toxicity.toxicity_features(lexicon)("text").alias("f")).collect():
        assert x.f == pytest.approx(brute_toxicity(texts[x.i], lexicon), abs=1e-6), texts[x.i]


def test_toxicity_lexicon_against_brute_force(spark):
    docs, labels = labelled(spark)
    sample = docs.join(labels, "doc_id").select("text", F.col("toxic").alias("label"))
    rows = [(set().union(*([*toxicity.terms_of(w)] for w in r.text.split())), r.label) for r in sample.collect()]
    ones, zeros = sum(x for _, x in rows), sum(1 - x for _, x in rows)
    expected = {}
    for t in set().union(*(terms for terms, _ in rows)):
        a, b = sum(t in s and x for s, x in rows), sum(t in s and not x for s, x in rows)
        odds = math.log((a + 0.5) / (ones + 1)) - math.log((b + 0.5) / (zeros + 1))
        if a >= max(3, round(0.005 * ones)) and odds >= 2:
            expected[t] = odds
    assert toxicity.learn_lexicon(sample) == pytest.approx(expected) and expected


def test_quality_densities_against_brute_force(spark):
    docs, labels = labelled(spark)
    model = fit_quality(docs, labels)
    x = np.random.default_rng(3).normal(size=(50, len(model.center))) * 2 * model.scale + model.center
    z = np.clip((x - model.center) / model.scale, -6, 6)

    def log_density(gauss, row):
        covariance = gauss.factor @ gauss.factor.T
        d = row - gauss.mean
        return -0.5 * (d @ np.linalg.inv(covariance) @ d + np.linalg.slogdet(covariance)[1])

    assert np.allclose(model.difference(x), [log_density(model.good, r) - log_density(model.bad, r) for r in z])
    assert np.allclose(np.triu(model.good.factor, 1), 0)


def test_quality_moments_and_statistics(spark):
    import zstandard

    texts = ["One two two. THREE!!\n\none two\nOne two two. THREE!!", "a #b 12 c…", "", None, "  x", "word " * 3000]
    got = quality_qda.statistics()(pa.array(texts, pa.string()))
    for text, row in zip(texts, got):
        words = (text or "").split()
        if not words:
            assert not row.any()
            continue
        n = len(words)
        chars, letters = sum(map(len, words)), sum(c.isalpha() for w in words for c in w)
        rate = lambda k, base: math.log((k + 0.25) / (base + 0.5))
        lines = [x for x in text.split("\n") if x.strip()]
        marks = set("#*$%&|<>@^~_=+\\/{}[]")
        expected = [
            math.log1p(n), chars / n, math.log1p(math.sqrt(max(0, sum(len(w) ** 2 for w in words) / n - (chars / n) ** 2))), math.log(len(set(words))) / math.log(n + 1), rate(sum(a == b for a, b in zip(words, words[1:])), n),
            rate(sum(c.isupper() for w in words for c in w), max(1, letters)), rate(sum(sum(map(str.isalpha, w)) > 1 and all(c.isupper() for c in w if c.isalpha()) for w in words), n), rate(sum(c in marks for c in text), n), rate(sum(any(c in marks for c in w) for w in words), n),
            rate(text.count("!"), n), rate(sum(w.endswith((".", "?", "…")) for w in words), n), rate(sum(c.isdigit() for c in text), n), rate(len(lines), n), rate(len(lines) - len(set(lines)), len(lines)), math.log(len(zstandard.ZstdCompressor(level=1).compress(text.encode())) / len(text.encode())),
        ]
        assert row == pytest.approx(expected, abs=1e-5)
    rows = spark.createDataFrame([(i % 2, [float(i * k % 7) for k in range(len(quality_qda.STATISTICS))]) for i in range(30)], "label int, x array<double>")
    for label, (n, first, second) in quality_qda._moments(rows).items():
        own = np.array([r.x for r in rows.collect() if r.label == label])
        assert n == len(own) and np.allclose(first, own.sum(axis=0)) and np.allclose(second, own.T @ own)


@pytest.mark.parametrize("fit", [fit_toxicity, fit_quality])
def test_classifier_odd_rows(spark, odd, fit):
    docs, labels = labelled(spark, 120)
    model = fit(docs, labels)
    named = ["__features", "_features", "_raw", "_margin", "features", "prediction", "rawPrediction", "label"]
    out = model.score(odd.withColumns({c: F.lit("own") for c in named}))
    assert {tuple(x) for x in out.select(*named).collect()} == {("own",) * len(named)}
    assert out.count() == odd.count() and dict(out.dtypes)["score"] == "double" and out.where("score is null").count() == 0
    assert model.score(odd.limit(0)).count() == 0
    none = fit(docs, labels.limit(0))
    assert none.score(odd).where("score between 0 and 1").count() == odd.count()
    doubled = labels.union(labels).union(spark.createDataFrame([(None, 1, 1), (1, None, None)], labels.schema))
    assert fit(docs, doubled).score(docs).count() == docs.count()


# -- 7: near-duplicates ----------------------------------------------------------------------------------------------


def bag(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(rows, similarity=0.8):
    parent = {i: i for i, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = [(i, bag(t)) for i, t in rows]
    for a, (i, x) in enumerate(bags):
        for j, y in bags[:a]:
            common = sum((x & y).values())
            if x and common >= similarity * (sum(x.values()) + sum(y.values()) - common):
                p, q = sorted((top(i), top(j)))
                parent[q] = p
    return {i: top(i) for i, _ in rows}


def edited(text, k, seed):
    r = random.Random(seed)
    words = text.split()
    for _ in range(k):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def test_near_classes_against_brute_force(spark):
    rows, i = [], 100
    for g in range(6):
        base = prose(g, 120)
        for k in range(14):
            rows.append((i := i + 1, edited(base, k % 8, 31 * g + k)))
        rows.append((i := i + 1, base.upper()))
        rows.append((i := i + 1, (base + " ") * 2))
    rows += [(i + k, prose(500 + k, 8)) for k in range(1, 40)] + [(1, "few words"), (2, "Few  words"), (3, "few word"), (4, ""), (5, None), (6, " \n")]
    random.Random(1).shuffle(rows)
    got = near.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(rows)


@pytest.mark.parametrize(("asked", "slice_"), [(near.ASKED, near.SLICE), (1, 16)])
def test_near_classes_of_copies_among_excerpts(spark, monkeypatch, asked, slice_):
    monkeypatch.setattr(near, "ASKED", asked)
    monkeypatch.setattr(near, "SLICE", slice_)
    # Nearly all buckets that hold two of the copies hold an excerpt of under 0.8 of their size.
    r, words = random.Random(8), prose(77, 300).split()
    rows = [(k, edited(" ".join(words), 3 * k, k)) for k in range(3)]
    for k in range(200):
        kept = sorted(r.sample(range(30), r.randrange(22, 24)))
        rows.append((1000 + k, " ".join(w for c in kept for w in words[10 * c : 10 * c + 10])))
    expected = brute_classes(rows)
    assert expected[0] == expected[1] == 0 and len(set(expected.values())) > 100
    got = near.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.class_id for r in got} == expected


def test_near_classes_with_a_hot_digest(spark):
    signed = spark.createDataFrame([(i, i % 4 if i > 20 else 0, 7, 0 if i % 5 == 0 else 3) for i in range(60)], "doc_id long, key_a long, key_b long, size long")
    texts = signed.where("size > 0").groupBy("key_a", "key_b").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("rows"))
    least = {(r.key_a, r.key_b): r.copy_of for r in texts.collect()}
    expected = sorted((r.doc_id, least[r.key_a, r.key_b] if r["size"] else r.doc_id) for r in signed.collect())
    for limit in (1, 3, 200_000):
        assert sorted(map(tuple, near.first_copies(signed, texts, limit).collect())) == expected


def test_near_classes_on_documents(spark):
    docs = documents(spark)
    got = {r.doc_id: r.class_id for r in near.near_classes(docs).collect()}
    assert got == brute_classes([(r.doc_id, r.text) for r in docs.collect()])


def test_bag_minhash_is_unbiased():
    r = np.random.default_rng(4)
    a, b = (r.integers(1, 9, 60) for _ in range(2))
    elements = r.integers(0, 2**63, 60).astype(np.uint64)
    expected = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    h = near.bag_minhash([(elements, a), (elements, b), (elements[:0], a[:0])], 6000)
    assert abs((h[0] == h[1]).mean() - expected) < 0.03 and np.isinf(h[2]).all()


def test_odd_sketch_never_says_too_much():
    rng = np.random.default_rng(5)
    pool = near.mix(np.arange(900, dtype=np.uint64))
    for _ in range(50):
        bags = [np.unique(rng.choice(pool, int(rng.integers(0, 1500))), return_counts=True) for _ in range(2)]
        a, b = (dict(zip(*(x.tolist() for x in bag))) for bag in bags)
        differ = sum(abs(a.get(k, 0) - b.get(k, 0)) for k in {*a, *b})
        bits = sum(int(x).bit_count() for x in (near.odd_sketch(*bags[0]) ^ near.odd_sketch(*bags[1])).view(np.uint64))
        assert bits <= differ


def test_drop_near_duplicates_odd_rows(spark, odd):
    out = near.drop_near_duplicates(odd)
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 0, 1, 2, 3, 4, 5, 6, 7] and out.columns == odd.columns
    assert near.near_classes(odd.limit(0)).count() == 0
    # An id with several texts goes by the least of them, in whatever order its rows come.
    several = [(1, prose(9)), (1, prose(8)), (2, min(prose(8), prose(9))), (3, max(prose(8), prose(9))), (4, None), (4, prose(7)), (5, prose(7))]
    for rows in (several, several[::-1]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted((r.doc_id, r.class_id) for r in near.near_classes(df).collect()) == [(1, 1), (1, 1), (2, 1), (3, 3), (4, 4), (4, 4), (5, 4)]
        assert sorted((r.doc_id, r.text) for r in near.drop_near_duplicates(df).where("doc_id < 4").collect()) == [(1, min(prose(8), prose(9))), (3, max(prose(8), prose(9)))]
    same = spark.createDataFrame([(i, prose(1)) for i in range(300)], "doc_id long, text string")
    assert near.drop_near_duplicates(same).collect()[0].doc_id == 0 and near.drop_near_duplicates(same).count() == 1


# -- 8: lines --------------------------------------------------------------------------------------------------------


def brute_lines(rows, least):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\v\f\r").translate(low)
    counts = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or counts[key(x)] < least]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_line_dedup(spark):
    r = random.Random(8)
    rows = [(i, "\n".join(r.choice(["Cookie Policy", " cookie policy\t", "ÄB", "äb", "", "own " + str(r.randrange(90)), "\u00a0x", "\\"]) for _ in range(r.randrange(9)))) for i in range(120)]
    rows += [(500, None), (501, ""), (None, "cookie policy\nleft"), (None, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_lines": F.lit("x"), "_drop": F.lit(1), "a": F.lit(2)})
    out = drop_common_lines(df)
    assert sorted(((x.doc_id, x.text, x.n_lines, x.n_dropped) for x in out.collect()), key=str) == brute_lines(rows, 10)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert drop_common_lines(df.limit(0)).count() == 0


def test_line_dedup_counts_distinct_documents(spark):
    # "seen" is in 12 rows of 3 ids, "wide" in 10 ids of which one has three rows, "bare" in ten rows without an id.
    rows = [(i % 3, f"seen\nown {i}") for i in range(12)] + [(100 + i, "wide") for i in range(9)] + [(2, "wide"), (2, "wide\nmore"), (2, "more")] + [(None, f"bare\n{i % 2}") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((x.doc_id, x.text, x.n_dropped) for x in drop_common_lines(df).collect())
    expected = Counter((i, "\n".join(x for x in t.split("\n") if x not in ("wide", "bare")), sum(x in ("wide", "bare") for x in t.split("\n"))) for i, t in rows)
    assert got == expected


def test_line_dedup_broadcasts_the_most_common_lines_only(spark):
    keys = spark.createDataFrame([(i, 0, a, a) for i in range(40) for a in range(30) if i % (a + 1) == 0], "_id long, _row long, _a long, _b long")
    common = keys.groupBy("_a", "_b").agg(F.count("*").alias("_docs")).where("_docs >= 3")
    assert sorted(map(tuple, hits_of(keys, common, 4).collect())) == sorted(map(tuple, hits_of(keys, common).collect())) == sorted(map(tuple, keys.where("_a < 19").collect()))


def test_line_dedup_is_linear_in_the_lines_of_a_document(spark):
    """Documents of 100,000 common lines each, and one of a single line of 20 MB."""
    lines = "\n".join(f"shared line {k}" for k in range(100_000))
    rows = [(i, f"own {i}\n{lines}\nlast {i}") for i in range(12)] + [(99, "word " * 4_000_000)]
    began = time.time()
    out = drop_common_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {x.doc_id: (x.n, x.n_lines, x.n_dropped) for x in out.select("doc_id", F.length("text").alias("n"), "n_lines", "n_dropped").collect()}
    assert got == {i: (len(f"own {i}\nlast {i}"), 100_002, 100_000) for i in range(12)} | {99: (20_000_000, 1, 0)}
    assert time.time() - began < 60


# -- 10: URLs --------------------------------------------------------------------------------------------------------


def test_url_filter(spark):
    urls = [
        None, "", "no scheme", "http://", "https://A.Example.COM/en/7x?q", "http://example.com/en/1", "http://com/en/", "http://xcom/en/", "http://a.net/de/8", "http://www.example.net/de/81#x", "http://example.net/DE/8",
        "http://x.org/es/1", "http://x.org?/es/", "ftp://notexample.com/en/7", "http://a.com/fr/http://b.org/es/", "http://spam-farm.example.de/x", "http://spamfarm.de/", "http://host/a/track/", "x://y.com:80/en/", "http://u@x.com/en/",
    ]
    df = spark.createDataFrame([(i, u, "own") for i, u in enumerate(urls)], "page_id long, url string, host string")

    def brute(u):
        head, mark, rest = (u or "").partition("://")
        if not mark:
            return "", "", None, "allow"
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, tail = rest[:end].lower(), rest[end:]
        path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
        rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fits:
            return host, path, max(fits)[1], max(fits)[2]
        return host, path, None, "block" if "spam-farm" in host or "/track/" in path else "allow"

    want = {i: brute(u) for i, u in enumerate(urls)}
    for per_pass in (50_000, 3):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(df, SITE_RULES, rules_per_pass=per_pass).collect()}
        assert got == want
    assert filter_urls(df.limit(0), SITE_RULES).count() == 0 and set(filter_urls(df, []).select("rule").collect()) == {(None,)}


def test_url_rules_are_indexed_by_their_rarest_token():
    index = rule_index(SITE_RULES, {"com": 900, "en": 700, "example": 1000, "net": 10, "de": 20, "org": 5, "es": 3})
    assert {k: sorted(r.name for r in v) for k, v in index.items()} == {"en": ["com/en/", "example.com/en/7"], "net": ["example.net/de/8", "net/de/"], "es": ["org/es/"]}
    assert rule_index([pattern_rule("block", "x", "x")], {})[""][0].name == "x"


def test_url_rules_that_run_and_rules_of_a_table(spark):
    table = spark.createDataFrame(
        [("block", "example.com", "/a/", None, None, None, None), ("allow", "com", "/b", None, None, None, None), ("block", None, None, "shop", r"/shop/\d+$", ["shop"], None), ("block", None, None, "ads", r"(?:^|/)(?:ads|banner)/", None, ["ads", "banner"])],
        "verdict string, host string, path string, name string, regex string, tokens array<string>, either array<string>",
    )
    rules = rules_of(table)
    urls = {"http://www.example.com/a/x": ("block", "example.com/a/"), "http://y.com/b": ("allow", "com/b"), "http://z.org/shop/12": ("block", None), "http://z.org/shop/12x": ("allow", None), "http://z.org/banner/1": ("block", None), "http://z.org/x": ("allow", None)}
    df = spark.createDataFrame([(u, "own") for u in urls], "url string, __best string").withColumns({"_best": F.lit("own"), "_best0": F.lit("own")})
    got = filter_urls(df, rules, patterns=()).collect()
    assert {r.url: (r.verdict, r.rule) for r in got} == urls and {(r["__best"], r._best, r._best0) for r in got} == {("own",) * 3}
    ran = df.select("url", match_rules(rule_index(rules, {}))(host_of(F.col("url")), path_of(F.col("url"))).alias("x")).collect()
    assert {r.url: r.x.tried for r in ran} == {"http://www.example.com/a/x": 2, "http://y.com/b": 1, "http://z.org/shop/12": 1, "http://z.org/shop/12x": 1, "http://z.org/banner/1": 1, "http://z.org/x": 0}


def test_url_patterns_run_on_urls_with_their_tokens_only(spark):
    index = rule_index(PATTERNS, {})
    assert "" not in index and {r.name for v in index.values() for r in v} == {r.name for r in PATTERNS}
    urls = ["xxx.com/", "my-porn.net/a", "a.com/track/", "a.com/tracker", "a.com/b/pixel.gif", "a.com/track/pixel/", "xxxy.com/", "a.com/xxx", "a.com/tracks/", "pixel.com/a", "a.com/Track/"]
    urls += [f"{a}{w}{b}.com/{c}{w}{d}" for w in ("xxx", "porn", "track", "tracker", "pixel") for a in ("", "x", "a-", "a_") for b in ("", "_b", "-b") for c in ("", "c/", "c.") for d in ("", "/", ".gif", ".gif/", "_")]
    got = filter_urls(spark.createDataFrame([(f"http://{u}",) for u in urls], "url string"), []).collect()
    assert [r.verdict for r in got] == ["block" if any(re.search(p.regex, u) for p in PATTERNS) else "allow" for u in urls]


# -- the pipeline ----------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = cp.quality_rules(spark, docs, SF)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    lines = cp.line_dedup(spark, kept, SF)
    assert lines.count() == kept.count() and lines.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in lines.collect()]
    near_ = cp.near_dedup(spark, lines, SF)
    assert sorted(r.doc_id for r in near_.collect()) == sorted({c for c in brute_classes(rows).values()})
    mixed = cp.source_mixing(spark, near_, SF)
    ids = [r.doc_id for r in mixed.collect()]
    assert mixed.columns == docs.columns and len(ids) == len(set(ids)) and 0 < len(ids) <= near_.count()
    packed = cp.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == set(ids)
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "source_mixing", "packing"]


def test_pipeline_stages_on_odd_rows(spark, odd):
    import corpus_pipeline as cp

    for name, stage in cp.STAGES:
        empty = stage(spark, odd.limit(0), SF)
        assert empty.count() == 0, name
        out = stage(spark, odd, SF)
        assert out.count() >= 0 and (name == "packing" or out.columns == odd.columns), name


def test_hash_of_kept_text(spark):
    from docketry.llm.queries import op8_line_dedup

    got = {r.doc_id: r.kept_sha256 for r in op8_line_dedup(spark, SF).collect()}
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t, _, _ in brute_lines(rows, 10)}


def test_texts_meet_their_common_lines_by_one_plan_at_every_size(spark):
    """The places of common lines were broadcast while they were few, so what was shuffled grew by a leap once they were not."""
    df = spark.createDataFrame([(n, f"all\nown {n}\nall") for n in range(12)] + [(None, "all"), (None, "alone"), (99, None)], "doc_id long, text string")
    out = drop_common_lines(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Broadcast" not in plan and "Sort" not in plan
    got = Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect())
    assert got == Counter([(n, f"own {n}", 3, 2) for n in range(12)] + [(None, "", 1, 1), (None, "alone", 1, 0), (99, "", 1, 0)])
