"""One query for each operator, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import chat_format as chat
from docketry.llm.common import held_out, table
from docketry.llm.compression_rules import compression_rules
from docketry.llm.conversation_repair import damaged, repair_conversations
from docketry.llm.html_extraction import extract_main_text
from docketry.llm.line_dedup import drop_common_lines
from docketry.llm.near_dedup import near_classes
from docketry.llm.packing import pack_documents
from docketry.llm.quality_qda import fit_quality
from docketry.llm.source_mixing import mix_sources
from docketry.llm.topk_search import top_k
from docketry.llm.toxicity import fit_toxicity
from docketry.llm.url_filter import PATTERNS, filter_urls, site_rule
from docketry.llm.vector_codes import books_sha256, compress_vectors

SITE_RULES = (
    site_rule("block", "com", "/en/"),
    site_rule("allow", "example.com", "/en/7"),
    site_rule("allow", "net", "/de/"),
    site_rule("block", "example.net", "/de/8"),
    site_rule("block", "org", "/es/"),
)
#: Target weights of the mixing query; names that are not here have weight 2.
WEIGHTS = {"domain": {"web": 4, "forum": 2, "reference": 3, "books": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_compression_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compression_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "n_chunks", "n_bad_chunks")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return mix_sources(docs, weights=WEIGHTS, default_weight=2).select("doc_id", "domain", "lang", "source", "epoch")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda vec_id: vec_id % 50 == 0)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.select("conv_id", "turn", chat.struct_turns(rows, ["role", "text"]).alias("turns"))
    said = "</s>[INST] ok [/INST]"
    nested = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.lit(0).cast("long").alias("turn"),
        F.array(*(F.struct(F.lit(r).alias("role"), F.lit(said).alias("content")) for r in ("user", "assistant"))).alias("messages"),
    )
    nested = nested.select("conv_id", "turn", chat.struct_turns(nested, ["messages"]).alias("turns"))
    out = chat.format_chats(rows.unionByName(nested))
    turns = chat.read_turns(F.col("formatted"))
    loss = chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    return out.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return model.score(docs).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return model.score(docs).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, SITE_RULES).select("page_id", "host", "path", "rule", "verdict")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ids = rows.select(F.col("conv_id").alias("_conv")).distinct()
    out = ids.join(repair_conversations(damaged(rows)), F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("_conv").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_compression_rules, op2_source_mixing, op3_packing, op4_topk_search, op5_chat_format, op6_toxicity, op7_near_dedup, op8_line_dedup, op9_quality_qda, op10_url_filter, op11_conversation_repair, op12_vector_codes, op13_html_extraction, pipeline)
}

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WEIGHT = lambda level: " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS[level].items())


def _split_sql(parent: str, name: str, weight: str, above: str, on: str) -> str:
    """The SQL of one level's budgets: nodes named by ``parent`` and ``name``, whose parents' budgets are in ``above``."""
    here = f"{parent}, {name}" if parent else name
    part = f"PARTITION BY {', '.join(f'n.{c}' for c in parent.split(', '))}" if parent else ""
    return f"""
    n_{name} AS (SELECT {here}, sum(tokens * 4)::HUGEINT AS supply, sum(tokens) AS tokens, {weight} AS weight FROM leaves GROUP BY {here}),
    o_{name} AS (
      SELECT n.*, greatest(a.budget - coalesce(sum(supply) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS lft,
             sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws
      FROM n_{name} n JOIN {above} a {on} WINDOW w AS ({part} ORDER BY supply::DOUBLE / weight::DOUBLE, n.{name})),
    f_{name} AS (
      SELECT n.*, first_value(CASE WHEN supply * ws > lft * weight THEN lft END IGNORE NULLS) OVER w AS rl,
             first_value(CASE WHEN supply * ws > lft * weight THEN ws END IGNORE NULLS) OVER w AS rw
      FROM o_{name} n WINDOW w AS ({part} ORDER BY supply::DOUBLE / weight::DOUBLE, n.{name} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    b_{name} AS (SELECT {here}, tokens, CASE WHEN supply * ws <= lft * weight THEN supply ELSE least(supply, (rl * weight) // rw) END AS budget FROM f_{name})"""


def _assign_sql(n: int) -> str:
    """The SQL of one assignment of parts to the entries of round ``n``."""
    return f"""a{n} AS (
      SELECT row, part, any_value(x) AS x, min({{'d': d, 'e': entry}}).e AS entry, min({{'d': d, 'e': entry}}).d AS d
      FROM (SELECT row, part, x, entry, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN b{n} USING (part))
      GROUP BY row, part)"""


def _update_sql(n: int) -> str:
    """The SQL of the entries of round ``n``: floors of means, or the entries before where nothing is assigned."""
    return f"""m{n} AS (
      SELECT part, entry, list(floor_mean ORDER BY k) AS c FROM (
        SELECT part, entry, k, (sum(x[k]) - ((sum(x[k]) % count(*)) + count(*)) % count(*)) // count(*) AS floor_mean
        FROM a{n - 1}, range(1, len(x) + 1) t(k) GROUP BY part, entry, k) GROUP BY part, entry),
    b{n} AS (SELECT part, entry, list_transform(coalesce(m.c, b.c), lambda c: c::BIGINT) AS c FROM b{n - 1} b LEFT JOIN m{n} m USING (part, entry))"""


ORACLES = {
    "op2_source_mixing": f"""
    WITH d AS (
      SELECT doc_id, lang, source, ['web', 'forum', 'reference', 'books'][(coalesce(try_cast(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') AS BIGINT), 0) % 4 + 1)::INT] AS domain,
             len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) AS tokens FROM documents),
    leaves AS (SELECT domain, lang, source, sum(tokens)::HUGEINT AS tokens FROM d GROUP BY ALL HAVING sum(tokens) > 0),
    root AS (SELECT (sum(tokens) * 60) // 100 AS budget FROM leaves),
    {_split_sql("", "domain", f"CASE domain {_WEIGHT('domain')} ELSE 2 END", "root", "ON true")},
    {_split_sql("domain", "lang", f"CASE lang {_WEIGHT('lang')} ELSE 2 END", "b_domain", "USING (domain)")},
    {_split_sql("domain, lang", "source", "2", "b_lang", "USING (domain, lang)")},
    placed AS (
      SELECT d.*, b.budget // b.tokens AS whole, b.budget % b.tokens AS part, md5('11:' || (b.budget // b.tokens) || ':' || doc_id) AS place
      FROM d JOIN b_source b USING (domain, lang, source) WHERE d.tokens > 0),
    spent AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM placed)
    SELECT doc_id, domain, lang, source, unnest(range(0, (whole + CASE WHEN before < part THEN 1 ELSE 0 END)::BIGINT))::INT AS epoch FROM spent""",
    "op4_topk_search": """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    s AS (
      SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
    "op12_vector_codes": f"""
    WITH v AS (
      SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    p AS (SELECT row, part, v[part * (len(v) // 16) + 1 : (part + 1) * (len(v) // 16)] AS x FROM v, range(16) t(part)),
    b0 AS (SELECT part, row - 1 AS entry, x AS c FROM p WHERE row <= 64),
    {_assign_sql(0)}, {_update_sql(1)}, {_assign_sql(1)}, {_update_sql(2)}, {_assign_sql(2)},
    books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS sha FROM b2),
    coded AS (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY row)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha AS codebooks_sha256 FROM coded JOIN v USING (row), books""",
    "op5_chat_format": """
    WITH r AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, n, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) x(n, role)),
    m AS (
      SELECT *, len(regexp_extract_all(text, '[<\\[]\\\\*(\\|im_start\\|>|\\|im_end\\|>|\\|endoftext\\|>|\\|startoftext\\|>|s>|/s>|unk>|pad>|INST\\]|/INST\\]|<SYS>>|</SYS>>)')) AS marks FROM r)
    SELECT conv_id, count(*) AS n_turns,
           sha256(coalesce(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text), '')) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(length(role) + length(text) + marks + 24)::BIGINT AS formatted_chars
    FROM m GROUP BY conv_id""",
    "op8_line_dedup": f"""
    WITH l AS (
      SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
    k AS (SELECT *, translate(trim(line, {_SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
    SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (c.key IS NULL), '')) AS kept_sha256
    FROM k LEFT JOIN c ON k.key = c.key GROUP BY doc_id""",
    "op10_url_filter": """
    WITH p AS (
      SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    r AS (SELECT * FROM (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')) x(h, s, v)),
    m AS (
      SELECT page_id, arg_max(h || s, length(h || s)) AS rule, arg_max(v, length(h || s)) AS v
      FROM p JOIN r ON (host = h OR host LIKE '%.' || h) AND starts_with(path, s) GROUP BY page_id)
    SELECT page_id, host, path, rule, CASE
      WHEN rule IS NOT NULL THEN v WHEN """
    + " OR ".join(f"regexp_matches(host || path, '{r.regex}')" for r in PATTERNS)
    + """ THEN 'block' ELSE 'allow' END AS verdict
    FROM p LEFT JOIN m USING (page_id)""",
}
