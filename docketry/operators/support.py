"""Support checks: what a model says on whether a passage supports a sentence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.schemas import REPLY
from docketry.functions.text import blank_to_null, comparable_quote

# The levels of support.
LEVELS = ["supported", "partial", "not_supported", "contradicted", "unknown"]


def parse_reply(reply: Column) -> Column:
    """A model's reply as a struct of REPLY: the whole as JSON, without a code fence, or its first brace to its last. Null if it holds no object."""
    bare = F.trim(F.regexp_replace(F.trim(reply), r"^```[a-zA-Z]*\s*|\s*```$", ""))
    inner = blank_to_null(F.regexp_extract(bare, r"(?s)(\{.*\})", 1))
    ok = lambda x: F.when(F.schema_of_variant(F.try_parse_json(x)).startswith("OBJECT"), x)
    text = F.coalesce(ok(bare), ok(inner))
    names = [x.split()[0] for x in REPLY.split(", ")]
    kinds = [x.split()[1] for x in REPLY.split(", ")]
    value = F.try_parse_json(text)
    return F.when(text.isNotNull(), F.struct(*(F.try_variant_get(value, f"$.{n}", k).alias(n) for n, k in zip(names, kinds))))


def clean_reply(parsed: Column, passage: Column) -> Column:
    """Known levels only, confidence within 0 and 1, and a cited passage only if the given one holds it."""
    level = F.regexp_replace(F.lower(F.trim(parsed["support"])), " ", "_")
    cited = parsed["passage"]
    held = F.contains(comparable_quote(passage), comparable_quote(cited)) & (comparable_quote(cited) != "")
    return F.struct(
        F.when(level.isin(LEVELS), level).otherwise("unknown").alias("support"),
        F.when(parsed["confidence"].isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), parsed["confidence"]))).alias("confidence"),
        F.coalesce(parsed["rationale"], F.when(parsed.isNull(), F.lit("the reply could not be read")), F.lit("")).alias("rationale"),
        F.when(held, cited).alias("passage"),
    )


def ask_model(rows: DataFrame, model: Callable[[list[dict]], list[str]], fields: list[str]) -> DataFrame:
    """``rows`` with ``reply``. The model gets a batch of rows as dicts of ``fields`` and gives a string each; it runs on executors."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(reply=model(batch[fields].to_dict("records")))

    return rows.mapInPandas(run, f"{kinds}, reply string")


def check_support(findings: DataFrame, passages: DataFrame, model: Callable[[list[dict]], list[str]] | None, name: str = "model") -> DataFrame:
    """``findings`` with ``fidelity`` (support, confidence, rationale, passage, model); null without a model.

    ``passages``: (doc_id, idx, passage, origin). Only rows with a case and a
    passage reach the model; the others are unknown.
    """
    kind = "struct<support:string,confidence:double,rationale:string,passage:string,model:string>"
    if model is None:
        return findings.withColumn("fidelity", F.lit(None).cast(kind))
    key = ["doc_id", "idx"]
    asked = findings.where("resolved is not null").join(passages.where("passage is not null and passage <> ''"), key)
    asked = asked.select(*key, F.col("context").alias("sentence"), F.coalesce(blank_to_null("resolved.case_name"), F.col("case_name")).alias("case_name"), "passage", F.col("matched_text").alias("citation"), "origin")
    replies = ask_model(asked, model, ["sentence", "case_name", "passage", "citation"])
    replies = replies.withColumn("_r", clean_reply(parse_reply(F.col("reply")), F.col("passage")))
    source = F.concat(F.lit("Passage source: "), F.col("origin"), F.lit("."))
    rationale = F.when(F.col("_r.rationale") != "", F.concat(F.col("_r.rationale"), F.lit(" ("), source, F.lit(")"))).otherwise(source)
    replies = replies.select(*key, F.struct(F.col("_r.support"), F.col("_r.confidence"), rationale.alias("rationale"), F.col("_r.passage"), F.lit(name).alias("model")).alias("_said"))
    why = F.when(F.col("resolved").isNull(), "no case record was resolved").otherwise("there was no passage of the case to read")
    unknown = F.struct(F.lit("unknown").alias("support"), F.lit(None).cast("double").alias("confidence"), why.alias("rationale"), F.lit(None).cast("string").alias("passage"), F.lit(name).alias("model"))
    return findings.join(replies, key, "left").withColumn("fidelity", F.coalesce("_said", unknown)).drop("_said")
