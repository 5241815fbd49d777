"""The scan of a text as table functions, for LATERAL in SQL."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from docketry.functions import fixed
from docketry.operators.extract import scan_citations, sentence_ends

_SPACES = re.compile(f"{fixed.SPACE}+")


def _normalized(text: str | None) -> str:
    return _SPACES.sub(" ", text or "").strip(" ")


@udtf(returnType="pos int, s int, e int, form string, matched_text string, volume string, reporter string, page string, pin string, kind string, told string")
class ExtractCitations:
    """One row per mention of a text, in order; places are those of the normalised text."""

    def eval(self, text: str) -> Iterator[tuple]:
        for pos, found in enumerate(scan_citations(_normalized(text))):
            s, e, form, matched, volume, reporter, page, pin, kind, told = found
            yield pos, s, e, form, matched, volume, reporter, page, pin, kind, told


@udtf(returnType="pos int, s int, e int, sentence string")
class SplitSentences:
    """One row per sentence of a text, in order. A text without words has none."""

    def eval(self, text: str) -> Iterator[tuple]:
        body, begin = _normalized(text), 0
        for pos, end in enumerate(sentence_ends(body) if body else ()):
            yield pos, begin, end, body[begin:end].strip(" ")
            begin = end


def register(spark: SparkSession) -> None:
    """``extract_citations(text)`` and ``split_sentences(text)`` for this session's SQL."""
    spark.udtf.register("extract_citations", ExtractCitations.asDeterministic())
    spark.udtf.register("split_sentences", SplitSentences.asDeterministic())
