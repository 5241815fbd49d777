"""Quality rules: zstandard ratios of whole texts and of fixed chunks, held against bands by length."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import fresh, tidy


class Band(NamedTuple):
    """Ratios (compressed bytes over bytes) that texts of ``min_bytes`` and more may have."""

    min_bytes: int
    low: float
    high: float


#: Short texts compress badly, as the frame's own bytes and the lack of context weigh more; so the limits fall with length.
BANDS = (Band(0, 0.0, 9.0), Band(64, 0.30, 1.45), Band(256, 0.36, 0.92), Band(1024, 0.33, 0.80), Band(4096, 0.30, 0.74), Band(16384, 0.26, 0.70))
CHUNK_BYTES = 2048
#: The share of a text's bytes that may lie in chunks outside the band of their length.
BAD_CHUNKS = 0.34
LEVEL = 3
SYMBOLS = "#*$%&|<>"

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bytes long, ratio double, n_chunks long, n_bad_chunks long, n_bad_bytes long, chunk_low double, chunk_high double"


def repeated_words(words: list, width: int = 5) -> int:
    """Words in windows of ``width`` words found twice or more, the first included."""
    grams = list(zip(*(words[k:] for k in range(width))))
    if len(grams) < 2 or len(set(grams)) == len(grams):
        return 0
    counts = Counter(grams)
    again = np.fromiter((counts[g] > 1 for g in grams), dtype=np.int64, count=len(grams))
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    edges[: len(grams)] += again
    edges[width:] -= again[: len(edges) - width]
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def band_of(n_bytes: int, bands=BANDS) -> Band:
    """The band of a length: that of the largest ``min_bytes`` it reaches; of a length below all, the first."""
    return max((b for b in bands if b.min_bytes <= n_bytes), default=min(bands))


def compression_measures(chunk_bytes: int = CHUNK_BYTES, bands=BANDS, level: int = LEVEL):
    """A pandas UDF: text -> struct of MEASURES. A null or empty text has zeros and ratio 1.

    Chunks follow one another from the text's beginning; the last one is as long as what is left.
    """

    @F.pandas_udf(MEASURES)
    @tidy
    def measures(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import zstandard

        press = zstandard.ZstdCompressor(level=level).compress
        names = [x.split()[0] for x in MEASURES.split(", ")]
        ordered = sorted(bands)

        def one(text: str | None) -> tuple:
            if not text:
                return 0, 0, 0, 0, 0, 0, 1.0, 0, 0, 0, 1.0, 1.0
            raw = text.encode()
            words = raw.split()
            lines = [x for x in raw.split(b"\n") if x.strip()]
            whole = len(press(raw)) / len(raw)
            sizes = [min(chunk_bytes, len(raw) - k) for k in range(0, len(raw), chunk_bytes)]
            ratios = [whole] if len(sizes) == 1 else [len(press(raw[k * chunk_bytes : k * chunk_bytes + n])) / n for k, n in enumerate(sizes)]
            bad = [n for n, x in zip(sizes, ratios) if not (band := band_of(n, ordered)).low <= x <= band.high]
            return (
                len(words), len(text) - sum(map(text.count, " \t\n\v\f\r")), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words),
                len(raw), whole, len(ratios), len(bad), sum(bad), min(ratios), max(ratios),
            )

        for texts in batches:
            yield pd.DataFrame([one(x) for x in texts], columns=names)

    return measures


def in_bands(n_bytes: Column, ratio: Column, bands=BANDS) -> Column:
    """Whether the whole text's ratio lies in the band of its length."""
    inside = F.lit(True)
    for band in sorted(bands):
        inside = F.when(n_bytes >= band.min_bytes, ratio.between(band.low, band.high)).otherwise(inside)
    return inside


def compression_rules(
    docs: DataFrame, text: str = "text", bands=BANDS, chunk_bytes: int = CHUNK_BYTES, bad_chunks: float = BAD_CHUNKS, min_words: int = 10, max_repeat_percent: int = 20, level: int = LEVEL
) -> DataFrame:
    """``docs`` with the columns of MEASURES, ``base_failed``, ``bands_failed`` and ``kept``.

    A text is rejected if it has under ``min_words`` words, if more than
    ``max_repeat_percent`` of its words lie in repeated five-word windows, if its
    ratio leaves the band of its length, or if over ``bad_chunks`` of its bytes lie in
    chunks whose ratio leaves the band of their own length. A text of one chunk is
    judged by one band; a short last chunk counts by its bytes. Null and empty texts
    have no words and are rejected. Every row is judged alone: repeated rows get equal
    verdicts, an empty table stays empty. An input column with the name of a result
    column is replaced, all others stay.
    """
    (held,) = fresh(docs, "_measures")
    out = docs.withColumn(held, compression_measures(chunk_bytes, bands, level)(F.col(text)))
    out = out.withColumns({x.split()[0]: F.col(f"{held}.{x.split()[0]}") for x in MEASURES.split(", ")}).drop(held)
    repeated = F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent
    out = out.withColumn("base_failed", (F.col("n_words") < min_words) | repeated)
    chunks = F.col("n_bad_bytes") > F.col("n_bytes") * bad_chunks
    out = out.withColumn("bands_failed", ~in_bands(F.col("n_bytes"), F.col("ratio"), bands) | chunks)
    return out.withColumn("kept", ~(F.col("base_failed") | F.col("bands_failed")))
