"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
import sys
import types
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.sources.shared import discard, stage as materialize

__all__ = ["discard", "materialize"]

#: Most rows of two or three numbers that an operator broadcasts; beyond it, the same join shuffles.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that ``df`` doesn't have, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (already materialised) with a broadcast hint if it has at most ``limit`` rows."""
    return F.broadcast(df) if df.count() <= limit else df


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of ids kept out of every fit: crc32(id as text) mod 5 is 0; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, label) of about ``max_rows`` labelled documents that are not held out.

    The bound is the operator's documented parameter: when more rows are
    labelled, a hash of the id keeps the fraction ``max_rows / rows``. Ids
    labelled more than once take the mean label, rounded up. Null labels and
    ids don't count.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).where(~held_out(doc_id))
    known = known.groupBy(F.col(doc_id).alias("_id")).agg(F.avg(label).alias("_mean"))
    held = known = materialize(known.select("_id", (F.col("_mean") >= 0.5).cast("int").alias("label")), "labels")
    rows = known.count()
    if rows > max_rows:
        known = known.where(F.pmod(F.xxhash64(F.lit("sample"), "_id"), F.lit(1 << 30)) < int((1 << 30) * max_rows / rows))
    known = F.broadcast(known) if max_rows <= BROADCAST_ROWS else known
    body = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = materialize(body.join(known, "_id").select("text", "label"), "labelled")
    discard(held)
    return out


def portions(column: pa.Array, rows: int, size: int) -> Iterator[slice]:
    """Places of ``column`` (texts or bytes) in turn, at most ``rows`` at once and, but for a single longer one, ``size`` bytes."""
    first = total = 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if k > first and (k - first == rows or total + n > size):
            yield slice(first, k)
            first, total = k, 0
        total += n
    if len(column) > first:
        yield slice(first, len(column))


def _memories() -> dict[str, dict]:
    return sys.modules.setdefault("_docketry_memory", types.ModuleType("_docketry_memory")).__dict__.setdefault("memories", {})


def worker_memory(name: str) -> dict:
    """A dict that a Python worker keeps from task to task, for things that cost time to make again, until a ``tidy`` task that doesn't keep it begins. No result depends on it."""
    return _memories().setdefault(name, {})


def give_back() -> None:
    """Give the memory that this process has freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidy(run=None, *, keeps: str | None = None):
    """A task's generator of batches that gives the memory it has freed back to the system at its end, as Python workers live on for other tasks.

    At its beginning the worker forgets every ``worker_memory`` but ``keeps``: what the tasks of another operator have left there.
    """
    if run is None:
        return functools.partial(tidy, keeps=keeps)

    @functools.wraps(run)
    def own(*args):
        memories = _memories()
        for name in [x for x in memories if x != keeps]:
            del memories[name]
        try:
            yield from run(*args)
        finally:
            give_back()

    return own


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs started inside hand Python at most ``rows`` rows in an Arrow batch: both the executor and the worker hold a whole one."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def coded_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, each word's place among them, each text's first word) of texts, by ASCII white space; null texts have none.

    The third has one more entry than there are texts. The words may hold an empty one, which has no place.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = lists.flatten().dictionary_encode()
    words, at, bounds = coded.dictionary, coded.indices.to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    empty = pc.index(words, pa.scalar("", words.type)).as_py()
    if empty >= 0:
        some = at != empty
        at, bounds = at[some], np.concatenate([[0], np.cumsum(some)])[bounds]
    return words, at, bounds


def split_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """``coded_words`` with the words as a list."""
    words, at, bounds = coded_words(texts)
    return words.to_pylist(), at, bounds


class WordTable:
    """A row of ``width`` numbers for each word, so that ``measure(word)`` runs once for each distinct word.

    Beyond ``limit`` words it starts over, which bounds memory and changes no result.
    """

    def __init__(self, measure, width: int, limit: int = 300_000):
        self.measure, self.limit, self.known = measure, limit, {}
        self.rows = np.zeros((4096, width), dtype=np.float32)

    def of(self, words: list[str]) -> np.ndarray:
        """The rows of distinct words."""
        if len(self.known) > self.limit:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        first, last = len(self.known), len(self.known) + len(new)
        while last > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        if new:
            self.rows[first:last] = [self.measure(w) for w in new]
            self.known.update(zip(new, range(first, last)))
        return self.rows[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]


def ranges(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """first[0] .. first[0] + length[0] - 1, first[1] .. and so on."""
    ends = np.cumsum(length)
    return np.repeat(first - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)


def sums(rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of rows between bounds; zeros where there are none."""
    out = np.zeros((len(bounds) - 1, rows.shape[1]))
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some] = np.add.reduceat(rows, bounds[some], axis=0, dtype=np.float64)
    return out


def as_lists(rows: np.ndarray) -> pa.Array:
    """A matrix as an Arrow array of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.reshape(-1)))
