"""Compression of vectors into codes: each part of a vector becomes the index of its nearest codebook entry.

Entries are searched by pivots. The distances from a part to a few fixed pivots are
worked out once and kept. In each round the pivots' distances to the entries give,
for each part and entry, a lower bound of their distance, the largest difference
of the two. Entries are tried by rising bound, and only those whose bound does not
exceed the best distance found are ever measured, in whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import BROADCAST_ROWS, discard, materialize, tidy

PARTS, ENTRIES, ROUNDS, PIVOTS = 16, 64, 2, 4
#: Rows that are searched at once.
BLOCK = 2048
#: What a bound may lose to rounding, as a part of the distances it is made from; they are kept as 32-bit floats.
SLACK = 1e-6
#: How many entries a part tries at first, and then, before all that are left within its bound.
TRIED = (1, 4)

Books = dict[int, list[np.ndarray]]  # by length of a vector: for each part, entries by components


def integer_vectors(df: DataFrame, vec_id: str, vector: str, label: str | None, scale: int, parts: int) -> DataFrame:
    """(vec_id, label, v): components as floor(scale * x). Rows whose vector is null or holds a null or non-finite component are left out.

    Vectors whose length is no multiple of ``parts`` have zeros at their end. A
    component that is no 64-bit integer ends the job with an error.
    """
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    clean = df.where(x.isNotNull()).where(~F.coalesce(bad, F.lit(True)))
    whole = lambda c: F.when(F.abs(c * scale) < F.lit(float(1 << 63)), F.floor(c * scale)).otherwise(F.raise_error("a vector's component is beyond 64 bits").cast("long"))
    v = F.transform(x, whole)
    zeros = F.array_repeat(F.lit(0).cast("long"), F.pmod(-F.size(x), F.lit(parts)))
    return clean.select(F.col(vec_id).alias("vec_id"), (F.col(label) if label else F.lit(None).cast("int")).alias("label"), F.concat(v, zeros).alias("v"))


def first_books(vectors: DataFrame, parts: int, entries: int) -> Books:
    """The codebooks to begin with, one for each length of vectors: their parts in the ``entries`` vectors of smallest ids. Rows without an id are none of them."""
    books = {}
    for (length,) in vectors.select(F.size("v")).distinct().collect():
        own = vectors.where((F.size("v") == length) & F.col("vec_id").isNotNull()).orderBy("vec_id", "v").limit(entries).collect()
        first = np.array([r.v for r in own], dtype=np.int64).reshape(len(own), parts, length // parts)
        books[length] = [first[:, k] for k in range(parts)]
    return books


def safe(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as a number kind in which squared distances are exact: 64-bit integers, or Python's."""
    most = max((abs(int(f(a))) for a in (x, book) if a.size for f in (np.min, np.max)), default=0)
    kind = np.int64 if 4 * most * most * max(1, x.shape[-1]) < 1 << 63 else object
    return x.astype(kind, copy=False), book.astype(kind, copy=False)


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Of every row of ``x`` to every entry of ``book``, as 64-bit floats."""
    x, book = safe(x, book)
    out = np.zeros((len(x), len(book)))
    for k, entry in enumerate(book):
        out[:, k] = np.sqrt(((x - entry) ** 2).sum(axis=1).astype(np.float64)) if x.shape[1] else 0
    return out


def pick_pivots(book: np.ndarray, most: int) -> np.ndarray:
    """Entries that lie far apart: the first, then each time the one farthest from those chosen, the first of equal ones."""
    if not len(book):
        return book
    chosen, far = [0], distances(book, book[:1])[:, 0]
    while len(chosen) < min(most, len(book)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(book, book[chosen[-1:]])[:, 0])
    return book[chosen]


def nearest(x: np.ndarray, book: np.ndarray, to_pivots: np.ndarray, pivots_to: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index, squared distance) of each row's nearest entry, of equal ones the first, and how many distances were measured.

    ``to_pivots``: rows by pivots; ``pivots_to``: pivots by entries.
    """
    x, book = safe(x, book)
    bound = np.zeros((len(x), len(book)))
    for mine, theirs in zip(to_pivots.T, pivots_to):
        mine = mine[:, None].astype(np.float64)
        np.maximum(bound, np.abs(mine - theirs) - SLACK * (mine + theirs), out=bound)
    bound *= bound
    order = np.argsort(bound, axis=1, kind="stable")
    rows = np.arange(len(x))
    best = np.full(len(x), -1, dtype=x.dtype)
    index = np.zeros(len(x), dtype=np.int64)
    measured, done = 0, 0
    for step in (*TRIED, len(book)):
        at = order[:, done : done + step]
        done += step
        if not at.size:
            break
        # A bound equal to the best distance is tried, too: the entry may be an earlier one.
        worth = (best[:, None] < 0) | (np.take_along_axis(bound, at, 1) <= best[:, None].astype(np.float64))
        row, column = np.nonzero(worth)
        entry = at[row, column]
        square = ((x[row] - book[entry]) ** 2).sum(axis=1) if x.shape[1] else np.zeros(len(row), dtype=x.dtype)
        measured += len(row)
        for k in range(at.shape[1]):
            own = column == k
            r, d, e = row[own], square[own], entry[own]
            better = (best[r] < 0) | (d < best[r]) | ((d == best[r]) & (e < index[r]))
            best[r[better]], index[r[better]] = d[better], e[better]
    return index, best, measured


def vectors_of(column: pa.Array, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors as rows by parts by components) of a list column, by length and ``BLOCK`` rows at a time."""
    lengths = np.asarray(column.value_lengths())
    for length in np.unique(lengths):
        places = np.flatnonzero(lengths == length)
        for k in range(0, len(places), BLOCK):
            own = places[k : k + BLOCK]
            yield own, column.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), parts, length // parts)


class Search:
    """Nearest entries of all parts of vectors, in the codebooks of a round."""

    def __init__(self, books: Books, pivots: Books):
        self.books, self.pivots = books, pivots
        self.between = {n: [distances(p, b) for p, b in zip(pivots[n], books[n])] for n in books}

    def rows(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(places, vectors, indexes, squared distances) of a batch with ``v`` and ``far``, both by part."""
        far = batch.column("far").flatten()
        starts = np.asarray(batch.column("far").offsets)
        for places, x in vectors_of(batch.column("v"), len(next(iter(self.books.values())))):
            length = x.shape[1] * x.shape[2]
            own = [len(p) for p in self.pivots[length]]
            starts_ = np.asarray(starts[places] - starts[0])
            to = np.asarray(far)[starts_[:, None] + np.arange(sum(own))]
            edges = np.cumsum([0, *own])
            found = [nearest(x[:, k], self.books[length][k], to[:, edges[k] : edges[k + 1]], self.between[length][k]) for k in range(x.shape[1])]
            yield places, x, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def with_pivot_distances(vectors: DataFrame, pivots: Books, parts: int) -> DataFrame:
    """``vectors`` with ``far``: the distances of each part to its pivots, one part after the other."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = [None] * batch.num_rows
            for places, x in vectors_of(batch.column(2), parts):
                own = pivots[x.shape[1] * x.shape[2]]
                together = np.concatenate([distances(x[:, k], own[k]) for k in range(parts)], axis=1).astype(np.float32)
                for place, row in zip(places, together):
                    far[place] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far, pa.list_(pa.float32()))], [*batch.schema.names, "far"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.mapInArrow(run, f"{kinds}, far array<float>")


def next_books(vectors: DataFrame, books: Books, pivots: Books) -> Books:
    """The codebooks after a round: each entry the floor of the mean of its parts; unused ones stay.

    A task sums its own parts, and Spark the tasks' sums; what comes to the driver
    has the size of the codebooks.
    """
    search = Search(books, pivots)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            for _, x, index, _ in search.rows(batch):
                length = x.shape[1] * x.shape[2]
                for part in range(x.shape[1]):
                    book = books[length][part]
                    if (length, part) not in held:
                        held[length, part] = np.zeros((len(book), x.shape[2] + 1), dtype=object)
                    own, at = np.unique(index[:, part], return_inverse=True)
                    order = np.argsort(at, kind="stable")
                    first = np.searchsorted(at[order], np.arange(len(own)))
                    values = np.concatenate([x[:, part], np.ones((len(x), 1), dtype=np.int64)], axis=1)[order]
                    # Halves of 32 bits are summed apart, so that no sum of a block is beyond 64 bits.
                    high, low = np.add.reduceat(values >> 32, first, axis=0), np.add.reduceat(values & 0xFFFFFFFF, first, axis=0)
                    held[length, part][own] += high.astype(object) * (1 << 32) + low.astype(object)
        rows = [(n, part, e, c, str(s)) for (n, part), sums in held.items() for e, row in enumerate(sums) if row[-1] for c, s in enumerate(row)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)] if rows else [pa.array([], t) for t in (*[pa.int64()] * 4, pa.string())], ["length", "part", "entry", "at", "total"])

    totals = vectors.select("v", "far").mapInArrow(run, "length long, part long, entry long, at long, total string")
    totals = totals.groupBy("length", "part", "entry", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    sums = {}
    for r in totals.toLocalIterator():
        sums.setdefault((r.length, r.part, r.entry), {})[r.at] = int(r.total)
    out = {n: [b.copy() for b in books[n]] for n in books}
    for (n, part, entry), row in sums.items():
        count = row.pop(max(row))
        out[n][part][entry] = [row[c] // count for c in range(len(row))]
    return out


def sums_by_label(coded: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``coded`` with ``label_error``, the sum of ``error`` over rows of an equal label, nulls together.

    Up to ``limit`` labels are broadcast; of more, those that have a ``limit``-th
    of all rows, so that no task gets all rows of one.
    """
    totals = materialize(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")), "label-errors", narrow=True)
    same: Column = F.col("label").eqNullSafe(F.col("_label"))
    if totals.count() <= limit:
        return coded.join(F.broadcast(totals.drop("_n")), same).drop("_label")
    often = F.broadcast(totals.where(F.col("_n") * limit > coded.count()).drop("_n"))
    rest = coded.join(often.select("_label"), same, "left_anti").join(totals.drop("_n"), same)
    return coded.join(often, same).union(rest).drop("_label")


def books_text(books: Books) -> str:
    """All entries' components in decimal, by length, part, entry and place, joined by commas."""
    return ",".join(str(int(c)) for n in sorted(books) for book in books[n] for entry in book for c in entry)


def compress_vectors(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str | None = "label", scale: int = 256, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS
) -> tuple[DataFrame, Books]:
    """((vec_id, label, code, error, label_error), codebooks) of vectors with integer components.

    Rows come back apiece: repeated ones have the same code, rows without an id
    begin no codebook. Vectors left out by ``integer_vectors`` have no row. Vectors of
    each length have codebooks of their own; empty ones have codes of zeros. With
    fewer rows than ``entries`` (256 at most), there are as many entries as rows; an
    empty table has no rows and no codebooks. Distances are exact at any size; an
    error beyond 64 bits ends the job. Other columns are left behind.

    The table is read once. Codebooks have the size of ``entries`` vectors and go
    out with the tasks; each round sums by entry within tasks before it shuffles.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits, so there are 1 to 256 entries")
    vectors = materialize(integer_vectors(df, vec_id, vector, label, scale, parts), "integer-vectors")
    books = first_books(vectors, parts, entries)
    # Where no row has an id there is nothing to begin with; an entry of zeros stands for it.
    books = {n: [b if len(b) else np.zeros((1, n // parts), dtype=np.int64) for b in own] for n, own in books.items()}
    fixed = {n: [pick_pivots(b, pivots) for b in own] for n, own in books.items()}
    measured = materialize(with_pivot_distances(vectors, fixed, parts), "pivot-distances")
    discard(vectors)
    for _ in range(rounds if books else 0):
        books = next_books(measured, books, fixed)
    search = Search(books, fixed)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.empty(batch.num_rows, dtype=object), np.empty(batch.num_rows, dtype=object)
            for places, _, index, square in search.rows(batch) if batch.num_rows else ():
                code[places] = [bytes(row).hex() for row in index.astype(np.uint8)]
                error[places] = [int(e) for e in square.astype(object).sum(axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    kinds = ", ".join(f"`{c}` {measured.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    coded = materialize(measured.mapInArrow(run, f"{kinds}, code string, error long"), "codes")
    discard(measured)
    return sums_by_label(coded), books


def books_sha256(books: Books) -> str:
    return hashlib.sha256(books_text(books).encode()).hexdigest()
