"""Vector codes, against a search of every entry in Python's integers."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.llm import vector_codes as V
from docketry.llm.queries import ORACLES, op12_vector_codes

SF = "/root/testdata/sf0.001"


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """(rows, codebooks' hash) of (vec_id, vector, label), all vectors of one length, a multiple of ``parts``."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = lambda v: [v[k * width : (k + 1) * width] for k in range(parts)]
    first = sorted((i, v) for i, v, _ in kept if i is not None)[:entries]
    books = [[list(cut(v)[k]) for _, v in first] for k in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda v: [min((square(p, e), n) for n, e in enumerate(books[k])) for k, p in enumerate(cut(v))]
    for _ in range(rounds):
        found = [assign(v) for _, v, _ in kept]
        for k in range(parts):
            for n in range(len(books[k])):
                own = [cut(v)[k] for (_, v, _), a in zip(kept, found) if a[k][1] == n]
                if own:
                    books[k][n] = [sum(c) // len(own) for c in zip(*own)]
    out, by_label = [], {}
    for i, v, label in kept:
        found = assign(v)
        error = sum(d for d, _ in found)
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, "".join(f"{n:02x}" for _, n in found), error, label))
    text = ",".join(str(c) for book in books for e in book for c in e)
    return sorted(((i, c, e, by_label[label]) for i, c, e, label in out), key=str), hashlib.sha256(text.encode()).hexdigest()


def test_query_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    expected, sha = brute_codes(rows)
    got = op12_vector_codes(spark, SF).collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str) == expected
    assert {r.codebooks_sha256 for r in got} == {sha}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    by_sql = con.execute(ORACLES["op12_vector_codes"]).fetchall()
    assert sorted((x[:4] for x in by_sql), key=str) == expected and {x[4] for x in by_sql} == {sha}


@pytest.mark.parametrize("count, spread", [(5, 1.0), (300, 0.01), (300, 3.0), (120, 2.0**19)])
def test_ties_repeats_and_sizes(spark, tmp_path, count, spread):
    r = random.Random(count)
    rows = [(r.choice([r.randrange(10**6), r.randrange(20), None]), [r.choice([0.0, round(r.uniform(-spread, spread), 2), spread]) for _ in range(32)], r.choice([None, 1, 2, 3])) for _ in range(count)]
    rows += rows[:4] + [(7, None, 1), (8, [0.0] * 31 + [None], 1), (9, [float("nan")] * 32, None), (10, [float("-inf")] * 32, 2), (11, [-0.001] * 32, 2), (None, None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("own") for c in ("v", "far", "code", "error", "_label")})
    df.repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    expected, sha = brute_codes(rows)
    got = op12_vector_codes(spark, str(tmp_path)).collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str) == expected
    assert {r.codebooks_sha256 for r in got} == {sha}


def test_lengths_labels_and_empty_tables(spark):
    rows = [(1, [0.5] * 16, "a"), (2, [0.25] * 16, "b"), (3, [], "b"), (4, [1.0, 2.0, 3.0], None), (5, [1.0, 2.0, 3.5], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    coded, books = V.compress_vectors(df)
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in coded.collect()}
    assert sorted(books) == [0, 16] and got[3] == ("00" * 16, 0, 0) and len(books[16][0]) == 4
    assert got[1][0] == "00" * 16 and all(e == 0 for _, e, _ in got.values())  # four rows, four entries: each is its own
    coded, books = V.compress_vectors(df.where("vec_id < 0"))
    assert coded.count() == 0 and books == {} and V.books_sha256(books) == hashlib.sha256(b"").hexdigest()
    alone, books = V.compress_vectors(df.select(F.lit(None).cast("long").alias("vec_id"), "embedding").where("size(embedding) = 3"), label=None)
    assert [r.vec_id for r in alone.collect()] == [None, None] and len(books[16][0]) == 1
    with pytest.raises(ValueError):
        V.compress_vectors(df, entries=257)


def test_labels_beyond_a_broadcast(spark):
    coded = spark.createDataFrame([(i, None if i % 7 == 0 else min(i, 30), "00", i) for i in range(60)], "vec_id long, label int, code string, error long")
    expected = sorted(map(tuple, V.sums_by_label(coded).select("vec_id", "label_error").collect()))
    assert sorted(map(tuple, V.sums_by_label(coded, 4).select("vec_id", "label_error").collect())) == expected


def test_bounds_prune_and_lose_nothing():
    r = np.random.default_rng(2)
    centres = r.integers(-2000, 2000, (64, 4))
    x = centres[r.integers(0, 64, 3000)] + r.integers(-30, 30, (3000, 4))
    pivots = V.pick_pivots(centres, 4)
    index, best, measured = V.nearest(x, centres, V.distances(x, pivots).astype(np.float32), V.distances(pivots, centres))
    every = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (index == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert measured < 0.1 * every.size
    assert len(V.pick_pivots(np.zeros((5, 3), dtype=np.int64), 4)) == 1


def test_components_beyond_squares_of_64_bits():
    book = np.array([[0, 0], [1 << 40, 3], [1 << 40, 4]], dtype=np.int64)
    x = np.array([[(1 << 40) + 1, 4], [5, 5], [1 << 39, 0]], dtype=np.int64)
    index, best, _ = V.nearest(x, book, V.distances(x, book[:1]).astype(np.float32), V.distances(book[:1], book))
    assert index.tolist() == [2, 0, 0] and best.tolist() == [1, 50, 1 << 78]
