"""Exact top-k search: tiles of queries times tiles of rows, partial selection in each tile, merging of the lists in a tree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import materialize

QUERY_TILE = 8192
ROW_TILE = 32768
#: As queries grow, so do their tiles: beyond this many tiles, as long as one has no more numbers than TILE_NUMBERS.
QUERY_TILES = 256
TILE_NUMBERS = 1 << 23
#: Pairs of tiles are dealt to at most so many tasks, which take them one at a time.
MOST_TASKS = 20_000
#: How many lists of one query a merging step takes.
FAN_IN = 16
FOUND = "query_id long, tile long, vec_id long, score long"
_BLOCK = 1024, 8192


def quantized(df: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, v): components as floor(scale * x). Rows with a null vector or a null or non-finite component are left out, null ids too.

    A component that is no 64-bit integer then ends the job with an error.
    """
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    clean = df.where(F.col(vec_id).isNotNull() & x.isNotNull()).where(~F.coalesce(bad, F.lit(True)))
    whole = lambda c: F.when(F.abs(c * scale) < F.lit(float(1 << 63)), F.floor(c * scale)).otherwise(F.raise_error("a vector's component is beyond 64 bits").cast("long"))
    return clean.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, whole).alias("v"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _number(q: np.ndarray, s: np.ndarray):
    """The fastest number kind in which every product and partial sum is exact: floats, 64-bit integers, or Python's integers."""
    size = lambda x: max(1, int(x.max(initial=0)), -int(x.min(initial=0)))
    most = max(1, q.shape[1]) * size(q) * size(s)
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object


def _as_scores(products: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Products as 64-bit integers, _NONE where ``same``; an error if another one is none, or is _NONE itself."""
    if products.dtype == object:
        products[same] = 0
        if products.size and not (_NONE < products.min() and products.max() < 1 << 63):
            raise OverflowError("an inner product is beyond 64 bits")
    return np.where(same, _NONE, products.astype(np.int64))


def tile_top(k: int):
    """Grouped by a pair of tiles: each query's ``k`` best rows of the tile; ties to the smaller vec_id."""

    def run(key, queries, rows):
        tile = key[1].as_py()
        out = ([], [], [])
        queries = queries.rename_columns({"q_id": "vec_id", "q_v": "v"})
        for width in np.intersect1d(*(pc.list_value_length(t.column("v")).to_numpy() for t in (queries, rows))):
            q, s = (t.filter(pc.equal(pc.list_value_length(t.column("v")), int(width))) for t in (queries, rows))
            s = s.sort_by("vec_id")  # so that of equal scores the earlier place is the smaller id
            q_ids, s_ids = (t.column("vec_id").to_numpy().astype(np.int64) for t in (q, s))
            q, s = _matrix(q.column("v"), int(width)), _matrix(s.column("v"), int(width))
            kind = _number(q, s)
            q, s = q.astype(kind), np.ascontiguousarray(s.astype(kind).T)
            for a in range(0, len(q), _BLOCK[0]):
                ids = q_ids[a : a + _BLOCK[0]]
                held_score = np.empty((len(ids), 0), dtype=np.int64)
                held_at = np.empty((len(ids), 0), dtype=np.int64)
                for b in range(0, len(s_ids), _BLOCK[1]):
                    own = s_ids[b : b + _BLOCK[1]]
                    same = ids[:, None] == own[None, :]
                    score = _as_scores(q[a : a + _BLOCK[0]] @ s[:, b : b + _BLOCK[1]], same)
                    at = np.broadcast_to(np.arange(b, b + len(own)), score.shape)
                    held_score, held_at = _best(np.hstack([held_score, score]), np.hstack([held_at, at]), k)
                good = held_score != _NONE
                out[0].append(np.repeat(ids, good.sum(axis=1)))
                out[1].append(s_ids[held_at[good]])
                out[2].append(held_score[good])
        found = [np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in out]
        return pa.table({"query_id": found[0], "tile": np.full(len(found[0]), tile, dtype=np.int64), "vec_id": found[1], "score": found[2]})

    return run


_NONE = np.iinfo(np.int64).min


def _best(score: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best columns of each row by (score down, place up): those over the k-th score, and the first of those equal to it."""
    n = score.shape[1]
    if n > k:
        kth = np.partition(score, n - k, axis=1)[:, n - k, None]
        over = score > kth
        equal = score == kth
        need = k - over.sum(axis=1, keepdims=True)
        # Held places come before the block's, and both rise: so the first equal ones are the smallest.
        keep = over | (equal & (np.cumsum(equal, axis=1) <= need))
        rows = np.nonzero(keep)
        score, at = score[rows].reshape(-1, k), at[rows].reshape(-1, k)
        order = np.argsort(at, axis=1)
        return np.take_along_axis(score, order, 1), np.take_along_axis(at, order, 1)
    return score, at


def merge_lists(found: DataFrame, tiles: int, k: int, fan_in: int = FAN_IN) -> DataFrame:
    """The best ``k`` of each query's lists, ``fan_in`` lists at a time."""
    best = lambda df, *by: df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))).where(F.col("_n") <= k)
    while tiles > fan_in:
        tiles = -(-tiles // fan_in)
        found = best(found.withColumn("tile", F.floor(F.col("tile") / fan_in).cast("long")), "query_id", "tile").drop("_n")
    return best(found, "query_id").withColumnRenamed("_n", "rank")


def query_tile_of(queries: int, width: int, least: int = QUERY_TILE) -> int:
    """Queries of a tile: ``least``, or so many that there are QUERY_TILES tiles, as far as TILE_NUMBERS allow it."""
    return max(least, min(-(-queries // QUERY_TILES), TILE_NUMBERS // max(1, width)))


def top_k(
    rows: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256, query_tile: int = QUERY_TILE, row_tile: int = ROW_TILE, fan_in: int = FAN_IN
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` rows of highest integer inner product, ties to the smaller id.

    ``is_query`` is a condition on ``vec_id``. Every row whose id is not the
    query's is a candidate; rows that agree in id and vector are one row, and of
    rows that share an id but not the vector each counts as a candidate. A query
    id with several vectors is asked with the smallest one. Vectors left out by
    ``quantized`` neither ask nor answer; vectors of another length than the
    query's do not answer it, so empty ones (score 0) answer empty ones only; an
    empty table gives no rows. Scores are exact: where products may be beyond 64 bits
    they are worked out in unbounded integers, and one that is ends the job with an error.

    Ids are integers; a text that is none ends the job with an error.

    Tiles are even, as rows go to them by a hash, and a task holds one tile of
    rows and one of queries at a time. Each row is sent once for every tile of
    queries, each query once for every ``row_tile`` rows; many queries have larger
    tiles than ``query_tile``, see ``query_tile_of``.
    """
    data = materialize(quantized(rows, vec_id, vector, scale).dropDuplicates(["vec_id", "v"]), "vectors")
    asked = data.where(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min("v").alias("v"))
    n_rows, n_queries, width = data.agg(F.count("*"), F.count_if(is_query(F.col("vec_id"))), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    row_tiles, query_tiles = max(1, -(-n_rows // row_tile)), max(1, -(-n_queries // query_tile_of(n_queries, width, query_tile)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    spread = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n))
    queries = asked.withColumn("q_tile", spread(query_tiles)).withColumn("r_tile", every(row_tiles))
    queries = queries.select(F.col("vec_id").alias("q_id"), F.col("v").alias("q_v"), "q_tile", "r_tile")
    tiles = data.withColumn("r_tile", spread(row_tiles)).withColumn("q_tile", every(query_tiles))
    # A pair of tiles costs much time for few bytes, so pairs are not gathered in tasks by their size.
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, row_tiles * query_tiles))
    dealt = lambda df: df.repartition(parts, "q_tile", "r_tile").groupBy("q_tile", "r_tile")
    pairs = dealt(queries).cogroup(dealt(tiles))
    found = pairs.applyInArrow(tile_top(k), FOUND)
    return merge_lists(found, row_tiles, k, fan_in).select("query_id", "rank", "vec_id", "score")
