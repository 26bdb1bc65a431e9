"""Exact nearest neighbours by cosine distance, for many queries at once.

Distances are rounded to `DISTANCE_DIGITS`, so that copies of a vector tie whichever block they fall
in; ties are then broken by id. A zero vector is at distance 1 from everything; a vector that is null or
holds a null, an infinite value or NaN is near to nothing and is left out on either side.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paylens.fixed_values import NEIGHBOURS

DISTANCE_DIGITS = 9
_UNITS = 10**DISTANCE_DIGITS

# Queries that are broadcast: at most so many, of at most so many bytes in all.
BROADCAST_QUERIES = 4096
BROADCAST_BYTES = 128 << 20

_CANDIDATES = pa.schema(
    [("query_id", pa.string()), ("tx_id", pa.string()), ("distance", pa.float64())]
)
_CANDIDATES_DDL = "query_id string, tx_id string, distance double"


def _matrix(column: pa.Array, dims: int | None = None) -> np.ndarray:
    """Rows of a list column as a float64 matrix."""
    values = np.asarray(column.flatten(), dtype=np.float64)
    dims = len(values) // max(len(column), 1) if dims is None else dims
    if len(values) != len(column) * dims:
        raise ValueError(f"vectors are not all of length {dims}")
    return values.reshape(len(column), dims)


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _rows(
    table: pa.Table | pa.RecordBatch, key: str, dims: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the rows that have a vector of finite numbers."""
    table = table.filter(pc.is_valid(table["embedding"]))
    if table.num_rows == 0:
        return np.empty(0, dtype=object), np.empty((0, dims or 0))
    column = table["embedding"]
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    matrix = _matrix(column, dims)
    finite = np.isfinite(matrix).all(axis=1)
    return np.array(table[key].to_pylist(), dtype=object)[finite], matrix[finite]


# A distance in units that stands for a repeated id; above every real one.
_REPEATED = (1 << 31) - 1


class _Nearest:
    """The k nearest ids so far for each of a block of queries; of a repeated id the nearest row."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        self.query_ids, self.queries, self.k = query_ids, _unit_rows(queries), k
        self.dims = queries.shape[1] if len(query_ids) else None
        self.units = np.empty((len(query_ids), 0), dtype=np.int64)
        self.ids = np.empty((len(query_ids), 0), dtype=object)

    def _keep(self, units: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Positions of the k least (distance, id rank) pairs of each row."""
        keys = (units << 32) | ranks
        if keys.shape[1] <= self.k:
            return np.broadcast_to(np.arange(keys.shape[1]), keys.shape)
        return np.argpartition(keys, self.k - 1, axis=1)[:, : self.k]

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        if not (len(ids) and len(self.query_ids)):
            return
        step = max(1, min((1 << 22) // max(len(self.query_ids), 1), (1 << 24) // rows.shape[1]))
        for at in range(0, len(ids), step):
            self._add_block(ids[at : at + step], rows[at : at + step])

    def _add_block(self, ids: np.ndarray, rows: np.ndarray) -> None:
        distance = 1.0 - self.queries @ _unit_rows(rows).T
        units = np.rint(distance * _UNITS).astype(np.int64).clip(min=0)
        order = np.argsort(ids, kind="stable")
        firsts = np.flatnonzero(np.concatenate(([True], ids[order][1:] != ids[order][:-1])))
        units, ids = np.minimum.reduceat(units[:, order], firsts, axis=1), ids[order][firsts]
        new = self._keep(units, np.arange(len(ids))[None, :])

        units = np.hstack([self.units, np.take_along_axis(units, new, axis=1)])
        merged = np.hstack([self.ids, ids[new]])
        _, ranks = np.unique(merged, return_inverse=True)
        ranks = ranks.reshape(merged.shape)
        by_id = np.lexsort((units, ranks), axis=1)
        sorted_ranks = np.take_along_axis(ranks, by_id, axis=1)
        again = np.zeros_like(by_id, dtype=bool)
        again[:, 1:] = sorted_ranks[:, 1:] == sorted_ranks[:, :-1]
        repeated = np.zeros_like(again)
        np.put_along_axis(repeated, by_id, again, axis=1)
        units = np.where(repeated, _REPEATED, units)
        best = self._keep(units, ranks)
        self.units = np.take_along_axis(units, best, axis=1)
        self.ids = np.take_along_axis(merged, best, axis=1)

    def batch(self) -> pa.RecordBatch:
        real = self.units.ravel() != _REPEATED
        columns = (
            np.repeat(self.query_ids, self.ids.shape[1])[real],
            self.ids.ravel()[real],
            self.units.ravel()[real] / float(_UNITS),
        )
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, _CANDIDATES.types)], schema=_CANDIDATES
        )


def _scan_against(queries: pa.Table, corpus: DataFrame, k: int) -> DataFrame:
    """Candidates from one pass over the corpus, k per query and task."""
    shared = corpus.sparkSession.sparkContext.broadcast(_rows(queries, "query_id"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = _Nearest(*shared.value, k)
        for batch in batches:
            nearest.add(*_rows(batch, "tx_id", nearest.dims))
        yield nearest.batch()

    return corpus.mapInArrow(scan, _CANDIDATES_DDL)


def ranked(candidates: DataFrame, k: int) -> DataFrame:
    """First k different ids per query, nearest first, with their rank from 1.

    Candidates of a query are spread by their ids, where repeats are merged; each task then keeps k per
    query, so that only these meet.
    """
    nearest_first = Window.partitionBy("query_id").orderBy("distance", "tx_id")
    return (
        candidates.groupBy("query_id", "tx_id")
        .agg(F.min("distance").alias("distance"))
        .withColumn("rank", F.row_number().over(nearest_first))
        .where(F.col("rank") <= k)
        .select("query_id", "tx_id", "rank", "distance")
    )


def nearest(
    queries: DataFrame, corpus: DataFrame, k: int = NEIGHBOURS, exclude_self: bool = False
) -> DataFrame:
    """`query_id, tx_id, rank, distance` of the k nearest corpus rows of each query.

    `queries` holds `query_id, embedding`, `corpus` holds `tx_id, embedding`; of an id that it holds
    several times the nearest row counts. With `exclude_self` a row whose id equals the query's is left out before ranking. Queries up to a
    checked size are broadcast and the corpus is scanned in place, without a shuffle; for more the corpus is
    indexed into cells first (see `cells`, which also takes an index that was built before).
    """
    queries = queries.select("query_id", "embedding")
    corpus = corpus.select("tx_id", "embedding")
    wanted = k + 1 if exclude_self else k

    taken = queries.limit(BROADCAST_QUERIES + 1).toArrow()
    if taken.num_rows > BROADCAST_QUERIES or taken.nbytes > BROADCAST_BYTES:
        from paylens.operators.cells import build_cells, nearest_in_cells  # it builds on this module

        return nearest_in_cells(queries, build_cells(corpus), k, exclude_self)
    candidates = _scan_against(taken, corpus, wanted)
    if exclude_self:
        candidates = candidates.where(F.col("query_id") != F.col("tx_id"))
    return ranked(candidates, k)


def cosine_distance(a: Column, b: Column) -> Column:
    """The same distance as a column expression, for a pair of vectors; null where one is unusable."""

    def dot(x, y):
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)

    def usable(x):
        return F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))

    similarity = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    distance = F.round(1 - F.coalesce(similarity, F.lit(0.0)), DISTANCE_DIGITS)
    return F.when(usable(a) & usable(b), F.greatest(distance, F.lit(0.0)))
