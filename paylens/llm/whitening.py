"""Whitening of embeddings with MLlib's BlockMatrix.

The vectors, as whole numbers, are indexed into blocks of rows, without a shuffle: every task fills blocks of
its own, the last of which ends in rows of zeros. Less the exact mean they are the distributed matrix A. The
scatter is the BlockMatrix product of A transposed and A, split along the rows into as many parts as A has;
its eigenvectors, a matrix as wide as a vector, are found on the driver; and the product of A and the whitening
matrix projects all rows. Rows of zeros add nothing to either product.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.llm.common import stored, usable_vectors, whole_number

COMPONENTS = 8
SCALE = 1024
SHIFT = 100_000
# Rows of a block, and the columns of one where rows are projected.
BLOCK_ROWS = 1024
PROJECTED_COLUMNS = 8
# Components whose eigenvalue is below this share of the largest are noise of rounding.
RANK = 1e-10

_INDEXED_SCHEMA = "task int, block int, ids binary, known binary, x binary, sums array<long>"
_WHITE_SCHEMA = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, "
    "identity_error double, deviation_exact string"
)
_WHITE = pa.schema(
    [
        ("vec_id", pa.int64()),
        ("component", pa.int32()),
        ("n", pa.int64()),
        ("deviation", pa.int64()),
        ("whitened", pa.float64()),
        ("explained", pa.float64()),
        ("identity_error", pa.float64()),
        ("deviation_exact", pa.string()),
    ]
)


def shifted_vectors(vectors: DataFrame) -> DataFrame:
    """`vec_id` and `x`, the floor of `SCALE` times each entry plus `SHIFT`; unusable vectors are left out."""
    return usable_vectors(vectors, lambda v: whole_number(v * float(SCALE)) + SHIFT)


def _indexed(dims: int, block_rows: int):
    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in blocks, numbered within the task, with the sums of their columns."""
        task, block = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def cut(rows: int) -> pa.RecordBatch:
            nonlocal block, held
            ids, known, x = (np.concatenate(c) for c in zip(*held))
            row = {
                "task": task,
                "block": block,
                "ids": ids[:rows].tobytes(),
                "known": known[:rows].tobytes(),
                "x": np.ascontiguousarray(x[:rows]).tobytes(),
                "sums": x[:rows].sum(axis=0).tolist(),
            }
            held, block = ([(ids[rows:], known[rows:], x[rows:])] if rows < len(ids) else []), block + 1
            return pa.RecordBatch.from_pylist([row], schema=_INDEXED)

        for batch in batches:
            for at in range(0, len(batch), block_rows):
                part = batch.slice(at, block_rows)
                ids, x = part.column("vec_id"), part.column("x")
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                held.append((ids.fill_null(0).to_numpy(), known, _padded(x, dims)))
                if sum(len(h[0]) for h in held) >= block_rows:
                    yield cut(block_rows)
        if held:
            yield cut(sum(len(h[0]) for h in held))

    return indexed


_INDEXED = pa.schema(
    [
        ("task", pa.int32()),
        ("block", pa.int32()),
        ("ids", pa.binary()),
        ("known", pa.binary()),
        ("x", pa.binary()),
        ("sums", pa.list_(pa.int64())),
    ]
)


def _padded(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column; shorter ones go on with what an entry of zero becomes."""
    values = np.asarray(column.flatten(), dtype=np.int64)
    if len(values) == len(column) * dims:
        return values.reshape(len(column), dims)
    out = np.full((len(column), dims), SHIFT, dtype=np.int64)
    for i, own in enumerate(column.to_pylist()):
        out[i, : len(own)] = own
    return out


def _centred(x: bytes, dims: int, mean: np.ndarray, block_rows: int) -> np.ndarray:
    """Rows less their mean, then rows of zeros."""
    rows = np.frombuffer(x, np.int64).reshape(-1, dims)
    out = np.zeros((block_rows, dims))
    out[: len(rows)] = rows - mean
    return out


def _block_matrix(index: DataFrame, blocks: int, mean: Broadcast, block_rows: int, columns: int) -> BlockMatrix:
    """The centred rows as a distributed matrix with blocks of so many columns."""
    dims = len(mean.value)

    def pieces(row):
        a = _centred(row.x, dims, mean.value, block_rows)
        for j in range(0, dims, columns):
            part = a[:, j : j + columns]
            yield (row.place, j // columns), DenseMatrix(*part.shape, part.ravel(order="F"))

    return BlockMatrix(index.select("place", "x").rdd.flatMap(pieces), block_rows, columns, blocks * block_rows, dims)


def _product(a: BlockMatrix, b: BlockMatrix, splits: int) -> BlockMatrix:
    """a b, with the inner dimension in so many parts."""
    found = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(found, a.rowsPerBlock, b.colsPerBlock)


def _whitening(scatter: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The first eigenvectors over the roots of their eigenvalues, as columns, and the shares explained."""
    covariance = (scatter + scatter.T) / (2 * n)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = np.trace(covariance)
    kept = min(components, int((values > RANK * max(values[0], 0)).sum())) if trace > 0 else 0
    return vectors[:, :kept] / np.sqrt(values[:kept]), values[:kept] / trace if kept else values[:0]


def _identity_error(white: DataFrame, n: int, components: int) -> float:
    """The largest entry of the whitened rows' covariance less the identity; centred before multiplying."""

    def sums(square: bool, mean: np.ndarray | None):
        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((components, components) if square else components)
            for batch in batches:
                for rows, data in zip(batch.column("rows").to_pylist(), batch.column("white").to_pylist()):
                    y = np.frombuffer(data, np.float64).reshape(-1, components)[:rows]
                    total += (y - mean).T @ (y - mean) if square else y.sum(axis=0)
            places = np.arange(total.size)
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(total.ravel())], ["place", "total"])

        found = white.select("rows", "white").mapInArrow(summed, "place int, total double")
        added = found.groupBy("place").agg(F.sum("total").alias("total")).orderBy("place").collect()
        return np.array([r.total for r in added]) / n

    covariance = sums(True, sums(False, None)).reshape(components, components)
    return float(np.abs(covariance - np.eye(components)).max())


def _told(mean_sums: np.ndarray, n: int, explained: np.ndarray, error: float):
    dims, components = len(mean_sums), len(explained)
    most = (1 << 63) - 1

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                x = np.frombuffer(row["x"], np.int64).reshape(-1, dims)
                y = np.frombuffer(row["white"], np.float64).reshape(-1, components)[: len(x)]
                known = np.frombuffer(row["known"], bool)
                ids = pa.array(np.frombuffer(row["ids"], np.int64), pa.int64(), mask=~known)
                exact = deviations(x, mean_sums, n)
                fitting = [d if d <= most else None for d in exact]
                rows = np.repeat(np.arange(len(x)), components)
                own = (
                    ids.take(pa.array(rows)),
                    pa.array(np.tile(np.arange(1, components + 1), len(x)), pa.int32()),
                    pa.array(np.full(len(rows), n), pa.int64()),
                    pa.array(fitting, pa.int64()).take(pa.array(rows)),
                    pa.array(y.ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(rows), error)),
                    pa.array([str(d) for d in exact], pa.string()).take(pa.array(rows)),
                )
                yield pa.RecordBatch.from_arrays(list(own), schema=_WHITE)

    return told


def deviations(x: np.ndarray, sums: np.ndarray, n: int) -> list[int]:
    """Exact sums over the columns of (n x - sums)^2, for every row."""
    bound = n * int(np.abs(x).max(initial=0)) + int(np.abs(sums).max(initial=0))
    if bound < 1 << 62 and bound * bound * x.shape[1] < 1 << 63:
        return ((n * x - sums) ** 2).sum(axis=1).tolist()
    wide = n * x.astype(object) - np.array([int(s) for s in sums], dtype=object)
    if bound < 1 << 62:
        wide = wide.astype(np.int64)
        far = int(np.abs(wide).max(initial=0))
        wide = wide if far * far * x.shape[1] < 1 << 63 else wide.astype(object)
    return [int(d) for d in (wide * wide).sum(axis=1)]


def whiten(vectors: DataFrame, components: int = COMPONENTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every vector on the first whitened components: a row for each vector and component.

    Takes `vec_id` and `embedding`, whose entries c become x = floor(1024 c) + 100000. Columns `vec_id,
    component` (from 1, by falling eigenvalue), `n` vectors, `deviation` (the sum over entries of
    (n x - S)^2, S the sums over all vectors; null beyond 64 bits, where `deviation_exact` still holds its
    digits), `whitened`, `explained` (the component's share of the variance) and `identity_error` (how far the
    whitened rows' covariance is from the identity). A null vector and one with a null, infinite or undefined
    entry is left out and counts nowhere; a null id stays one. A shorter vector counts as ending in zeros.
    Rows that repeat an id or a whole vector all count. Of equal eigenvalues any eigenvectors may come, the
    same for all rows. A component without variance can't be whitened: fewer than `components` may come, and
    none for no vector, a single one, or equal ones. Other columns are not read, whatever their names. The
    driver sees the column sums, a number for each task, and the scatter, which is as wide as a vector.
    """
    spark = vectors.sparkSession
    rows = stored(shifted_vectors(vectors), "vectors")
    dims = rows.agg(F.max(F.size("x")).alias("dims")).first().dims or 0
    empty = spark.createDataFrame([], _WHITE_SCHEMA)
    if dims == 0:
        return empty
    index = stored(rows.mapInArrow(_indexed(dims, block_rows), _INDEXED_SCHEMA), "index")
    # A row for each task.
    counts = index.groupBy("task").agg(
        F.count(F.lit(1)).alias("blocks"), F.sum(F.octet_length("known")).alias("rows")
    )
    told = counts.orderBy("task").collect()
    n = sum(r.rows for r in told)
    before = np.cumsum([0, *(r.blocks for r in told)]).tolist()
    bases = spark.createDataFrame([(r.task, b) for r, b in zip(told, before)], "task int, before int")
    placed = index.join(F.broadcast(bases), "task").withColumn("place", F.col("before") + F.col("block"))
    by_column = index.select(F.posexplode("sums").alias("at", "sum")).groupBy("at").agg(F.sum("sum").alias("sum"))
    sums = np.array([r["sum"] for r in by_column.orderBy("at").collect()], dtype=np.int64)
    mean = spark.sparkContext.broadcast(sums / n)

    a = _block_matrix(placed, before[-1], mean, block_rows, dims)
    parts = max(1, index.rdd.getNumPartitions())
    scatter = _product(a.transpose(), a, parts).toLocalMatrix().toArray()
    matrix, explained = _whitening(scatter, n, components)
    kept = matrix.shape[1]
    if kept == 0:
        return empty

    narrow = min(PROJECTED_COLUMNS, dims)
    pieces = [
        ((i // narrow, 0), DenseMatrix(len(part), kept, part.ravel(order="F")))
        for i in range(0, dims, narrow)
        for part in [matrix[i : i + narrow]]
    ]
    projector = BlockMatrix(spark.sparkContext.parallelize(pieces, 1), narrow, kept, dims, kept)
    split_rows = _block_matrix(placed, before[-1], mean, block_rows, narrow)
    projected = _product(split_rows, projector, len(pieces)).blocks
    white = spark.createDataFrame(
        projected.map(lambda b: (int(b[0][0]), bytearray(np.ascontiguousarray(b[1].toArray()).tobytes()))),
        "place int, white binary",
    )
    own = placed.select("place", F.octet_length("known").alias("rows"), "ids", "known", "x")
    white = stored(own.join(white, "place"), "white")
    error = _identity_error(white, n, kept)
    return white.mapInArrow(_told(sums, n, explained, error), _WHITE_SCHEMA)
