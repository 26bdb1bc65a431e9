"""Exact top-k inner products through a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance from it. Sorted by this key the table is cut
into annuli (a pivot and a range of distances) and these into blocks of bounded size. For a query q at
distance D from a pivot, a vector x at distance r has |q - x| >= |D - r|, so that
q.x <= (|q|^2 + |x|^2 - (D - r)^2) / 2. A query starts in its own block, where its k-th best score so far
is found; then only annuli are visited whose bound reaches it, and in each only the rows around D, outwards
until the bound falls below it. Pivots come from a bounded sample and only decide how much is compared.

Queries meet blocks by a join on the block's number: the annuli's bounds (at most `ANNULI` and one more for
each pivot) are all that is broadcast. Where vectors have no clusters, as random ones of many dimensions,
no bound excludes anything and every query is compared with every block.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paylens.llm.common import stored, usable_vectors, whole_number

K = 5
SCALE = 256
# Bytes of a block's vectors as doubles, and the most ranges that the keys are cut into.
BLOCK_BYTES = 4 << 20
ANNULI = 4096
# Vectors of which pivots are chosen, the most pivots, and their bytes.
SAMPLE = 1024
PIVOTS = 256
PIVOT_BYTES = 8 << 20
# Score matrices hold so many numbers at a time; a task tells what it found after so many candidates.
_CELLS = 1 << 22
_TELL = 1 << 21
# Doubles hold whole numbers exactly up to here.
_EXACT = float(1 << 53)

KEYED_SCHEMA = "vec_id long, x array<long>, pivot int, r double"
INDEX_SCHEMA = (
    "kind int, annulus long, block int, pivot int, lo double, hi double, norm double, kind_of_x string, "
    "ids binary, r binary, x binary, found binary"
)
_INDEX = pa.schema(
    [
        ("kind", pa.int32()),
        ("annulus", pa.int64()),
        ("block", pa.int32()),
        ("pivot", pa.int32()),
        ("lo", pa.float64()),
        ("hi", pa.float64()),
        ("norm", pa.float64()),
        ("kind_of_x", pa.string()),
        ("ids", pa.binary()),
        ("r", pa.binary()),
        ("x", pa.binary()),
        ("found", pa.binary()),
    ]
)
_BLOCK, _QUERIES = 0, 1
FOUND_SCHEMA = "chunk long, place int, query_id long, vec_id long, score long"
_FOUND = pa.schema(
    [
        ("chunk", pa.int64()),
        ("place", pa.int32()),
        ("query_id", pa.int64()),
        ("vec_id", pa.int64()),
        ("score", pa.int64()),
    ]
)
ROUTED_SCHEMA = "block_id long, chunk long, kind_of_x string, ids binary, x binary, found binary"
# More blocks than an annulus can have.
_PER_ANNULUS = 1 << 24


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """`vec_id` and `x`, the floor of `scale` times each component; rows without an id or unusable are left out."""
    return usable_vectors(vectors.where("vec_id IS NOT NULL"), lambda v: whole_number(v * float(scale)))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column; shorter ones end in zeros."""
    ends = np.cumsum(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False))
    values = np.asarray(column.flatten(), dtype=np.int64)
    if len(values) == len(column) * dims:
        return values.reshape(len(column), dims)
    out = np.zeros((len(column), dims), dtype=np.int64)
    for i, (a, b) in enumerate(zip(np.concatenate(([0], ends[:-1])), ends)):
        out[i, : b - a] = values[a:b]
    return out


def _small(x: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest type that holds them."""
    most = int(np.abs(x).max(initial=0))
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def _scores(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of all rows: whole numbers, as doubles where these are exact."""
    if exact:
        return a.astype(np.float64) @ b.astype(np.float64).T
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)


def _norms(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return np.einsum("ij,ij->i", x, x)


def _distances(x: np.ndarray, norms: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = norms[:, None] + _norms(pivots)[None, :] - 2 * (x.astype(np.float64) @ pivots.T)
    return np.sqrt(np.maximum(squares, 0))


def _best(place: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores of each place, ties by id, in order."""
    order = np.lexsort((ids, -score, place))
    sorted_place = place[order]
    first = np.searchsorted(sorted_place, sorted_place, side="left")
    return order[np.arange(len(order)) - first < k]


class _Top:
    """The k best so far for the queries of a chunk; `own` marks those that the chunk came with."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, exact: bool):
        self.ids, self.x, self.k, self.exact = ids, x, k, exact
        self.norms = _norms(x)
        self.place = np.empty(0, dtype=np.int64)
        self.score = np.empty(0, dtype=np.int64)
        self.found = np.empty(0, dtype=np.int64)
        self.own = np.empty(0, dtype=bool)
        self.least = np.full(len(ids), -np.inf)

    def add(self, place: np.ndarray, score: np.ndarray, found: np.ndarray, own: bool = False) -> None:
        place = np.concatenate([self.place, place])
        score = np.concatenate([self.score, score.astype(np.int64)])
        found = np.concatenate([self.found, found])
        own = np.concatenate([self.own, np.full(len(place) - len(self.own), own)])
        best = _best(place, score, found, self.k)
        self.place, self.score, self.found, self.own = place[best], score[best], found[best], own[best]
        counts = np.bincount(self.place, minlength=len(self.ids))
        last = np.cumsum(counts) - 1
        full = counts >= self.k
        self.least[full] = self._below(self.score[last[full]])

    def _below(self, scores: np.ndarray) -> np.ndarray:
        """Scores as doubles, rounded down where doubles are not exact."""
        return scores.astype(np.float64) if self.exact else np.nextafter(scores.astype(np.float64), -np.inf)

    def compare(self, ids: np.ndarray, x: np.ndarray, live: np.ndarray) -> None:
        """Meets rows of a block with the queries at the places `live`; a query's own id is left out."""
        step = max(1, _CELLS // max(1, len(ids)))
        for at in range(0, len(live), step):
            part = live[at : at + step]
            scores = _scores(self.x[part], x, self.exact)
            other = self.ids[part][:, None] != ids[None, :]
            least = self.least[part]
            if len(ids) > 4 * self.k and np.isneginf(least).any():
                # A lower bound on what can count: the k-th best here.
                kth = np.partition(np.where(other, scores, -np.inf), len(ids) - self.k, axis=1)
                least = np.maximum(least, self._below(kth[:, len(ids) - self.k]))
            rows, cols = np.nonzero((scores >= least[:, None]) & other)
            self.add(part[rows], scores[rows, cols], ids[cols])

    def within(self, pivot: np.ndarray, norm: float) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance from a pivot that a vector may have to count, of each query."""
        d = _distances(self.x, self.norms, pivot[None, :])[:, 0]
        room = _room(self.norms, norm, self.least, d)
        width = np.sqrt(np.maximum(room, 0))
        return np.where(room < 0, np.inf, d - width), np.where(room < 0, -np.inf, d + width)

    def new(self, chunk: int) -> pa.RecordBatch:
        """What was found since the chunk came."""
        new = ~self.own
        place = self.place[new]
        columns = (np.full(len(place), chunk), place, self.ids[place], self.found[new], self.score[new])
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND)], schema=_FOUND)


def _room(norms: np.ndarray, norm: np.ndarray | float, least: np.ndarray, d: np.ndarray) -> np.ndarray:
    """How large (D - r)^2 may be for a score that counts, with what rounding may add."""
    total = norms + norm
    return total - 2 * least + 1e-9 * (total + d * d) + 1e-6


def _stored_rows(data: bytes, kind: str, rows: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(rows, -1)


def _keyed(pivots, dims: int):
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), dims)
            d = _distances(x, _norms(x), pivots.value)
            nearest = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    batch.column("x"),
                    pa.array(nearest, pa.int32()),
                    pa.array(d[np.arange(len(d)), nearest], pa.float64()),
                ],
                ["vec_id", "x", "pivot", "r"],
            )

    return keyed


def _indexed(dims: int, block_rows: int, modulus: int, k: int, exact: bool):
    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of rows that are sorted by pivot and distance, and the queries of each block with the best
        that they find in it."""
        part = TaskContext.get().partitionId()
        held: list[tuple] = []
        numbers: dict[int, int] = {}

        def cut(pivot: int) -> pa.RecordBatch:
            ids, r, x = (np.concatenate(c) for c in zip(*held))
            annulus, block = part * PIVOTS + pivot, numbers.setdefault(pivot, 0)
            numbers[pivot] += 1
            small = _small(x)
            shared = {"annulus": annulus, "block": block, "pivot": pivot, "kind_of_x": small.dtype.str}
            rows = [
                shared
                | {"kind": _BLOCK, "lo": r[0], "hi": r[-1], "norm": _norms(x).max(), "ids": ids.tobytes()}
                | {"r": r.tobytes(), "x": small.tobytes()}
            ]
            asked = np.flatnonzero(ids % modulus == 0)
            if len(asked):
                top = _Top(ids[asked], x[asked], k, exact)
                top.compare(ids, x, np.arange(len(asked)))
                triples = np.stack([top.place, top.score, top.found])
                rows.append(
                    shared
                    | {"kind": _QUERIES, "ids": top.ids.tobytes(), "x": np.ascontiguousarray(small[asked]).tobytes()}
                    | {"found": triples.tobytes()}
                )
            return pa.RecordBatch.from_pylist(rows, schema=_INDEX)

        last, size = None, 0
        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            pivot = batch.column("pivot").to_numpy(zero_copy_only=False)
            r = batch.column("r").to_numpy(zero_copy_only=False)
            x = _matrix(batch.column("x"), dims)
            at = 0
            while at < len(ids):
                if last is not None and (pivot[at] != last or size >= block_rows):
                    yield cut(last)
                    held, size = [], 0
                last = int(pivot[at])
                end = min(int(np.searchsorted(pivot, last, side="right")), at + block_rows - size)
                held.append((ids[at:end], r[at:end], x[at:end]))
                size += end - at
                at = end
        if held:
            yield cut(last)

    return indexed


def _chunk(row: dict, dims: int, k: int, exact: bool) -> _Top:
    """Queries as they were written, with what they found."""
    ids = np.frombuffer(row["ids"], np.int64)
    top = _Top(ids, _stored_rows(row["x"], row["kind_of_x"], len(ids)).reshape(len(ids), dims), k, exact)
    place, score, found = np.frombuffer(row["found"], np.int64).reshape(3, -1)
    top.add(place, score, found, own=True)
    return top


def _routed(pivots, annuli, dims: int, k: int, exact: bool):
    names = ("block_id", "chunk", "kind_of_x", "ids", "x", "found")

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries of a block, once for every other block of an annulus that may hold what counts."""
        for batch in batches:
            for row in batch.to_pylist():
                top = _chunk(row, dims, k, exact)
                own = row["annulus"] * _PER_ANNULUS + row["block"]
                d = _distances(top.x, top.norms, pivots.value)
                number, pivot, lo, hi, norm, blocks = annuli.value
                wanted = np.zeros(len(number), dtype=bool)
                step = max(1, _CELLS // max(1, len(number)))
                for at in range(0, len(d), step):
                    own_d = d[at : at + step][:, pivot]
                    gap = np.maximum(0, np.maximum(lo[None, :] - own_d, own_d - hi[None, :]))
                    room = _room(
                        top.norms[at : at + step, None], norm[None, :], top.least[at : at + step, None], own_d
                    )
                    wanted |= (gap * gap <= room).any(axis=0)
                to = [
                    int(number[i]) * _PER_ANNULUS + b for i in np.flatnonzero(wanted) for b in range(int(blocks[i]))
                ]
                to = [b for b in to if b != own]
                sent = (row["kind_of_x"], row["ids"], row["x"], row["found"])
                per = max(1, (4 << 20) // max(1, len(row["x"])))
                for at in range(0, len(to), per):
                    part = to[at : at + per]
                    columns = [part, [own] * len(part), *([v] * len(part) for v in sent)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, _ROUTED_TYPES)], list(names)
                    )

    return routed


_ROUTED_TYPES = (pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * 3)


def _searched(pivots, dims: int, k: int, exact: bool, compared: Accumulator | None):
    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What chunks of queries find in blocks; a chunk that meets several blocks in a task carries its best on."""
        chunks: dict[int, _Top] = {}
        held = 0
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                top = chunks.get(row["chunk"])
                if top is None:
                    top = chunks[row["chunk"]] = _chunk(row, dims, k, exact)
                    held += len(top.ids) * (k + dims)
                ids = np.frombuffer(row["block_ids"], np.int64)
                r = np.frombuffer(row["r"], np.float64)
                x = _stored_rows(row["block_x"], row["kind_of_block"], len(ids)).reshape(len(ids), dims)
                low, high = top.within(pivots.value[row["pivot"]], row["norm"])
                start, end = np.searchsorted(r, low, side="left"), np.searchsorted(r, high, side="right")
                live = np.flatnonzero(end > start)
                if len(live):
                    a, b = int(start[live].min()), int(end[live].max())
                    top.compare(ids[a:b], x[a:b], live)
                    if compared is not None:
                        compared.add(len(live) * (b - a))
                if held > _TELL:
                    yield from (t.new(chunk) for chunk, t in chunks.items())
                    chunks, held = {}, 0
        yield from (t.new(chunk) for chunk, t in chunks.items())

    return searched


def _told(dims: int, k: int, exact: bool):
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What queries found in their own block."""
        for batch in batches:
            for row in batch.to_pylist():
                top = _chunk(row, dims, k, exact)
                top.own[:] = False
                yield top.new(row["annulus"] * _PER_ANNULUS + row["block"])

    return told


def _pivots(rows: DataFrame, n: int, dims: int, block_rows: int) -> np.ndarray:
    """Different vectors of a sample by hash, more of them where there are more blocks."""
    sample = rows.orderBy(F.xxhash64("vec_id", "x")).limit(SAMPLE).select("x").toArrow()
    column = sample["x"].combine_chunks()
    different = np.unique(_matrix(column, dims), axis=0)
    wanted = min(PIVOTS, max(4, 2 * n // block_rows), max(1, PIVOT_BYTES // (8 * max(1, dims))))
    order = np.random.default_rng(7).permutation(len(different))
    return different[order[:wanted]].astype(np.float64)


def exact_top_k(
    vectors: DataFrame,
    modulus: int,
    k: int = K,
    scale: int = SCALE,
    block_bytes: int = BLOCK_BYTES,
    compared: Accumulator | None = None,
) -> DataFrame:
    """Each query's k highest inner products: `query_id, rank` (from 1), `vec_id, score`.

    Takes `vec_id` and `embedding`, whose components x become floor(`scale` * x). Queries are the rows whose
    id is divisible by `modulus`, candidates all rows with another id; ties go to the smaller id. Vectors
    that are null or hold a null or a number that is not finite take no part, nor do rows without an id. A
    shorter vector counts as ending in zeros, so an empty one scores 0. Rows that repeat an id are rows of
    their own: each is a candidate, and each is a query if its id is. Scores are exact; one beyond 64 bits is
    an error. Fewer than k candidates give all of them; no query or no candidate gives no row. Columns other
    than these two are not read, whatever their names. `compared` counts the pairs compared between blocks.
    """
    spark = vectors.sparkSession
    rows = stored(integer_vectors(vectors, scale), "vectors")
    most = F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x"))))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("dims"), most.alias("most")).first()
    n, dims = seen.n, max(1, seen.dims or 0)
    exact = dims * float(seen.most or 0) ** 2 < _EXACT
    block_rows = max(16, block_bytes // (8 * dims))
    if n:
        chosen = _pivots(rows, n, dims, block_rows)
    else:
        chosen = np.zeros((1, dims))
    pivots = spark.sparkContext.broadcast(chosen)
    keyed = rows.mapInArrow(_keyed(pivots, dims), KEYED_SCHEMA)
    parts = min(ANNULI, max(1, -(-n // block_rows)))
    # The hash spreads equal vectors over the ranges.
    sorted_rows = keyed.repartitionByRange(parts, "pivot", "r", F.xxhash64("vec_id")).sortWithinPartitions("pivot", "r")
    index = stored(sorted_rows.mapInArrow(_indexed(dims, block_rows, modulus, k, exact), INDEX_SCHEMA), "index")
    blocks, queries = index.where(F.col("kind") == _BLOCK), index.where(F.col("kind") == _QUERIES)

    # One row for each annulus: at most as many as ranges and pivots together.
    bounds = blocks.groupBy("annulus", "pivot").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("norm").alias("norm"), F.count(F.lit(1)).alias("blocks")
    )
    told = bounds.orderBy("annulus").collect()
    arrays = [np.array([r[c] for r in told]) for c in ("annulus", "pivot", "lo", "hi", "norm", "blocks")]
    arrays[1] = arrays[1].astype(np.int64)
    annuli = spark.sparkContext.broadcast(tuple(arrays))

    routed = queries.mapInArrow(_routed(pivots, annuli, dims, k, exact), ROUTED_SCHEMA)
    targets = blocks.select(
        (F.col("annulus") * _PER_ANNULUS + F.col("block")).alias("block_id"),
        "pivot",
        "norm",
        F.col("kind_of_x").alias("kind_of_block"),
        F.col("ids").alias("block_ids"),
        "r",
        F.col("x").alias("block_x"),
    )
    met = routed.join(targets, "block_id").mapInArrow(_searched(pivots, dims, k, exact, compared), FOUND_SCHEMA)
    found = queries.mapInArrow(_told(dims, k, exact), FOUND_SCHEMA).unionByName(met)
    best_first = Window.partitionBy("chunk", "place").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best_first))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


# The same rows in SQL, by all scores.
ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
  WHERE len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""
