"""Exact nearest neighbours by cosine distance through cells, for any number of queries.

The index: vectors go to the nearest of some centroids, their cell, and are sorted by cell and angle from the
centroid. Ranges of this order are rings (a cell, the least and the greatest angle), cut into blocks of bounded
size. For a query at angle a from a centroid, a vector at angle b is at least |a - b| away, so a ring from
`low` to `high` holds nothing nearer than max(low - a, a - high).

The search: queries are sorted by cell and angle too and cut into tiles, which are dealt into groups. A group is a
task. Blocks are dealt into shards of bounded size, which pass by one after the other; a query knows from the shards
before how far it need look, and gives its k neighbours once. So blocks move once for each group and queries once,
whatever their number. Rows of a shard are sorted into leaves: boxes along the principal axes of the rows, halved
where they are longest, so that a few far rows do not widen the box of many close ones. A query is no nearer to a row
than to its box. Each query first meets the leaf nearest to it, which bounds the distance of its k-th neighbour, then
those whose box lies within it. Inner products in single precision tell which rows may count; only these are worked
out in double.

Only centroids, and for `probes` rings, of bounded number, are broadcast. Nothing runs before the result is asked
for but the index.

With `probes` only so many rings are visited, those of the least bound: then neighbours may be missed.

Distances, ties and unusable vectors are as in `vectors`: a vector without a direction is at distance 1 from
everything, so such vectors are a cell of their own, and such queries visit all rings.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator, Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.fixed_values import NEIGHBOURS
from paylens.operators.vectors import _CANDIDATES, _CANDIDATES_DDL, _UNITS, _matrix, _unit_rows, ranked
from paylens.session import scratch_path

# Bytes of a block's vectors, and the most ranges that the sorted rows are cut into.
BLOCK_BYTES = 1 << 20
RANGES = 4096
# Vectors that centroids are learned from, the most centroids, their bytes, and rounds of learning.
SAMPLE = 8192
CENTROIDS = 1024
CENTROID_BYTES = 32 << 20
ROUNDS = 6
# Bytes of vectors, in single precision, and rows of a shard; queries of a tile; tasks for each core; of as many
# queries as the index has rows, those of a task.
SHARD_BYTES = 128 << 20
SHARD_ROWS = 1 << 19
TILE = 2048
TASKS = 3
GROUP_ROWS = 1 << 18
# Most rows of a leaf, leaves of a branch, axes that boxes go by, and halvings in a row before rows are split evenly.
LEAF_ROWS = 512
BRANCH = 16
AXES = 12
HALVINGS = 64
# Room for what rounding does to an angle.
_SLACK = 1e-6
# A neighbour as one number that sorts by query of the tile, distance in units and place of its id in the shard.
_UNIT_BITS, _RANK_BITS = 31, 21
_FAR = (1 << _UNIT_BITS) - 1
# Pairs that are worked out in double at once.
_PAIRS = 1 << 16
_PER_RING = 1 << 24
# Rows around a query's leaf, for each neighbour wanted, that first tell how far to look.
_AROUND = 4
_BLOCK = -1

_ASSIGNED_DDL = "tx_id string, embedding array<double>, cell int, angle double"
_BLOCKS_DDL = (
    "block_id long, ring long, cell int, low double, high double, ids array<string>, angles binary, kind string, x binary"
)
_BLOCKS = pa.schema(
    [
        ("block_id", pa.int64()),
        ("ring", pa.int64()),
        ("cell", pa.int32()),
        ("low", pa.float64()),
        ("high", pa.float64()),
        ("ids", pa.list_(pa.string())),
        ("angles", pa.binary()),
        ("kind", pa.string()),
        ("x", pa.binary()),
    ]
)
# Blocks and tiles of queries on their way to tasks; a tile has a number, a block has not.
_SENT_DDL = "number long, block_id long, ring long, cell int, ids array<string>, kind string, x binary"
_SENT = pa.schema(
    [
        ("number", pa.int64()),
        ("block_id", pa.int64()),
        ("ring", pa.int64()),
        ("cell", pa.int32()),
        ("ids", pa.list_(pa.string())),
        ("kind", pa.string()),
        ("x", pa.binary()),
    ]
)


@dataclass(frozen=True)
class CellIndex:
    """`blocks` of vectors, the `centroids` of their cells (the last without direction), and the rings: arrays
    `ring`, `cell`, `low`, `high` and `rows`, one place for each ring."""

    blocks: DataFrame
    centroids: np.ndarray
    rings: dict[str, np.ndarray]

    @property
    def dims(self) -> int:
        return self.centroids.shape[1]


def _usable(vectors: DataFrame, key: str) -> DataFrame:
    c = F.col("embedding").cast("array<double>")
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(F.coalesce(finite, F.lit(False))).select(F.col(key).cast("string").alias(key), c.alias("embedding"))


def _angles(units: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centroids.T, -1.0, 1.0))


def _learned(sample: np.ndarray, wanted: int) -> np.ndarray:
    """Centroids of unit vectors, by rounds of assigning and averaging; fewer where vectors repeat."""
    centroids = np.unique(sample, axis=0)
    centroids = centroids[np.random.default_rng(11).permutation(len(centroids))[:wanted]]
    for _ in range(ROUNDS):
        nearest = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        sums = _unit_rows(sums)
        moved = (sums * sums).sum(axis=1) > 0
        centroids = np.where(moved[:, None], sums, centroids)
    return centroids


def _small(x: np.ndarray) -> np.ndarray:
    """In single precision, where that holds the same numbers."""
    small = x.astype(np.float32)
    return np.ascontiguousarray(small if (small == x).all() else x)


def _assigned(centroids: Broadcast):
    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, dims = centroids.value[:-1], centroids.value.shape[1]
        for batch in batches:
            units = _unit_rows(_matrix(batch.column("embedding"), dims))
            empty = ~units.any(axis=1)
            angles = _angles(units, cells) if len(cells) else np.zeros((len(units), 1))
            cell = angles.argmin(axis=1)
            angle = np.where(empty, 0.0, angles[np.arange(len(units)), cell])
            cell = np.where(empty, len(cells), cell)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell, pa.int32()), pa.array(angle)], ["tx_id", "embedding", "cell", "angle"]
            )

    return assigned


def _blocked(dims: int, cells: int, block_rows: int):
    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by cell and angle, in blocks of one cell."""
        part = TaskContext.get().partitionId()
        counts: dict[int, int] = {}
        held: list[tuple] = []
        last, size = None, 0

        def cut() -> pa.RecordBatch:
            ids, angles, x = (np.concatenate(c) for c in zip(*held))
            small = _small(x)
            ring, number = part * cells + last, counts.get(last, 0)
            counts[last] = number + 1
            row = {
                "block_id": ring * _PER_RING + number,
                "ring": ring,
                "cell": last,
                "low": angles[0],
                "high": angles[-1],
                "ids": ids.tolist(),
                "angles": angles.tobytes(),
                "kind": small.dtype.str,
                "x": small.tobytes(),
            }
            return pa.RecordBatch.from_pylist([row], schema=_BLOCKS)

        for batch in batches:
            ids = np.array(batch.column("tx_id").to_pylist(), dtype=object)
            x = _matrix(batch.column("embedding"), dims)
            cell = batch.column("cell").to_numpy(zero_copy_only=False)
            angle = batch.column("angle").to_numpy(zero_copy_only=False)
            at = 0
            while at < len(ids):
                if last is not None and (cell[at] != last or size >= block_rows):
                    yield cut()
                    held, size = [], 0
                last = int(cell[at])
                end = min(int(np.searchsorted(cell, last, side="right")), at + block_rows - size)
                held.append((ids[at:end], angle[at:end], x[at:end]))
                size += end - at
                at = end
        if held:
            yield cut()

    return blocked


def build_cells(vectors: DataFrame, path: str | None = None, block_bytes: int = BLOCK_BYTES) -> CellIndex:
    """Indexes `tx_id, embedding`, into a new folder or `path`, from where `read_cells` takes it up again.

    Vectors that are null or hold a null, an infinite value or NaN are left out. An id may occur several times.
    Equal vectors are spread over ranges by their ids. Vectors of another length are an error.
    """
    spark = vectors.sparkSession
    rows = _usable(vectors, "tx_id")
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dims")).first()
    dims = seen.dims or 0
    block_rows = max(16, block_bytes // max(1, 8 * dims))
    wanted = min(CENTROIDS, max(1, CENTROID_BYTES // max(1, 8 * dims)), max(1, round(seen.n**0.5)))
    told = rows.orderBy(F.xxhash64("tx_id")).limit(SAMPLE).select("embedding").toArrow()
    sample = _unit_rows(_matrix(told["embedding"].combine_chunks(), dims)) if told.num_rows else np.empty((0, dims))
    sample = sample[sample.any(axis=1)]
    centroids = np.vstack([_learned(sample, wanted) if len(sample) else sample, np.zeros((1, dims))])
    shared = spark.sparkContext.broadcast(centroids)
    assigned = rows.mapInArrow(_assigned(shared), _ASSIGNED_DDL)
    parts = min(RANGES, max(1, -(-seen.n // block_rows)))
    ordered = assigned.repartitionByRange(parts, "cell", "angle", F.xxhash64("tx_id"))
    ordered = ordered.sortWithinPartitions("cell", "angle")
    path = path or scratch_path(spark, "cells")
    ordered.mapInArrow(_blocked(dims, len(centroids), block_rows), _BLOCKS_DDL).write.mode("overwrite").parquet(
        f"{path}/blocks"
    )
    rows = [(i, [float(c) for c in row]) for i, row in enumerate(centroids)]
    spark.createDataFrame(rows, "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(
        f"{path}/centroids"
    )
    return read_cells(spark, path)


def read_cells(spark: SparkSession, path: str) -> CellIndex:
    """An index that was built; the driver sees its centroids and a row for each ring."""
    blocks = spark.read.schema(_BLOCKS_DDL).parquet(f"{path}/blocks")
    centroids = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    rings = blocks.groupBy("ring", "cell").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum(F.length("angles") / 8).cast("long").alias("rows")
    )
    told = rings.orderBy("ring").collect()
    arrays = {c: np.array([r[c] for r in told]) for c in ("ring", "cell", "low", "high", "rows")}
    arrays["cell"] = arrays["cell"].astype(np.int64)
    return CellIndex(blocks, np.array([r.centroid for r in centroids], dtype=np.float64).reshape(len(centroids), -1), arrays)


def _bounds(units: np.ndarray, centroids: np.ndarray, rings: dict) -> tuple[np.ndarray, np.ndarray]:
    """Of each query and ring the angle from the centroid, and the least distance in units of rounding."""
    angles = _angles(units, centroids)[:, rings["cell"]]
    gap = np.maximum(rings["low"][None, :] - angles, angles - rings["high"][None, :]) - _SLACK
    least = (1.0 - np.cos(np.clip(gap, 0.0, np.pi))) * _UNITS
    least[:, rings["cell"] == len(centroids) - 1] = _UNITS
    least[~units.any(axis=1)] = _UNITS
    return angles, least - 2


def _tiled(dims: int, directed: int):
    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries sorted by cell and angle, in tiles; those without a direction in tiles of their own."""
        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size, last = 0, False

        def cut() -> pa.RecordBatch:
            nonlocal number
            ids = pa.concat_arrays([i for i, _ in held])
            x = _small(np.concatenate([x for _, x in held]))
            row = {"number": part * _PER_RING + number, "ids": ids, "kind": x.dtype.str, "x": x.tobytes()}
            number += 1
            return pa.RecordBatch.from_pylist([{**row, "ids": ids.to_pylist()}], schema=_SENT)

        for batch in batches:
            ids, x = batch.column("tx_id"), _matrix(batch.column("embedding"), dims)
            empty = batch.column("cell").to_numpy(zero_copy_only=False) >= directed
            at = 0
            while at < len(ids):
                if size and (size >= TILE or bool(empty[at]) != last):
                    yield cut()
                    held, size = [], 0
                last = bool(empty[at])
                other = np.flatnonzero(empty[at:] != last)
                end = min(at + (int(other[0]) if len(other) else len(ids) - at), at + TILE - size)
                held.append((ids.slice(at, end - at), x[at:end]))
                size += end - at
                at = end
        if size:
            yield cut()

    return tiled


def _leaves(points: np.ndarray, most: int) -> list[np.ndarray]:
    """Positions of the rows of each leaf, `most` at most, near ones beside each other."""
    out, waiting = [], [(np.arange(len(points)), 0)]
    while waiting:
        own, depth = waiting.pop()
        if len(own) <= most:
            out.append(own)
            continue
        rows = points[own]
        low, high = rows.min(axis=0), rows.max(axis=0)
        axis = int((high - low).argmax())
        at = rows[:, axis]
        below = at <= (low[axis] + high[axis]) / 2
        if depth >= HALVINGS or below.all():
            below = np.zeros(len(own), dtype=bool)
            below[np.argsort(at, kind="stable")[: len(own) // 2]] = True
        waiting += [(own[~below], depth + 1), (own[below], depth + 1)]
    return out


def _gaps(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The squared distance of each point from each box."""
    out = np.zeros((len(points), len(low)), dtype=np.float32)
    for axis in range(points.shape[1]):
        at = points[:, axis, None]
        gap = np.maximum(low[:, axis] - at, at - high[:, axis])
        np.maximum(gap, 0, out=gap)
        gap *= gap
        out += gap
    return out


# Twice the distance from a row without a direction; no row is further than `_ANY`.
_EMPTY = np.float32(2.0)
_ANY = np.float32(3e38)


class _Shard:
    """The rows that a task holds, in leaves and branches of leaves, and the search of a tile in them."""

    def __init__(self, blocks: list[dict], centroids: np.ndarray, wanted: int, compared: Accumulator | None, limited: bool):
        dims = centroids.shape[1]
        self.wanted, self.compared = wanted, compared
        self.ids = pa.concat_arrays([block["ids"] for block in blocks])
        rank = pc.rank(self.ids, sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64) - 1
        total = len(rank)
        if total > 1 << _RANK_BITS:
            raise ValueError(f"a shard holds {total} rows")
        self.row_of = np.empty(int(rank.max()) + 1, dtype=np.int64)
        self.row_of[rank] = np.arange(total)
        # So many rows hold `wanted` different ids at least.
        self.enough = wanted * int(np.bincount(rank).max())
        self.repeated = len(self.row_of) < total
        # What single precision may make of the inner product of two unit vectors, and of a distance from a box.
        self.room = (dims + 16) * 2.0**-22
        self.slack = 4 * self.room

        sizes = [len(block["ids"]) for block in blocks]
        x = np.concatenate([np.frombuffer(block.pop("x"), block["kind"]).reshape(-1, dims) for block in blocks])
        # Any middle and axes give true bounds; axes of the most spread give high ones.
        some = _unit_rows(x[:: -(-total // _PAIRS)].astype(np.float64))
        self.middle = some.mean(axis=0).astype(np.float32)
        spread = some - self.middle
        self.axes = np.ascontiguousarray(np.linalg.eigh(spread.T @ spread)[1][:, ::-1][:, :AXES], np.float32)
        turned = np.empty((total, self.axes.shape[1]), dtype=np.float32)
        for at in range(0, total, _PAIRS):
            turned[at : at + _PAIRS] = self._turned(_unit_rows(x[at : at + _PAIRS].astype(np.float64)).astype(np.float32))

        # Rows without a direction are leaves of their own, and so is each ring where rings are chosen.
        empty = np.repeat([block["cell"] == len(centroids) - 1 for block in blocks], sizes)
        ring = np.repeat([block["ring"] for block in blocks], sizes) if limited else np.where(empty, 1, 0)
        order, low, high, self.starts, self.first, self.rings, self.empty = [], [], [], [0], [0], [], []
        most = min(LEAF_ROWS, 1 + int(total**0.5))
        for own in np.unique(ring):
            rows = np.flatnonzero(ring == own)
            leaves = _leaves(turned[rows], most)
            for at in range(0, len(leaves), BRANCH):
                part = leaves[at : at + BRANCH]
                self.first.append(self.first[-1] + len(part))
                self.rings.append(own)
                self.empty.append(bool(empty[rows[0]]))
            for leaf in leaves:
                leaf = rows[leaf]
                order.append(leaf)
                low.append(turned[leaf].min(axis=0))
                high.append(turned[leaf].max(axis=0))
                self.starts.append(self.starts[-1] + len(leaf))
        self.low, self.high, self.empty = np.array(low), np.array(high), np.array(self.empty)
        self.branch_low = np.minimum.reduceat(self.low, self.first[:-1], axis=0)
        self.branch_high = np.maximum.reduceat(self.high, self.first[:-1], axis=0)
        order = np.concatenate(order)
        self.rank, self.x = rank[order], x[order]
        del x, turned
        self.norms, self.near = np.empty(total), np.empty((total, dims), dtype=np.float32)
        for at in range(0, total, _PAIRS):
            part = self.x[at : at + _PAIRS].astype(np.float64)
            self.norms[at : at + _PAIRS] = np.sqrt(np.einsum("ij,ij->i", part, part))
            self.near[at : at + _PAIRS] = _unit_rows(part)

    def _turned(self, near: np.ndarray) -> np.ndarray:
        return (near - self.middle) @ self.axes

    def _units(self, rows: np.ndarray) -> np.ndarray:
        x, norms = self.x[rows].astype(np.float64), self.norms[rows][:, None]
        return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)

    def _kept(self, keys: np.ndarray) -> np.ndarray:
        """The least keys of each query, of a repeated id the nearest."""
        if self.repeated:
            rank = keys & ((1 << _RANK_BITS) - 1)
            query = keys >> (_UNIT_BITS + _RANK_BITS)
            order = np.lexsort((keys, rank, query))
            first = np.ones(len(keys), dtype=bool)
            first[1:] = (rank[order][1:] != rank[order][:-1]) | (query[order][1:] != query[order][:-1])
            keys = keys[order][first]
        keys = np.sort(keys)
        query = keys >> (_UNIT_BITS + _RANK_BITS)
        counts = np.bincount(query)
        place = np.arange(len(keys)) - (np.cumsum(counts) - counts)[query]
        return keys[place < self.wanted]

    def _limits(self, reach: np.ndarray) -> np.ndarray:
        """The squared distance up to which a row may lie from a query."""
        limits = (np.sqrt(2.0 * (reach + 2) / _UNITS) + self.slack) ** 2
        return np.where(reach >= _FAR, _ANY, limits).astype(np.float32)

    def _reached(self, branch: int, leaf: int, near: np.ndarray) -> np.ndarray:
        """How far, in units, a query need look, as far as the rows around a leaf of its branch tell."""
        start, end = self.starts[leaf], self.starts[leaf + 1]
        more = max(0, _AROUND * self.enough - (end - start))
        start = max(self.starts[self.first[branch]], start - more // 2)
        end = min(self.starts[self.first[branch + 1]], end + more // 2)
        if end - start < self.enough:
            return np.full(len(near), _FAR)
        if self.compared is not None:
            self.compared.add(len(near) * (end - start))
        dots = near @ self.near[start:end].T
        place = end - start - self.enough
        least = np.partition(dots, place, axis=1)[:, place].astype(np.float64)
        return np.ceil((1.0 - least + 2 * self.room) * _UNITS).astype(np.int64) + 4

    def _meet(self, leaf: int, live: np.ndarray, units: np.ndarray, near: np.ndarray, reach: np.ndarray) -> Iterator[np.ndarray]:
        """Keys of a leaf's rows within reach of the queries `live`."""
        start, end = self.starts[leaf], self.starts[leaf + 1]
        if self.compared is not None:
            self.compared.add(len(live) * (end - start))
        reach = reach[live]
        dots = near[live] @ self.near[start:end].T
        least = 1.0 - (reach + 2) / _UNITS - self.room
        least = least.astype(np.float32)
        some = np.flatnonzero(dots.max(axis=1) >= least)
        if not len(some):
            return
        live, reach, least, dots = live[some], reach[some], least[some], dots[some]
        hits = np.flatnonzero(dots >= least[:, None])
        for part in range(0, len(hits), _PAIRS):
            q, row = np.divmod(hits[part : part + _PAIRS], dots.shape[1])
            row += start
            distance = 1.0 - np.einsum("ij,ij->i", units[live[q]], self._units(row))
            found = np.rint(distance * _UNITS).astype(np.int64).clip(min=0)
            kept = found <= reach[q]
            q, row, found = live[q[kept]], row[kept], found[kept]
            yield (((q << _UNIT_BITS) | found) << _RANK_BITS) | self.rank[row]

    def search(self, queries: np.ndarray, allowed: np.ndarray | None = None, known: np.ndarray | None = None) -> np.ndarray:
        """Keys of the nearest rows of each query, in order; `allowed` tells which branches it may visit, `known` how
        far, in units, it need look."""
        units = _unit_rows(queries)
        near, empty = units.astype(np.float32), ~units.any(axis=1)
        turned = self._turned(near)
        bounds = _gaps(turned, self.branch_low, self.branch_high)
        bounds[:, self.empty] = _EMPTY
        bounds[empty] = _EMPTY
        if allowed is not None:
            bounds[~allowed] = np.inf
        reach = np.full(len(queries), _FAR, dtype=np.int64) if known is None else known.copy()
        furthest = np.where(empty, _ANY, self._limits(reach))
        best, pending, waiting = np.empty(0, dtype=np.int64), [], 0

        def settle() -> None:
            nonlocal best, pending, waiting, furthest
            best = self._kept(np.concatenate([best, *pending]))
            pending, waiting = [], 0
            counts = np.bincount(best >> (_UNIT_BITS + _RANK_BITS), minlength=len(queries))
            last = np.cumsum(counts) - 1
            full = counts >= self.wanted
            reach[full] = np.minimum(reach[full], (best[last[full]] >> _RANK_BITS) & _FAR)
            furthest = np.where(empty, _ANY, self._limits(reach))

        def meet(leaf: int, live: np.ndarray) -> None:
            nonlocal waiting
            for keys in self._meet(leaf, live, units, near, reach) if len(live) else ():
                pending.append(keys)
                waiting += len(keys)
                if waiting > max(_PAIRS, 4 * len(queries)):
                    settle()

        def leaf_gaps(branch: int, live: np.ndarray) -> np.ndarray:
            own = slice(self.first[branch], self.first[branch + 1])
            gaps = _gaps(turned[live], self.low[own], self.high[own])
            gaps[empty[live] | self.empty[branch]] = _EMPTY
            return gaps

        home = bounds.argmin(axis=1)
        for k in np.unique(home):
            live = np.flatnonzero((home == k) & (bounds[:, k] <= furthest))
            if len(live):
                nearest = self.first[k] + leaf_gaps(k, live).argmin(axis=1)
                for leaf in np.unique(nearest):
                    own = live[nearest == leaf]
                    reach[own] = np.minimum(reach[own], self._reached(k, int(leaf), near[own]))
        furthest = np.where(empty, _ANY, self._limits(reach))
        # A query's own branch comes first.
        for k, first in [(k, True) for k in np.unique(home)] + [(k, False) for k in np.argsort(bounds.min(axis=0), kind="stable")]:
            live = np.flatnonzero((bounds[:, k] <= furthest) & ((home == k) == first))
            if not len(live):
                continue
            gaps = leaf_gaps(k, live)
            for place in range(gaps.shape[1]):
                leaf = self.first[k] + place
                meet(leaf, live[gaps[:, place] <= furthest[live]])
                if waiting > 4 * len(queries):
                    settle()
        settle()
        return best


class _Tile:
    """Queries on their way through the shards, and the rows nearest to them so far: `query` (its place), `units` and
    `ids`, by query, distance and id."""

    def __init__(self, ids: pa.Array, kind: str, x: bytes, dims: int):
        self.query_ids, self.x = ids, np.frombuffer(x, kind).reshape(len(ids), dims)
        self.query = self.units = np.empty(0, dtype=np.int64)
        self.ids = pa.array([], pa.string())

    def meet(self, shard: _Shard, allowed: np.ndarray | None) -> None:
        """Takes in what is nearer in a shard. Of an id that several shards hold the nearest row counts."""
        wanted, known = shard.wanted, np.full(len(self.query_ids), _FAR, dtype=np.int64)
        counts = np.bincount(self.query, minlength=len(known))
        full = counts >= wanted
        known[full] = self.units[(np.cumsum(counts) - 1)[full]]
        best = shard.search(self.x.astype(np.float64), allowed, known)
        before = len(self.query)
        self.query = np.concatenate([self.query, best >> (_UNIT_BITS + _RANK_BITS)])
        self.units = np.concatenate([self.units, (best >> _RANK_BITS) & _FAR])
        self.ids = pa.concat_arrays([self.ids, shard.ids.take(pa.array(shard.row_of[best & ((1 << _RANK_BITS) - 1)]))])
        if before and len(best):
            rank = pc.rank(self.ids, sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)
            order = np.lexsort((self.units, rank, self.query))
            again = np.zeros(len(order), dtype=bool)
            again[1:] = (rank[order][1:] == rank[order][:-1]) & (self.query[order][1:] == self.query[order][:-1])
            order = order[~again]
            order = order[np.lexsort((rank[order], self.units[order], self.query[order]))]
            query = self.query[order]
            order = order[np.arange(len(order)) - np.searchsorted(query, query) < wanted]
            self.query, self.units, self.ids = self.query[order], self.units[order], self.ids.take(pa.array(order))

    def found(self) -> pa.RecordBatch:
        columns = [self.query_ids.take(pa.array(self.query)), self.ids, pa.array(self.units / float(_UNITS))]
        return pa.RecordBatch.from_arrays(columns, schema=_CANDIDATES)


def _searched(centroids: Broadcast, rings: Broadcast | None, wanted: int, probes: int | None, compared: Accumulator | None):
    def allowed(shard: _Shard, queries: np.ndarray) -> np.ndarray | None:
        """Of each query and branch whether its ring is among those of the least bound."""
        if rings is None:
            return None
        own = rings.value
        angles, least = _bounds(_unit_rows(queries), centroids.value, own)
        chosen = np.zeros(least.shape, dtype=bool)
        np.put_along_axis(chosen, np.argpartition(least, probes - 1, axis=1)[:, :probes], True, axis=1)
        chosen[np.arange(len(least)), (least / _UNITS + 1e-3 * angles).argmin(axis=1)] = True
        place = np.searchsorted(own["ring"], shard.rings)
        return chosen[:, place]

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of one shard its blocks come first, and tiles pass by; of several the tiles come first, and shards pass by."""
        dims = centroids.value.shape[1]
        tiles: list[_Tile] = []
        held: list[dict] = []
        shard = None

        def built() -> _Shard:
            nonlocal held
            blocks, held = held, []
            return _Shard(blocks, centroids.value, wanted, compared, rings is not None)

        def pass_by(tile: _Tile, shard: _Shard) -> None:
            tile.meet(shard, allowed(shard, tile.x.astype(np.float64)))

        for batch in batches:
            for i in range(len(batch)):
                row = {name: batch.column(name)[i].as_py() for name in ("shard", "number", "ring", "cell", "kind", "x")}
                ids = batch.column("ids")[i].values
                if row["number"] == _BLOCK:
                    if held and held[0]["shard"] != row["shard"]:
                        shard = built()
                        for tile in tiles:
                            pass_by(tile, shard)
                        shard = None
                    held.append({**row, "ids": ids})
                    continue
                tile = _Tile(ids, row["kind"], row["x"], dims)
                if held:
                    shard = built()
                if shard is None:
                    tiles.append(tile)
                else:
                    pass_by(tile, shard)
                    yield tile.found()
        if tiles and held:
            shard = built()
            for tile in tiles:
                pass_by(tile, shard)
        for tile in tiles:
            yield tile.found()

    return searched


def nearest_in_cells(
    queries: DataFrame,
    index: CellIndex,
    k: int = NEIGHBOURS,
    exclude_self: bool = False,
    probes: int | None = None,
    compared: Accumulator | None = None,
) -> DataFrame:
    """`query_id, tx_id, rank, distance` of the k nearest indexed rows of each query, as `vectors.nearest` gives.

    `queries` holds `query_id, embedding`. Exact unless `probes` limits the rings that a query visits.
    `compared` counts the pairs whose distance was worked out.
    """
    context = queries.sparkSession.sparkContext
    rows = int(index.rings["rows"].sum())
    if not rows:
        return ranked(queries.sparkSession.createDataFrame([], _CANDIDATES_DDL), k)
    centroids = context.broadcast(index.centroids)
    limited = probes is not None and probes < len(index.rings["ring"])
    rings = context.broadcast(index.rings) if limited else None
    wanted = k + 1 if exclude_self else k
    shards = max(-(-4 * index.dims * rows // SHARD_BYTES), -(-rows // SHARD_ROWS))
    groups = max(TASKS * context.defaultParallelism, -(-rows // GROUP_ROWS))

    placed = _usable(queries, "query_id").withColumnRenamed("query_id", "tx_id").mapInArrow(_assigned(centroids), _ASSIGNED_DDL)
    # Queries of one place are spread by their ids.
    placed = placed.repartitionByRange(groups, "cell", "angle", F.xxhash64("tx_id")).sortWithinPartitions("cell", "angle")
    tiles = placed.mapInArrow(_tiled(index.dims, len(index.centroids) - 1), _SENT_DDL)
    blocks = index.blocks.withColumn("number", F.lit(_BLOCK).cast("long")).select(tiles.columns)
    # Tiles are dealt in turn, as some places take longer than others.
    group = F.pmod(F.floor(F.col("number") / _PER_RING) + F.pmod("number", F.lit(_PER_RING)), F.lit(groups))
    shard = F.pmod(F.xxhash64("block_id"), F.lit(shards))
    tile_shard = F.lit(-1 if shards > 1 else shards)
    sent = tiles.select(group.cast("int").alias("group"), tile_shard.cast("long").alias("shard"), *tiles.columns)
    dealt = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), shard.cast("long").alias("shard"), *tiles.columns)
    met = sent.unionByName(dealt).repartitionById(groups, "group").sortWithinPartitions("shard", "number")
    candidates = met.mapInArrow(_searched(centroids, rings, wanted, probes, compared), _CANDIDATES_DDL)
    if exclude_self:
        candidates = candidates.where(F.col("query_id") != F.col("tx_id"))
    return ranked(candidates, k)
