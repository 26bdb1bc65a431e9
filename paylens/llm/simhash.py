"""SimHash near-duplicates by a distributed vantage-point tree.

Fingerprints within `REACH` differing bits are linked; linked documents form components. The tree is
built on a bounded sample of distinct fingerprints and only decides where rows go: at a node with
vantage point v and radius m, a fingerprint lives inside if its distance to v is below m, and it is
also asked on the other side when the triangle inequality allows a partner there. Every pair within
reach therefore meets in the leaf where one of the two lives, and the result is exact whatever the
sample was.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from paylens.llm.common import components, quoted, stored

REACH = 2
SHINGLE = 3
SEED = 42
# Distinct fingerprints that should live in one leaf.
LEAF_ROWS = 8192
# Fingerprints drawn to build the tree, evenly over their hashes: what the driver sees at most.
SAMPLE = 100_000
# Below this many rows a local branch is compared directly.
DIRECT = 96
_CHUNK = 1 << 16


def simhash(data: bytes) -> int:
    """64-bit SimHash of the three-word shingles of a UTF-8 text; 0 when it has no word.

    A-Z count as lower case, words are cut at ASCII white space, repeated shingles count each time. A
    text of fewer words is one shingle. A bit is set when over half of the hashes have it.
    """
    words = data.lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    size = min(SHINGLE, len(words))
    spans = list(zip(starts.tolist(), (ends[size - 1 :] - 1).tolist()))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(spans), _CHUNK):
        joined = b"".join([xxhash.xxh64_digest(text[s:e], SEED) for s, e in spans[at : at + _CHUNK]])
        bits = np.unpackbits(np.frombuffer(joined, dtype=np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(spans)).tobytes(), "big", signed=True)


@F.arrow_udf(LongType())
def fingerprint(texts: pa.Array) -> pa.Array:
    """SimHash of each text; null counts as empty."""
    return pa.array([simhash(d.as_py() or b"") for d in texts.cast(pa.binary())], pa.int64())


def _bits(a, b):
    return np.bitwise_count(a ^ b).astype(np.int16)


def build_tree(sample: np.ndarray, leaves: int, weight: float, leaf_rows: int) -> tuple[list, int]:
    """Nodes of a tree over sampled fingerprints and the number of leaf ids.

    A node is `(vantage, radius, inside, outside)`; a leaf is `(first id, blocks)`. A leaf stands for
    its sampled rows times `weight`; where fingerprints lie too close together to be split by
    distance, what is over `leaf_rows` is cut into blocks, each with an id of its own.
    """
    nodes: list = []
    ids = 0
    rng = np.random.default_rng(7)

    def grow(rows: np.ndarray, leaves: int) -> int:
        nonlocal ids
        at = len(nodes)
        nodes.append(None)
        if leaves > 1 and len(rows) > 3:
            best = None
            for v in rng.choice(rows, min(8, len(rows)), replace=False):
                d = _bits(rows, v)
                m = int(np.median(d))
                near = int(((d < m + REACH) & (d >= m - REACH)).sum())
                if 0 < (d < m).sum() < len(d) and (best is None or near < best[0]):
                    best = (near, v, m, d)
            if best is not None and best[0] < len(rows):
                _, v, m, d = best
                nodes[at] = (v, m, grow(rows[d < m], (leaves + 1) // 2), grow(rows[d >= m], leaves // 2))
                return at
        blocks = max(1, int(np.ceil(len(rows) * weight / (2 * leaf_rows))))
        nodes[at] = (ids, blocks)
        ids += blocks
        return at

    grow(sample, leaves)
    return nodes, ids


def route(nodes: list, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaf ids, positions of the rows there, and whether the row lives there.

    A pair across leaves meets once, in the leaf of the higher id.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    home = np.full(len(rows), -1, dtype=np.int64)
    seen: list[tuple[int, int, np.ndarray]] = []

    def walk(at: int, idx: np.ndarray, lives: np.ndarray) -> None:
        if len(idx) == 0:
            return
        node = nodes[at]
        if len(node) == 2:
            first, blocks = node
            own = idx[lives]
            home[own] = first + (rows[own] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(
                np.int64
            ) % blocks
            seen.extend((first + b, first, idx) for b in range(blocks))
            return
        v, m, inside, outside = node
        d = _bits(rows[idx], v)
        to_in, to_out = d < m + REACH, d >= m - REACH
        walk(inside, idx[to_in], (lives & (d < m))[to_in])
        walk(outside, idx[to_out], (lives & (d >= m))[to_out])

    walk(0, np.arange(len(rows)), np.ones(len(rows), dtype=bool))
    for leaf, _, idx in seen:
        keep = idx[home[idx] <= leaf]
        out.append((np.full(len(keep), leaf), keep, home[keep] == leaf))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (home[:0], home[:0], home[:0] == 0)


class _Sets:
    """Disjoint sets over positions; a block of pairs is first reduced to pairs of different roots."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return self.parent
            self.parent = up

    def _find(self, x: int) -> int:
        while self.parent[x] != x:
            x = self.parent[x]
        return int(x)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.parent[a], self.parent[b]
        differ = a != b
        if not differ.any():
            return
        for x, y in np.unique(np.stack((a[differ], b[differ])), axis=1).T.tolist():
            x, y = self._find(x), self._find(y)
            if x != y:
                self.parent[max(x, y)] = min(x, y)


def leaf_links(rows: np.ndarray, lives: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the rows of a leaf just as all pairs within reach would.

    One row of each pair lives in the leaf. The rows are searched through a local tree of the same
    kind; found pairs go into disjoint sets at once, so at most one link per row comes out.
    """
    rng = np.random.default_rng(7)
    sets = _Sets(len(rows))

    def compare(homes: np.ndarray, asked: np.ndarray) -> None:
        step = max(1, (1 << 21) // max(1, len(homes)))
        for at in range(0, len(asked), step):
            part = asked[at : at + step]
            i, j = np.nonzero(np.bitwise_count(rows[part][:, None] ^ rows[homes][None, :]) <= REACH)
            sets.join(part[i], homes[j])
        sets.roots()

    def search(homes: np.ndarray, asked: np.ndarray) -> None:
        if len(homes) == 0 or len(asked) == 0:
            return
        if len(homes) > DIRECT:
            for v in rows[rng.choice(homes, 3)]:
                to_homes, to_asked = _bits(rows[homes], v), _bits(rows[asked], v)
                m = int(np.median(to_homes))
                inside = to_homes < m
                a, b = to_asked < m + REACH, to_asked >= m - REACH
                if inside.any() and a.sum() * inside.sum() + b.sum() * (~inside).sum() < 0.9 * len(
                    homes
                ) * len(asked):
                    search(homes[inside], asked[a])
                    search(homes[~inside], asked[b])
                    return
        compare(homes, asked)

    search(np.flatnonzero(lives), np.arange(len(rows)))
    roots = sets.roots()
    linked = np.flatnonzero(roots != np.arange(len(rows)))
    return rows[linked], rows[roots[linked]]


def near_links(prints: DataFrame, leaf_rows: int = LEAF_ROWS, sample: int = SAMPLE) -> DataFrame:
    """Links `a`, `b` between distinct fingerprints (column `fp`) that connect them as far as all pairs
    within `REACH` bits do."""
    drawn = prints.select("fp").orderBy(F.xxhash64("fp", F.lit(1))).limit(sample).toPandas()["fp"]
    total = prints.count()
    points = drawn.to_numpy(dtype=np.int64).view(np.uint64)
    weight = total / max(1, len(points))
    nodes, leaves = build_tree(points, -(-total // leaf_rows), weight, leaf_rows)
    spread = prints.sparkSession.sparkContext.broadcast(nodes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            for at in range(0, len(values), _CHUNK):
                part = values[at : at + _CHUNK]
                leaf, idx, lives = route(spread.value, part.view(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf), pa.array(part[idx]), pa.array(lives)], ["leaf", "fp", "lives"]
                )

    def link(group: pa.Table) -> pa.Table:
        rows = group.column("fp").to_numpy().view(np.uint64)
        a, b = leaf_links(rows, group.column("lives").to_numpy())
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    placed = prints.select("fp").mapInArrow(place, "leaf long, fp long, lives boolean")
    return placed.groupBy("leaf").applyInArrow(link, "a long, b long")


def component_names(prints: DataFrame, links: Callable[[DataFrame], DataFrame] = near_links) -> DataFrame:
    """Columns `fp`, `component` (its least linked fingerprint) and `component_id` (the least
    `doc_id` of the component; null when it has none), one row per distinct fingerprint."""
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct))
    linked = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("component")
    )
    linked = stored(linked, "linked")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    return stored(linked.join(least, "component").select("fp", "component", "component_id"), "named")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Fingerprint and component of each document: `doc_id`, `fp` (long) and `component_id`.

    Takes `doc_id` and `text`. Null and empty texts have fingerprint zero and are linked like others;
    equal rows share a component; `component_id` is the smallest id in it, nulls aside, and null if
    it has no other. No document gives no row.
    """
    prints = stored(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint("text").alias("fp")),
        "prints",
    )
    named = component_names(prints)
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def as_digits(fp: Column | str) -> Column:
    """Sixteen lower-case hexadecimal digits of a fingerprint."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without near-duplicates: of each component the one with the smallest id stays.

    All columns are kept, whatever their names. Null and empty texts are alike. Of several rows with this id, the
    one with the least hash of its text stays, and of equal rows one. A component without any id keeps one row
    likewise. No document gives no row.
    """
    rows = docs.select(
        F.struct(*quoted(docs)).alias("row"),
        F.monotonically_increasing_id().alias("number"),
        F.col("doc_id").cast("long").alias("doc_id"),
        fingerprint("text").alias("fp"),
        F.xxhash64("text").alias("hash"),
    )
    rows = stored(rows, "rows")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash", "number")
    # The first row of each fingerprint, then of each component, so that copies combine before they meet.
    of_print = rows.groupBy("fp").agg(F.min(first).alias("first"))
    of_component = of_print.join(component_names(rows), "fp").groupBy("component").agg(F.min("first").alias("first"))
    kept = stored(of_component.select("first.number"), "firsts")
    # Both sides grow with the rows, so they are sorted and merged at every size.
    return rows.join(kept.hint("merge"), "number", "left_semi").select("row.*")
