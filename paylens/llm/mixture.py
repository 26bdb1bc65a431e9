"""Mixture-controlled packing: deficit round-robin over one queue per source.

The documents of a source, one after the other, are its queue of ids. All queues together follow one schedule: at
each moment every source with ids left sends in proportion to its target, and one that runs dry leaves its share to
the others; sources without a target come when the others are dry. The schedule is cut into shards of bounded size,
and so is every queue, at the places that the schedule has reached, in quanta. So no source, however large, meets in
one task, and a shard starts with the deficits that the shards before it left, which follow from the schedule.

A shard fills windows of `LENGTH` ids: before each window every source earns its share, the source that is owed most
sends next, at least `PIECE` ids at a time, and what it is owed or has overpaid is carried on to the next window. So
a window holds runs of a few sources, and the windows together hold the targets within a run or two.
"""

import gc
import heapq
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paylens.llm.common import stored
from paylens.llm.tokens import LENGTH, encode_texts, tokenizer_path

# Ids per shard, dealt in quanta; a piece is at least `PIECE` ids long where the queue has them.
SHARD_TOKENS = 1 << 20
QUANTUM = 1024
PIECE = 256
_PHASES = 1 << 16

TOKENS_SCHEMA = "doc_id long, source string, ids binary, n long, task int, at long"
PIECES_SCHEMA = (
    "doc_id long, source string, start long, length long, doc_tokens long, sequence_id long, "
    "offset long, ids binary"
)
_PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("source", pa.string()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("ids", pa.binary()),
    ]
)
_CUT_SCHEMA = (
    "shard long, source string, place long, doc_id long, start long, doc_tokens long, total long, size long, ids binary"
)
_CUT = pa.schema(
    [
        ("shard", pa.int64()),
        ("source", pa.string()),
        ("place", pa.int64()),
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("total", pa.int64()),
        ("size", pa.int64()),
        ("ids", pa.binary()),
    ]
)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _narrow(ids: bytes) -> bytes:
    """Four-byte ids in two bytes each, if all fit."""
    numbers = np.frombuffer(ids, "<u4")
    return numbers.astype("<u2").tobytes() if numbers.max(initial=0) < 1 << 16 else ids


def _wide(ids: bytes, n: int) -> bytes:
    """So many ids in four bytes each."""
    return ids if len(ids) == 4 * n else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def document_tokens(docs: DataFrame, path: str) -> DataFrame:
    """Ids of each document with the end id, in two bytes each where they fit, their number, its source, its task
    and its place in the task's queue of that source."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.collect()  # what an earlier task of this worker remembered
        task = TaskContext.get().partitionId()
        queued: dict[str | None, int] = {}
        for batch in batches:
            for at in range(0, len(batch), 64):
                doc_ids, sources, texts = (c.to_pylist() for c in batch.slice(at, 64).columns)
                ids = encode_texts([t or "" for t in texts], path)
                places = []
                for source, own in zip(sources, ids):
                    places.append(queued.get(source, 0))
                    queued[source] = places[-1] + len(own) // 4
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()),
                        pa.array(sources, pa.string()),
                        pa.array(list(map(_narrow, ids)), pa.binary()),
                        pa.array([len(i) // 4 for i in ids], pa.int64()),
                        pa.array([task] * len(ids), pa.int32()),
                        pa.array(places, pa.int64()),
                    ],
                    ["doc_id", "source", "ids", "n", "task", "at"],
                )
            pa.default_memory_pool().release_unused()

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.col("text").cast("string").alias("text"),
    )
    return rows.mapInArrow(encoded, TOKENS_SCHEMA)


class Schedule:
    """How far all queues have come when so many ids are sent: `at` gives a moment, `ids_at` turns it back.

    A source of weight w (all weights together are 1) has sent w v ids at moment v, until it is dry; those without
    a weight, `rest` ids together, start when all others are dry and end together.
    """

    def __init__(self, weighted: list[tuple[int, float]], rest: int):
        ends = sorted((total / w, w) for total, w in weighted if total)
        rates = np.cumsum([w for _, w in reversed(ends)])[::-1] if ends else []
        moments, ids = [0.0], [0.0]
        for (end, _), rate in zip(ends, rates):
            ids.append(ids[-1] + rate * (end - moments[-1]))
            moments.append(end)
        self.dry, self.rest = moments[-1], rest
        if rest:
            moments.append(self.dry + rest)
            ids.append(ids[-1] + rest)
        self.moments, self.ids = np.array(moments), np.array(ids)

    def at(self, ids: float) -> float:
        return float(np.interp(ids, self.ids, self.moments))

    def ids_at(self, moment: float) -> float:
        return float(np.interp(moment, self.moments, self.ids))


class Deal:
    """Which shard each place of a source's queue goes to, by the schedule, a quantum at a time. Sources begin at
    different phases, so that the only quanta of many small ones are spread."""

    def __init__(self, source: str | None, total: int, weight: float, schedule: Schedule, size: int, shards: int):
        self.total, self.weight, self.schedule, self.size, self.shards = total, weight, schedule, size, shards
        self.quanta = -(-total // QUANTUM)
        self.phase = zlib.crc32(repr(source).encode()) % _PHASES / _PHASES

    def sent(self, shard: int) -> float:
        """How many ids the schedule has sent before this shard."""
        moment = self.schedule.at(shard * self.size)
        if self.weight:
            return min(self.total, self.weight * moment)
        return self.total * min(1.0, max(0.0, moment - self.schedule.dry) / max(1, self.schedule.rest))

    def first(self, shard: int) -> int:
        """The first place that goes to this shard or a later one."""
        if shard <= 0 or shard >= self.shards:
            return 0 if shard <= 0 else self.total
        begun = math.ceil(self.sent(shard) / self.total * self.quanta - self.phase)
        return min(self.total, max(0, begun) * QUANTUM)

    def shard(self, place: int) -> int:
        share = (place // QUANTUM + self.phase) / self.quanta
        moment = share * self.total / self.weight if self.weight else self.schedule.dry + share * self.schedule.rest
        found = min(self.shards - 1, max(0, int(self.schedule.ids_at(moment) // self.size)))
        while found > 0 and self.first(found) > place:
            found -= 1
        while self.first(found + 1) <= place:
            found += 1
        return found

    def owed(self, shard: int) -> float:
        """What the source is owed before this shard: sent by the schedule, but not dealt yet."""
        return self.sent(shard) - self.first(shard)


@dataclass(frozen=True)
class Plan:
    """The targets as weights that add up to 1, and what follows from them."""

    weights: dict[str | None, float]
    schedule: Schedule
    size: int
    shards: int

    def deal(self, source: str | None, total: int) -> Deal:
        return Deal(source, total, self.weights.get(source, 0.0), self.schedule, self.size, self.shards)


def _cut(plan: Plan):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents by shard, with their place in the source's whole queue; few lie in two and are cut."""
        deals: dict[str | None, Deal] = {}
        until: dict[str | None, tuple[int, int, int]] = {}
        for batch in batches:
            rows, size = [], 0
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "source", "ids", "n", "place", "total"))):
                doc_id, source, ids, n, place, total = row
                deal = deals.get(source)
                if deal is None:
                    deal = deals[source] = plan.deal(source, total)
                start, width = 0, len(ids) // n
                while start < n:
                    shard, low, high = until.get(source, (0, 0, 0))
                    if not low <= place + start < high:
                        shard = deal.shard(place + start)
                        low, high = deal.first(shard), deal.first(shard + 1)
                        until[source] = shard, low, high
                    end = min(n, high - place)
                    own = ids[width * start : width * end]
                    rows.append((shard, source, place + start, doc_id, start, n, total, end - start, own))
                    start = end
                size += len(ids)
                if size >= 1 << 23:
                    yield _rows(rows, _CUT)
                    rows, size = [], 0
            yield _rows(rows, _CUT)

    return cut


def windows(left: dict, shares: dict, owed: dict, length: int = LENGTH) -> Iterator[list[tuple]]:
    """Deficit round-robin over queues of the given lengths: per window, what each source sends in turn.

    Sources that run dry leave their share to the others; those without a share come when no other is left, in
    proportion to their lengths.
    """
    left, owed, whole = dict(left), dict(owed), dict(left)
    live = {s for s, n in left.items() if n}
    while live:
        sending = {s for s in live if shares[s]} or live
        weight = shares if shares[next(iter(sending))] else whole
        room, sent = length, []
        total = sum(weight[s] for s in sending)
        for s in sending:
            owed[s] += length * weight[s] / total
        queue = [(-owed[s], repr(s), s) for s in sending]
        heapq.heapify(queue)
        while room and queue:
            _, name, s = heapq.heappop(queue)
            n = min(room, left[s], max(PIECE, int(owed[s])))
            sent.append((s, n))
            left[s] -= n
            owed[s] -= n
            room -= n
            if left[s]:
                heapq.heappush(queue, (-owed[s], name, s))
            else:
                live.discard(s)
                if not queue and room:
                    # The window goes on with those that are left.
                    others = {o for o in live if shares[o]} or live
                    queue = [(-owed[o], repr(o), o) for o in others]
                    heapq.heapify(queue)
        merged: dict = {}
        for s, n in sent:
            merged[s] = merged.get(s, 0) + n
        yield list(merged.items())


def _pack(plan: Plan, length: int):
    def pack(group: pa.Table) -> pa.Table:
        """The pieces of one shard in their windows."""
        queues: dict[str | None, list[dict]] = {}
        for row in group.to_pylist():
            queues.setdefault(row["source"], []).append(row)
        deals = {}
        for source, rows in queues.items():
            rows.sort(key=lambda r: r["place"], reverse=True)
            deals[source] = plan.deal(source, rows[0]["total"])
        shard = group.column("shard")[0].as_py()
        left = {s: sum(r["size"] for r in rows) for s, rows in queues.items()}
        shares = {s: d.weight for s, d in deals.items()}
        owed = {s: d.owed(shard) for s, d in deals.items()}
        batches, out = [], []
        for k, sent in enumerate(windows(left, shares, owed, length)):
            offset = 0
            for source, n in sent:
                while n:
                    row = queues[source][-1]
                    if "whole" not in row:
                        row["whole"], row["at"] = _wide(row["ids"], row["size"]), 0
                    take = min(n, row["size"] - row["at"])
                    ids = row["whole"][4 * row["at"] : 4 * (row["at"] + take)]
                    start = row["start"] + row["at"]
                    out.append((row["doc_id"], source, start, take, row["doc_tokens"], (shard << 32) + k, offset, ids))
                    row["at"] += take
                    if row["at"] == row["size"]:
                        queues[source].pop()
                    n -= take
                    offset += take
            if len(out) >= 1 << 14:
                batches.append(_rows(out, _PIECES))
                out = []
        return pa.Table.from_batches([*batches, _rows(out, _PIECES)], schema=_PIECES)

    return pack


def pack_mixture(
    docs: DataFrame,
    targets: dict[str | None, float] | None = None,
    length: int = LENGTH,
    path: str | None = None,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Packs all documents into sequences of `length` ids, in which sources have their target shares.

    Takes `doc_id`, `source` and `text`. `targets` are weights by source; by default each source gets its share of
    all ids. The shares hold over the sequences in order of `sequence_id`, across shards, as long as all sources
    last; one that runs dry leaves its share to the others, and sources without a target come last, each by its
    share of these. A null source is a source of its own, a null text is empty (its end id alone), repeated rows
    are packed each, a long text goes over as many sequences as it needs. Ties between sources that are owed the
    same go by name. Returns a row per piece: `doc_id`, `source`, `start` (ids of the document before it),
    `length`, `doc_tokens`, `sequence_id`, `offset` in the sequence, and `ids`. Only the last sequence of a shard
    may be short. The driver sees the number of ids, and that of each source with a target; no document gives no
    row. Other columns are not read, whatever their names.
    """
    tokens = stored(document_tokens(docs, path or tokenizer_path()), "tokens")
    sums = tokens.groupBy("source", "task").agg(F.sum("n").alias("sum"))
    of_source = Window.partitionBy("source")
    before = of_source.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(
        sums.select(
            F.col("source").alias("_source"),
            F.col("task").alias("_task"),
            F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"),
            F.sum("sum").over(of_source).alias("total"),
        ),
        "queues",
    )
    plan = _planned(tokens, targets, shard_tokens)
    placed = tokens.join(
        bases, (F.col("task") == F.col("_task")) & F.col("source").eqNullSafe(F.col("_source"))
    ).select("doc_id", "source", "ids", "n", (F.col("base") + F.col("at")).alias("place"), "total")
    pieces = placed.mapInArrow(_cut(plan), _CUT_SCHEMA)
    return pieces.groupBy("shard").applyInArrow(_pack(plan, length), PIECES_SCHEMA)


def _planned(tokens: DataFrame, targets: dict[str | None, float] | None, shard_tokens: int) -> Plan:
    """The schedule; of single sources only those with a target are looked at."""
    wanted = {s: w for s, w in (targets or {}).items() if w > 0}
    named = F.col("source").isin([s for s in wanted if s is not None])
    named = named | F.col("source").isNull() if None in wanted else F.coalesce(named, F.lit(False))
    of_targets = tokens.where(named).groupBy("source").agg(F.sum("n").alias("n")).collect() if wanted else []
    total = tokens.agg(F.sum("n")).first()[0] or 0
    whole = sum(wanted[r.source] for r in of_targets)
    weights = {r.source: wanted[r.source] / whole for r in of_targets}
    known = sum(r.n for r in of_targets)
    schedule = Schedule([(r.n, weights[r.source]) for r in of_targets], total - known)
    return Plan(weights, schedule, shard_tokens, max(1, -(-total // shard_tokens)))


def packed_pieces(pieces: DataFrame, with_ids: bool = False) -> DataFrame:
    """Pieces with a checksum in place of their ids, or beside them."""
    columns = ["doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source"]
    return pieces.select(*columns, *(["ids"] if with_ids else []))
