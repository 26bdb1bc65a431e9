"""Token ids of documents, and packing them with little padding."""

import base64
import functools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The id that ends every document, and ids in a sequence.
END = 0
LENGTH = 1024
# Words whose ids a worker remembers, and the longest one.
_REMEMBER, _LONG = 200_000, 64
# A space that other white space follows, or that ends the text: there words can't be encoded apart.
_LOOSE = re.compile(r" (?:\s|\Z)")


def tokenizer_path() -> str:
    """The installed byte-level vocabulary; beside it lies the same as ranks, under `.tiktoken`."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def _whole_texts(path: str):
    """Encoder of lists of texts, whatever is in them."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return lambda texts: [e.ids for e in found.encode_batch_fast(texts, add_special_tokens=False)]


@functools.cache
def _short_words(path: str):
    """Encoder of one short text, from the ranks of the same vocabulary: three times as fast."""
    import public_tokenizers
    import tiktoken

    with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    ).encode_ordinary


@functools.cache
def _remembered(path: str) -> dict[str, bytes]:
    return {}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each text, ended by `END`.

    The vocabulary cuts a text before a single space that no white space follows, so the words between
    such spaces are encoded once and remembered; other texts and very long words are encoded as they are.
    """
    known, encode, encode_all = _remembered(path), _short_words(path), _whole_texts(path)
    end = _packed([END])
    out: list[bytes] = []
    for text in texts:
        if _LOOSE.search(text):
            out.append(_packed(encode_all([text])[0]) + end)
            continue
        words = text.replace(" ", "\0 ").split("\0") if "\0" not in text else _spaced(text)
        parts = []
        for word in words:
            ids = known.get(word)
            if ids is None:
                if len(word) > _LONG:
                    ids = _packed(encode_all([word])[0])
                else:
                    ids = _packed(encode(word))
                    if len(known) >= _REMEMBER:
                        known.clear()
                    known[word] = ids
            parts.append(ids)
        parts.append(end)
        out.append(b"".join(parts))
    return out


def _spaced(text: str) -> list[str]:
    first, *others = text.split(" ")
    return [first, *[" " + w for w in others]]


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)


class Room:
    """Which bins have how much room left: a segment tree over room sizes.

    A leaf stands for one size and holds the bins with exactly that room; an inner node tells whether
    any below it does. The bin that fits best is the first non-empty leaf from the wanted size up.
    """

    def __init__(self, most: int):
        self.leaves = 1 << (most + 1).bit_length()
        self.filled = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]

    def _count(self, room: int, by: int) -> None:
        at = self.leaves + room
        while at:
            self.filled[at] += by
            at >>= 1

    def add(self, room: int, bin_id: int) -> None:
        self.bins[room].append(bin_id)
        self._count(room, 1)

    def take(self, wanted: int) -> tuple[int, int] | None:
        """Room and id of the bin with the least room of at least `wanted`, which is taken out."""
        at = self.leaves + wanted
        if not self.filled[at]:
            while at > 1 and (at & 1 or not self.filled[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.filled[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._count(room, -1)
        return room, self.bins[room].pop()


def best_fit_decreasing(lengths: list[int], most: int) -> list[list[int]]:
    """Positions of the pieces in each bin: longest first, each into the fullest bin that still fits."""
    room = Room(most)
    bins: list[list[int]] = []
    for at in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = room.take(lengths[at])
        if found is None:
            found = (most, len(bins))
            bins.append([])
        left, bin_id = found
        bins[bin_id].append(at)
        if left > lengths[at]:
            room.add(left - lengths[at], bin_id)
    return bins


# Ids that are packed together: what a task holds at once.
SHARD_TOKENS = 1 << 21

PACKED_SCHEMA = (
    "sequence_id long, input_ids binary, position_ids binary, segment_ends array<int>, "
    "doc_ids array<long>, doc_starts array<long>, n_tokens int"
)
_PACKED_ARROW = pa.schema(
    [
        ("sequence_id", pa.int64()),
        ("input_ids", pa.binary()),
        ("position_ids", pa.binary()),
        ("segment_ends", pa.list_(pa.int32())),
        ("doc_ids", pa.list_(pa.int64())),
        ("doc_starts", pa.list_(pa.int64())),
        ("n_tokens", pa.int32()),
    ]
)


def pack_documents(
    docs: DataFrame, length: int = LENGTH, path: str | None = None, shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """Packs documents whole where they fit, best fit in decreasing order, into rows of `length` ids.

    Takes `doc_id` and `text`. A document is its ids and the id `END`; a null text is empty; one longer
    than a row is cut into full rows and a rest, so nothing is lost. Each task packs what it reads in
    shards of bounded size, without moving text. A row has `input_ids` and `position_ids` (little-endian
    unsigned 32-bit matrix rows, padded with 0; positions count from the start of the
    document's piece), `segment_ends` (cumulative lengths of the segments, from 0), the document and its
    offset per segment, and `n_tokens` without padding. `sequence_id` is unique. Pieces of equal length go in the
    order they are read, repeated rows are packed each, other columns are not read. No document, no row.
    """
    path = path or tokenizer_path()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id = TaskContext.get().partitionId() << 33
        pieces: list[tuple[int | None, int, bytes]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal next_id
            rows = []
            for members in best_fit_decreasing([len(p[2]) // 4 for p in pieces], length):
                own = [pieces[i] for i in members]
                sizes = [len(p[2]) // 4 for p in own]
                ends = np.cumsum([0, *sizes])
                places = np.concatenate([np.arange(n) for n in sizes]).astype("<u4")
                rows.append(
                    (
                        next_id,
                        b"".join(p[2] for p in own).ljust(4 * length, b"\0"),
                        places.tobytes().ljust(4 * length, b"\0"),
                        ends.tolist(),
                        [p[0] for p in own],
                        [p[1] for p in own],
                        int(ends[-1]),
                    )
                )
                next_id += 1
                if len(rows) == 512:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)
            pieces.clear()

        held = 0
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc_id, ids in zip(part.column(0).to_pylist(), encode_texts(texts, path)):
                    for start in range(0, len(ids), 4 * length):
                        pieces.append((doc_id, start // 4, ids[start : start + 4 * length]))
                    held += len(ids) // 4
                    if held >= shard_tokens:
                        yield from flush()
                        held = 0
        yield from flush()

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * len(_PACKED_ARROW)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, _PACKED_ARROW)], schema=_PACKED_ARROW
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(packed, PACKED_SCHEMA)


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """Writes packed rows as Parquet: id matrix rows, segment lengths and positions side by side."""
    pack_documents(docs, **options).write.parquet(path)
