"""Context-triggered piecewise hashing of documents.

A hash of the last seven bytes runs over the UTF-8 text. Where its mixed value ends in at least
`level` zero bits, a piece ends, so the pieces of a higher level are unions of those of a lower one.
Each piece gives one of 64 letters. The fingerprint is `level:letters:letters of level + 1` for the
lowest level with at most 64 pieces; the whole text is hashed whatever its length.
"""

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructType

ALPHABET = np.frombuffer(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8
)
PIECES = 64
WINDOW = 7
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WEIGHTS = [pow(int(_MIX) | 1, j + 1, 1 << 64) for j in range(WINDOW)]


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31)) ^ _MIX) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def _letters(hashes: np.ndarray, zeros: np.ndarray, level: int) -> str:
    starts = np.flatnonzero(zeros[:-1] >= level) + 1
    sums = np.add.reduceat(hashes, np.concatenate(([0], starts)))
    return ALPHABET[(_mixed(sums) >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint_of(data: bytes) -> str:
    """Fingerprint of one UTF-8 text; the empty text has `0::`."""
    if not data:
        return "0::"
    values = np.frombuffer(data, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    rolling = np.zeros(len(values), dtype=np.uint64)
    for back, weight in enumerate(_WEIGHTS[: len(values)]):
        rolling[back:] += values[: len(values) - back] * np.uint64(weight)
    hashes = _mixed(rolling)
    lowest = hashes & (~hashes + np.uint64(1))
    zeros = np.bitwise_count(lowest - np.uint64(1))
    ends = np.cumsum(np.bincount(zeros[:-1], minlength=66)[::-1])[::-1]
    level = int(np.argmax(ends < PIECES))
    return f"{level}:{_letters(hashes, zeros, level)}:{_letters(hashes, zeros, level + 1)}"


@F.arrow_udf(StringType())
def fingerprint(texts: pa.Array) -> pa.Array:
    """Fingerprint of each text; null counts as empty."""
    return pa.array(
        [fingerprint_of(data.as_py() or b"") for data in texts.cast(pa.binary())], pa.string()
    )


def _alike(a: Column, b: Column) -> Column:
    return 1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def likeness(one: Column, other: Column) -> Column:
    """Likeness of two fingerprints, from 0 to 1, by edit distance at a level that both have.

    Equal fingerprints give 1. Levels more than one apart have no common letters and give 0.
    """
    a, b = F.split(one, ":"), F.split(other, ":")
    rise = b[0].cast("int") - a[0].cast("int")
    return (
        F.when(one == other, 1.0)
        .when(rise == 0, _alike(a[1], b[1]))
        .when(rise == 1, _alike(a[2], b[1]))
        .when(rise == -1, _alike(a[1], b[2]))
        .otherwise(0.0)
    )


def _bucket(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most the value, by binary search; null gives -1."""
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    if not bounds:
        return F.when(value.isNull(), -1).otherwise(0)
    array = F.array(*map(F.lit, bounds))

    def step(found, width):
        to = found + width
        return F.when((to <= len(bounds)) & (F.try_element_at(array, to) <= value), to).otherwise(found)

    found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)
    return F.when(value.isNull(), -1).otherwise(found)


@F.arrow_udf(BinaryType())
def packed(texts: pa.Array) -> pa.Array:
    """Each text compressed, for moving it."""
    press = zstandard.ZstdCompressor(level=3)
    return pa.array([press.compress(d.as_py() or b"") for d in texts.cast(pa.binary())], pa.binary())


@F.arrow_udf(StructType().add("sha256", StringType()).add("fingerprint", StringType()))
def _edited(texts: pa.Array, others: pa.Array) -> pa.Array:
    """Hash and fingerprint of each text with its last third taken from the start of the other."""
    unpress = zstandard.ZstdDecompressor()
    out = []
    for own, other in zip(texts, others):
        text, other = (unpress.decompress(x.as_py()).decode() for x in (own, other))
        third = len(text) // 3
        data = (text[: len(text) - third] + other[:third]).encode()
        out.append((hashlib.sha256(data).hexdigest(), fingerprint_of(data)))
    sha256, prints = zip(*out) if out else ((), ())
    return pa.StructArray.from_arrays(
        [pa.array(sha256, pa.string()), pa.array(prints, pa.string())], ["sha256", "fingerprint"]
    )


def with_next(rows: DataFrame, columns: list[str], buckets: int | None = None) -> DataFrame:
    """Gives each row, as struct `next`, the named columns of the row after it in descending `doc_id`.

    The first row comes after the last. Rows of one id go by descending `hash`, null ids come last.
    Ids are cut into ranges of about equal size, and each range also gets the first row of the range
    below, so that rows move once and no range holds more than its share. The driver sees the bounds
    and one id and hash per range.
    """
    spark = rows.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = [k / buckets for k in range(1, buckets)]
    found = rows.select("doc_id").approxQuantile("doc_id", parts, 0.1 / buckets) if parts else []
    in_range = _bucket(F.col("doc_id"), sorted({int(x) for x in found}))
    heads = sorted(
        rows.groupBy(in_range.alias("range")).agg(F.max(F.struct("doc_id", "hash")).alias("head")).collect()
    )
    firsts = spark.createDataFrame(
        [(*h["head"], heads[(k + 1) % len(heads)]["range"]) for k, h in enumerate(heads)],
        "_first_id long, _first_hash long, _also int",
    )
    placed = rows.join(
        F.broadcast(firsts),
        F.col("doc_id").eqNullSafe(F.col("_first_id")) & (F.col("hash") == F.col("_first_hash")),
        "left",
    )
    home = F.struct(in_range.alias("range"), F.lit(0).alias("copy"))
    also = F.struct(F.col("_also").alias("range"), F.lit(1).alias("copy"))
    both = F.when(F.col("_also").isNull(), F.array(home)).otherwise(F.array(home, also))
    order = Window.partitionBy(F.col("_place.range")).orderBy(
        F.col("_place.copy"), F.col("doc_id").desc_nulls_last(), F.col("hash").desc()
    )
    return (
        placed.withColumn("_place", F.explode(both))
        .withColumn("next", F.lead(F.struct(*columns)).over(order))
        .where("_place.copy = 0")
        .select(*rows.columns, "next")
    )


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their texts with the last third taken from the next one.

    Takes `doc_id` and `text`; other columns are not looked at. A null text counts as empty, equal
    rows follow each other, a single document follows itself, no document gives no row. Texts move
    compressed.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.length(text).cast("long").alias("n_chars"),
        F.xxhash64(text).alias("hash"),
        fingerprint("text").alias("fingerprint"),
        packed("text").alias("packed"),
    )
    edited = with_next(rows, ["packed", "fingerprint"]).withColumn(
        "edited", _edited("packed", "next.packed")
    )
    return edited.select(
        "doc_id",
        "n_chars",
        F.col("edited.sha256").alias("edited_sha256"),
        "fingerprint",
        F.col("edited.fingerprint").alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited.fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next.fingerprint")).alias("near_next"),
    )
