"""Sketches of ids: which ids a set may hold, so that a set without a hit need not be read.

A sketch is a Bloom filter of `BITS` bits, four for each id, kept as rows of 4 KB bitmaps; only bitmaps with a bit
set are there. Sketches of several sets are or-ed into that of their union, of 16 MB at most, which is broadcast.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 27
HASHES = 4
_BITMAP = 1 << 15
DDL = "bucket int, bitmap binary"


def _places(ids: DataFrame) -> DataFrame:
    places = F.array(*[F.pmod(F.xxhash64("tx_id", F.lit(k)), F.lit(BITS)) for k in range(HASHES)])
    placed = ids.select("tx_id", F.explode(places).alias("at"))
    return placed.select("tx_id", (F.col("at") / _BITMAP).cast("int").alias("bucket"), (F.col("at") % _BITMAP).alias("at"))


def sketch(ids: DataFrame) -> DataFrame:
    """The sketch of `tx_id`s: `bucket, bitmap`."""
    return _places(ids).groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bitmap"))


def _is_set(bitmap: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10)
    return F.getbit(byte.cast("int"), (at % 8).cast("int")) == 1


def may_hold(sketches: DataFrame, ids: DataFrame) -> DataFrame:
    """Those of `tx_id`s that a set with one of the sketches may hold, each once. Of others, few come through."""
    union = sketches.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    met = _places(ids.select("tx_id").distinct()).join(F.broadcast(union), "bucket")
    found = met.where(_is_set(F.col("bitmap"), F.col("at"))).groupBy("tx_id").agg(F.count(F.lit(1)).alias("n"))
    return found.where(F.col("n") == HASHES).select("tx_id")
