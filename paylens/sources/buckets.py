"""A vector table in buckets, of which an upsert rewrites only those that it touches.

An id's hash names its bucket. A batch writes every bucket it touches, whole, into a folder of its own, and then a
manifest: for each bucket the folder that holds it now. Readers go by the newest manifest, so they see a batch
wholly or not at all; files are never changed, and a batch that fails leaves only files that nothing reads.
"""

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.sources.tables import upsert_vectors, written

BUCKETS = 64

_MANIFEST_DDL = "version int, buckets int, bucket int, folder string"
_VECTORS_DDL = "tx_id string, embedding array<float>"


def bucket_of(tx_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(tx_id), F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest manifest: a row for each bucket that was ever written. None if there is no table."""
    try:
        known = spark.read.schema(_MANIFEST_DDL).parquet(f"{path}/manifest")
    except AnalysisException:
        return None
    newest = known.agg(F.max("version").alias("version")).first().version
    return known.where(F.col("version") == newest)


def _read(spark: SparkSession, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], _VECTORS_DDL)
    return spark.read.schema(_VECTORS_DDL).parquet(*folders)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """`tx_id, embedding` of the table as it is now. The driver sees a folder name for each bucket."""
    known = manifest(spark, path)
    if known is None:
        raise FileNotFoundError(f"no vector table at {path}")
    return _read(spark, [f"{path}/{r.folder}" for r in known.orderBy("bucket").collect()])


@dataclass(frozen=True)
class Upsert:
    rows: int
    buckets: int


def upsert_buckets(new: DataFrame, path: str, buckets: int = BUCKETS) -> Upsert:
    """Inserts the vectors of `new`, or replaces those of the same id; gives the rows taken and the buckets written.

    The first batch makes the table, of `buckets` buckets; later ones keep to its number. Of an id that the batch
    holds several times one row stays, the same each time; rows without an id are left out. A batch without rows
    writes nothing. One writer at a time.
    """
    spark = new.sparkSession
    known = manifest(spark, path)
    rows = known.collect() if known is not None else []
    buckets = rows[0].buckets if rows else buckets
    version = rows[0].version + 1 if rows else 1
    folders = {r.bucket: r.folder for r in rows}

    tx_id = F.col("tx_id").cast("string")
    row = F.struct(F.xxhash64("embedding").alias("hash"), F.col("embedding").cast("array<float>").alias("embedding"))
    given = new.where(tx_id.isNotNull()).groupBy(tx_id.alias("tx_id")).agg(F.min(row).alias("row"))
    given = given.select("tx_id", "row.embedding", bucket_of(F.col("tx_id"), buckets).alias("bucket"))
    given = written(given, "batch")
    counts = given.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).collect()
    if not counts:
        return Upsert(0, 0)
    touched = sorted(r.bucket for r in counts)
    old = _read(spark, [f"{path}/{folders[b]}" for b in touched if b in folders])
    merged = upsert_vectors(old, given).withColumn("bucket", bucket_of(F.col("tx_id"), buckets))
    batch = f"batch-{version:06d}-{uuid.uuid4().hex}"
    merged.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{path}/{batch}")

    folders |= {b: f"{batch}/bucket={b}" for b in touched}
    told = spark.createDataFrame([(version, buckets, b, f) for b, f in sorted(folders.items())], _MANIFEST_DDL)
    told.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return Upsert(sum(r.rows for r in counts), len(touched))


def point_view(spark: SparkSession, view: str, path: str) -> None:
    """Makes the view `view` give the table as it is now: one scan for each batch that buckets still lie in."""
    batches: dict[str, list[int]] = {}
    for row in manifest(spark, path).orderBy("bucket").collect():
        batches.setdefault(row.folder.split("/")[0], []).append(row.bucket)
    parts = [
        f"SELECT tx_id, embedding FROM parquet.`{path}/{batch}` WHERE bucket IN ({', '.join(map(str, own))})"
        for batch, own in batches.items()
    ]
    spark.sql(f"CREATE OR REPLACE VIEW {view} AS " + " UNION ALL ".join(parts))
