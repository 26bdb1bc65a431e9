"""Reading tables, cutting lineage and connected components, shared by the operators."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.session import scratch_path


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes rows to the shared folder and reads them back: computed once, safe from lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quoted(df: DataFrame) -> list[Column]:
    """All columns, whatever is in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that `df` does not have, in upper or lower case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


# Places in one bitmap, and the most bits of all bitmaps together: 64 MB.
_BITMAP = 1 << 15
_MOST_BITS = 1 << 29


def likely_in(rows: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """The `rows` that equal a row of `wanted` in `columns`, and a few others.

    Hashes of `wanted` are drawn into bitmaps, 16 bits for each up to 64 MB in all, which are broadcast; past that
    more rows get through. So what is left can be joined by a shuffle that moves little, at any size.
    """
    bits = max(_BITMAP, min(_MOST_BITS, 1 << (16 * max(1, wanted.count()) - 1).bit_length()))
    at, bucket, bitmap = fresh(rows, "_at"), fresh(rows, "_bucket"), fresh(rows, "_bitmap")

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumn(at, F.pmod(F.xxhash64(*columns), F.lit(bits)))

    drawn = placed(wanted.select(*columns)).groupBy((F.col(at) / _BITMAP).cast("int").alias(bucket))
    drawn = stored(drawn.agg(F.bitmap_construct_agg(F.col(at) % _BITMAP).alias(bitmap)), "bitmaps")
    found = placed(rows).withColumn(bucket, (F.col(at) / _BITMAP).cast("int")).join(F.broadcast(drawn), bucket)
    inside = (F.col(at) % _BITMAP).cast("int")
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(inside / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return found.where(F.getbit(byte, inside % 8) == 1).drop(at, bucket, bitmap)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once per row, also where lambdas inside `body` use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, zero: Column, fold: Callable[[Column, Column], Column]) -> Column:
    """For each place of a non-empty array, the fold of all values before it.

    Folds of whole blocks are taken first, so that a long array costs little more than its length.
    """
    block = 64

    def body(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int"))
        blocks = F.transform(starts, lambda c: F.aggregate(F.slice(v, F.lit(1), c * block), zero, fold))
        return let(blocks, lambda b: F.transform(v, lambda _, i: within(v, b, i)))

    def within(v: Column, blocks: Column, i: Column) -> Column:
        c = F.floor(i / block).cast("int")
        return fold(F.get(blocks, c), F.aggregate(F.slice(v, c * block + 1, i - c * block), zero, fold))

    return let(values, body)


def components(links: DataFrame) -> DataFrame:
    """The smallest node that each linked node can reach.

    `links` has columns `a` and `b` (long) and may hold a link several times or in one direction only.
    Returns `node` and `root`, one row per node that has a link. Every round takes the least root
    among a node's neighbours and then the root of that root. Rounds start from written tables, so
    that both sides of each join are plain shuffles, whose hot keys adaptive execution splits.
    """
    both = links.where("a <> b")
    both = both.union(both.select("b", "a"))
    edges = stored(both.distinct(), "links")
    roots = stored(
        edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")),
        "roots",
    )
    while True:
        reached = edges.join(roots, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "root")
        lower = stored(reached.union(roots).groupBy("node").agg(F.min("root").alias("root")), "lower")
        above = lower.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = stored(lower.join(above, "root").select("node", F.col("above").alias("root")), "roots")
        changed = jumped.join(roots.withColumnRenamed("root", "old"), "node").where("root <> old")
        if changed.isEmpty():
            return jumped
        roots = jumped


def usable_vectors(vectors: DataFrame, entry: Callable[[Column], Column]) -> DataFrame:
    """`vec_id` and `x`, `entry` of every component as a double, of the vectors that hold finite numbers only.

    A null vector and one with a component that is null, infinite or not a number is left out.
    """
    c = F.col("embedding").cast("array<double>")
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(F.coalesce(finite, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(c, entry).alias("x")
    )


def whole_number(value: Column) -> Column:
    """The floor of a double as a long; beyond 62 bits an error, never a wrong number."""
    fits = F.abs(value) < float(1 << 62)
    return F.when(fits, F.floor(value)).otherwise(F.raise_error(F.lit("a vector component is beyond 62 bits")).cast("long"))
