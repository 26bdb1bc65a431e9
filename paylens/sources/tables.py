"""Tables: writing whole versions, pointing a name at one, and vector upserts."""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from paylens.functions.text import is_blank
from paylens.session import scratch_path


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished table lies at `path`."""
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True


def write_table(df: DataFrame, path: str) -> dict[str, int]:
    """Overwrites `path`; gives the row count from the same pass."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    return seen.get


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table of the scratch folder: worked out once, and a plain scan from then on."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_if_absent(df: DataFrame, path: str) -> None:
    """Writes unless something is at `path`; what is there is not looked at."""
    df.write.mode("ignore").parquet(path)


def new_version_path(base_path: str) -> str:
    return f"{base_path.rstrip('/')}/version-{uuid.uuid4().hex}"


def point_table(spark: SparkSession, table: str, path: str) -> None:
    """Makes `table` read from `path`. Only the catalog changes, so readers see the old rows or the
    new ones, never a mix, and a failed write before this call loses nothing."""
    if spark.catalog.tableExists(table):
        location = path.replace("'", "\\'")
        spark.sql(f"ALTER TABLE {table} SET LOCATION '{location}'")
        spark.catalog.refreshTable(table)
    else:
        spark.catalog.createTable(table, path=path, source="parquet")


def blank_text_audit(transactions: DataFrame) -> DataFrame:
    """One row: how many transactions have no search text."""
    return transactions.agg(F.count_if(is_blank(F.col("search_text"))).alias("blank_rows"))


def upsert_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    """All of `new`, and those of `old` whose id `new` does not hold.

    Only the ids of `new` meet `old`: a small batch is broadcast by size, so that the stored vectors
    are scanned and not moved; for a large one both sides are hashed by id, which is unique.
    """
    kept = old.join(new.select("tx_id"), "tx_id", "left_anti")
    return kept.select("tx_id", "embedding").unionByName(new.select("tx_id", "embedding"))
