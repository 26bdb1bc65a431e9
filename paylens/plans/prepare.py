"""Preparation: statements to a transactions table, search texts, vector table.

Every write goes to a new folder under `base_path`; the table name is pointed at it once the rows are
checked. So a failed or repeated run never leaves a half-written table behind.
"""

from dataclasses import dataclass

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from paylens.functions.text import search_text
from paylens.operators.encode import Encoder, build_vectors
from paylens.sources.buckets import point_view, upsert_buckets
from paylens.sources.statements import (
    check_statements,
    duplicate_ids,
    is_valid,
    read_statements,
    rejected_rows,
    valid_rows,
)
from paylens.sources.tables import (
    blank_text_audit,
    new_version_path,
    point_table,
    write_table,
)

EXAMPLES = 5


@dataclass(frozen=True)
class LoadReport:
    path: str
    rows: int
    rejects: int


def _search_text():
    return search_text(F.col("counterparty"), F.col("description"))


def load_statements(
    spark: SparkSession,
    paths: str | list[str],
    base_path: str,
    table: str,
    strict: bool = True,
    with_search_text: bool = False,
) -> LoadReport:
    """Replaces `table` by the rows of statement files.

    One pass over the files reads, checks, counts and writes. If `strict`, a rejected row fails the
    load; otherwise rejects are left out and counted. An empty statement and a repeated id always fail
    it. After a failure the table is as it was; the folder just written stays, to be looked into.
    """
    checked = check_statements(read_statements(spark, paths))
    seen = Observation()
    watched = checked.observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~is_valid()).alias("rejects"),
    )
    rows = valid_rows(watched)
    if with_search_text:
        rows = rows.withColumn("search_text", _search_text())
    path = new_version_path(base_path)
    rows.write.parquet(path)

    counts = seen.get
    if counts["rows"] == 0:
        raise ValueError("the statement is empty")
    if strict and counts["rejects"]:
        examples = [list(r.errors) for r in rejected_rows(checked).limit(EXAMPLES).collect()]
        raise ValueError(f"{counts['rejects']} rows rejected, among them: {examples}")
    repeated = duplicate_ids(spark.read.parquet(path)).limit(EXAMPLES).collect()
    if repeated:
        raise ValueError(f"repeated transaction ids, among them: {[r.tx_id for r in repeated]}")
    point_table(spark, table, path)
    return LoadReport(path, counts["rows"] - counts["rejects"], counts["rejects"])


def fill_search_text(spark: SparkSession, table: str, base_path: str) -> int:
    """If any row lacks its search text, writes all rows anew with it. Gives the rows written."""
    transactions = spark.table(table)
    if blank_text_audit(transactions).first().blank_rows == 0:
        return 0
    path = new_version_path(base_path)
    counts = write_table(transactions.withColumn("search_text", _search_text()), path)
    point_table(spark, table, path)
    return counts["rows"]


def build_index(
    spark: SparkSession,
    transactions_table: str,
    vectors_table: str,
    base_path: str,
    encoder: Encoder,
    tasks: int | None = None,
) -> int:
    """Encodes all search texts into the vector table, replacing vectors of the same id and keeping
    those of other ids. Gives the rows encoded; none is an error.

    The table lies in buckets under `base_path`; only buckets with an encoded id are written anew."""
    vectors = build_vectors(spark.table(transactions_table), encoder, tasks=tasks)
    path = f"{base_path.rstrip('/')}/{vectors_table}"
    done = upsert_buckets(vectors, path)
    if done.rows == 0:
        raise ValueError("no transaction has a search text; fill them first")
    point_view(spark, vectors_table, path)
    return done.rows


def prepare(
    spark: SparkSession,
    paths: str | list[str],
    base_path: str,
    encoder: Encoder,
    transactions_table: str = "transactions",
    vectors_table: str = "transaction_vectors",
) -> None:
    """Whole preparation. A table that exists is taken as it is, whatever it was made from, so name
    the vector table after the dataset."""
    if not spark.catalog.tableExists(transactions_table):
        load_statements(spark, paths, base_path, transactions_table, with_search_text=True)
    fill_search_text(spark, transactions_table, base_path)
    if not spark.catalog.tableExists(vectors_table):
        build_index(spark, transactions_table, vectors_table, base_path, encoder)
