"""Transactions laid out by month: a period is read from the folders of its months alone."""

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.operators.filters import BOOKING_MONTH

_FOLDER = re.compile(rf"/{BOOKING_MONTH}=(-?\d+)/")


def month_of(day: Column) -> Column:
    """The month's number, twelve to a year."""
    return F.year(day) * 12 + F.month(day) - 1


def write_by_month(transactions: DataFrame, path: str) -> None:
    """Writes the rows into a folder for each month. A large month is written by several tasks, small ones together.

    Rows without a day go to a folder of their own, which no period reads.
    """
    rows = transactions.withColumn(BOOKING_MONTH, month_of(F.col("booking_date")))
    rows.hint("rebalance", BOOKING_MONTH).write.partitionBy(BOOKING_MONTH).parquet(path)


def read_by_month(spark: SparkSession, path: str) -> DataFrame:
    """The rows with their month, by which `filters.in_period` chooses folders."""
    return spark.read.parquet(path)


def stored_period(spark: SparkSession, path: str) -> DataFrame:
    """One row: first and last day, as `periods.dataset_period` gives, read from the first and the last month only.

    Which months there are follows from the names of the folders. Both days are null for an empty table.
    """
    rows = read_by_month(spark, path)
    months = {int(m.group(1)) for m in map(_FOLDER.search, rows.inputFiles()) if m}
    ends = sorted({min(months), max(months)}) if months else []
    kept = rows.where(F.col(BOOKING_MONTH).isin(ends)) if ends else rows.where("false")
    return kept.agg(F.min("booking_date").alias("date_from"), F.max("booking_date").alias("date_to"))

