"""Periods: what a dataset covers, and named periods around a day."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.functions.dates import named_periods


def dataset_period(transactions: DataFrame) -> DataFrame:
    """One row: first and last day. Both are null for an empty table."""
    return transactions.agg(
        F.min("booking_date").alias("date_from"), F.max("booking_date").alias("date_to")
    )


def dataset_bounds(transactions: DataFrame):
    """First and last day as values; an empty table is an error."""
    row = dataset_period(transactions).first()
    if row.date_from is None:
        raise ValueError("the transactions table is empty: it covers no period")
    return row.date_from, row.date_to


def relative_periods(days: DataFrame, day: str = "day") -> DataFrame:
    """Eight rows per day: `day, period, date_from, date_to`."""
    rows = [
        F.struct(F.lit(name).alias("period"), first.alias("date_from"), last.alias("date_to"))
        for name, (first, last) in named_periods(F.col(day)).items()
    ]
    return days.select(F.col(day).alias("day"), F.explode(F.array(*rows)).alias("p")).select(
        "day", "p.period", "p.date_from", "p.date_to"
    )
