"""Row and column selection."""

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.fixed_values import ROW_CAP
from paylens.functions.numbers import amount_literal
from paylens.functions.text import has_text
from paylens.schema import DETAIL_COLUMNS, TECHNICAL_COLUMNS


# The month of a row, in a table that is laid out by month (see `sources.months`).
BOOKING_MONTH = "booking_month"


def month_number(day: date) -> int:
    return day.year * 12 + day.month - 1


def in_period(transactions: DataFrame, date_from: date, date_to: date) -> DataFrame:
    """Both days included; a reversed period holds nothing. Of a table laid out by month only the months are read."""
    kept = transactions.where(F.col("booking_date").between(F.lit(date_from), F.lit(date_to)))
    if BOOKING_MONTH in transactions.columns:
        kept = kept.where(F.col(BOOKING_MONTH).between(month_number(date_from), month_number(date_to)))
    return kept


def up_to_amount(transactions: DataFrame, max_amount: float) -> DataFrame:
    return transactions.where(F.col("amount") <= amount_literal(max_amount))


def detail(transactions: DataFrame) -> DataFrame:
    return transactions.select(*DETAIL_COLUMNS)


def searchable(transactions: DataFrame) -> DataFrame:
    """Ids and search texts that can be encoded."""
    return transactions.where(has_text(F.col("search_text"))).select("tx_id", "search_text")


def without_technical(result: DataFrame) -> DataFrame:
    return result.drop(*TECHNICAL_COLUMNS)


def by_id(transactions: DataFrame, tx_id: str) -> DataFrame:
    """The row with this id, or none."""
    return transactions.where(F.col("tx_id") == F.lit(tx_id))


def by_ids(transactions: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is in `ids`; repeats there change nothing."""
    return transactions.join(ids.select("tx_id"), "tx_id", "left_semi")


def capped(result: DataFrame, limit: int = ROW_CAP) -> DataFrame:
    """The first `limit` rows of a sorted result, for a caller that shows no more."""
    return result.limit(limit)
