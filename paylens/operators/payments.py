"""The five analytical queries.

Each takes typed parameters and gives its whole sorted result; `filters.capped` cuts one where that is
wanted. Sort keys end in a column that breaks ties. Aggregates combine before the shuffle, so a counterparty with a large share
of the rows sends one partial row per task.
"""

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.fixed_values import (
    DATE_MAX,
    DATE_MIN,
    PRICE_RISE_MAX_RATIO,
    PRICE_RISE_MAX_VARIATION,
)
from paylens.functions.dates import span_text
from paylens.functions.numbers import amount_literal, average, percent_change, total, variation
from paylens.operators.filters import detail, in_period, up_to_amount
from paylens.operators.joins import join_unique


def _within(name: str, value, least, greatest) -> None:
    if not least <= value <= greatest:
        raise ValueError(f"{name}={value} is not within [{least}, {greatest}]")


@dataclass(frozen=True)
class Period:
    date_from: date = DATE_MIN
    date_to: date = DATE_MAX

    def __post_init__(self):
        _within("date_from", self.date_from, DATE_MIN, DATE_MAX)
        _within("date_to", self.date_to, DATE_MIN, DATE_MAX)


@dataclass(frozen=True)
class TopTransactions(Period):
    direction: str = "DESC"
    limit: int = 10

    def __post_init__(self):
        super().__post_init__()
        if self.direction not in ("DESC", "ASC"):
            raise ValueError(f"direction={self.direction!r} is neither DESC nor ASC")
        _within("limit", self.limit, 1, 50)


@dataclass(frozen=True)
class RecurringPayments(Period):
    pass


@dataclass(frozen=True)
class DuplicatePayments(Period):
    pass


@dataclass(frozen=True)
class FrequentSmallPayments(Period):
    max_amount: float = 15.0
    min_count: int = 5

    def __post_init__(self):
        super().__post_init__()
        _within("max_amount", self.max_amount, 0.01, 9999999.99)
        _within("min_count", self.min_count, 2, 100)


@dataclass(frozen=True)
class PriceRise(Period):
    min_count: int = 3
    min_change_pct: float = 5.0

    def __post_init__(self):
        super().__post_init__()
        _within("min_count", self.min_count, 2, 50)
        _within("min_change_pct", self.min_change_pct, 1.0, 2000.0)


# Result order of each query, as (column, descending).
RESULT_ORDER = {
    "top_transactions_desc": (("amount", True), ("tx_id", False)),
    "top_transactions_asc": (("amount", False), ("tx_id", False)),
    "recurring_payments": (("n", True), ("counterparty", False)),
    "duplicate_payments": (
        ("n", True), ("booking_date", True), ("amount", True), ("counterparty", False),
    ),
    "frequent_small_payments": (("n", True), ("total_amount", True), ("counterparty", False)),
    "price_rise": (("change_pct", True), ("counterparty", False)),
}


def order_columns(name: str) -> list[Column]:
    """Sort keys of a result; nulls come last in either direction."""
    return [
        F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last()
        for c, descending in RESULT_ORDER[name]
    ]


def top_transactions(transactions: DataFrame, p: TopTransactions = TopTransactions()) -> DataFrame:
    """The largest (or smallest) single amounts."""
    rows = detail(in_period(transactions, p.date_from, p.date_to))
    order = order_columns(f"top_transactions_{p.direction.lower()}")
    return rows.orderBy(*order).limit(p.limit)


def recurring_payments(
    transactions: DataFrame, p: RecurringPayments = RecurringPayments()
) -> DataFrame:
    """Counterparties seen at least twice."""
    amount, day = F.col("amount"), F.col("booking_date")
    groups = (
        in_period(transactions, p.date_from, p.date_to)
        .groupBy("counterparty")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(amount).alias("min_amount"),
            F.max(amount).alias("max_amount"),
            average(amount).alias("avg_amount"),
            total(amount).alias("total_amount"),
            span_text(F.min(day), F.max(day)).alias("date_span"),
        )
        .where(F.col("n") >= 2)
    )
    return groups.orderBy(*order_columns("recurring_payments"))


def duplicate_payments(
    transactions: DataFrame, p: DuplicatePayments = DuplicatePayments()
) -> DataFrame:
    """Same day, same counterparty, same amount, more than once."""
    groups = (
        in_period(transactions, p.date_from, p.date_to)
        .groupBy("booking_date", "counterparty", "amount")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= 2)
    )
    return groups.orderBy(*order_columns("duplicate_payments"))


def frequent_small_payments(
    transactions: DataFrame, p: FrequentSmallPayments = FrequentSmallPayments()
) -> DataFrame:
    """Counterparties with many amounts up to a threshold; negative amounts count as small."""
    amount = F.col("amount")
    groups = (
        up_to_amount(in_period(transactions, p.date_from, p.date_to), p.max_amount)
        .groupBy("counterparty")
        .agg(
            F.count(F.lit(1)).alias("n"),
            total(amount).alias("total_amount"),
            average(amount).alias("avg_amount"),
        )
        .where(F.col("n") >= p.min_count)
    )
    return groups.orderBy(*order_columns("frequent_small_payments"))


def price_levels(transactions: DataFrame) -> DataFrame:
    """Per counterparty and amount: how often and between which days."""
    return transactions.groupBy("counterparty", "amount").agg(
        F.count(F.lit(1)).alias("c"),
        F.min("booking_date").alias("first_day"),
        F.max("booking_date").alias("last_day"),
    )


def is_price_rise(
    n: Column, old: Column, new: Column, n_old: Column, n_new: Column, cv: Column, p: PriceRise
) -> Column:
    """Dearest well above cheapest, but not too far; both charged at least twice; steady amounts."""
    factor = F.lit(1 + p.min_change_pct / 100.0)
    return (
        (n >= p.min_count)
        & (new.cast("double") > old.cast("double") * factor)
        & (new <= old * F.lit(PRICE_RISE_MAX_RATIO).cast("decimal(2,1)"))
        & (cv <= F.lit(PRICE_RISE_MAX_VARIATION))
        & (n_old >= 2)
        & (n_new >= 2)
    )


def price_rise(transactions: DataFrame, p: PriceRise = PriceRise()) -> DataFrame:
    """Counterparties whose dearest charge is a step above the cheapest (in either time order).

    Two levels: rows become price levels, levels become counterparties. A fixed price collapses to one
    level before the first shuffle, and that shuffle is by counterparty and amount, so one huge
    counterparty is spread over its prices; the second aggregates again before it shuffles.
    """
    return price_rises(price_levels(in_period(transactions, p.date_from, p.date_to)), p)


def price_rises(prices: DataFrame, p: PriceRise) -> DataFrame:
    """The second level of `price_rise`, from `price_levels`."""
    c, amount = F.col("c"), F.col("amount")
    x = amount.cast("double")
    groups = (
        prices.groupBy("counterparty")
        .agg(
            F.sum(c).alias("n"),
            F.min(amount).alias("old_amount"),
            F.max(amount).alias("new_amount"),
            F.min_by(c, amount).alias("n_old"),
            F.max_by(c, amount).alias("n_new"),
            variation(F.sum(c), F.sum(c * x), F.sum(c * x * x)).alias("cv"),
            span_text(F.min("first_day"), F.max("last_day")).alias("date_span"),
        )
        .where(
            is_price_rise(
                *[F.col(k) for k in ("n", "old_amount", "new_amount", "n_old", "n_new", "cv")], p
            )
        )
        .select(
            "counterparty",
            "n",
            "old_amount",
            "new_amount",
            percent_change(F.col("old_amount"), F.col("new_amount")).alias("change_pct"),
            "date_span",
        )
    )
    return groups.orderBy(*order_columns("price_rise"))


def amount_bounds(transactions: DataFrame) -> DataFrame:
    """Each transaction with the least and greatest amount of its counterparty.

    A window over the counterparty would pull all its rows into one task. The bounds are aggregated
    instead and joined back, the rows of a frequent counterparty in several parts.
    """
    bounds = transactions.groupBy("counterparty").agg(
        F.min("amount").alias("min_amount"), F.max("amount").alias("max_amount")
    )
    return join_unique(transactions, bounds, "counterparty")


QUERIES = {
    "top_transactions": (top_transactions, TopTransactions),
    "recurring_payments": (recurring_payments, RecurringPayments),
    "duplicate_payments": (duplicate_payments, DuplicatePayments),
    "frequent_small_payments": (frequent_small_payments, FrequentSmallPayments),
    "price_rise": (price_rise, PriceRise),
}
