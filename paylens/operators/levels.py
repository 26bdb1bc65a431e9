"""The queries over groups from counts that add up, so that a load need not read what was loaded before.

The state of a set of transactions is how often each counterparty was charged each amount on each day. States of
parts add up to the state of the whole, and the four queries over groups follow from it for any period.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.functions.dates import span_text
from paylens.functions.numbers import average_of, total_of
from paylens.operators import payments
from paylens.operators.filters import in_period, up_to_amount

KEYS = ("counterparty", "amount", "booking_date")
# Rows of states that a task adds up.
TASK_ROWS = 1 << 18


def levels(transactions: DataFrame, *further: str) -> DataFrame:
    """The state of transactions: `counterparty, amount, booking_date, c`, by `further` columns as well."""
    return transactions.groupBy(*further, *KEYS).agg(F.count(F.lit(1)).alias("c"))


def merged(states: DataFrame, rows: int | None = None) -> DataFrame:
    """The sum of states, each key once.

    Given how many `rows` the states have, they are dealt to tasks of at most about `TASK_ROWS` rows first. A state
    holds a key once, so there is little to add up before, and tasks sized by bytes would hold many millions of keys.
    They are dealt by counterparty and amount, of which each state has a row a day at most: price levels follow in place.
    """
    if rows is not None:
        states = states.repartition(max(1, -(-rows // TASK_ROWS)), "counterparty", "amount")
    return states.groupBy(*KEYS).agg(F.sum("c").alias("c"))


def recurring_payments(
    state: DataFrame, p: payments.RecurringPayments = payments.RecurringPayments()
) -> DataFrame:
    """As `payments.recurring_payments` of the transactions."""
    c, amount, day = F.col("c"), F.col("amount"), F.col("booking_date")
    groups = in_period(state, p.date_from, p.date_to).groupBy("counterparty").agg(
        F.sum(c).alias("n"),
        F.min(amount).alias("min_amount"),
        F.max(amount).alias("max_amount"),
        average_of(amount, c).alias("avg_amount"),
        total_of(amount, c).alias("total_amount"),
        span_text(F.min(day), F.max(day)).alias("date_span"),
    )
    return groups.where(F.col("n") >= 2).orderBy(*payments.order_columns("recurring_payments"))


def duplicate_payments(
    state: DataFrame, p: payments.DuplicatePayments = payments.DuplicatePayments()
) -> DataFrame:
    """As `payments.duplicate_payments` of the transactions."""
    groups = in_period(state, p.date_from, p.date_to).groupBy("booking_date", "counterparty", "amount")
    found = groups.agg(F.sum("c").alias("n")).where(F.col("n") >= 2)
    return found.orderBy(*payments.order_columns("duplicate_payments"))


def frequent_small_payments(
    state: DataFrame, p: payments.FrequentSmallPayments = payments.FrequentSmallPayments()
) -> DataFrame:
    """As `payments.frequent_small_payments` of the transactions."""
    c, amount = F.col("c"), F.col("amount")
    groups = up_to_amount(in_period(state, p.date_from, p.date_to), p.max_amount).groupBy("counterparty").agg(
        F.sum(c).alias("n"), total_of(amount, c).alias("total_amount"), average_of(amount, c).alias("avg_amount")
    )
    found = groups.where(F.col("n") >= p.min_count)
    return found.orderBy(*payments.order_columns("frequent_small_payments"))


def price_rise(state: DataFrame, p: payments.PriceRise = payments.PriceRise()) -> DataFrame:
    """As `payments.price_rise` of the transactions."""
    prices = in_period(state, p.date_from, p.date_to).groupBy("counterparty", "amount").agg(
        F.sum("c").alias("c"), F.min("booking_date").alias("first_day"), F.max("booking_date").alias("last_day")
    )
    return payments.price_rises(prices, p)
