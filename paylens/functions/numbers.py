"""Numbers: averages, percentages, and how they are written."""

from decimal import ROUND_FLOOR, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from paylens.schema import AMOUNT, TOTAL


def round_half_away(value: Column, digits: int) -> Column:
    """Rounds a double as binary arithmetic does: scale up, round to a whole number, scale down.

    Spark's own `round` goes through the decimal text of the double and differs at halves.
    """
    scale = float(10**digits)
    return F.round(value * F.lit(scale), 0) / F.lit(scale)


def total(amount: Column) -> Column:
    return F.sum(amount).cast(TOTAL)


def average(amount: Column, digits: int = 2) -> Column:
    """Mean of decimals: the exact sum, divided in double, then rounded."""
    return round_half_away(F.sum(amount).cast("double") / F.count(amount), digits)


def total_of(amount: Column, c: Column) -> Column:
    """`total` of amounts that occur `c` times each."""
    return F.sum(amount * c.cast("decimal(18,0)")).cast(TOTAL)


def average_of(amount: Column, c: Column, digits: int = 2) -> Column:
    """`average` of amounts that occur `c` times each."""
    return round_half_away(F.sum(amount * c.cast("decimal(18,0)")).cast("double") / F.sum(c), digits)


def percent_change(old: Column, new: Column, digits: int = 1) -> Column:
    """Null where the old value is zero."""
    ratio = F.try_divide((new - old).cast("double"), old.cast("double"))
    return round_half_away(ratio * F.lit(100.0), digits)


def variation(n: Column, total: Column, total_squares: Column) -> Column:
    """Coefficient of variation (sample deviation by mean) from double sums; null for n < 2."""
    spread = F.greatest(total_squares - F.try_divide(total * total, n.cast("double")), F.lit(0.0))
    deviation = F.sqrt(F.try_divide(spread, (n - 1).cast("double")))
    return F.try_divide(deviation, F.try_divide(total, n.cast("double")))


def amount_literal(value: float | int | str | Decimal) -> Column:
    """Literal for `amount <= value`: cut down to cents, which changes no comparison with cents and
    leaves the column uncast, so that the filter reaches the scan."""
    cents = Decimal(str(value)).quantize(Decimal("0.01"), rounding=ROUND_FLOOR)
    return F.lit(cents).cast(AMOUNT)


def _fixed_point(value: Column, data_type: str, digits: int) -> Column:
    if data_type.startswith("decimal"):
        return value.cast(f"decimal(38,{digits})").cast("string")
    # The pattern form rounds the exact binary value, ties to even.
    return F.call_function(
        "format_number", value.cast("double"), F.lit("0." + "0" * digits)
    )


def money_text(value: Column, data_type: str) -> Column:
    """`12,34 €`; null gives an empty text."""
    text = F.translate(_fixed_point(value, data_type, 2), ".", ",")
    return F.coalesce(F.concat(text, F.lit(" €")), F.lit(""))


def percent_text(value: Column, data_type: str) -> Column:
    """`5,0 %`; null gives an empty text."""
    text = F.translate(_fixed_point(value, data_type, 1), ".", ",")
    return F.coalesce(F.concat(text, F.lit(" %")), F.lit(""))
