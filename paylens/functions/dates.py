"""Dates: parsing, checking, spans and named periods."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from paylens.fixed_values import PERIOD_NAMES


def parse_statement_date(text: Column) -> Column:
    """`d.M.yyyy` with one or two digits for day and month; null if no such day."""
    shaped = F.when(text.rlike(r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$"), text)
    return F.try_to_date(shaped, "d.M.yyyy")


def parse_iso_date(text: Column) -> Column:
    """`yyyy-MM-dd`; null if misshaped or no such day."""
    shaped = F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text)
    return F.try_to_date(shaped, "yyyy-MM-dd")


def span_text(first: Column, last: Column) -> Column:
    """`first .. last`; a null end is left out."""
    return F.concat(
        F.coalesce(first.cast("string"), F.lit("")),
        F.lit(" .. "),
        F.coalesce(last.cast("string"), F.lit("")),
    )


def named_periods(day: Column) -> dict[str, tuple[Column, Column]]:
    """Period name -> (first day, last day) as seen from `day`; "this" periods end on `day`."""
    week = F.trunc(day, "WEEK")
    month = F.trunc(day, "MM")
    year = F.trunc(day, "YEAR")
    bounds = (
        (day, day),
        (F.date_sub(day, 1), F.date_sub(day, 1)),
        (week, day),
        (F.date_sub(week, 7), F.date_sub(week, 1)),
        (month, day),
        (F.add_months(month, -1), F.date_sub(month, 1)),
        (year, day),
        (F.add_months(year, -12), F.date_sub(year, 1)),
    )
    return dict(zip(PERIOD_NAMES, bounds, strict=True))
