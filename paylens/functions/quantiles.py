"""Exact quantiles of large columns, by a sketch that narrows down and a count that makes sure."""

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.sources.tables import written

# The sketch's error is one in so many ranks; so many rows are looked at by the driver in the end.
ACCURACY = 1000
LOOKED_AT = 10_000


def _at_rank(values: DataFrame, n: int, rank: int):
    """The value with `rank` others before it, of the column `x` without nulls."""
    spread = 3 / ACCURACY
    while n > LOOKED_AT:
        # The sketch gives values of about these ranks; counting tells whether the wanted one lies between.
        shares = [max(0.0, rank / n - spread), min(1.0, rank / n + spread)]
        low, high = values.agg(F.percentile_approx("x", shares, ACCURACY).alias("ends")).first().ends
        x = F.col("x")
        seen = values.agg(F.count_if(x < low).alias("below"), F.count_if(x.between(low, high)).alias("inside")).first()
        if seen.below > rank or rank >= seen.below + seen.inside:
            spread *= 4
            continue
        if low == high:
            return low
        if seen.inside == n:
            # Few different values: count each.
            counts = values.groupBy("x").agg(F.count(F.lit(1)).alias("c")).orderBy("x")
            for row in counts.toLocalIterator():
                if rank < row.c:
                    return row.x
                rank -= row.c
        values = written(values.where(x.between(low, high)), "inside")
        n, rank = seen.inside, rank - seen.below
    return values.orderBy("x").collect()[rank].x


def median(rows: DataFrame, column: str):
    """The median of a column, nulls aside: of an even number the mean of the middle two. None if there is none.

    Nothing is gathered but sketches and at most `LOOKED_AT` rows, in a pass for each factor of some hundred.
    """
    values = written(rows.select(F.col(f"`{column}`").alias("x")).where("x IS NOT NULL"), "values")
    n = values.count()
    if n == 0:
        return None
    middle = [_at_rank(values, n, k) for k in {(n - 1) // 2, n // 2}]
    total = sum(middle)
    return total / len(middle) if not isinstance(total, Decimal) else total / Decimal(len(middle))
