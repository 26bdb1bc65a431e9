"""A join to a side of unique keys that stays even when few keys hold most rows."""

from pyspark.sql import DataFrame

from paylens.sources.tables import written


def join_unique(rows: DataFrame, unique: DataFrame, key: str) -> DataFrame:
    """Inner join of many rows with a side where each key is unique, such as an aggregate of them.

    The unique side is written first. Both sides of the join are then plain shuffles, and adaptive
    execution splits the partitions of frequent keys by their bytes, however many such keys there are;
    it can't do so next to an aggregate. A unique side of few bytes is broadcast instead.
    """
    return rows.join(written(unique, "unique"), key)
