"""Results as display rows and as JSON."""

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.functions.numbers import money_text, percent_text
from paylens.operators.filters import without_technical
from paylens.schema import MONEY_COLUMNS, PERCENT_COLUMNS
from paylens.session import scratch_path

ROW_NUMBER = "#"


@dataclass(frozen=True)
class ResultIndex:
    """A sorted result as it was written: `rows` in ranges of the order, each in a folder of its own, with their
    place in the range; of each range its number, the rows before it, and its own."""

    rows: DataFrame
    columns: list[str]
    ranges: list[tuple[int, int, int]]

    def numbered(self) -> DataFrame:
        """All rows with their number from 1."""
        spark = self.rows.sparkSession
        before = spark.createDataFrame([r[:2] for r in self.ranges], "_range int, _before long")
        number = (F.col("_before") + F.col("_place") + 1).alias(ROW_NUMBER)
        return self.rows.join(F.broadcast(before), "_range").select(*_named(self.columns), number)

    def row(self, number: int) -> DataFrame:
        """The row with this number, from the folder of its range; an error if there is none."""
        for part, before, n in self.ranges:
            if before < number <= before + n:
                found = self.rows.where((F.col("_range") == part) & (F.col("_place") == number - before - 1))
                return found.select(*_named(self.columns), F.lit(number).cast("long").alias(ROW_NUMBER))
        raise ValueError(f"the result has no row {number}")


def _named(columns: list[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in columns]


def index_result(result: DataFrame, order: list[Column]) -> ResultIndex:
    """Sorts and writes a result once; any row of it is then found without sorting.

    The sort cuts the rows into ranges, one per task, and the driver sees a row for each of them.
    """
    in_range = (1 << 33) - 1
    placed = result.orderBy(*order).select(
        "*",
        F.monotonically_increasing_id().bitwiseAND(in_range).alias("_place"),
        F.spark_partition_id().alias("_range"),
    )
    path = scratch_path(result.sparkSession, "ranges")
    placed.write.partitionBy("_range").parquet(path)
    rows = result.sparkSession.read.schema(placed.schema).parquet(path)
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).orderBy("_range").collect()
    before = accumulate((r.n for r in counts), initial=0)
    return ResultIndex(rows, result.columns, [(r["_range"], b, r.n) for r, b in zip(counts, before)])


def numbered(result: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with their number from 1 in the result's order."""
    return index_result(result, order).numbered()


def row_at(result: DataFrame, order: list[Column], number: int) -> DataFrame:
    """The row with this number; an error if the result has no such row. For several, keep an `index_result`."""
    return index_result(result, order).row(number)


def cell_text(name: str, data_type: str) -> Column:
    """A value as shown: money and percentages in their format, others as text, null as nothing."""
    value = F.col(f"`{name}`")
    if name in MONEY_COLUMNS:
        return money_text(value, data_type)
    if name in PERCENT_COLUMNS:
        return percent_text(value, data_type)
    return F.coalesce(value.cast("string"), F.lit(""))


def display_rows(result: DataFrame, order: list[Column]) -> DataFrame:
    """All cells as text, a leading row number, technical columns hidden."""
    shown = without_technical(numbered(result, order))
    columns = [ROW_NUMBER] + [c for c in shown.columns if c != ROW_NUMBER]
    types = dict(shown.dtypes)
    return shown.select(*[cell_text(c, types[c]).alias(c) for c in columns])


def rows_as_json(result: DataFrame) -> DataFrame:
    """Each row as a JSON object in column order; dates and decimals as text, nulls kept."""
    fields = [
        (F.col(f"`{c}`").cast("string") if t == "date" or t.startswith("decimal") else F.col(f"`{c}`"))
        .alias(c)
        for c, t in result.dtypes
    ]
    return result.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))
