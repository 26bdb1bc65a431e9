"""Facts about results and about similar transactions, for a summary to state."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paylens.functions.quantiles import median
from paylens.functions.text import search_text

STANDOUTS = 3
REPEATED_AT_LEAST = 3
# Deviations from the median at which a row stands out, and a normal distribution's deviation over its median one.
OUTLIER = 3.5
NORMAL = 1.4826


def result_overview(result: DataFrame) -> DataFrame:
    """One row: how many rows, and between which days if the result has days."""
    if "booking_date" in result.columns:
        first = last = F.col("booking_date")
    elif "date_span" in result.columns:
        ends = F.split("date_span", " \\.\\. ")
        first, last = ends[0].cast("date"), ends[1].cast("date")
    else:
        first = last = F.lit(None).cast("date")
    return result.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(first).alias("date_from"),
        F.max(last).alias("date_to"),
    )


def standouts(result: DataFrame, order: list[Column]) -> DataFrame:
    """The first three rows of the result's own order, numbered."""
    first = result.orderBy(*order).limit(STANDOUTS)
    return first.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def outliers(result: DataFrame, column: str, at_least: float = OUTLIER) -> DataFrame:
    """Rows of a result that stand out by a column: `distance` says by how many deviations from the median.

    The deviation is the median distance from the median, scaled to that of a normal distribution, so that rows far
    out do not hide each other. Where more than half of the values are equal there is no such scale, and no row
    stands out; null values never do. The medians are exact.
    """
    x = F.col(f"`{column}`").cast("double")
    centre = median(result.select(x.alias("x")), "x")
    if centre is None:
        return result.withColumn("distance", F.lit(None).cast("double")).where("false")
    spread = median(result.select(F.abs(x - F.lit(centre)).alias("x")), "x") * NORMAL
    if spread == 0:
        return result.withColumn("distance", F.lit(None).cast("double")).where("false")
    distance = (x - F.lit(centre)) / F.lit(spread)
    return result.withColumn("distance", distance).where(F.abs("distance") >= at_least)


def repeated_counterparties(result: DataFrame) -> DataFrame:
    """Counterparties on three rows of the result or more."""
    return (
        result.groupBy("counterparty")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= REPEATED_AT_LEAST)
    )


def _with_source(found: DataFrame, sources: DataFrame) -> DataFrame:
    """Neighbours next to the words and counterparty they were searched by.

    `sources` holds `query_id, counterparty, description`, with no description for a search by name.
    """
    described = sources.select(
        "query_id",
        F.col("counterparty").alias("source_counterparty"),
        F.split(
            search_text(F.col("counterparty"), F.coalesce(F.col("description"), F.lit(""))), " "
        ).alias("source_words"),
    )
    words = F.split(search_text(F.col("counterparty"), F.col("description")), " ")
    return found.join(described, "query_id").withColumn(
        "shared_words",
        F.filter(F.array_intersect(words, F.col("source_words")), lambda w: w != ""),
    )


def similarity_facts(found: DataFrame, sources: DataFrame) -> DataFrame:
    """Per query: neighbours, how many share its counterparty or a word, and the span of amounts."""
    same = F.col("counterparty") == F.col("source_counterparty")
    return (
        _with_source(found, sources)
        .groupBy("query_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(same).alias("n_same_counterparty"),
            F.count_if(F.size("shared_words") > 0).alias("n_sharing_words"),
            F.min("amount").alias("min_amount"),
            F.max("amount").alias("max_amount"),
        )
    )


def shared_words(found: DataFrame, sources: DataFrame) -> DataFrame:
    """Per query and word of its search text: how many neighbours have the word."""
    return (
        _with_source(found, sources)
        .select("query_id", F.explode("shared_words").alias("word"))
        .groupBy("query_id", "word")
        .agg(F.count(F.lit(1)).alias("n"))
    )
