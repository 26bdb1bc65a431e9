"""Similar transactions of result rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.fixed_values import NEIGHBOURS, TEMPLATE_IDS
from paylens.functions.text import is_blank, normalise, strip
from paylens.operators.encode import Encoder, encode_names
from paylens.operators.filters import by_ids, detail
from paylens.operators.vectors import nearest
from paylens.sources.tables import written


def hydrate(neighbours: DataFrame, transactions: DataFrame) -> DataFrame:
    """Neighbours with their transaction details; ids without a transaction are left out.

    The neighbours are written first, so that few are broadcast by their size and the transactions of
    many are met by shuffling, an id that is near to much in several parts. Sort by `query_id, rank`
    to show them nearest first.
    """
    return detail(transactions).join(written(neighbours, "neighbours"), "tx_id").select(
        "query_id", "rank", "distance", "tx_id", "booking_date", "counterparty", "amount",
        "description",
    )


def source_problems(ids: DataFrame, transactions: DataFrame) -> DataFrame:
    """Ids that cannot be searched by, and why."""
    known = transactions.select("tx_id", "search_text", F.lit(True).alias("known"))
    problem = F.when(F.col("known").isNull(), F.lit("no such transaction")).when(
        is_blank(F.col("search_text")), F.lit("no search text")
    )
    return (
        ids.select("tx_id").distinct()
        .join(known, "tx_id", "left")
        .select("tx_id", problem.alias("problem"))
        .where(F.col("problem").isNotNull())
    )


def name_problems(names: DataFrame) -> DataFrame:
    """Names that cannot be searched by, and why."""
    name = strip(F.col("counterparty"))
    problem = F.when(F.coalesce(name, F.lit("")) == "", F.lit("empty name")).when(
        normalise(name) == "", F.lit("nothing left of the name")
    )
    return (
        names.select("counterparty").distinct()
        .select("counterparty", problem.alias("problem"))
        .where(F.col("problem").isNotNull())
    )


def similar_by_id(
    ids: DataFrame, vectors: DataFrame, transactions: DataFrame, k: int = NEIGHBOURS
) -> DataFrame:
    """The k transactions nearest to each of the given ones, itself left out."""
    queries = by_ids(vectors, ids).select(F.col("tx_id").alias("query_id"), "embedding")
    return hydrate(nearest(queries, vectors, k, exclude_self=True), transactions)


def similar_by_name(
    names: DataFrame,
    vectors: DataFrame,
    transactions: DataFrame,
    encoder: Encoder,
    k: int = NEIGHBOURS,
) -> DataFrame:
    """The k transactions nearest to each distinct counterparty name; `query_id` is the name."""
    return hydrate(nearest(encode_names(names, encoder), vectors, k), transactions)


def similar_to_result(
    template_id: str,
    result: DataFrame,
    vectors: DataFrame,
    transactions: DataFrame,
    encoder: Encoder,
    k: int = NEIGHBOURS,
) -> DataFrame:
    """Follow-up on the rows of a result: single transactions by id, aggregates by counterparty.

    Sources that can't be searched by give no rows here; `source_problems` and `name_problems` say why.
    """
    if template_id not in TEMPLATE_IDS.values():
        raise ValueError(f"no such template: {template_id!r}")
    if template_id == TEMPLATE_IDS["top_transactions"]:
        return similar_by_id(result, vectors, transactions, k)
    return similar_by_name(result, vectors, transactions, encoder, k)
