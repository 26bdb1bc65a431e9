"""Encoding search texts.

An encoder is a function from a text column to a vector column: `letter_profile`, or
`batch_encoder(...)` around any model.
"""

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paylens.functions.text import normalise, strip
from paylens.operators.filters import searchable
from paylens.operators.joins import join_unique

Encoder = Callable[[Column], Column]

# Texts given to a model at once.
ENCODE_BATCH = 16


def batch_encoder(
    load: Callable[[], Callable[[list[str]], np.ndarray]], batch_size: int = ENCODE_BATCH
) -> Encoder:
    """Encoder around a model. `load` runs once per Python worker and gives `list[str] -> ndarray`.

    The vector of a null text is null; the model gets an empty text in its place.
    """

    def make():
        encode = load()
        return lambda texts: np.asarray(encode([str(t) for t in texts]), dtype=np.float32)

    predict = predict_batch_udf(make, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return lambda text: F.when(text.isNotNull(), predict(F.coalesce(text, F.lit(""))))


def encode_rows(rows: DataFrame, encoder: Encoder) -> DataFrame:
    """Vectors of `tx_id, search_text` rows, each encoded where it lies.

    The texts are taken to be searchable: a filter on the vectors would compute each of them twice.
    """
    return rows.select("tx_id", encoder(F.col("search_text")).alias("embedding"))


def encode_distinct(rows: DataFrame, encoder: Encoder, tasks: int | None = None) -> DataFrame:
    """The same vectors, each different text encoded once.

    For a costly model: fixed payments repeat one text without end. Repeats go before the texts
    shuffle, and the rows of a frequent text are joined back in several parts. `tasks` sets how many
    tasks encode; if not given, it follows the bytes of the texts, which says little about the model.
    """
    texts = rows.select("search_text").distinct()
    given = texts if tasks is None else texts.repartition(tasks)
    encoded = given.select("search_text", encoder(F.col("search_text")).alias("embedding"))
    return join_unique(rows, encoded, "search_text").select("tx_id", "embedding")


def build_vectors(
    transactions: DataFrame, encoder: Encoder, distinct: bool = True, tasks: int | None = None
) -> DataFrame:
    """Vector table of all transactions that have a search text."""
    rows = searchable(transactions)
    return encode_distinct(rows, encoder, tasks) if distinct else encode_rows(rows, encoder)


def encode_names(names: DataFrame, encoder: Encoder) -> DataFrame:
    """Query vectors `query_id, query_text, embedding` of distinct counterparty names.

    Names are normalised like search texts. One of which nothing is left has a null vector.
    """
    name = strip(F.col("counterparty"))
    queries = (
        names.select(name.alias("query_id")).distinct()
        .withColumn("query_text", normalise(F.col("query_id")))
    )
    return queries.withColumn(
        "embedding", F.when(F.col("query_text") != "", encoder(F.col("query_text")))
    )
