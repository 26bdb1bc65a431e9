"""Table schemas."""

from pyspark.sql import types as T

AMOUNT = T.DecimalType(18, 2)
TOTAL = T.DecimalType(38, 2)

TRANSACTIONS = T.StructType(
    [
        T.StructField("tx_id", T.StringType(), False),
        T.StructField("booking_date", T.DateType(), False),
        T.StructField("counterparty_account", T.StringType()),
        T.StructField("counterparty", T.StringType(), False),
        T.StructField("amount", AMOUNT, False),
        T.StructField("reference_no", T.StringType()),
        T.StructField("description", T.StringType(), False),
        T.StructField("currency", T.StringType(), False),
        T.StructField("search_text", T.StringType()),
    ]
)

VECTORS = T.StructType(
    [
        T.StructField("tx_id", T.StringType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType()), False),
    ]
)

NEIGHBOURS = T.StructType(
    [
        T.StructField("query_id", T.StringType(), False),
        T.StructField("tx_id", T.StringType(), False),
        T.StructField("rank", T.IntegerType(), False),
        T.StructField("distance", T.DoubleType(), False),
    ]
)

# What a single transaction shows in a result.
DETAIL_COLUMNS = ("tx_id", "booking_date", "counterparty", "amount", "description")

# Kept in results for lookups, never shown.
TECHNICAL_COLUMNS = ("tx_id",)

MONEY_COLUMNS = (
    "amount",
    "min_amount",
    "max_amount",
    "avg_amount",
    "total_amount",
    "old_amount",
    "new_amount",
)
PERCENT_COLUMNS = ("change_pct",)
