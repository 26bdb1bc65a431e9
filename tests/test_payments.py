from datetime import date

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from paylens.fixed_values import ROW_CAP
from paylens.functions.dates import span_text
from paylens.functions.numbers import percent_change
from paylens.operators import payments as P
from paylens.operators.filters import by_id, by_ids, capped, in_period
from paylens.operators.periods import dataset_bounds
from paylens.plans.fixtures import view

SF_DIR = "/root/testdata/sf0.01"


def price_rise_by_window(transactions, p):
    """The query as it reads: bounds over a window, then groups of counterparty and bounds."""
    w = Window.partitionBy("counterparty")
    rows = in_period(transactions, p.date_from, p.date_to).select(
        "counterparty", "booking_date", "amount",
        F.min("amount").over(w).alias("old_amount"), F.max("amount").over(w).alias("new_amount"),
    )
    mean = F.avg(F.col("amount").cast("double"))
    return (
        rows.groupBy("counterparty", "old_amount", "new_amount")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("amount") == F.col("old_amount")).alias("n_old"),
            F.count_if(F.col("amount") == F.col("new_amount")).alias("n_new"),
            F.try_divide(F.stddev_samp(F.col("amount").cast("double")), mean).alias("cv"),
            span_text(F.min("booking_date"), F.max("booking_date")).alias("date_span"),
        )
        .where(P.is_price_rise(
            *[F.col(k) for k in ("n", "old_amount", "new_amount", "n_old", "n_new", "cv")], p))
        .select("counterparty", "n", "old_amount", "new_amount",
                percent_change(F.col("old_amount"), F.col("new_amount")).alias("change_pct"),
                "date_span")
        .orderBy(*P.order_columns("price_rise"))
    )


@pytest.mark.parametrize("pct", [5.0, 9.0, 10.0])
def test_price_rise_is_the_window_form(spark, pct):
    p = P.PriceRise(min_change_pct=pct)
    tx = view(spark, SF_DIR, "tx_price")
    assert P.price_rise(tx, p).collect() == price_rise_by_window(tx, p).collect()


def prices(name, *amounts):
    return [(name, a, f"2024-01-{i:02d}") for i, a in enumerate(amounts, 1)]


@pytest.mark.parametrize(
    "amounts, kept",
    [
        ((100, 100, 105.01, 105.01), True),
        ((100, 100, 105, 105), False),  # not more than 5 %
        ((100, 100, 180, 180), True),  # at the ratio
        ((100, 100, 180.01, 180.01), False),
        ((100, 110, 110), False),  # once at the low price
        ((100, 100, 110), False),  # once at the high price
        ((110, 110, 100, 100), True),  # a drop counts too
        ((0, 0, 10, 10), False),
        ((-10, -10, -8, -8), False),
        ((100,), False),
    ],
)
def test_price_rise_bounds(transactions, amounts, kept):
    tx = transactions(prices("pood", *amounts))
    assert (P.price_rise(tx).count() == 1) is kept
    assert (price_rise_by_window(tx, P.PriceRise()).count() == 1) is kept


def test_variation_is_sample_deviation_by_mean(transactions):
    from paylens.functions.numbers import variation

    x = F.col("amount").cast("double")
    row = transactions(prices("a", 1, 2, 4)).agg(
        variation(F.count(x), F.sum(x), F.sum(x * x)).alias("v"),
        (F.stddev_samp(x) / F.avg(x)).alias("w"),
    ).first()
    assert row.v == pytest.approx(row.w, rel=1e-12)
    one = transactions(prices("a", 1)).agg(variation(F.count(x), F.sum(x), F.sum(x * x))).first()
    assert one[0] is None


def test_ties_are_broken_by_id(transactions):
    tx = transactions([("a", 5, "2024-01-01"), ("b", 5, "2024-01-02"), ("c", 7, "2024-01-03")])
    ids = [r.tx_id for r in P.top_transactions(tx, P.TopTransactions(limit=2)).collect()]
    assert ids == ["3", "1"]
    ids = [r.tx_id for r in P.top_transactions(tx, P.TopTransactions(direction="ASC")).collect()]
    assert ids == ["1", "2", "3"]


def test_lookups(spark, transactions):
    tx = transactions([("a", 5, "2024-01-01"), ("b", 6, "2024-01-02")])
    assert by_id(tx, "2").first().counterparty == "b" and by_id(tx, "3").count() == 0
    ids = spark.createDataFrame([("2",), ("2",), ("9",)], "tx_id string")
    assert [r.tx_id for r in by_ids(tx, ids).collect()] == ["2"]
    assert by_ids(tx, ids.where("false")).count() == 0


def test_one_day_and_reversed_period(transactions):
    tx = transactions([("a", 1, "2024-01-01"), ("a", 2, "2024-01-02")])
    day, later = date(2024, 1, 1), date(2024, 1, 2)
    assert P.top_transactions(tx, P.TopTransactions(day, day)).count() == 1
    assert P.top_transactions(tx, P.TopTransactions(later, day)).count() == 0


def test_threshold_is_exact_and_takes_negatives(transactions):
    rows = [("a", x, "2024-01-01") for x in (14.99, 15, 15.01, -3)]
    p = P.FrequentSmallPayments(max_amount=15.009, min_count=2)
    assert P.frequent_small_payments(transactions(rows), p).first().n == 3


def test_cap(spark):
    many = spark.range(1500).select(F.col("id").cast("string").alias("counterparty"), F.explode(
        F.array(F.lit(1), F.lit(2))).alias("amount")).withColumns(
        {"amount": F.col("amount").cast("decimal(18,2)"), "booking_date": F.lit(date(2024, 1, 1))})
    assert P.recurring_payments(many).count() == 1500
    assert capped(P.recurring_payments(many)).count() == ROW_CAP
    assert capped(P.recurring_payments(many), 7).count() == 7


@pytest.mark.parametrize(
    "make, params",
    [
        (P.TopTransactions, {"limit": 51}),
        (P.TopTransactions, {"direction": "UP"}),
        (P.FrequentSmallPayments, {"max_amount": 0.0}),
        (P.FrequentSmallPayments, {"min_count": 101}),
        (P.PriceRise, {"min_change_pct": 0.5}),
        (P.Period, {"date_from": date(1899, 12, 31)}),
    ],
)
def test_parameters_are_checked(make, params):
    with pytest.raises(ValueError):
        make(**params)


def test_empty_table_has_no_period(transactions):
    tx = transactions([("a", 1, "2024-01-01")])
    assert dataset_bounds(tx) == (date(2024, 1, 1), date(2024, 1, 1))
    with pytest.raises(ValueError):
        dataset_bounds(tx.where("amount > 5"))


def test_filters_reach_the_scan(spark, tmp_path, transactions):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    path = str(tmp_path / "tx")
    transactions([("a", 1, "2024-01-01")]).write.parquet(path)
    p = P.FrequentSmallPayments(date(2024, 1, 1), date(2024, 2, 1))
    plan = P.frequent_small_payments(spark.read.parquet(path), p)._jdf.queryExecution().toString()
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "LessThanOrEqual(amount,15.00)" in pushed
    assert "GreaterThanOrEqual(booking_date,2024-01-01)" in pushed


def test_rows_by_number_from_one_index(spark):
    """A row is read from the folder of its range; nothing is sorted again."""
    import os
    import shutil

    from paylens.operators.present import index_result

    result = spark.range(1000).selectExpr("(id * 7919) % 1000 AS v", "id AS `a.b`")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = index_result(result, [F.col("v")])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(index.ranges) > 1 and sum(n for *_, n in index.ranges) == 1000
    assert {r["#"]: r.v for r in index.numbered().collect()} == {k + 1: k for k in range(1000)}
    part, before, n = index.ranges[-1]
    folder = index.rows.inputFiles()[0].split("/_range=")[0].removeprefix("file:")
    for other in os.listdir(folder):
        if other.startswith("_range=") and other != f"_range={part}":
            shutil.rmtree(os.path.join(folder, other))
    row = index.row(before + 1).first()
    assert (row.v, row["#"], row["a.b"] * 7919 % 1000) == (before, before + 1, before)
    plan = index.row(before + n)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan
    for number in (0, 1001):
        with pytest.raises(ValueError, match="no row"):
            index.row(number)
