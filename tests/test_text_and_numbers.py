import re
from decimal import Decimal

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paylens.fixed_values import SEARCH_LETTERS
from paylens.functions import numbers, text
from paylens.functions.letters import encode_letters, letter_profile


def python_normalise(s):
    s = re.sub(f"[^{SEARCH_LETTERS}]+", " ", s.replace("İ", "i").lower())
    return s.strip(" ")


def test_normalise_over_all_characters(spark):
    points = [i for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000]
    rows = [(f"x{chr(i)}Y {chr(i)} z",) for i in points]
    df = spark.createDataFrame(rows, "t string").select("t", text.normalise(F.col("t")).alias("n"))
    wrong = [r.t for r in df.collect() if r.n != python_normalise(r.t)]
    assert wrong == []


@pytest.mark.parametrize(
    "given_text, wanted",
    [("  A--b  c1 ", "a b c"), ("123", ""), (" . a", "a"), ("", ""), (None, None)],
)
def test_normalise(spark, given_text, wanted):
    df = spark.createDataFrame([(given_text,)], "t string")
    assert df.select(text.normalise(F.col("t"))).first()[0] == wanted


def test_strip_is_pythons(spark):
    spaces = [chr(i) for i in range(1, 0x3100)]
    rows = [(f"{c}a{c}b{c}",) for c in spaces]
    df = spark.createDataFrame(rows, "t string").select("t", text.strip(F.col("t")).alias("s"))
    assert [r.t for r in df.collect() if r.s != r.t.strip()] == []


def test_letter_profiles_agree(spark):
    rows = [("ab ba",), ("õõš",), ("zzz",)]
    df = spark.createDataFrame(rows, "t string").select("t", letter_profile(F.col("t")).alias("v"))
    for r in df.collect():
        assert r.v == encode_letters([r.t])[0].tolist()
    assert spark.createDataFrame([("  ",)], "t string").select(
        letter_profile(F.col("t"))).first()[0] is None


AMOUNTS = st.lists(
    st.decimals("-99999.99", "99999.99", places=2, allow_nan=False), min_size=1, max_size=8
)


@settings(max_examples=8, deadline=None)
@given(st.lists(AMOUNTS, min_size=20, max_size=60))
def test_average_is_the_databases(spark, groups):
    rows = [(g, a) for g, amounts in enumerate(groups) for a in amounts]
    df = spark.createDataFrame(rows, "g int, a decimal(18,2)")
    got = {r.g: r.m for r in df.groupBy("g").agg(numbers.average(F.col("a")).alias("m")).collect()}
    values = ", ".join(f"({g}, {a}::DECIMAL(18,2))" for g, a in rows)
    wanted = dict(duckdb.execute(
        f"SELECT g, m FROM (SELECT g, round(avg(a), 2) AS m, sum(a), count(*) "
        f"FROM (VALUES {values}) t(g, a) GROUP BY g)").fetchall())
    assert got == wanted


@pytest.mark.parametrize("value", [0.0, 1.005, 2.675, 0.125, 12.5, -3.456, 1234567.891, None])
def test_money_and_percent_of_doubles(spark, value):
    df = spark.createDataFrame([(value,)], "v double")
    row = df.select(numbers.money_text(F.col("v"), "double"), numbers.percent_text(F.col("v"), "double"))
    money = "" if value is None else f"{value:.2f}".replace(".", ",") + " €"
    percent = "" if value is None else f"{value:.1f}".replace(".", ",") + " %"
    assert tuple(row.first()) == (money, percent)


def test_money_of_decimals(spark):
    df = spark.createDataFrame([(Decimal("1234.50"),)], "v decimal(18,2)")
    assert df.select(numbers.money_text(F.col("v"), "decimal(18,2)")).first()[0] == "1234,50 €"


def test_percent_change_of_zero_is_null(spark):
    df = spark.createDataFrame([(Decimal("0"), Decimal("5"))], "a decimal(18,2), b decimal(18,2)")
    assert df.select(numbers.percent_change(F.col("a"), F.col("b"))).first()[0] is None


def test_median_is_exact(spark, monkeypatch):
    """By sketches alone until few rows are left; many equal values, odd and even numbers, nulls, decimals."""
    import random
    import statistics

    from paylens.functions import quantiles as Q

    monkeypatch.setattr(Q, "LOOKED_AT", 40)
    rng = random.Random(3)
    for n, kind in ((5001, "any"), (4000, "any"), (3000, "few"), (2001, "one"), (2, "any"), (1, "any")):
        values = [
            round(rng.gauss(0, 50), 3) if kind == "any" else float(rng.randrange(3)) if kind == "few" else 7.0 for _ in range(n)
        ]
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "`a.b` double")
        assert Q.median(df, "a.b") == statistics.median(values)
    amounts = spark.range(101).selectExpr("CAST(id / 4 AS DECIMAL(18,2)) AS x")
    assert str(Q.median(amounts, "x")) == "12.50"
    assert Q.median(amounts.where("false"), "x") is None


def test_outliers(spark):
    from paylens.operators.facts import outliers

    rows = spark.createDataFrame([(i, float(i % 10)) for i in range(100)] + [(100, 60.0), (101, -50.0), (102, None)], "i int, x double")
    assert [r.i for r in outliers(rows, "x").orderBy("i").collect()] == [100, 101]
    assert outliers(rows.selectExpr("i", "1.0 AS x"), "x").count() == 0 and outliers(rows.where("false"), "x").count() == 0
