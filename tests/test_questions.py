from datetime import date

import pytest

from paylens.fixed_values import TEMPLATE_IDS
from paylens.operators.payments import order_columns, recurring_payments
from paylens.operators.present import display_rows, row_at, rows_as_json
from paylens.operators.replies import parse_replies, validate_params
from paylens.operators.routing import route_questions
from paylens.plans.answer import answer_question, answer_reply

TODAY = date(2024, 5, 15)
BOUNDS = (date(2023, 1, 1), date(2024, 4, 30))


def route(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "question_id int, text string")
    return route_questions(df, TODAY, BOUNDS).orderBy("question_id").collect()


@pytest.mark.parametrize(
    "question, template",
    [
        ("Too välja 10 kõige suurimat ostu, 2024-01-01 kuni 2025-12-31", "top_transactions"),
        ("Kellele läheb raha regulaarselt? 2024-01-01 kuni 2025-12-31", "recurring_payments"),
        ("On midagi makstud kaks korda? 2024-01-01 kuni 2025-12-31",
         "duplicate_payments"),
        ("Kus ma sageli alla 15 euro kulutan, 2024-01-01 kuni 2025-12-31?", "frequent_small_payments"),
        ("Mis teenus on läinud kallimaks rohkem kui 10% 2024-01-01 kuni 2025-12-31?",
         "price_rise"),
    ],
)
def test_sample_questions(spark, question, template):
    (row,) = route(spark, question)
    assert row.template_id == TEMPLATE_IDS[template]
    assert (row.date_from, row.date_to) == (date(2024, 1, 1), date(2025, 12, 31))
    wanted = {"top_transactions": ("limit", "10"), "frequent_small_payments": ("max_amount", "15"),
              "price_rise": ("min_change_pct", "10")}.get(template)
    assert wanted is None or row[wanted[0]] == wanted[1]


@pytest.mark.parametrize(
    "text, days",
    [
        ("eelmisel kuul", ("2024-04-01", "2024-04-30")),
        ("sel nädalal", ("2024-05-13", "2024-05-15")),
        ("eelmise nädala ostud", ("2024-05-06", "2024-05-12")),
        ("eile", ("2024-05-14", "2024-05-14")),
        ("eelmine aasta", ("2023-01-01", "2023-12-31")),
        ("mai 2023", ("2023-05-01", "2023-05-31")),
        ("veebruaris", ("2024-02-01", "2024-02-29")),
        ("detsembrikuus 2022?", ("2022-12-01", "2022-12-31")),
        ("maitsev", ("2023-01-01", "2024-04-30")),
        ("midagi", ("2023-01-01", "2024-04-30")),
        ("2024-02-30 ja 2024-03-01", ("2024-03-01", "2024-03-01")),
    ],
)
def test_periods(spark, text, days):
    (row,) = route(spark, text)
    assert (row.date_from.isoformat(), row.date_to.isoformat()) == days
    assert row.template_id is None


def check(spark, reply):
    df = spark.createDataFrame([("q", reply)], "question_id string, reply string")
    parsed = parse_replies(df)
    rows = validate_params(parsed, BOUNDS).collect()
    return parsed.first(), {r.param: r.value for r in rows}, {r.param: r.error for r in rows if r.error}


@pytest.mark.parametrize(
    "reply, problem",
    [
        ('```json\n{"malli_id": "topeltmaksed", "parameetrid": {}}\n```', None),
        ("{ }", "no template fits"),
        ('{"malli_id": "", "parameetrid": {}}', "no template fits"),
        ('{"malli_id": false}', "no template fits"),
        ('{"malli_id": "false"}', "unknown template"),
        ('{"malli_id": 7}', "unknown template"),
        ('{"malli_id": "topeltmaksed", "parameetrid": [1]}', "parameters are not an object"),
        ('{"malli_id": "topeltmaksed", "parameetrid": []}', None),
        ("} {", "no JSON object"),
        ("{'malli_id': 1}", "JSON does not parse"),
        (None, "no JSON object"),
    ],
)
def test_replies(spark, reply, problem):
    assert check(spark, reply)[0].problem == problem


@pytest.mark.parametrize(
    "value, wanted, error",
    [
        ("null", "10", None),
        ("3.9", "3", None),
        ('" 7 "', "7", None),
        ('"1_0"', "10", None),
        ("true", "1", None),
        ('"true"', None, "not a number"),
        ('"5d"', None, "not a number"),
        ("[1]", None, "not a number"),
        ("51", None, "out of range"),
        ("0.5", None, "out of range"),
        ("5e1", "50", None),
    ],
)
def test_numbers(spark, value, wanted, error):
    reply = f'{{"malli_id": "suurimad_kulutused", "parameetrid": {{"limit": {value}}}}}'
    _, values, errors = check(spark, reply)
    assert values["limit"] == wanted and errors.get("limit") == error
    assert values["alates_kuupaev"] == "2023-01-01" and values["kuni_kuupaev"] == "2024-04-30"
    assert values["suund"] == "DESC"


@pytest.mark.parametrize(
    "value, error",
    [("2024-02-29", None), (" 2024-01-01 ", None), ("2023-02-29", "no such day"),
     ("1.1.2024", "not a date"), ("1899-12-31", "out of range"), ("2100-01-01", "out of range")],
)
def test_dates(spark, value, error):
    reply = f'{{"malli_id": "topeltmaksed", "parameetrid": {{"alates_kuupaev": "{value}"}}}}'
    _, values, errors = check(spark, reply)
    assert errors.get("alates_kuupaev") == error
    assert values["alates_kuupaev"] == (None if error else value.strip())


def test_answers(spark, transactions):
    tx = transactions([("a", 5, "2024-01-01"), ("a", 7, "2024-01-03"), ("b", 1, "2024-01-02")])
    template, result = answer_question(spark, tx, "Mis olid 2 väikseimat ostu?", TODAY)
    assert template == "suurimad_kulutused" and [r.tx_id for r in result.collect()] == ["3", "1"]
    template, result = answer_reply(spark, tx, '{"malli_id": "korduvad_maksed"}')
    assert [r.counterparty for r in result.collect()] == ["a"]
    with pytest.raises(ValueError, match="no template fits"):
        answer_question(spark, tx, "Mis ilm on?", TODAY)
    with pytest.raises(ValueError, match="out of range"):
        answer_question(spark, tx, "Näita 99 suurimat ostu", TODAY)


def test_display(spark, transactions):
    tx = transactions([("a", 5, "2024-01-01"), ("a", 7.5, "2024-01-03")])
    order = order_columns("recurring_payments")
    result = recurring_payments(tx)
    assert display_rows(result, order).first().asDict() == {
        "#": "1", "counterparty": "a", "n": "2", "min_amount": "5,00 €", "max_amount": "7,50 €",
        "avg_amount": "6,25 €", "total_amount": "12,50 €", "date_span": "2024-01-01 .. 2024-01-03"}
    assert row_at(result, order, 1).first().counterparty == "a"
    for missing in (0, 2):
        with pytest.raises(ValueError, match="no row"):
            row_at(result, order, missing)
    assert rows_as_json(tx.select("amount", "booking_date").limit(1)).first()[0] == (
        '{"amount":"5.00","booking_date":"2024-01-01"}')


@pytest.mark.parametrize(
    "question, template",
    [
        ("Milline on ilm, tellimus 12?", None),
        ("Kus mu tellimus on?", None),
        ("Palun soovita head raamatut", None),
        ("Mis kell pood avatakse?", None),
        ("Millised tellimused mul jooksevad?", "recurring_payments"),
        ("Kas sama summa läks topelt?", "duplicate_payments"),
    ],
)
def test_labelled_questions(spark, question, template):
    (row,) = route(spark, question)
    assert row.template_id == (template and TEMPLATE_IDS[template])
