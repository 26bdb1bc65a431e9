from datetime import date, datetime
from decimal import Decimal, InvalidOperation

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paylens.fixed_values import REQUIRED_HEADERS, STATEMENT_HEADERS
from paylens.functions.letters import letter_profile
from paylens.plans.prepare import build_index, fill_search_text, load_statements, prepare
from paylens.sources.statements import check_statements, is_valid, read_statements, valid_rows
from paylens.sources.tables import path_exists, write_if_absent

HEADER = ";".join(STATEMENT_HEADERS)
ROW = '{id};01.02.2024;;Pood;1,50;;ost;EUR'


def write(tmp_path, *lines, name="s.csv", start="﻿"):
    path = tmp_path / name
    path.write_text(start + "\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_scan(spark, tmp_path):
    path = write(
        tmp_path, HEADER, "",
        'a;1.2.2024;EE1;"Pood; ""Kesk""";-1,50;;"rida\nteine";EUR',
        "b;02.02.2024;  ;Buss;2.5",
        "",
    )
    checked = check_statements(read_statements(spark, path)).orderBy("tx_id").collect()
    first, short = checked
    assert first.errors == [] and first.counterparty == 'Pood; "Kesk"'
    assert first.description == "rida\nteine" and first.amount == Decimal("-1.50")
    assert first.booking_date == date(2024, 2, 1) and first.counterparty_account == "EE1"
    assert short.errors == ["SELGITUS missing", "VALUUTA missing"]
    assert short.counterparty_account is None


def test_missing_and_further_headers(spark, tmp_path):
    path = write(tmp_path, "muu;SELGITUS;tehingu_id", "x;ost;1")
    row = check_statements(read_statements(spark, path)).first()
    assert row.description == "ost" and "TEHINGU_ID missing" in row.errors


def reference_row(fields):
    """The rules in plain Python: None for a row that must be rejected."""
    text = {h: (fields[h] or "").strip() for h in STATEMENT_HEADERS}
    if any(not text[h] for h in REQUIRED_HEADERS):
        return None
    try:
        day = datetime.strptime(text["KUUPÄEV"], "%d.%m.%Y").date()
        amount = Decimal(text["SUMMA"].replace(",", "."))
    except (ValueError, InvalidOperation):
        return None
    if not amount.is_finite() or abs(amount) >= Decimal(10) ** 16:
        return None
    return day, amount.quantize(Decimal("0.01"), rounding="ROUND_HALF_UP"), text["SELGITUS"]


PIECE = st.sampled_from(["", " ", "\xa0", "\x1c", "a", "õ", "\t"])
FIELDS = st.fixed_dictionaries(
    {h: st.lists(PIECE, max_size=4).map("".join) for h in STATEMENT_HEADERS}
    | {
        "KUUPÄEV": st.sampled_from(
            ["1.2.2024", "31.12.2023", "31.2.2024", "2024-01-01", " 05.06.2024 ", "1.2.24", ""]),
        "SUMMA": st.sampled_from(
            ["1,5", "1.005", "-2", "1e3", "1_0", "x", " 7 ", "1.2.3", "NaN", "Infinity", "1e20", ".5"]),
    }
)


@settings(max_examples=5, deadline=None)
@given(st.lists(FIELDS, min_size=60, max_size=80))
def test_cleaning_follows_the_rules(spark, rows):
    ddl = ", ".join(f"`{h}` string" for h in STATEMENT_HEADERS)
    df = spark.createDataFrame(
        [(i, *[r[h] for h in STATEMENT_HEADERS]) for i, r in enumerate(rows)], f"i int, {ddl}"
    ).coalesce(1)
    got = check_statements(df).collect()
    for fields, row in zip(rows, got):
        wanted = reference_row(fields)
        assert (row.errors == []) == (wanted is not None), fields
        if wanted:
            assert (row.booking_date, row.amount, row.description) == wanted
    checked = check_statements(df)
    assert checked.where(is_valid() != (F.size("errors") == 0)).count() == 0


def test_load_replaces_only_when_right(spark, tmp_path):
    base, table = str(tmp_path / "base"), "load_test"
    good = write(tmp_path, HEADER, ROW.format(id="a"), ROW.format(id="b"))
    report = load_statements(spark, good, base, table)
    assert (report.rows, report.rejects, spark.table(table).count()) == (2, 0, 2)

    bad = write(tmp_path, HEADER, ROW.format(id="c"), "d;31.02.2024;;Pood;x;;ost;EUR", name="b.csv")
    with pytest.raises(ValueError, match="1 rows rejected"):
        load_statements(spark, bad, base, table)
    with pytest.raises(ValueError, match="empty"):
        load_statements(spark, write(tmp_path, HEADER, name="e.csv"), base, table)
    twice = write(tmp_path, HEADER, ROW.format(id="c"), ROW.format(id="c"), name="t.csv")
    with pytest.raises(ValueError, match="repeated"):
        load_statements(spark, twice, base, table)
    assert {r.tx_id for r in spark.table(table).collect()} == {"a", "b"}

    report = load_statements(spark, bad, base, table, strict=False)
    assert (report.rows, report.rejects) == (1, 1)
    assert [r.tx_id for r in spark.table(table).collect()] == ["c"]


def test_search_text_and_index(spark, tmp_path):
    base, tx, vec = str(tmp_path / "base"), "fill_test", "fill_vectors"
    load_statements(spark, write(tmp_path, HEADER, ROW.format(id="a")), base, tx)
    with pytest.raises(ValueError, match="search text"):
        build_index(spark, tx, vec, base, letter_profile)
    assert fill_search_text(spark, tx, base) == 1
    assert spark.table(tx).first().search_text == "pood ost"
    assert fill_search_text(spark, tx, base) == 0
    assert build_index(spark, tx, vec, base, letter_profile) == 1
    load_statements(
        spark, write(tmp_path, HEADER, ROW.format(id="b"), name="n.csv"), base, tx,
        with_search_text=True)
    assert build_index(spark, tx, vec, base, letter_profile) == 1
    assert {r.tx_id for r in spark.table(vec).collect()} == {"a", "b"}


def test_prepare_takes_what_is_there(spark, tmp_path):
    path = write(tmp_path, HEADER, ROW.format(id="a"))
    for _ in range(2):
        prepare(spark, path, str(tmp_path / "base"), letter_profile, "prep_tx", "prep_vec")
    assert spark.table("prep_tx").count() == spark.table("prep_vec").count() == 1
    assert len(list((tmp_path / "base").iterdir())) == 2


def test_write_if_absent(spark, tmp_path):
    path = str(tmp_path / "t")
    assert not path_exists(spark, path)
    write_if_absent(spark.range(3), path)
    write_if_absent(spark.range(5), path)
    assert path_exists(spark, path) and spark.read.parquet(path).count() == 3


def test_valid_rows_have_the_table_shape(spark, tmp_path):
    from paylens.schema import TRANSACTIONS

    checked = check_statements(read_statements(spark, write(tmp_path, HEADER, ROW.format(id="a"))))
    assert valid_rows(checked).dtypes == [
        (f.name, f.dataType.simpleString()) for f in TRANSACTIONS.fields]


def test_files_with_other_headers(spark, tmp_path):
    """Columns go by name, whatever their order in each file."""
    (tmp_path / "a.csv").write_text(
        "TEHINGU_ID;KUUPÄEV;SAAJA_MAKSJA_NIMI;SUMMA;SELGITUS;VALUUTA\n1;1.2.2024;Pood;5;leib;EUR\n", "utf-8-sig"
    )
    (tmp_path / "b.csv").write_text(
        "VALUUTA;SELGITUS;SAAJA_MAKSJA_NIMI;TEHINGU_ID;SUMMA;KUUPÄEV;VIITENUMBER\nEUR;sai;Kohvik;2;6,5;2.2.2024;77\n", "utf-8"
    )
    rows = valid_rows(check_statements(read_statements(spark, str(tmp_path)))).orderBy("tx_id").collect()
    got = [(r.tx_id, r.counterparty, r.description, str(r.amount), r.reference_no) for r in rows]
    assert got == [("1", "Pood", "leib", "5.00", None), ("2", "Kohvik", "sai", "6.50", "77")]


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    """Quoted line breaks, doubled quotes and separators, across splits and chunks of any size."""
    import csv
    import io
    import random

    rng = random.Random(9)
    parts = ["a", "b;", '"', "\n", "\n\n", "x\r\ny", "õ", " ", ";;", '""', "pikk " * 30]
    rows = [
        [str(i), "1.2.2024", "".join(rng.choice(parts) for _ in range(rng.randrange(6))), "Pood", "1,5", "",
         "".join(rng.choice(parts) for _ in range(rng.randrange(8))), "EUR"]
        for i in range(400)
    ]
    rows[200][6] = "rida\n" * 3000  # longer than a split
    out = io.StringIO()
    writer = csv.writer(out, delimiter=";", lineterminator="\r\n")
    writer.writerows([list(STATEMENT_HEADERS), *rows])
    path = tmp_path / "one.csv"
    path.write_text("﻿" + out.getvalue(), encoding="utf-8", newline="")
    wanted = sorted(tuple(r) for r in csv.reader(io.StringIO(out.getvalue(), newline=""), delimiter=";"))
    wanted.remove(tuple(STATEMENT_HEADERS))
    for size, chunk in (("2k", 700), ("3k", 1 << 20), ("128m", 500)):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            lines = spark.read.text(str(path))
            assert size == "128m" or lines.rdd.getNumPartitions() > 8
            got = sorted(tuple(c or "" for c in r) for r in read_statements(spark, str(path), chunk).collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert got == wanted


def test_quotes_without_a_match(spark, tmp_path):
    path = write(tmp_path, HEADER, ROW.format(id='"a'), ROW.format(id="b"))
    with pytest.raises(ValueError, match="quotes without a match.*s.csv"):
        read_statements(spark, path)


def test_files_without_rows(spark, tmp_path):
    assert read_statements(spark, write(tmp_path, HEADER)).count() == 0
    (tmp_path / "empty.csv").write_text("", "utf-8")
    assert read_statements(spark, str(tmp_path / "empty.csv")).count() == 0
