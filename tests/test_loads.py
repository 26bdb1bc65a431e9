"""Loading by content, sketches of ids, states that add up, and the layout by month."""

import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from paylens.fixed_values import STATEMENT_HEADERS
from paylens.operators import levels, payments
from paylens.operators.filters import in_period
from paylens.operators.periods import dataset_period
from paylens.sources import loads, months, sketches

HEADER = ";".join(STATEMENT_HEADERS)


def put(folder, name, *rows):
    """A file of (id, day, counterparty, amount) rows."""
    lines = [f'{i};{day};;"{who}";{amount};;ost;EUR' for i, day, who, amount in rows]
    (folder / name).write_text("\n".join([HEADER, *lines]) + "\n", "utf-8")


def ids(spark, base):
    return sorted(r.tx_id for r in loads.loaded_rows(spark, base).collect())


@pytest.fixture
def files(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        put(folder, f"f {k}%.csv", (f"a{k}", "1.2.2024", "Pood", "1,5"), (f"b{k}", "2.2.2024", "Buss", k))
    return folder


def test_only_new_and_changed_files_are_read(spark, tmp_path, files, monkeypatch):
    base, paths = str(tmp_path / "base"), str(files)
    assert loads.load_files(spark, paths, base) == loads.Loaded(3, 0, 6, 0)
    asked = []
    read = loads.read_statements
    monkeypatch.setattr(loads, "read_statements", lambda s, p, **k: asked.append(p) or read(s, p, **k))
    assert loads.load_files(spark, paths, base) == loads.Loaded(0, 3, 0, 0) and asked == []

    put(files, "g.csv", ("c", "3.2.2024", "Pood", "7"))
    assert loads.load_files(spark, paths, base) == loads.Loaded(1, 3, 1, 0)
    assert [os.path.basename(p) for p in asked.pop()] == ["g.csv"]
    assert ids(spark, base) == ["a0", "a1", "a2", "b0", "b1", "b2", "c"]

    # Another time, but the same lines; and other lines, of the same size.
    os.utime(files / "g.csv", (1, 1))
    assert loads.load_files(spark, paths, base) == loads.Loaded(0, 4, 0, 0)
    put(files, "g.csv", ("d", "3.2.2024", "Pood", "8"))
    assert loads.load_files(spark, paths, base) == loads.Loaded(1, 3, 1, 0)
    os.remove(files / "f 0%.csv")
    assert loads.load_files(spark, paths, base) == loads.Loaded(0, 3, 0, 0)
    assert ids(spark, base) == ["a1", "a2", "b1", "b2", "d"]
    row = loads.loaded_rows(spark, base).where("tx_id = 'd'").first()
    assert row.search_text == "pood ost" and str(row.amount) == "8.00"


def test_a_failed_load_changes_nothing(spark, tmp_path, files):
    base, paths = str(tmp_path / "base"), str(files)
    loads.load_files(spark, paths, base)
    put(files, "bad.csv", ("x", "31.2.2024", "Pood", "1"), ("y", "1.2.2024", "Pood", "1"))
    with pytest.raises(ValueError, match="1 rows rejected"):
        loads.load_files(spark, paths, base)
    put(files, "bad.csv", ("x", "1.2.2024", "Pood", "1"), ("x", "1.2.2024", "Pood", "1"))
    with pytest.raises(ValueError, match="repeated.*x"):
        loads.load_files(spark, paths, base)
    assert len(ids(spark, base)) == 6
    put(files, "bad.csv", ("x", "31.2.2024", "Pood", "1"), ("y", "1.2.2024", "Pood", "1"))
    assert loads.load_files(spark, paths, base, strict=False) == loads.Loaded(1, 3, 1, 1)
    for f in files.iterdir():
        f.write_text(HEADER + "\n", "utf-8")
    with pytest.raises(ValueError, match="empty"):
        loads.load_files(spark, paths, base)
    assert len(ids(spark, base)) == 7


def test_ids_against_many_old_loads(spark, tmp_path, files, monkeypatch):
    base, paths = str(tmp_path / "base"), str(files)
    loads.load_files(spark, paths, base)
    looked = []
    old_ids = loads._old_ids
    monkeypatch.setattr(loads, "_old_ids", lambda *a: looked.append(1) or old_ids(*a))
    for k in range(5):
        put(files, f"h{k}.csv", *[(f"n{k}-{j}", "1.3.2024", "Pood", "1") for j in range(20)])
        loads.load_files(spark, paths, base)
    assert looked == []  # no new id looked like an old one, so no old ids were read
    put(files, "again.csv", ("n3-7", "1.3.2024", "Pood", "1"), ("new", "1.3.2024", "Pood", "1"))
    with pytest.raises(ValueError, match="repeated.*n3-7"):
        loads.load_files(spark, paths, base)
    assert looked == [1]


def test_sketches(spark):
    made = [sketches.sketch(spark.range(a, a + 3000).selectExpr("CAST(id AS STRING) AS tx_id")) for a in (0, 10_000)]
    asked = spark.range(20_000).selectExpr("CAST(id AS STRING) AS tx_id")
    found = {int(r.tx_id) for r in sketches.may_hold(made[0].union(made[1]), asked).collect()}
    assert found >= {*range(3000), *range(10_000, 13_000)} and len(found) < 6100


def test_states_add_up(spark, transactions):
    """The four queries from the states of parts are those of the whole."""
    import random

    rng = random.Random(2)
    rows = [
        (f"p{rng.randrange(12)}", rng.choice([10, 10, 12.5, 15, -3, 99.99]), f"2024-0{rng.randrange(1, 7)}-1{rng.randrange(3)}")
        for _ in range(900)
    ]
    tx = transactions(rows)
    parts = [levels.levels(tx.where(F.col("tx_id") % 3 == k)) for k in range(3)]
    state = levels.merged(parts[0].union(parts[1]).union(parts[2]))
    period = {"date_from": date(2024, 2, 11), "date_to": date(2024, 5, 12)}
    for extra in ({}, period):
        for name, (query, kind) in payments.QUERIES.items():
            if name == "top_transactions":
                continue
            given = {"max_amount": 20.0} if name == "frequent_small_payments" else {}
            p = kind(**extra, **given)
            got = [tuple(r) for r in getattr(levels, name)(state, p).collect()]
            wanted = [tuple(r) for r in query(tx, p).collect()]
            assert got == wanted and (got or name == "price_rise"), name


def test_states_of_loads(spark, tmp_path, files):
    base = str(tmp_path / "base")
    for k in range(3):
        put(files, f"more{k}.csv", *[(f"m{k}-{j}", f"{1 + j % 5}.3.2024", "Pood", j % 4) for j in range(40)])
        loads.load_files(spark, str(files), base)
    state, rows = loads.loaded_levels(spark, base), loads.loaded_rows(spark, base)
    assert rows.count() == 126
    got = levels.recurring_payments(state).collect()
    assert got == payments.recurring_payments(rows).collect() and len(got) == 2


def test_months(spark, transactions, tmp_path):
    tx = transactions([(f"p{k}", k, f"20{20 + k % 3}-0{1 + k % 9}-{10 + k % 18}") for k in range(300)])
    path = str(tmp_path / "m")
    months.write_by_month(tx, path)
    table = months.read_by_month(spark, path)
    a, b = date(2020, 12, 5), date(2021, 3, 12)
    some = in_period(table, a, b)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(booking_month" in plan and "booking_month" not in plan.split("PushedFilters")[1].split("\n")[0]
    assert sorted(r.tx_id for r in some.collect()) == sorted(r.tx_id for r in in_period(tx, a, b).collect())
    assert months.stored_period(spark, path).collect() == dataset_period(tx).collect()
    # The files of the months between the first and the last are not looked at.
    folders = sorted(os.listdir(path))
    inner = [f for f in folders if f.startswith("booking_month=")][1:-1]
    assert len(inner) > 5
    for f in inner:
        for name in os.listdir(os.path.join(path, f)):
            if name.endswith(".parquet"):
                with open(os.path.join(path, f, name), "wb") as out:
                    out.write(b"not a file of rows")
    assert months.stored_period(spark, path).collect() == dataset_period(tx).collect()
    months.write_by_month(tx.where("false"), str(tmp_path / "none"))


def test_merged_states_are_dealt_to_bounded_tasks(spark, transactions, monkeypatch):
    """The more rows states have, the more tasks add them up; the sums are the same."""
    rows = [(f"firma {i % 9}", 1 + i % 5, f"2024-01-{1 + i % 28:02d}") for i in range(400)]
    part = levels.levels(transactions(rows))
    states = part.unionByName(part)
    monkeypatch.setattr(levels, "TASK_ROWS", 50)
    dealt = levels.merged(states, states.count())
    assert sorted(dealt.collect()) == sorted(levels.merged(states).collect())
    assert dealt.rdd.getNumPartitions() >= states.count() / 50 > 8
    assert sorted(levels.price_rise(dealt).collect()) == sorted(levels.price_rise(levels.merged(states)).collect())
