"""The vector table in buckets."""

import os

import pytest
from pyspark.sql import functions as F

from paylens.sources.buckets import bucket_of, point_view, read_vectors, upsert_buckets
from test_vectors import frame


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet") and "manifest" not in d}


def rows(spark, path):
    return {r.tx_id: r.embedding for r in read_vectors(spark, path).collect()}


def test_one_row_rewrites_one_bucket(spark, tmp_path):
    path = str(tmp_path / "v")
    first = [(f"t{i}", [float(i), 1.0]) for i in range(500)]
    done = upsert_buckets(frame(spark, first), path, buckets=16)
    assert (done.rows, done.buckets) == (500, 16)
    point_view(spark, "bucket_view", path)
    before = files(path)
    touched = spark.range(1).select(bucket_of_literal("t7")).first()[0]
    done = upsert_buckets(frame(spark, [("t7", [9.0, 9.0])]), path)
    assert (done.rows, done.buckets) == (1, 1)
    new = files(path) - before
    assert files(path) >= before and len(new) == 1 and f"bucket={touched}/" in new.pop()
    assert rows(spark, path) == dict(first) | {"t7": [9.0, 9.0]}
    # The view gives what it was pointed at until it is pointed again.
    assert {r.tx_id: r.embedding for r in spark.table("bucket_view").collect()} == dict(first)
    point_view(spark, "bucket_view", path)
    assert {r.tx_id: r.embedding for r in spark.table("bucket_view").collect()} == rows(spark, path)
    spark.sql("DROP VIEW bucket_view")


def bucket_of_literal(tx_id):
    from pyspark.sql import functions as F

    return bucket_of(F.lit(tx_id), 16)


def test_odd_batches(spark, tmp_path):
    path = str(tmp_path / "v")
    with pytest.raises(FileNotFoundError):
        read_vectors(spark, path)
    assert upsert_buckets(frame(spark, [(None, [1.0])]), path).rows == 0
    with pytest.raises(FileNotFoundError):
        read_vectors(spark, path)
    assert upsert_buckets(frame(spark, [("a", [1.0]), ("a", [2.0]), ("b", None)]), path, 4).rows == 2
    once = rows(spark, path)
    assert once["a"] in ([1.0], [2.0]) and once["b"] is None and len(once) == 2
    assert upsert_buckets(frame(spark, [("c", [3.0])]).where("false"), path).buckets == 0
    # Another number of buckets does not change the table's.
    upsert_buckets(frame(spark, [("c", [3.0]), ("b", [4.0])]), path, 9)
    assert rows(spark, path) == once | {"b": [4.0], "c": [3.0]}


def test_a_failed_batch_changes_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    path = str(tmp_path / "v")
    upsert_buckets(frame(spark, [("a", [1.0])]), path, 4)
    bad = frame(spark, [("a", [2.0])]).withColumn("embedding", F.raise_error(F.lit("no")).cast("array<float>"))
    with pytest.raises(Exception):
        upsert_buckets(bad, path)
    assert rows(spark, path) == {"a": [1.0]}


def _tables(spark, folder):
    docs = [(i, f"Dokument {i} ülekanne Tartu") for i in range(30)] + [(30, None), (31, "12 34")]
    parts = [(i, f"nimi {i}", "liik", "mark", 1.0) for i in range(20, 40)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string, p_brand string, p_retailprice double").write.parquet(
        f"{folder}/part.parquet"
    )
    return str(folder)


def test_each_document_is_encoded_once(spark, tmp_path, monkeypatch):
    """However often a table of buckets asks for its vector."""
    from paylens.plans import registered

    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<float>")
    def counted(text):
        seen.add(1)
        return [1.0, float(len(text))]

    monkeypatch.setattr(registered, "letter_profile", lambda text: counted(text))
    rows = registered.bucketed_upsert(spark, _tables(spark, tmp_path)).groupBy("tx_id").count().collect()
    assert {r.tx_id for r in rows} == {str(i) for i in range(40)}
    assert seen.value == 30 + 20


def test_a_document_is_normalised_once(spark, tmp_path, capsys):
    from paylens.plans import registered

    registered._document_vectors(spark, _tables(spark, tmp_path)).explain()
    assert capsys.readouterr().out.count("regexp_replace(") == 1
