import numpy as np
import pytest
from pyspark.sql import functions as F

from paylens.functions.letters import encode_letters, letter_profile
from paylens.operators import encode, similar, vectors
from paylens.operators.vectors import cosine_distance, nearest, ranked
from paylens.sources.tables import upsert_vectors

VECTORS = "tx_id string, embedding array<float>"


def frame(spark, rows, key="tx_id", parts=3):
    df = spark.createDataFrame(rows, f"{key} string, embedding array<float>")
    return df.repartition(parts)


def brute(queries, corpus, k, exclude_self):
    out = {}
    for q, v in queries:
        v = np.array(v, dtype=np.float64)
        found = []
        for i, w in corpus:
            w = np.array(w, dtype=np.float64)
            norm = np.sqrt(v @ v) * np.sqrt(w @ w)
            d = 1.0 - (v @ w / norm if norm else 0.0)
            if not (exclude_self and i == q):
                found.append((max(round(d, 9), 0.0), i))
        out[q] = [i for _, i in sorted(found)[:k]]
    return out


def as_lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append(r.tx_id)
    return out


@pytest.fixture
def sample():
    rng = np.random.default_rng(7)
    rows = [(f"v{i:03d}", rng.integers(-3, 4, 5).astype(float).tolist()) for i in range(90)]
    copies = [(f"c{i:03d}", rows[0][1]) for i in range(45)]  # a third are one vector
    return rows + copies + [("zero", [0.0] * 5)]


@pytest.mark.parametrize("exclude_self", [False, True])
@pytest.mark.parametrize("many", [False, True])
def test_nearest_is_brute_force(spark, sample, monkeypatch, many, exclude_self):
    if many:
        monkeypatch.setattr(vectors, "BROADCAST_QUERIES", 3)
    got = nearest(frame(spark, sample, "query_id"), frame(spark, sample), 20, exclude_self)
    assert as_lists(got) == brute(sample, sample, 20, exclude_self)


def test_nearest_over_many_batches(spark, sample):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = as_lists(nearest(frame(spark, sample, "query_id"), frame(spark, sample, parts=1), 20))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(sample, sample, 20, False)


def test_more_wanted_than_there_are(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 1.0])]
    got = nearest(frame(spark, rows, "query_id"), frame(spark, rows), 20, exclude_self=True)
    assert as_lists(got) == {"a": ["b"], "b": ["a"]}


def test_no_queries_no_vectors(spark):
    rows = [("a", [1.0, 0.0]), ("n", None)]
    corpus = frame(spark, rows)
    assert nearest(frame(spark, [("n", None)], "query_id"), corpus).count() == 0
    assert nearest(corpus.where("false").withColumnRenamed("tx_id", "query_id"), corpus).count() == 0
    assert as_lists(nearest(frame(spark, rows, "query_id"), corpus)) == {"a": ["a"]}


def test_lengths_must_agree(spark):
    with pytest.raises(Exception, match="not all of length"):
        nearest(frame(spark, [("q", [1.0, 0.0])], "query_id"), frame(spark, [("a", [1.0])])).collect()


def test_same_distance_as_the_expression(spark, sample):
    corpus = frame(spark, sample)
    queries = frame(spark, sample[:5], "query_id")
    got = nearest(queries, corpus, 200)
    pairs = got.join(corpus, "tx_id").join(queries.withColumnRenamed("embedding", "q"), "query_id")
    off = pairs.where(F.abs(cosine_distance(F.col("q"), F.col("embedding")) - F.col("distance")) > 2e-9)
    assert pairs.count() == 5 * len(sample) and off.count() == 0


def test_repeated_candidates_are_merged(spark):
    rows = [("q", "a", 0.2), ("q", "a", 0.1), ("q", "b", 0.15), ("q", "c", 0.3)]
    df = ranked(spark.createDataFrame(rows, "query_id string, tx_id string, distance double"), 2)
    assert as_lists(df) == {"q": ["a", "b"]}


def test_upsert(spark):
    old = frame(spark, [("a", [1.0]), ("b", [2.0])])
    new = frame(spark, [("b", [3.0]), ("c", [4.0])])
    got = {r.tx_id: r.embedding for r in upsert_vectors(old, new).collect()}
    assert got == {"a": [1.0], "b": [3.0], "c": [4.0]}


def test_distinct_texts_are_encoded_alike(spark):
    rows = [(str(i), t) for i, t in enumerate(["kohv", "buss kohv", "kohv", " ", None, "kohv"])]
    tx = spark.createDataFrame(rows, "tx_id string, search_text string")
    batch = encode.batch_encoder(lambda: encode_letters)
    frames = [
        encode.build_vectors(tx, letter_profile, distinct=False),
        encode.build_vectors(tx, letter_profile),
        encode.build_vectors(tx, batch, tasks=3),
    ]
    results = [{r.tx_id: r.embedding for r in f.collect()} for f in frames]
    assert sorted(results[0]) == ["0", "1", "2", "5"]
    assert results[0] == results[1] == results[2]


def test_follow_up(spark, transactions):
    tx = transactions(
        [("Kohvik", 3, "2024-01-01"), ("Kohvik", 4, "2024-01-02"), ("Buss", 2, "2024-01-03")], ""
    ).withColumn("search_text", F.lower("counterparty"))
    stored = encode.build_vectors(tx, letter_profile)
    by_id = similar.similar_by_id(tx.where("tx_id = '1'"), stored, tx)
    assert [r.tx_id for r in by_id.orderBy("rank").collect()] == ["2", "3"]
    names = spark.createDataFrame([(" Kohvik ",), ("123",), ("kohvik",)], "counterparty string")
    by_name = similar.similar_by_name(names, stored, tx, letter_profile, k=2)
    assert {(r.query_id, r["rank"], r.tx_id) for r in by_name.collect()} == {
        ("Kohvik", 1, "1"), ("Kohvik", 2, "2"), ("kohvik", 1, "1"), ("kohvik", 2, "2")}
    assert [tuple(r) for r in similar.name_problems(names).collect()] == [
        ("123", "nothing left of the name")]
    ids = spark.createDataFrame([("1",), ("9",)], "tx_id string")
    assert [tuple(r) for r in similar.source_problems(ids, tx).collect()] == [
        ("9", "no such transaction")]


@pytest.mark.parametrize("many", [False, True])
def test_repeated_ids_and_unusable_vectors(spark, monkeypatch, many):
    if many:
        monkeypatch.setattr(vectors, "BROADCAST_QUERIES", 0)
    inf, nan = float("inf"), float("nan")
    rows = [("a", [1.0, 0.1]), ("a", [1.0, 0.0]), ("a", [1.0, 0.05]), ("a", [1.0, 0.2]), ("a", [1.0, 0.3]),
            ("b", [0.9, 0.5]), ("c", [0.5, 0.9]), ("x", [inf, 1.0]), ("y", [nan, 1.0]), ("z", [None, 1.0]), ("n", None)]
    corpus = spark.createDataFrame(rows, "tx_id string, embedding array<double>")
    queries = spark.createDataFrame([("q", [1.0, 0.0]), ("bad", [inf, 0.0])], "query_id string, embedding array<double>")
    got = [(r.query_id, r.tx_id, r.rank) for r in nearest(queries, corpus, 2).orderBy("rank").collect()]
    assert got == [("q", "a", 1), ("q", "b", 2)]
    pairs = corpus.withColumn("d", cosine_distance(F.col("embedding"), F.array(F.lit(1.0), F.lit(0.0))))
    assert {r.tx_id for r in pairs.where("d IS NULL").collect()} == {"x", "y", "z", "n"}
