"""Exact top-k inner products against all scores."""

import math
import random

import numpy as np
import pytest

from paylens.llm import topk as T

SCHEMA = "vec_id long, embedding array<float>, label int, x int, pivot string"


def brute(rows, modulus, k):
    """All scores, for the vectors that are whole."""
    whole = [
        (i, [math.floor(T.SCALE * float(np.float32(c))) for c in v])
        for i, v, *_ in rows
        if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)
    ]
    out = []
    for q, x in whole:
        if q % modulus == 0:
            scored = [(-sum(a * b for a, b in zip(x, y)), i) for i, y in whole if i != q]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def found(spark, rows, modulus=5, k=T.K, **options):
    vectors = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in T.exact_top_k(vectors, modulus, k, **options).collect())


def row(i, v):
    return i, [float(c) for c in v] if v is not None else None, 1, 2, "clash"


def test_random_and_clustered(spark):
    rng = np.random.default_rng(3)
    random_rows = [row(i, v) for i, v in enumerate(rng.normal(size=(400, 8)))]
    assert found(spark, random_rows, block_bytes=40 * 64) == brute(random_rows, 5, T.K)
    centres = rng.normal(size=(12, 8)) * 20
    clustered = [row(i, centres[i % 12] + rng.normal(size=8) * 0.1) for i in range(1200)]
    count = spark.sparkContext.accumulator(0)
    assert found(spark, clustered, block_bytes=40 * 64, compared=count) == brute(clustered, 5, T.K)
    # Bounds leave out most of the pairs between blocks.
    assert 0 < count.value < 1200 * 240 / 4


def test_one_vector_in_most_rows(spark):
    """Ties go by id; the equal rows are dealt to several blocks."""
    rng = np.random.default_rng(4)
    same = rng.normal(size=6)
    rows = [row(i, same if i % 3 else rng.normal(size=6)) for i in range(600)]
    random.Random(1).shuffle(rows)
    assert found(spark, rows, block_bytes=30 * 48) == brute(rows, 5, T.K)


def test_norms_far_apart_and_large_numbers(spark):
    rng = np.random.default_rng(5)
    rows = [row(i, rng.normal(size=5) * 10.0 ** rng.integers(-3, 4)) for i in range(300)]
    assert found(spark, rows, block_bytes=20 * 40, k=7) == brute(rows, 5, 7)
    large = [row(i, rng.integers(-(1 << 20), 1 << 20, size=4)) for i in range(40)]
    assert found(spark, large) == brute(large, 5, T.K)
    with pytest.raises(Exception, match="too large|int64|Overflow|too big"):
        found(spark, [row(i, [1e15, 1e15]) for i in range(8)])
    with pytest.raises(Exception, match="beyond 62 bits"):
        found(spark, [row(i, [1e30]) for i in range(8)])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [row(i, [i, 1, -i]) for i in range(7)]
    rows += [row(10, None), (15, [1.0, None, 2.0], 1, 2, "n"), row(20, [nan, 0, 0]), row(25, [inf, 0, 0]), row(None, [9, 9, 9])]
    rows += [row(30, []), row(35, [2]), row(6, [6, 1, -6]), row(35, [2])]
    got = found(spark, rows)
    assert got == brute(rows, 5, T.K)
    assert {q for q, *_ in got} == {0, 5, 30, 35}
    assert found(spark, rows[:2]) == brute(rows[:2], 5, T.K) and len(found(spark, rows[:2])) == 1
    assert found(spark, rows[:1]) == [] and found(spark, []) == [] and found(spark, [row(10, None)]) == []
