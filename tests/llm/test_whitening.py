"""Whitening against NumPy over the whole matrix."""

import math
from fractions import Fraction

import numpy as np

from paylens.llm import whitening as W
from paylens.llm.common import read

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, n int, place string"


def compare(rows, vectors, components=W.COMPONENTS):
    """Rows of the operator against the covariance of all vectors (id, entries) worked out at once."""
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in vectors])
    n, sums = len(x), x.sum(axis=0)
    centred = np.array([[float(Fraction(int(a) * n - int(s), n)) for a, s in zip(own, sums)] for own in x])
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1], basis[:, ::-1]
    by = {}
    for r in rows:
        assert r.n == n and abs(r.identity_error) < 1e-8 and str(r.deviation) == r.deviation_exact
        by.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    wanted = {}
    for (i, _), own in zip(vectors, x):
        wanted.setdefault((i, sum((n * int(a) - int(s)) ** 2 for a, s in zip(own, sums))), own)
    assert by.keys() == wanted.keys()
    kept = int((values > W.RANK * values[0]).sum()) if len(values) else 0
    for own in by.values():
        assert sorted(own) == list(range(1, min(components, kept) + 1))
    for c in range(1, min(components, kept) + 1):
        got = np.array([by[k][c].whitened for k in wanted])
        unit = np.array([(wanted[k] - sums / n) @ basis[:, c - 1] / math.sqrt(values[c - 1]) for k in wanted])
        assert min(np.abs(got - unit).max(), np.abs(got + unit).max()) < 1e-6
        assert all(math.isclose(by[k][c].explained, values[c - 1] / values.sum(), rel_tol=1e-9) for k in wanted)


def whitened(spark, vectors, **options):
    rows = [(i, [float(c) for c in v] if v is not None else None, 1, "p") for i, v in vectors]
    return W.whiten(spark.createDataFrame(rows, SCHEMA).repartition(3), **options).collect()


def test_given_table(spark):
    table = read(spark, SF_DIR, "embeddings")
    vectors = [(r.vec_id, r.embedding) for r in table.collect()]
    rows = W.whiten(table, block_rows=64).collect()
    assert len(rows) == 8 * len(vectors)
    compare(rows, vectors)


def test_blocks_that_do_not_come_out_even(spark):
    rng = np.random.default_rng(1)
    mixed = rng.normal(size=(101, 11)) @ rng.normal(size=(11, 11)) + 5
    vectors = [(i, v) for i, v in enumerate(mixed)]
    compare(whitened(spark, vectors, block_rows=7), vectors)
    compare(whitened(spark, vectors, block_rows=1000), vectors)
    compare(whitened(spark, vectors, components=3, block_rows=16), vectors, 3)


def test_fewer_components_than_asked(spark):
    rng = np.random.default_rng(2)
    flat = rng.integers(-5, 6, size=(60, 2)) @ rng.integers(-4, 5, size=(2, 9))
    narrow = [(i, v) for i, v in enumerate(rng.normal(size=(50, 3)))]
    compare(whitened(spark, narrow), narrow)
    assert {r.component for r in whitened(spark, [(i, v) for i, v in enumerate(flat)])} == {1, 2}
    assert whitened(spark, [(1, [1.0, 2.0])]) == []
    assert whitened(spark, [(i, [1.0, 2.0]) for i in range(5)]) == []


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    whole = [(i, v) for i, v in enumerate(rng.normal(size=(40, 4)))]
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(c) for c in v], 1, "p") for i, v in whole]
    odd = [(50, None, 1, "p"), (51, [1.0, None, 1.0, 1.0], 1, "p"), (52, [nan] * 4, 1, "p"), (53, [1.0, 1.0, 1.0, -inf], 1, "p")]
    compare(W.whiten(spark.createDataFrame(rows + odd, SCHEMA)).collect(), whole)
    assert W.whiten(spark.createDataFrame(odd, SCHEMA)).collect() == []
    assert W.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    # A repeated row, a null id and a shorter vector all count.
    more = whole + [whole[3], (None, [1.0, 2.0, 3.0, 4.0]), (60, [0.5, 0.5])]
    got = whitened(spark, more)
    assert len(got) == 4 * len(more) and sum(r.vec_id is None for r in got) == 4
    compare(got, more[:-1] + [(60, [0.5, 0.5, 0.0, 0.0])])


def test_deviations_beyond_64_bits():
    x = np.array([[100_000 + 2_000, 99_000], [98_000, 100_500]])
    sums = x.sum(axis=0) * 10**8
    n = 2 * 10**8
    assert W.deviations(x, sums, n) == [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, sums)) for r in x]
    assert W.deviations(x, sums, n)[0] > 1 << 63
    huge = x * (1 << 45)
    assert W.deviations(huge, huge.sum(axis=0), 2) == [
        sum((2 * int(a) - int(s)) ** 2 for a, s in zip(r, huge.sum(axis=0))) for r in huge
    ]
