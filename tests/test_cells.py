"""Neighbours through cells: the same as by scanning, with less compared."""

import numpy as np
import pytest
from test_vectors import as_lists, brute, frame

from paylens.operators.cells import build_cells, nearest_in_cells, read_cells


def clustered(n=1500, dims=12, clusters=25, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    rows = [(f"v{i:04d}", (centres[i % clusters] + rng.normal(size=dims) * 0.08).astype(np.float32).tolist()) for i in range(n)]
    same = [(f"c{i:04d}", rows[0][1]) for i in range(n // 3)]  # a quarter are one vector
    return rows + same + [("zero", [0.0] * dims), ("none", [0.0] * dims)]


@pytest.fixture(scope="module")
def index(spark):
    return build_cells(frame(spark, clustered()), block_bytes=100 * 96)


@pytest.mark.parametrize("exclude_self", [False, True])
def test_same_as_brute_force(spark, index, exclude_self):
    rows = clustered()
    asked = rows[::7] + rows[-2:]
    count = spark.sparkContext.accumulator(0)
    got = nearest_in_cells(frame(spark, asked, "query_id"), index, 20, exclude_self, compared=count)
    assert as_lists(got) == brute(asked, rows, 20, exclude_self)
    # Under a quarter of all pairs; the queries without a direction meet all rows.
    assert count.value < len(asked) * len(rows) / 4


def test_random_vectors_and_an_index_read_again(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(f"v{i:03d}", rng.normal(size=7).tolist()) for i in range(300)]
    build_cells(frame(spark, rows), str(tmp_path / "cells"), block_bytes=30 * 56)
    got = nearest_in_cells(frame(spark, rows, "query_id"), read_cells(spark, str(tmp_path / "cells")), 5)
    assert as_lists(got) == brute(rows, rows, 5, False)


def test_planning_runs_nothing(spark, index):
    """Queries are first worked out when the result is asked for."""
    from pyspark.sql import functions as F

    failing = frame(spark, clustered()[:5], "query_id").withColumn("query_id", F.raise_error(F.lit("worked out")))
    found = nearest_in_cells(failing, index)
    with pytest.raises(Exception, match="worked out"):
        found.collect()


def test_probes(spark, index):
    rows = clustered()
    asked = rows[:1500:5]
    exact = brute(asked, rows, 10, False)
    count = spark.sparkContext.accumulator(0)
    got = as_lists(nearest_in_cells(frame(spark, asked, "query_id"), index, 10, probes=4, compared=count))
    recall = np.mean([len(set(got[q]) & set(own)) / len(own) for q, own in exact.items()])
    assert recall >= 0.95
    assert count.value < len(asked) * len(rows) / 8


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("a", [1.0, 0.0]), ("a", [0.9, 0.1]), ("b", [0.0, 1.0]), ("x", [inf, 1.0]), ("y", [nan, 1.0]), ("z", [None, 1.0]), ("n", None)]
    index = build_cells(frame(spark, rows))
    asked = frame(spark, [("q", [1.0, 0.0]), ("bad", None)], "query_id")
    assert as_lists(nearest_in_cells(asked, index, 5)) == {"q": ["a", "b"]}
    empty = build_cells(frame(spark, rows[-1:]))
    assert nearest_in_cells(asked, empty, 5).count() == 0
    with pytest.raises(Exception, match="not all of length"):
        build_cells(frame(spark, [("a", [1.0]), ("b", [1.0, 2.0])]))


def test_candidates_do_not_grow_with_blocks(spark, monkeypatch):
    """Of each query a shard gives so many rows as are wanted, however many blocks it visits."""
    from paylens.operators import cells

    rng = np.random.default_rng(9)
    rows = [(f"v{i:03d}", rng.normal(size=16).tolist()) for i in range(400)]
    rows += [(rows[i][0], rng.normal(size=16).tolist()) for i in range(0, 400, 9)]  # ids that occur again
    given, ranked = [], cells.ranked
    monkeypatch.setattr(cells, "ranked", lambda found, k: given.append(found) or ranked(found, k))
    asked, index = frame(spark, rows[:400], "query_id"), build_cells(frame(spark, rows), block_bytes=20 * 128)
    found = nearest_in_cells(asked, index, 5)
    wanted = {q: list(dict.fromkeys(own))[:5] for q, own in brute(rows[:400], rows, 10, False).items()}
    assert index.blocks.count() > 20
    assert given[0].count() <= 400 * 5
    assert as_lists(found) == wanted
    # Several shards, over which the same id may lie.
    monkeypatch.setattr(cells, "SHARD_ROWS", 150)
    assert as_lists(nearest_in_cells(asked, index, 5)) == wanted
    assert given[1].count() <= 400 * 5 * 3


def test_each_query_gives_its_neighbours_once(spark, monkeypatch):
    """A query gives as many rows as are wanted however many shards the index has, ids in several shards included."""
    from paylens.operators import cells

    rng = np.random.default_rng(12)
    rows = [(f"v{i:03d}", rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(rows[i][0], rng.normal(size=8).tolist()) for i in range(0, 300, 5)]
    rows += [("zero", [0.0] * 8)]
    asked = rows[:300:3] + [("none", [0.0] * 8)]
    given, ranked = [], cells.ranked
    monkeypatch.setattr(cells, "ranked", lambda found, k: given.append(found) or ranked(found, k))
    monkeypatch.setattr(cells, "SHARD_ROWS", 80)
    monkeypatch.setattr(cells, "TILE", 16)
    index = build_cells(frame(spark, rows), block_bytes=20 * 64)
    found = as_lists(nearest_in_cells(frame(spark, asked, "query_id"), index, 5))
    assert found == {q: list(dict.fromkeys(own))[:5] for q, own in brute(asked, rows, 10, False).items()}
    assert given[0].count() == len(asked) * 5


def test_far_rows_do_not_widen_the_leaves_of_close_ones():
    from paylens.operators.cells import _leaves

    rng = np.random.default_rng(13)
    points = np.concatenate([rng.normal(size=(3000, 6)), 1000 * rng.normal(size=(30, 6)), np.zeros((2000, 6))]).astype(np.float32)
    leaves = _leaves(points, 100)
    assert sorted(np.concatenate(leaves)) == list(range(len(points)))
    assert max(map(len, leaves)) <= 100
    widths = [np.ptp(points[own], axis=0).max() for own in leaves if (own < 3000).any()]
    assert np.median(widths) < 8
