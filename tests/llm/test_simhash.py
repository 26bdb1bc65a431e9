"""SimHash, its tree and the components against brute force."""

import re

import numpy as np
import xxhash

from paylens.llm import simhash as S
from paylens.llm.common import read

SF_DIR = "/root/testdata/sf0.001"


def slow_simhash(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    """Component of each (id, fingerprint) row by comparing all pairs."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if bin(a ^ rows[j][1]).count("1") <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(k, least.get(find(i), k))
    return {k: least[find(i)] for i, (k, _) in enumerate(rows)}


def unsigned(x):
    return x % (1 << 64)


def test_documents(spark):
    docs = read(spark, SF_DIR, "documents")
    got = S.near_duplicates(docs).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert {r.doc_id: unsigned(r.fp) for r in got} == {k: slow_simhash(t) for k, t in texts.items()}
    expected = brute([(r.doc_id, unsigned(r.fp)) for r in got])
    assert {r.doc_id: r.component_id for r in got} == expected
    assert len(got) == len(texts)


def clustered(n=900, seed=3):
    """Fingerprints of which many differ from others in few bits, chains included."""
    rng = np.random.default_rng(seed)
    seeds = rng.integers(0, 1 << 64, 60, dtype=np.uint64)
    rows = list(rng.integers(0, 1 << 64, n // 2, dtype=np.uint64)) + list(seeds)
    while len(rows) < n:
        base = rows[rng.integers(n // 2, len(rows))]
        for b in rng.choice(64, rng.integers(1, 4), replace=False):
            base ^= np.uint64(1) << np.uint64(b)
        rows.append(base)
    return np.unique(np.array(rows, dtype=np.uint64))


def test_tree_finds_every_link(spark):
    points = clustered()
    expected = brute([(i, int(p)) for i, p in enumerate(points)])
    assert len(set(expected.values())) < len(points) - 200
    rows = [(i, int(p)) for i, p in zip(range(len(points)), points.view(np.int64))]
    prints = spark.createDataFrame(rows, "doc_id long, fp long")
    for leaf_rows, sample in ((S.LEAF_ROWS, S.SAMPLE), (40, 500), (12, 60)):
        links = S.near_links(prints, leaf_rows, sample)
        roots = {r.node: r.root for r in S.components(links).collect()}
        groups = {}
        for k, fp in rows:
            groups.setdefault(roots.get(fp, fp), []).append(k)
        assert {k: min(g) for g in groups.values() for k in g} == expected


def test_every_pair_meets_in_one_leaf():
    points = clustered(600, 5)
    nodes, leaves = S.build_tree(points[::3], 16, 3.0, 10)
    assert leaves > 16
    leaf, idx, lives = S.route(nodes, points)
    assert sorted(idx[lives]) == list(range(len(points)))
    at = {}
    for n, i, own in zip(leaf.tolist(), idx.tolist(), lives.tolist()):
        at.setdefault(n, ([], []))[0 if own else 1].append(i)
    met = {tuple(sorted((a, b))) for own, asked in at.values() for a in own for b in own + asked if a != b}
    for i in range(len(points)):
        near = np.flatnonzero(np.bitwise_count(points ^ points[i]) <= 2)
        assert all((min(i, j), max(i, j)) in met for j in near.tolist() if j != i)


def test_close_rows_without_a_split():
    """A ball around one point: a dense leaf that distances hardly divide."""
    base = np.uint64(0x0123456789ABCDEF)
    one = np.uint64(1)
    points = np.array(
        [base] + [base ^ (one << np.uint64(i)) ^ (one << np.uint64(j)) for i in range(64) for j in range(i)],
        dtype=np.uint64,
    )
    a, _ = S.leaf_links(points, np.ones(len(points), dtype=bool))
    assert len(a) == len(points) - 1
    nodes, leaves = S.build_tree(points, 50, 1.0, 40)
    leaf, idx, lives = S.route(nodes, points)
    assert lives.sum() == len(points)


def test_odd_rows(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame(
        [(5, text, "x"), (3, text, "y"), (3, text, "y"), (None, text, None), (9, None, "a"), (8, "", "b"),
         (7, " \t\n", "c"), (4, "A b", "d"), (6, "a  B", "e"), (None, "something else altogether here", "f")],
        "doc_id long, text string, fp string",
    )
    got = S.near_duplicates(docs.drop("fp")).collect()
    named = sorted((r.doc_id or -1, r.fp == 0, r.component_id or -1) for r in got)
    assert named == [(-1, False, -1), (-1, False, 3), (3, False, 3), (3, False, 3), (4, False, 4),
                     (5, False, 3), (6, False, 4), (7, True, 7), (8, True, 7), (9, True, 7)]
    kept = S.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.fp) for r in kept.collect()) == [(-1, "f"), (3, "y"), (4, "d"), (7, "c")]


def test_clashing_names(spark):
    columns = ["doc_id", "text", "fp", "Number", "a.b", "row", "hash", "component"]
    docs = spark.createDataFrame([(k, "one two three four", *[k] * 6) for k in (2, 1, 1)], columns)
    got = S.one_of_each(docs)
    assert got.columns == columns and [tuple(r) for r in got.collect()] == [(1, "one two three four", *[1] * 6)]


def test_long_text():
    text = " ".join(str(i) for i in range(70_000))
    assert S.simhash(text.encode()) % (1 << 64) == slow_simhash(text)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(docs).collect() == []
    assert S.one_of_each(docs).collect() == []
