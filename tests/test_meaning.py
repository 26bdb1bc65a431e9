"""Word vectors against NumPy over the whole matrix, and what an encoder made of them finds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paylens.operators import encode, similar
from paylens.operators import meaning as M


def plain_matrix(texts, window, least):
    counts = {}
    for text in texts:
        words = [w for w in (text or "").split(" ") if w]
        for i, w in enumerate(words):
            for j in range(max(0, i - window), min(len(words), i + window + 1)):
                if i != j:
                    counts[w, words[j]] = counts.get((w, words[j]), 0) + 1
    sums = {}
    for (w, _), n in counts.items():
        sums[w] = sums.get(w, 0) + n
    names = sorted(w for w, s in sums.items() if s >= least)
    total = sum(sums[w] for w in names)
    m = np.zeros((len(names), len(names)))
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            if (a, b) in counts:
                m[i, j] = max(0.0, np.log(counts[a, b] * total / (sums[a] * sums[b])))
    return names, m


def corpus(n=400):
    """Words of three uses; each use has names that are spelt like those of another."""
    rng = random.Random(8)
    uses = {
        "fuel": (["bensiin", "diislikütus", "kütus"], ["tankla", "auto", "liiter", "paak"]),
        "pool": (["bassein", "ujula", "saun"], ["vesi", "pilet", "rada", "ujumine"]),
        "food": (["kohvik", "restoran", "söökla"], ["lõuna", "kohv", "eine", "laud"]),
    }
    texts = []
    for i in range(n):
        names, around = uses[rng.choice([*uses])]
        texts.append(" ".join(rng.sample([rng.choice(names), *rng.sample(around, 3), f"nr{'abcdef'[i % 6]}"], 5)))
    return texts


def test_counts_and_vectors_as_in_numpy(spark, monkeypatch):
    texts = [*corpus(120), None, "", "üksik", "kaks  kaks", "kaks kaks kaks"]
    rows = spark.createDataFrame([(t,) for t in texts], "search_text string")
    names, m = plain_matrix(texts, M.WINDOW, M.LEAST)
    weights = M.associations(M.co_occurrences(rows))
    got = {(r.word, r.other): r.weight for r in weights.collect()}
    wanted = {(a, b): m[i, j] for i, a in enumerate(names) for j, b in enumerate(names) if m[i, j] > 0}
    assert got.keys() == wanted.keys() and all(abs(got[k] - v) < 1e-9 for k, v in wanted.items())

    dims = 6
    values, basis = np.linalg.eigh(m)
    order = np.argsort(-np.abs(values))[:dims]
    # Eigenvectors have any sign, so the rows' inner products are compared.
    exact = basis[:, order] * np.sqrt(np.abs(values[order]))
    for spare, turns, off in ((len(names), 1, 1e-6), (M.SPARE, M.TURNS, 0.02)):
        monkeypatch.setattr(M, "SPARE", spare)
        vectors = {r.word: np.array(r.vector) for r in M.word_vectors(weights, dims, turns).collect()}
        found = np.array([vectors.get(w, np.zeros(dims)) for w in names])
        assert np.abs(found @ found.T - exact @ exact.T).max() < off


def test_like_use_before_like_spelling(spark, transactions):
    texts = corpus()
    tx = transactions([(f"k{i}", 1, "2024-01-01") for i in range(len(texts))])
    words = spark.createDataFrame([(str(i + 1), t) for i, t in enumerate(texts)], "tx_id string, search_text string")
    tx = tx.drop("search_text").join(words, "tx_id")
    encoder = M.corpus_encoder(tx.select("search_text"), dims=8)
    one = spark.createDataFrame([(w,) for w in ("bensiin", "kütus", "bassein", "diislikütus", "saun", "kohvik")], "w string")
    v = {r.w: np.array(r.v) for r in one.select("w", encoder(F.col("w")).alias("v")).collect()}

    def near(a, b):
        return float(v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b]))

    assert near("bensiin", "kütus") > near("bensiin", "bassein") + 0.3
    assert near("bensiin", "diislikütus") > near("bensiin", "kohvik") + 0.3
    assert near("bassein", "saun") > near("bassein", "bensiin") + 0.3

    vectors = encode.build_vectors(tx, encoder)
    names = spark.createDataFrame([("Kütus",), ("tundmatu",)], "counterparty string")
    found = similar.similar_by_name(names, vectors, tx, encoder, k=30).join(words, "tx_id").collect()
    assert {r.query_id for r in found} == {"Kütus"} and len(found) == 30
    fuel = {"bensiin", "diislikütus", "kütus"}
    assert np.mean([bool(fuel & set(r.search_text.split())) for r in found]) > 0.95


def test_odd_texts(spark):
    none = spark.createDataFrame([(None,), ("",), ("üks",)], "search_text string")
    assert M.word_vectors(M.associations(M.co_occurrences(none))).count() == 0
    long = spark.createDataFrame([("a b c " * 5000,)], "search_text string")
    assert {r.word for r in M.co_occurrences(long).collect()} == {"a", "b", "c"}
    with pytest.raises(Exception):
        M.co_occurrences(none.drop("search_text"))
