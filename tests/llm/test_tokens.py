"""Ids, best-fit packing and its lossless round trip."""

import random

import numpy as np
from tokenizers import Tokenizer

from paylens.llm import tokens as T
from paylens.llm.common import read
from paylens.session import scratch_path

SF_DIR = "/root/testdata/sf0.001"


def plain():
    found = Tokenizer.from_file(T.tokenizer_path())
    found.encode_special_tokens = True
    return lambda text: found.encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_whole_texts():
    encode = plain()
    rng = random.Random(1)
    parts = ["the", " ", "  ", "\n", "\t", "é", "a1", "12", "!?", "'s", "日本", " ", "\x85", "\x1c", " x", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(4000)]
    texts += ["", " ", "a ", "x" * 500, "word " * 3000 + "end"]
    for text, ids in zip(texts, T.encode_texts(texts, T.tokenizer_path())):
        assert np.frombuffer(ids, "<u4").tolist() == [*encode(text), 0], repr(text)


def slow_best_fit(lengths, most):
    bins, room = [], []
    for at in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [r for r in room if r >= lengths[at]]
        if fits:
            b = room.index(min(fits))
        else:
            b = len(bins)
            bins.append([])
            room.append(most)
        bins[b].append(at)
        room[b] -= lengths[at]
    return room


def test_best_fit():
    rng = random.Random(2)
    for most in (1, 7, 64, 1024):
        for n in (0, 1, 5, 300):
            lengths = [rng.randint(1, most) for _ in range(n)]
            bins = T.best_fit_decreasing(lengths, most)
            assert sorted(i for b in bins for i in b) == list(range(n))
            room = [most - sum(lengths[i] for i in b) for b in bins]
            assert all(r >= 0 for r in room)
            assert sorted(room) == sorted(slow_best_fit(lengths, most))


def unpacked(rows, length):
    """Ids of each document from packed rows, with the layout checked."""
    pieces, seen = {}, set()
    for r in rows:
        assert r.sequence_id not in seen
        seen.add(r.sequence_id)
        ids, places = np.frombuffer(r.input_ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        assert len(ids) == len(places) == length and r.segment_ends[-1] == r.n_tokens
        assert not ids[r.n_tokens :].any() and not places[r.n_tokens :].any()
        for a, b, doc, start in zip(r.segment_ends, r.segment_ends[1:], r.doc_ids, r.doc_starts):
            assert places[a:b].tolist() == list(range(b - a))
            pieces.setdefault(doc, []).append((start, ids[a:b].tolist()))
    out = {}
    for doc, parts in pieces.items():
        whole = []
        for start, ids in sorted(parts):
            assert start == len(whole)
            whole += ids
        out[doc] = whole
    return out


def test_documents(spark):
    docs = read(spark, SF_DIR, "documents")
    encode = plain()
    wanted = {r.doc_id: [*encode(r.text or ""), 0] for r in docs.collect()}
    path = scratch_path(spark, "packed")
    T.write_packed(docs, path)
    rows = spark.read.parquet(path).collect()
    assert unpacked(rows, 1024) == wanted
    total = sum(map(len, wanted.values()))
    assert len(rows) * 1024 < 1.02 * total + 1024
    small = T.pack_documents(docs.repartition(3), length=100, shard_tokens=5000).collect()
    assert unpacked(small, 100) == wanted


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, 0), (2, "", 0), (3, "long " * 30_000, 0), (None, "no id", 0)],
        "doc_id long, text string, input_ids int",
    )
    got = unpacked(T.pack_documents(docs).collect(), 1024)
    assert got[1] == got[2] == [0] and got[3][-1] == 0 and len(got[3]) > 30_000 and len(got[None]) > 2
    assert T.pack_documents(docs.where("false")).collect() == []
    twice = T.pack_documents(docs.where("doc_id = 2").union(docs.where("doc_id = 2")).coalesce(1)).collect()
    assert [r.n_tokens for r in twice] == [2] and twice[0].doc_ids == [2, 2]
