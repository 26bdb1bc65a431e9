"""Mixture packing: lossless, gapless, in proportion."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from paylens.llm import mixture as M
from paylens.llm import tokens as T
from paylens.llm.common import read

SF_DIR = "/root/testdata/sf0.001"


def sequences(rows, length):
    """Pieces by sequence, in order, checked to lie gapless in at most `length` ids."""
    out = {}
    for r in rows:
        out.setdefault(r.sequence_id, []).append(r)
    for own in out.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at and r.length > 0 and len(r.ids) == 4 * r.length
            at += r.length
        assert at <= length
    return out


def whole(rows):
    """Ids by document, checked to lie in exactly one piece each; repeated ids are summed up."""
    by_doc = {}
    for r in sorted(rows, key=lambda r: r.start):
        done = by_doc.setdefault(r.doc_id, [])
        assert r.start == len(done)
        done += np.frombuffer(r.ids, "<u4").tolist()
        assert len(done) <= r.doc_tokens
    return by_doc


def test_documents(spark):
    docs = read(spark, SF_DIR, "documents")
    encode = Tokenizer.from_file(T.tokenizer_path())
    wanted = {r.doc_id: [*encode.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    total = sum(map(len, wanted.values()))
    for shard_tokens, length, cut in ((M.SHARD_TOKENS, 1024, docs), (9000, 256, docs.repartition(5))):
        rows = M.pack_mixture(cut, shard_tokens=shard_tokens, length=length).collect()
        assert whole(rows) == wanted
        packed = sequences(rows, length)
        shards = -(-total // shard_tokens)
        assert len(packed) <= total / length + shards
        assert {k >> 32 for k in packed} == set(range(shards))


def by_source(spark, names, seed=4, n=3000):
    rng = random.Random(seed)
    docs = spark.createDataFrame(
        [(i, rng.choices([*names], [*names.values()])[0], "word " * rng.randrange(1, 400)) for i in range(n)],
        "doc_id long, source string, text string",
    )
    return docs.orderBy("source").repartitionByRange(4, "source")


def shares_so_far(rows, length=1024):
    """Per window in order, what each source has sent up to its end."""
    packed, sent, out = sequences(rows, length), {}, []
    for key in sorted(packed):
        for r in packed[key]:
            sent[r.source] = sent.get(r.source, 0) + r.length
        out.append(dict(sent))
    return out


def test_windows_have_the_proportions(spark):
    names = {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}
    rows = M.pack_mixture(by_source(spark, names), shard_tokens=60_000).collect()
    whole = shares_so_far(rows)[-1]
    total = sum(whole.values())
    assert len({r.sequence_id >> 32 for r in rows}) > 8
    for sent in shares_so_far(rows):
        done = sum(sent.values())
        for s in names:
            assert abs(sent.get(s, 0) - whole[s] / total * done) < 2 * M.QUANTUM


def test_targets_hold_across_shards(spark):
    """Until a source runs dry, and then for those that are left; one without a target comes last."""
    names = {"a": 0.4, "b": 0.2, "c": 0.2, "d": 0.2}
    targets = {"a": 1.0, "b": 2.0, "c": 1.0, "none": 5.0}
    rows = M.pack_mixture(by_source(spark, names, 6), targets, shard_tokens=50_000).collect()
    so_far = shares_so_far(rows)
    whole = so_far[-1]
    assert len({r.sequence_id >> 32 for r in rows}) > 8
    dry = 2 * whole["b"]
    checked = {"first": 0, "then": 0, "last": 0}
    for sent in so_far:
        done = sum(sent.values())
        if done < dry - 4 * M.QUANTUM:
            for s, share in (("a", 0.25), ("b", 0.5), ("c", 0.25)):
                assert abs(sent.get(s, 0) - share * done) < 2 * M.QUANTUM
            assert sent.get("d", 0) <= M.QUANTUM
            checked["first"] += 1
        elif done > dry + 4 * M.QUANTUM and sent["c"] < whole["c"] - 4 * M.QUANTUM:
            assert sent["b"] == whole["b"] and abs(sent["a"] - sent["c"]) < 3 * M.QUANTUM
            checked["then"] += 1
        elif done > sum(whole.values()) - whole["d"] + 4 * M.QUANTUM:
            assert all(sent[s] == whole[s] for s in "abc")
            checked["last"] += 1
    assert min(checked.values()) > 20


def test_documents_stay_in_few_pieces(spark):
    docs = read(spark, SF_DIR, "documents")
    rows = M.pack_mixture(docs, {f"src{k}": 1 + k % 3 for k in range(20)}).collect()
    cut = sum(r.length for r in rows) / M.LENGTH
    assert len(rows) < 5 * max(len({r.doc_id for r in rows}), cut)


def test_windows():
    sent = list(M.windows({"x": 5000, "y": 5000}, {"x": 3, "y": 1}, {"x": 0, "y": 0}))
    assert [dict(w)["x"] for w in sent[:6]] == [768] * 6
    assert sum(n for w in sent for _, n in w) == 10_000 and all(sum(n for _, n in w) == 1024 for w in sent[:-1])
    zero = list(M.windows({"x": 100, "y": 50}, {"x": 0, "y": 0}, {"x": 0, "y": 0}, 64))
    assert [sum(n for _, n in w) for w in zero] == [64, 64, 22]
    late = list(M.windows({"x": 3000, "y": 3000}, {"x": 1, "y": 0}, {"x": 0, "y": 0}))
    assert all(s == "x" for w in late[:2] for s, _ in w) and dict(late[2])["x"] == 3000 - 2048
    assert all(sum(n for _, n in w) == 1024 for w in late[:-1])


@pytest.mark.parametrize("total,shards", [(1, 1), (1, 50), (255, 7), (100_000, 7), (12_345, 500), (10**13, 10**7)])
def test_deal(total, shards):
    size = max(1, 3 * total // shards)
    shards = -(-3 * total // size)
    for weights in ((), ((total, 0.25), (2 * total, 0.75)), ((total, 0.9), (total, 0.1))):
        schedule = M.Schedule(list(weights), 3 * total - sum(t for t, _ in weights))
        assert schedule.ids[-1] == pytest.approx(3 * total)
        for source in ("a", "b", None):
            rest = 3 * total - sum(t for t, _ in weights)
            for own, weight in [*weights, *([(min(total, rest), 0.0)] if rest else [])]:
                deal = M.Deal(source, own, weight, schedule, size, shards)
                assert deal.first(0) == 0 and deal.first(shards) == own
                for place in {0, own - 1, *(own * k // 9 for k in range(9))}:
                    at = deal.shard(place)
                    assert 0 <= at < shards and deal.first(at) <= place < deal.first(at + 1)
                    assert abs(deal.owed(at)) <= 2 * M.QUANTUM
    small = [M.Deal(str(i), 5, 0.0, M.Schedule([], 5000), 125, 40).shard(0) for i in range(400)]
    assert len(set(small)) > 30


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, None, 1), (2, "s", "", 2), (3, "s", "many words " * 20_000, 3), (None, "t", "no id", 4)],
        "doc_id long, source string, text string, place int",
    )
    rows = M.pack_mixture(docs, shard_tokens=5000).collect()
    got = whole(rows)
    assert got[1] == got[2] == [0] and len(got[3]) > 40_000 and got[None][-1] == 0
    sequences(rows, 1024)
    assert M.pack_mixture(docs.where("false")).collect() == []
    twice = M.pack_mixture(docs.where("doc_id = 3").union(docs.where("doc_id = 3"))).collect()
    assert sum(r.length for r in twice) == 2 * len(got[3])
    assert zlib.crc32(got[2][0].to_bytes(4, "little")) == zlib.crc32(b"\0\0\0\0")
