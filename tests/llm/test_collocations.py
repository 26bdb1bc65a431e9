"""Collocations against counting every phrase; filters against what went into them."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from paylens.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, id int, f int, phrase string"


def brute(rows, least, first):
    counts, totals = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        lower = re.sub("[A-Z]", lambda c: c.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            own = counts.setdefault(lang, Counter())
            for m in range(1, 6):
                own.update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, own in counts.items():
        n, found = totals[lang], []
        frequent = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        inside = {}
        for p, a in frequent.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside.get(p[i : i + m], 0), a)
        for p, a in frequent.items():
            if inside.get(p, 0) < a:
                score, k = min((1000 * a * n // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def found(spark, rows, least=5, first=50, **options):
    docs = spark.createDataFrame([(*r, 1, 2, "clash") for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in C.collocations(docs, least, first, **options).collect())


def texts(seed, n=300):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(30)] + ["Ärger", "NEW", "York", "ß𝄞", "a-b", " ", "x y"]
    weights = [1 / (i + 1) for i in range(len(names))]
    set_phrases = ["New York city", "once upon a time", "a a a a", "one two three four five six", "ÄRGER ärger"]
    rows = []
    for i in range(n):
        parts = [rng.choice(set_phrases) if rng.random() < 0.15 else rng.choices(names, weights)[0] for _ in range(rng.randrange(40))]
        ends = [rng.choice([" ", "  ", "\t", ", ", ".", "\n", "\x0b", " ; ", "\x1c"]) if rng.random() < 0.3 else " " for _ in parts]
        rows.append((i, "".join(a + b for a, b in zip(parts, ends)), rng.choice(["en", "de", None, "und"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts(spark, seed):
    rows = texts(seed)
    assert found(spark, rows) == brute(rows, 5, 50)
    assert found(spark, rows, first=3) == brute(rows, 5, 3)


def test_words_that_share_a_hash(spark, monkeypatch):
    rows = texts(3)
    assert found(spark, rows, bits=3) == brute(rows, 5, 50)
    monkeypatch.setattr(C, "SHARED", 2)
    with pytest.raises(ValueError, match="share a hash"):
        found(spark, rows, bits=3)


def test_many_shards_and_writes(spark, monkeypatch):
    """Filters of many shards, several from a task, give the same; tasks are told the limits with the code."""
    rows = texts(4)
    monkeypatch.setattr(C, "SHARD_BYTES", 512)
    monkeypatch.setattr(C, "MOST_SHARD_BITS", 5)
    assert found(spark, rows) == brute(rows, 5, 50)


def test_several_writes():
    """What a task writes in many small filters adds up."""
    import pyarrow as pa

    rows = texts(5)
    batch = pa.RecordBatch.from_arrays([pa.array([r[2] or "und" for r in rows]), pa.array([r[1] for r in rows])], ["lang", "text"])

    class Told:
        def __init__(self, value):
            self.value = value

    every = (C._SLICE_BITS, b"\xff" * (1 << C._SLICE_BITS - 3))

    def counts():
        filters = {}
        for out in C._counted_phrases(Told({}), Told(every), Told(every), 2, C.ID_BITS)(iter([batch])):
            for r in out.to_pylist():
                filters.setdefault((r["m"], r["shard"]), []).append(r["filter"])
        found = {}
        for (m, shard), own in filters.items():
            lanes, n = C.merge_filters(own, shard, 2)
            lanes[0] = C.permuted(lanes)
            found |= {(m, *map(int, lane)): int(c) for *lane, c in zip(*lanes, n)}
        return found, sum(map(len, filters.values()))

    whole, few = counts()
    held, C.HELD = C.HELD, 200
    try:
        again, many = counts()
    finally:
        C.HELD = held
    assert whole == again and many > 4 * few and len(whole) > 1000


@pytest.mark.parametrize("m,n,shard_bits", [(1, 1, 0), (2, 1000, 0), (2, 1000, 4), (5, 3000, 3), (3, 2, 10), (4, 70_000, 1)])
def test_filters_keep_everything(m, n, shard_bits):
    rng = np.random.default_rng(m * n)
    lanes = [rng.integers(0, 1 << C.LANE_BITS, n, dtype=np.uint64) for _ in range(m)]
    lanes[0][: n // 3] = lanes[0][0]
    counts = rng.integers(1, 300, n).astype(np.int64) ** rng.integers(1, 7, n)
    wanted = Counter()
    for *lane, c in zip(*lanes, counts):
        wanted[tuple(map(int, lane))] += int(c)
    assert (C._mix(lanes[0][:5]) == [C._mixed(int(x)) for x in lanes[0][:5]]).all()
    mixed = C.permuted(lanes)
    assert (C.permuted([mixed, *lanes[1:]]) == lanes[0]).all()
    got, size = {}, 0
    half = len(counts) // 2
    parts = [([lane[s] for lane in lanes], counts[s]) for s in (slice(None, half), slice(half, None))]
    shards = {}
    for part in parts:
        for shard, entries, data in C.shard_filters(*part, shard_bits):
            decoded = C.decode_filter(data, shard, shard_bits)
            assert entries == len(decoded[1]) and all(len(lane) == entries for lane in decoded[0])
            shards.setdefault(shard, []).append(data)
            size += len(data)
    for shard, filters in shards.items():
        merged, sums = C.merge_filters(filters, shard, shard_bits)
        merged = [C.permuted(merged), *merged[1:]]
        got |= {tuple(map(int, lane)): int(c) for *lane, c in zip(*merged, sums)}
    assert got == wanted
    # No more than the lanes, less the quotient and shard, a byte or two of counter and one of run.
    assert size <= n * (C.LANE_BYTES * m + 9) + 64 * len(shards)


def test_odd_rows(spark):
    rows = [(1, None, "en"), (None, "", None), (2, " ., \n", "en"), (3, "go on " * 40_000, "fr"), (4, "x" * 300_000, "fr")]
    rows += [(5, "same words here", "de")] * 6
    assert found(spark, rows) == brute(rows, 5, 50)
    assert found(spark, rows[:3]) == [] and found(spark, []) == []
    lower = [(i, "ÄB Äb äb. ÄB Äb", "en") for i in range(6)]
    assert found(spark, lower) == brute(lower, 5, 50) != []


def test_exact_beyond_64_bits(spark):
    """Counts whose products pass 64 bits."""
    a, n, left, right = 3_000_000_007, 9_000_000_000_000_019, 7_000_000_003, 5_000_000_029
    row = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    score = row.selectExpr(
        "(CAST(1000 AS DECIMAL(4,0)) * (CAST(a AS DECIMAL(18,0)) * CAST(n AS DECIMAL(18,0)))) div "
        "(CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0))) AS score"
    )
    assert score.first().score == 1000 * a * n // (left * right)
