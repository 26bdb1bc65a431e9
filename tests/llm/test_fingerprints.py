"""Piecewise fingerprints: exact parts against a plain version, likeness by its properties."""

import hashlib
import random

from pyspark.sql import functions as F

from paylens.llm import fingerprints as P
from paylens.llm.common import read

SF_DIR = "/root/testdata/sf0.001"


def slow_fingerprint(data):
    """The same from plain integers, byte by byte."""
    if not data:
        return "0::"
    bits, mask = 64, (1 << 64) - 1

    def mixed(v):
        v = ((v ^ (v >> 31) ^ int(P._MIX)) * 0xD6E8FEB86659FD93) & mask
        return v ^ (v >> 32)

    hashes = []
    for i in range(len(data)):
        window = range(min(P.WINDOW, i + 1))
        hashes.append(mixed(sum((data[i - j] + 1) * P._WEIGHTS[j] for j in window) & mask))
    zeros = [bits if h == 0 else (h & -h).bit_length() - 1 for h in hashes]

    def pieces(level):
        out, total = [], 0
        for i, h in enumerate(hashes):
            total = (total + h) & mask
            if zeros[i] >= level or i == len(data) - 1:
                out.append(chr(P.ALPHABET[mixed(total) >> 58]))
                total = 0
        return "".join(out)

    level = 0
    while len(pieces(level)) > P.PIECES:
        level += 1
    return f"{level}:{pieces(level)}:{pieces(level + 1)}"


def test_fingerprint_by_hand():
    rng = random.Random(1)
    for n in (0, 1, 2, 6, 7, 8, 63, 64, 65, 500, 3000):
        data = bytes(rng.choice(b"abcdefgh tion") for _ in range(n))
        assert P.fingerprint_of(data) == slow_fingerprint(data)
    assert P.fingerprint_of(b"\0" * 300) == slow_fingerprint(b"\0" * 300)
    assert P.fingerprint_of(b"ab" * 5000) == slow_fingerprint(b"ab" * 5000)


def expected(rows):
    """Plain results by doc_id; rows are (id, text) with distinct ids."""
    rows = sorted(((k, t or "") for k, t in rows), reverse=True)
    out = {}
    for i, (k, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        n = len(text) // 3
        edited = text[: len(text) - n] + following[:n]
        out[k] = (
            len(text), hashlib.sha256(edited.encode()).hexdigest(), P.fingerprint_of(text.encode()),
            P.fingerprint_of(edited.encode()), following,
        )
    return out


def test_documents(spark):
    docs = read(spark, SF_DIR, "documents")
    wanted = expected([(r.doc_id, r.text) for r in docs.collect()])
    got = P.edited_fingerprints(docs).collect()
    assert len(got) == len(wanted)
    for r in got:
        found = (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint)
        assert found == wanted[r.doc_id][:4]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    near = sorted(r.near_edited for r in got)
    assert near[len(near) // 20] > 0.4
    assert sum(r.near_next > 0.4 for r in got) < len(got) / 20


def test_gaps_and_ranges(spark):
    rng = random.Random(2)
    ids = rng.sample(range(-(10**15), 10**15), 300)
    rows = [(k, "".join(rng.choice("aé𝄞b ") for _ in range(rng.randrange(60)))) for k in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    docs = docs.withColumn("hash", F.xxhash64("text"))
    wanted = expected(rows)
    for buckets in (1, 2, 16, 200):
        order = P.with_next(docs, ["text"], buckets).select("doc_id", F.col("next.text").alias("t"))
        assert {r.doc_id: r.t for r in order.collect()} == {k: v[4] for k, v in wanted.items()}
    got = {r.doc_id: r.edited_sha256 for r in P.edited_fingerprints(docs).collect()}
    assert got == {k: v[1] for k, v in wanted.items()}


def test_likeness(spark):
    rng = random.Random(3)
    text = " ".join(str(rng.randrange(10**6)) for _ in range(2000))
    other = " ".join(str(rng.randrange(10**6)) for _ in range(2000))
    pairs = [(text, text), (text, text[:7000] + "x" + text[7000:]), (text, other), ("", ""), ("", text),
             (text, text + other[: len(text) // 2])]
    prints = [(P.fingerprint_of(a.encode()), P.fingerprint_of(b.encode())) for a, b in pairs]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(prints)], "i int, a string, b string")
    near = [r.n for r in df.orderBy("i").select(P.likeness(F.col("a"), F.col("b")).alias("n")).collect()]
    assert near[0] == near[3] == 1 and near[1] > 0.9 and near[2] < 0.3 and near[4] == 0 and near[5] > 0.4


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(None, "abcdef", 1), (3, None, 2), (3, None, 2), (1, "xyz" * 50, 3), (None, None, 4)],
        "doc_id long, text string, n_chars int",
    )
    got = P.edited_fingerprints(docs).collect()
    assert sorted((r.doc_id or -1, r.n_chars) for r in got) == [(-1, 0), (-1, 6), (1, 150), (3, 0), (3, 0)]
    alone = P.edited_fingerprints(docs.where("doc_id = 1")).collect()
    text = "xyz" * 50
    assert alone[0].edited_sha256 == hashlib.sha256((text[:100] + text[:50]).encode()).hexdigest()
    assert P.edited_fingerprints(docs.where("false")).collect() == []
