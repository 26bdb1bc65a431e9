"""Language identification against plain counting, and on held-out documents."""

import zlib
from collections import Counter

from paylens.llm import language as L
from paylens.llm.common import read

SF_DIR = "/root/testdata/sf0.001"


def slow_ngrams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out = []
    for w in words:
        out += list(w)
        padded = f"_{w}_"
        out += [padded[i : i + 2] for i in range(len(padded) - 1)]
        out += [padded[i : i + 3] for i in range(len(padded) - 2)]
    return out


def code(gram):
    points = [0 if c == "_" else ord(c) for c in gram]
    a, b, c = [L._NONE] * (3 - len(points)) + points
    return a << 42 | b << 21 | c


def slow_profile(counts):
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[: L.TOP]


def test_ngrams():
    for text in ("", " 12 ", "a", "Ab, cd!", "Größe 𐐀𐐁 x-y", "日本 語"):
        assert Counter(L.ngrams(text).tolist()) == Counter(code(g) for g in slow_ngrams(text))


def test_documents(spark):
    docs = read(spark, SF_DIR, "documents")
    counts = {}
    for r in docs.collect():
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            counts.setdefault(r.lang, Counter()).update(slow_ngrams(r.text))
    profiles = {lang: {g: i for i, g in enumerate(slow_profile(c))} for lang, c in counts.items()}
    got = {r.doc_id: r for r in L.identify(docs).collect()}
    right = 0
    for r in docs.collect():
        own = slow_profile(Counter(slow_ngrams(r.text)))
        away = {
            lang: sum(abs(i - p[g]) if g in p else L.TOP for i, g in enumerate(own))
            for lang, p in profiles.items()
        }
        best = min(sorted(away), key=away.get)
        row = got[r.doc_id]
        assert row.lang_pred == best
        assert abs(row.score - (1 - away[best] / (L.TOP * len(own)))) < 1e-12
        assert row.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        right += best == r.lang
    assert right / len(got) > 0.97


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, "the cat", "en", "a"), (3, "le chat", "fr", "b"), (4, None, "en", "c"), (5, "123 !", None, "d"),
         (6, "", "", "e"), (None, "the dog", "xx", "f"), (7, "the " * 50_000, None, "g"), (7, "the", None, "g")],
        "doc_id long, text string, lang string, score string",
    )
    got = L.identify(docs).collect()
    found = sorted((r.doc_id or -1, r.lang_pred) for r in got)
    assert found == [(-1, "en"), (1, "en"), (3, "fr"), (4, "und"), (5, "und"), (6, "und"), (7, "en"), (7, "en")]
    assert all(0 <= r.score <= 1 for r in got) and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert [r.held_out for r in got if r.doc_id is None] == [True]
    assert {r.lang_pred for r in L.identify(docs.where("lang IS NULL")).collect()} == {"und"}
    assert L.identify(docs.where("false")).collect() == []
