"""Personal data: spans against plain patterns, disclosure against counting by hand."""

import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from paylens.llm import pii as P
from paylens.llm.common import read

SF_DIR = "/root/testdata/sf0.001"

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def slow_spans(text):
    return {
        k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if valid(k, m.group())] for k, p in PLAIN.items()
    }


def digest(spans):
    return ",".join(f"{k}:{a}:{b}" for k in PLAIN for a, b in spans[k])


def compare(rows):
    for r in rows:
        wanted = slow_spans(r.text)
        got = {k: [(s.start, s.end) for s in r[k]] for k in P.KINDS}
        assert got == wanted, r.text
        assert all(r.text[s.start : s.end] == s.found for k in P.KINDS for s in r[k])


def card(rng, n=16):
    while True:
        digits = "".join(rng.choice("0123456789") for _ in range(n))
        if luhn(digits):
            return digits


def test_random_texts(spark):
    rng = random.Random(11)
    parts = ["a", "b_c", "@", ".", "-", " ", "+", "1", "25", "255", "256", "0007", "(", ")", "é", "𝄞", "\n", "x@y.z", "1.2.3.4",
             "+44 20 7946 0958", "4111 1111 1111 1111", "%", "_", ",", "@a", ".5"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(18))) for _ in range(6000)]
    texts += [card(rng, n) for n in (15, 16, 17, 18, 19, 20)] + [" ".join(card(rng)) + "-" + card(rng) for _ in range(50)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = P.with_base_spans(docs).collect()
    compare(rows)
    assert all(sum(len(r[k]) for r in rows) > 20 for k in P.KINDS)


def test_long_texts(spark):
    """Long runs, on which the plain patterns take quadratic time, so short ones stand in for those."""
    rng = random.Random(12)

    def texts(n):
        return ["1" * n, "a" * n, "a." * n + "@", "+1" + "(" * n, "1." * n, "@" * n, "+1 " * n, "a@b" + ".c" * n,
                "x@y.zz, " * (n // 10), " ".join(card(rng) for _ in range(n // 100))]

    def spans(n):
        rows = [(i, t) for i, t in enumerate(texts(n))]
        return P.with_base_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()

    compare(spans(900))
    long = {r.doc_id: {k: len(r[k]) for k in P.KINDS if r[k]} for r in spans(60_000)}
    assert long == {0: {}, 1: {}, 2: {}, 3: {}, 4: {"ip": 15_000}, 5: {}, 6: {}, 7: {"email": 1}, 8: {"email": 6000}, 9: {}}


def test_documents(spark):
    docs = read(spark, SF_DIR, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = P.span_digests(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = slow_spans(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(spans[k]) for k in PLAIN)
        assert r.base_sha256 == hashlib.sha256(digest(spans).encode()).hexdigest()
        assert r.spans == digest(spans) or r.spans.startswith(digest(spans))
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got) > 5


def telling_corpus():
    """`Holder` and `hidden7` go with addresses alone, `common` with everything."""
    rng = random.Random(13)
    rows = []
    for i in range(400):
        fill = " ".join(rng.choice("alpha beta gamma delta common".split()) for _ in range(6))
        if i % 10 == 0:
            rows.append((i, f"{fill}. Holder hidden7 common x{i}@mail.org wrote. {fill}"))
        else:
            rows.append((i, f"{fill}. common hidden text {'Holiday' if i % 3 else 'rest'}. {fill}"))
    rows.append((1000, "The Holder of nothing"))
    rows.append((1001, None))
    return rows


def test_disclosure(spark):
    rows = telling_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    terms = {r.term: r for r in P.disclosing_terms(docs).collect()}
    assert set(terms) == {"holder", "hidden7", "wrote"}
    sentences = [s for _, t in rows for s in re.split(r"(?<=[.!?])\s+|\n", t or "") if s]
    n, of_kind = len(sentences), sum("@" in s for s in sentences)
    alone = sum("Holder" in s for s in sentences)
    assert math.isclose(terms["holder"].pmi, math.log2((of_kind / n) / (alone / n * of_kind / n)))
    assert math.isclose(terms["holder"].content, -math.log2(of_kind / n))
    # "Holiday" shares the first letters of "holder", "hidden" not the blanked digits of "hidden7".
    assert terms["holder"].instead == "hol*" and terms["hidden7"].instead is None and terms["wrote"].instead is None
    texts = {r.doc_id: r.text for r in P.sanitised(docs).collect()}
    assert texts[1000] == "The hol* of nothing" and texts[1001] == ""
    assert "hol*  common [EMAIL] ." in texts[10] and texts[11] == rows[11][1]
    spans = {r.doc_id: r.spans for r in P.span_digests(docs).collect()}
    assert spans[1000] == "term:4:10" and spans[11] == ""


def test_copies_do_not_teach(spark):
    """A sentence that is copied often is one context."""
    rows = [(i, "Rareword at me@home.org now.") for i in range(60)] + [(100 + i, f"plain text {i}.") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert P.disclosing_terms(docs).collect() == []


def test_single_datum(spark):
    """A name that always stands beside one person's data is found; words of chance and of one context are not."""
    rng = random.Random(14)
    words = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    fill = lambda: " ".join(rng.choice(words) for _ in range(6))
    rows = [(i, f"{fill()}. {fill()} user{i}@mail.org.") for i in range(300)]
    rows += [(1000 + i, f"{fill()} Quillon {fill()} quill@home.org.") for i in range(5)]
    rows += [(2000 + i, f"{fill()} Zorba {fill()} {c}.") for i, c in enumerate(("4111 1111 1111 1111", "4111-1111-1111-1111") * 2)]
    rows += [(3000 + i, "Once copied beside only@home.org.") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    terms = {r.term: r.kind for r in P.disclosing_terms(docs).collect()}
    assert terms == {"quillon": "email", "zorba": "card"}


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(None, "a@b.co", 1), (1, None, 2), (1, "", 3), (2, "+12345678 and +12345678", 4), (2, "+12345678 and +12345678", 4)],
        "doc_id long, text string, email int",
    )
    got = sorted((r.doc_id or -1, r.spans) for r in P.span_digests(docs).collect())
    assert got == [(-1, "email:0:6"), (1, ""), (1, ""), (2, "phone:0:9,phone:14:23"), (2, "phone:0:9,phone:14:23")]
    texts = sorted(r.text for r in P.sanitised(docs).collect())
    assert texts == ["", "", "[EMAIL]", "[PHONE] and [PHONE]", "[PHONE] and [PHONE]"]
    assert P.span_digests(docs.where("false")).collect() == []
    overlap = spark.createDataFrame([(1, "to 1.2.3.4@x.y. and 4111-1111-1111-1111")], "doc_id long, text string")
    assert P.sanitised(overlap).first().text == "to [IP]. and [CARD]"


def test_general_forms(spark):
    words = spark.createDataFrame([("holder",), ("ab12",), ("ü",)], "w string")
    assert [r.g for r in words.select(P.general(F.col("w")).alias("g")).collect()] == ["hol*", "ab00", "ü*"]


def slow_terms(texts):
    """The rule over plain counts: {term: (kind, pmi, content, instead)}."""
    import regex

    sentences = [s for t in texts for s in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+|\n", t or "") if s]

    def general(w):
        return re.sub("[0-9]", "0", w) if re.search("[0-9]", w) else w[: P.STEM] + "*"

    def plain(found, kind):
        return re.sub("[^0-9]", "", found) if kind in ("card", "phone") else found.lower()

    total, alone, shares, met = max(1, len(sentences)), {}, {}, {}
    for s in sentences:
        bare = s
        for p in PLAIN.values():
            bare = re.sub(p, " ", bare)
        words = dict.fromkeys(w for w in regex.split(r"[^\p{L}\p{N}]+", bare.lower()) if len(w) > 1)
        terms = tuple(dict.fromkeys([*("=" + w for w in words), *("~" + general(w) for w in words)]))
        for t in terms:
            alone[t] = alone.get(t, 0) + 1
        for kind, spans in slow_spans(s).items():
            data = [s[a:b] for a, b in spans]
            if data:
                entities = [("kind", kind, 0, tuple(data))] + [
                    ("datum", kind, d, terms) for d in dict.fromkeys(plain(x, kind) for x in data)
                ]
                for level, kind_, entity, context in entities:
                    key = (level, kind_, entity)
                    shares.setdefault(key, []).append(context)
                    for t in terms:
                        met.setdefault((t, key), []).append(context)
    # A datum in one context only is no entity.
    entities = {k for k, c in shares.items() if k[0] == "kind" or len(set(c)) > 1}
    rated = {}
    for level in ("kind", "datum"):
        own = {k: c for k, c in met.items() if k[1] in entities and k[1][0] == level}
        for (term, key), contexts in own.items():
            k, both = len(set(contexts)), len(contexts)
            share = len(shares[key]) / total
            if k < P.LEAST_CONTEXTS:
                continue
            pmi, content = math.log2(both / (alone[term] * share)), -math.log2(share)
            assert pmi <= content + 1e-9 and alone[term] >= both
            n = k + alone[term] - both
            q = k / n
            without = (1 - q) * math.log((1 - q) / max(1 - share, 1e-12)) if q < 1 else 0.0
            chance = q <= share or n * (q * math.log(q / share) + without) < math.log(max(1, len(own)) / P.CHANCE)
            if pmi >= content / P.ALPHA and not chance:
                rated.setdefault(term, []).append((pmi, key[1], content))
    best = {t: max(r) for t, r in rated.items()}
    return {
        t[1:]: (kind, pmi, content, None if "~" + general(t[1:]) in best else general(t[1:]))
        for t, (pmi, kind, content) in best.items()
        if t[0] == "="
    }


def test_terms_by_brute_force(spark):
    """Words with digits glued to data, repeated sentences and data, and words that always go with some."""
    rng = random.Random(15)
    found = 0
    for seed in range(4):
        words = [f"{c}{d}{n}" for c in "kmnprst" for d in "aeio" for n in ("n", "la", "7", "99")] + ["zeta", "zeta99", "Ünit"]
        people = [(f"who{p}@m{p % 3}.org", f"Name{p}") for p in range(9)] + [("+44 20 7946 09" + str(p), f"caller{p}") for p in range(10, 16)]
        texts = []
        for i in range(250):
            fill = [rng.choice(words) for _ in range(rng.randrange(2, 7))]
            how = rng.random()
            if how < 0.25:
                datum, name = rng.choice(people)
                glue = rng.choice(["", " ", "zeta99 ", "99", "7 "])
                fill.insert(rng.randrange(len(fill)), f"{name} {glue}{datum}" if rng.random() < 0.8 else f"{glue}{datum}")
            texts.append(" ".join(fill) + rng.choice([".", "!", "\n", ""]))
            if rng.random() < 0.3:
                texts.append(texts[rng.randrange(len(texts))])
            if rng.random() < 0.2:
                texts[-1] += " " + rng.choice(texts)
        texts += [None, "", "zeta99 x@a.org", "zeta99 x@a.org", "zeta99 y@a.org", "zeta here"]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.term: r for r in P.disclosing_terms(docs).collect()}
        wanted = slow_terms(texts)
        assert got.keys() == wanted.keys()
        for term, (kind, pmi, content, instead) in wanted.items():
            r = got[term]
            assert (r.kind, r.instead) == (kind, instead)
            assert math.isclose(r.pmi, pmi, rel_tol=1e-9) and math.isclose(r.content, content, rel_tol=1e-9)
            assert r.pmi <= r.content + 1e-9
        found += len(wanted)
    assert found > 20
