"""Contained items against counting shingles of every pair."""

import math
import random
import re

from paylens.llm import decontaminate as D


def shingle_set(text):
    words = [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]
    if len(words) < 5:
        return {" ".join(words)} - {""}
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)}


def slow(docs, items):
    classes, out = {}, set()
    for k, text in items:
        s = frozenset(shingle_set(text))
        if s:
            classes[s] = min(k, classes.get(s, k))
    for doc_id, text in docs:
        own = shingle_set(text)
        for s, k in classes.items():
            shared = len(own & s)
            if shared * 10 >= 8 * len(s) and shared:
                out.add((doc_id, k, len(s), shared, shared / len(s)))
    return out


def test_random_texts(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(prose(rng.choice((1, 3, 4, 5, 6, 8, 9, 12, 13, 20, 36, 37, 60, 68))))) for k in range(60)]
    items += [(100 + k, t.upper() + "!") for k, t in items[:5]] + [(200, None), (201, "  ?! ")]
    docs = []
    for k in range(150):
        words = prose(rng.randrange(300))
        for _ in range(rng.randrange(3)):
            piece = rng.choice(items)[1] or ""
            piece = piece.split()
            for _ in range(rng.choice((0, 0, 1, 2, 3))):
                if piece:
                    piece[rng.randrange(len(piece))] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = piece
        docs.append((k, " ".join(words)))
    docs += [(500 + k, t) for k, t in items[:20]] + [(600, "w1"), (601, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_shingles, r.shared, r.containment) for r in D.contained_items(frame, benchmark).collect()}
    wanted = slow(docs, items)
    assert got == wanted
    assert len(wanted) > 60 and any(c < 1 for *_, c in wanted)
    kept = {r.doc_id for r in D.drop_contaminated(frame, benchmark).collect()}
    assert kept == {k for k, _ in docs} - {k for k, *_ in wanted}


def test_sketches_are_long_enough(spark):
    """Whatever shingles a document lacks, it has one of the sketch when it has the needed part."""
    sizes = [*range(1, 70), 127, 128, 255, 256, 1000]
    items = [(n, " ".join(f"t{n}x{i}" for i in range(n + 4))) for n in sizes]
    frame = D.item_shingles(spark.createDataFrame(items, "item_id long, text string"))
    counts = {r.item_id: r["count"] for r in D.sketches(frame).groupBy("item_id").count().collect()}
    for n in sizes:
        assert n - math.ceil(n * 8 / 10) + 1 <= counts[n] <= n


def test_odd_rows(spark):
    passage = "alpha beta gamma delta epsilon zeta eta"
    docs = spark.createDataFrame(
        [(1, passage, 0), (1, "other", 1), (None, "x " + passage, 2), (2, None, 3), (3, "", 4), (4, "Short item.", 5),
         (5, "a short item", 6), (6, "pad " * 100_000 + passage, 7), (6, "pad " * 100_000 + passage, 7)],
        "doc_id long, text string, item_id int",
    )
    items = spark.createDataFrame([(1, passage, 0), (2, passage, 0), (3, "short ITEM", 0), (4, None, 0), (5, "", 0)],
                                  "item_id long, text string, doc_id int")
    got = sorted((r.doc_id or -1, r.item_id) for r in D.contained_items(docs, items).collect())
    assert got == [(-1, 1), (1, 1), (4, 3), (6, 1)]
    kept = D.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.item_id for r in kept.collect()) == [1, 3, 4, 6]
    assert D.contained_items(docs.where("false"), items).collect() == []
    assert D.contained_items(docs, items.where("false")).collect() == []
    assert D.drop_contaminated(docs, items.where("false")).count() == 9


def test_clashing_names(spark):
    columns = ["doc_id", "text", "_id", "_OF", "a.b", "hash", "words"]
    docs = spark.createDataFrame([(k, f"one two three four five {k}", *[k] * 5) for k in (1, 2)], columns)
    items = spark.createDataFrame([(7, "two three four five 1", 0)], "item_id long, text string, `a.b` int")
    got = D.drop_contaminated(docs, items)
    assert got.columns == columns and [tuple(r) for r in got.collect()] == [(2, "one two three four five 2", *[2] * 5)]
