"""Repeated lines against comparing all lines with all earlier ones."""

import random
import re

from paylens.llm import common as M
from paylens.llm import lines as L


def edits(a, b):
    """Word edits between two sequences: 0, 1, or 2 for more."""
    if a == b:
        return 0
    if len(a) == len(b):
        return 1 if sum(x != y for x, y in zip(a, b)) == 1 else 2
    if len(a) < len(b):
        a, b = b, a
    return 1 if any(a[:i] + a[i + 1 :] == b for i in range(len(a))) else 2


def slow(rows):
    """{(doc_id, line): (of_doc_id, of_line, edits)} for rows (doc_id, text) with distinct ids."""
    seen, first, out = [], {}, {}
    for doc_id, text in sorted(rows):
        for i, line in enumerate((text or "").split("\n")):
            words = tuple(line.split())
            if words:
                seen.append((doc_id, i, words))
    for doc_id, i, words in seen:
        first.setdefault(words, (doc_id, i))
    near = {}
    for words, place in first.items():
        near[words] = min(
            (p for w, p in first.items() if p < place and min(len(w), len(words)) >= 8 and edits(w, words) == 1),
            default=None,
        )
    for doc_id, i, words in seen:
        if near[words]:
            out[doc_id, i] = (*near[words], 1)
        elif first[words] != (doc_id, i):
            out[doc_id, i] = (*first[words], 0)
    return out


def check(spark, rows, partitions=3):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    got = {(r.doc_id, r.line): (r.of_doc_id, r.of_line, r.edits) for r in L.repeated_lines(docs).collect()}
    assert got == slow(rows)
    wanted = {
        k: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (k, i) not in got)
        for k, t in rows
    }
    assert {r.doc_id: r.text for r in L.drop_repeated_lines(docs).collect()} == wanted
    return got


def changed(rng, words):
    words = list(words)
    for _ in range(rng.choice((0, 1, 1, 1, 2))):
        at = rng.randrange(len(words))
        how = rng.randrange(3)
        if how == 0:
            words[at] = rng.choice("xyz")
        elif how == 1:
            words.insert(at, rng.choice("xyz"))
        elif len(words) > 1:
            del words[at]
    return words


def test_random_lines(spark):
    rng = random.Random(5)
    pool = [[rng.choice("abc") for _ in range(rng.randrange(1, 16))] for _ in range(30)]
    pool += [[rng.choice("abcdefgh") for _ in range(n)] for n in (63, 64, 65, 130)]
    rows = []
    for k in range(140):
        own = [" ".join(changed(rng, rng.choice(pool))) for _ in range(rng.randrange(5))]
        own += rng.choice(([], [""], ["  \t"]))
        rows.append((k * 3, "\n".join(own)))
    got = check(spark, rows)
    assert sum(e for _, _, e in got.values()) > 40 and len(got) > 100


def test_template_lines(spark):
    """Lines that differ at one place all meet in one group; moved words do not match."""
    base = [f"w{i}" for i in range(12)]
    rows = [(k, " ".join(base[:5] + [f"user{k}"] + base[6:])) for k in range(40)]
    rows += [(100, " ".join(base[1:] + base[:1])), (101, " ".join(base[1:] + ["z"])), (102, " ".join(base[:7]))]
    got = check(spark, rows)
    assert len([1 for (k, _), v in got.items() if k < 40 and v == (0, 0, 1)]) == 39


def test_bitmaps_of_any_size(spark, monkeypatch):
    """Bitmaps that let nearly everything through change nothing."""
    rows = [(k, "\n".join(f"one two three four five six seven {k % 5} nine {k % 3}" for _ in range(2))) for k in range(30)]
    check(spark, rows)
    monkeypatch.setattr(M, "_MOST_BITS", 8)
    monkeypatch.setattr(M, "_BITMAP", 8)
    check(spark, rows)


def test_likely_in(spark):
    rows = spark.range(20_000).selectExpr("id", "CAST(id % 7 AS STRING) AS _at", "IF(id % 11 = 0, NULL, id) AS `_bucket`")
    wanted = rows.where("id % 40 = 0").select("_bucket", "id")
    got = M.likely_in(rows, wanted, ["id", "_bucket"])
    assert got.columns == rows.columns
    found = {r.id for r in got.collect()}
    assert found >= set(range(0, 20_000, 40)) and len(found) < 3000
    assert M.likely_in(rows, wanted.where("false"), ["id", "_bucket"]).count() == 0


def test_clashing_names(spark):
    columns = ["doc_id", "text", "_id", "_copy", "_LINES", "_at", "_bucket", "_bitmap", "a.b", "words"]
    docs = spark.createDataFrame([(k, "one line\none line", *[k] * 8) for k in (1, 2)], columns)
    got = L.drop_repeated_lines(docs)
    assert got.columns == columns
    assert sorted(tuple(r) for r in got.collect()) == [(1, "one line", *[1] * 8), (2, "", *[2] * 8)]


def test_odd_rows(spark):
    line = "one two three four five six seven eight"
    docs = spark.createDataFrame(
        [(None, line, 1), (1, line + " more", 2), (2, None, 3), (3, "", 4), (4, "short one\nshort two", 5),
         (5, "x\n\nx\n \nshort one", 6), (5, "x\n\nx\n \nshort one", 6), (6, "w " * 30_000 + "end", 7), (7, "w " * 30_000, 8)],
        "doc_id long, text string, line int",
    )
    got = sorted((r.doc_id, r.line, r.of_doc_id or -1, r.of_line, r.edits) for r in L.repeated_lines(docs).collect())
    again = [(5, 2, 5, 0, 0), (5, 4, 4, 0, 0)]
    assert got == [(1, 0, -1, 0, 1), *sorted(again * 2), (7, 0, 6, 0, 1)]
    kept = L.drop_repeated_lines(docs)
    assert kept.columns == docs.columns
    texts = {r.line: r.text for r in kept.collect()}
    assert texts[2] == "" and texts[3] is None and texts[6] == "x\n\n " and texts[1] == line and kept.count() == 9
    assert L.repeated_lines(docs.where("false")).collect() == []
    assert L.drop_repeated_lines(docs.where("false")).collect() == []


def test_texts_hashed_and_lines_cut_once(spark, monkeypatch):
    """In no step a line carries its text or is cut into words twice; rows with a blank line come out right."""
    plans, stored = [], L.stored

    def recorded(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, *args)

    monkeypatch.setattr(L, "stored", recorded)
    line = "one two three four five six seven eight"
    check(spark, [(1, f" {line}\t\n\x0b\n{line} nine"), (2, f"\n{line}\x0cten\n{line}"), (3, None), (4, "")])
    carried = [c for p in plans for c in re.findall(r"Generate posexplode\(split\(.*?, -1\)\), \[(.*?)\], ", p, re.S)]
    assert len(carried) >= 2 and not any("text" in c for c in carried)
    cuts = [p.count(r"[\x20\x09-\x0D]+") for p in plans]
    assert max(cuts) == 1 and sum(cuts) >= 2
