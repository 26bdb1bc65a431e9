"""The pipeline: each stage on its predecessor's rows, against plain versions."""

import numpy as np
from test_decontaminate import slow as contained
from test_lines import slow as repeated
from test_simhash import brute, slow_simhash

import corpus_pipeline as C
from paylens.llm import quality as Q
from paylens.llm.common import read
from paylens.llm.tokens import encode_texts, tokenizer_path

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read(spark, SF_DIR, "documents")
    columns = docs.columns
    rows = {name: None for name, _ in C.STAGES}
    for name, stage in C.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, SF_DIR)
        kept = docs.collect()
        rows[name] = kept
        if name == "packing":
            break
        assert docs.columns == columns and len({r.doc_id for r in kept}) == len(kept)
        docs = spark.createDataFrame(kept, docs.schema)
        after = {r.doc_id: r.text for r in kept}
        texts = [(k, r.text) for k, r in before.items()]
        if name == "quality":
            scores = Q.score_documents(read(spark, SF_DIR, "documents"), read(spark, SF_DIR, "labels"))
            assert after.keys() == {r.doc_id for r in scores.collect() if r.predicted}
        elif name == "line_dedup":
            gone = repeated(texts)
            assert after == {
                k: "\n".join(x for i, x in enumerate(t.split("\n")) if (k, i) not in gone) for k, t in texts
            }
        elif name == "near_dedup":
            group = brute([(k, slow_simhash(t)) for k, t in texts])
            assert after.keys() == set(group.values())
        else:
            items = [(r.item_id, r.text) for r in read(spark, SF_DIR, "benchmark").collect()]
            assert after.keys() == before.keys() - {k for k, *_ in contained(texts, items)}
    ids = dict(zip(before, encode_texts([r.text for r in before.values()], tokenizer_path())))
    lengths = {}
    for r in rows["packing"]:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == {k: len(v) // 4 for k, v in ids.items()}
    assert np.all([len(rows[a]) >= len(rows[b]) for a, b in zip(rows, list(rows)[1:4])])
    assert len(rows["quality"]) > len(rows["near_dedup"]) > len(rows["decontamination"])


def test_odd_and_empty_documents(spark):
    schema = read(spark, SF_DIR, "documents").schema
    odd = [(None, None, None, None, None), (1, "", "en", None, 0), (2, None, None, "s", None), (2, None, None, "s", None),
           (3, "plain words of a text", "en", "s", 1), (3, "plain words of a text", "en", "s", 1)]
    for given in (odd, []):
        docs = spark.createDataFrame(given, schema)
        for name, stage in C.STAGES:
            docs = stage(spark, docs, SF_DIR)
            kept = docs.collect()
            if name != "packing":
                docs = spark.createDataFrame(kept, docs.schema)
        assert bool(kept) == bool(given)


def test_run(spark):
    assert C.run(spark, SF_DIR).count() > 100
