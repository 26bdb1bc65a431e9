"""The text and vector operators over the given tables, whole, with production parameters."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from paylens.llm import collocations, decontaminate, lines, topk
from paylens.llm.common import read
from paylens.llm.fingerprints import edited_fingerprints
from paylens.llm.language import identify
from paylens.llm.mixture import pack_mixture, packed_pieces
from paylens.llm.pii import span_digests
from paylens.llm.quality import score_documents
from paylens.llm.simhash import as_digits, near_duplicates
from paylens.llm.tokens import pack_documents
from paylens.llm.warc import read_archives, write_archives
from paylens.llm.whitening import whiten
from paylens.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

# Weights by source: every fifth source counts three times, every other one once, `src0` twice.
MIXTURE = {f"src{k}": 3.0 if k % 5 == 4 else 1.0 for k in range(20)} | {"src0": 2.0}


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(read(spark, sf_dir, "documents"))


def op2_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(read(spark, sf_dir, "documents"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeated_lines(read(spark, sf_dir, "documents")).drop("copy")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))


def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(pack_mixture(read(spark, sf_dir, "documents"), MIXTURE))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", as_digits("fp").alias("fingerprint"), "component_id")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(read(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).drop("payload")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(read(spark, sf_dir, "embeddings"), modulus=50)


QUERIES: dict[str, Query] = {
    "op1_pii": op1_pii,
    "op2_packed_ids": op2_packed_ids,
    "op3_fingerprints": op3_fingerprints,
    "op4_lines": op4_lines,
    "op5_quality": op5_quality,
    "op6_language": op6_language,
    "op7_mixture": op7_mixture,
    "op8_simhash": op8_simhash,
    "op9_decontamination": op9_decontamination,
    "op10_warc": op10_warc,
    "op11_collocations": op11_collocations,
    "op12_whitening": op12_whitening,
    "op13_topk": op13_topk,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op4_lines": lines.ORACLE,
    "op9_decontamination": decontaminate.ORACLE,
    "op11_collocations": collocations.ORACLE,
    "op13_topk": topk.ORACLE,
}
