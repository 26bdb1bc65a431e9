"""Language identification by rank-order profiles of letter n-grams.

A profile is the `TOP` most frequent n-grams of one to three letters within words, in order. A document
is nearest to the language from which its own profile is least out of place.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paylens.llm.quality import held_out

TOP = 300
# Of four remainders of crc32(doc_id), the one that is never learned from.
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
# N-grams counted at once while learning.
_FLUSH = 1 << 20
# An n-gram is three fields of 21 bits; this field stands for "no letter at all", 0 for a word's edge.
_NONE = (1 << 21) - 1


class _Letters:
    """Which code points are letters; made once per worker."""

    table: np.ndarray | None = None

    @classmethod
    def known(cls) -> np.ndarray:
        if cls.table is None:
            cls.table = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        return cls.table


def ngrams(text: str) -> np.ndarray:
    """Codes of the n-grams of one to three letters in a text, repeats included; words carry an edge on
    either side and no n-gram spans two words."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    points = np.where(_Letters.known()[points], points, 0)
    points = np.concatenate(([0], points, [0]))
    points = points[np.concatenate(([True], (points[1:] != 0) | (points[:-1] != 0)))]
    if len(points) < 3:
        return points[:0]
    one = points[points != 0] | (_NONE << 42) | (_NONE << 21)
    two = (points[:-1] << 21) | points[1:] | (_NONE << 42)
    three = (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]
    return np.concatenate((one, two, three[points[1:-1] != 0]))


def ranked(codes: np.ndarray) -> np.ndarray:
    """The `TOP` most frequent codes, most frequent first, ties by code."""
    found, counts = np.unique(codes, return_counts=True)
    return found[np.lexsort((found, -counts))[:TOP]]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-gram counts per language of what a task has read, in parts of bounded size."""
    waiting: dict[str, list[np.ndarray]] = {}
    size = 0

    def flush():
        for lang, parts in waiting.items():
            codes, counts = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)],
                ["lang", "code", "n"],
            )
        waiting.clear()

    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1)):
            codes = ngrams(text.as_py())
            waiting.setdefault(lang.as_py(), []).append(codes)
            size += len(codes)
            if size >= _FLUSH:
                yield from flush()
                size = 0
    yield from flush()


def learn_profiles(docs: DataFrame) -> dict[str, list[int]]:
    """The profile of each language over all rows of `text` and `lang`; rows with a null do not count."""
    counts = (
        docs.select(F.col("text"), F.col("lang").cast("string"))
        .where("text IS NOT NULL AND lang IS NOT NULL")
        .mapInArrow(_counted, "lang string, code long, n long")
        .groupBy("lang", "code")
        .agg(F.sum("n").alias("n"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= TOP)
    profiles: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "place").select("lang", "code").collect():
        profiles.setdefault(r.lang, []).append(r.code)
    return profiles


def place_table(profiles: dict[str, list[int]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, all n-grams of their profiles, and the place of each n-gram (row) in each language,
    `TOP` where it has none; one more row stands for unknown n-grams."""
    langs = sorted(profiles)
    codes = np.unique(np.array([c for p in profiles.values() for c in p], dtype=np.int64))
    places = np.full((len(codes) + 1, len(langs)), TOP, dtype=np.int32)
    for k, lang in enumerate(langs):
        places[np.searchsorted(codes, profiles[lang]), k] = np.arange(len(profiles[lang]))
    return langs, codes, places


def nearest(text: str | None, table: tuple[list[str], np.ndarray, np.ndarray]) -> tuple[str, float]:
    """Language and score (1: every n-gram in its place); unknown for a text without letters."""
    langs, codes, places = table
    own = ngrams(text or "")
    if not langs or len(own) == 0:
        return UNKNOWN, 0.0
    own = ranked(own)
    at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
    found = places[np.where(codes[at] == own, at, len(codes))]
    away = np.where(found == TOP, TOP, np.abs(found - np.arange(len(own))[:, None])).sum(axis=0)
    best = int(np.argmin(away))
    return langs[best], 1.0 - float(away[best]) / (TOP * len(own))


def identify(docs: DataFrame) -> DataFrame:
    """`doc_id`, `held_out`, `lang_pred` and `score` of every document, by profiles of those not held out.

    Takes `doc_id`, `text` and `lang`. Null texts and texts without a letter are `und` with score 0, and
    so is every text when there is nothing to learn from. Languages equally near go by name. Equal rows
    get equal results; a row without id is not learned from. Long texts count whole, and other columns are not
    read, whatever their names. No document gives no row.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text"),
        F.col("lang"),
        held_out("doc_id", FOLDS, HELD_OUT).alias("held_out"),
    )
    profiles = learn_profiles(rows.where(~F.col("held_out")))
    spread = docs.sparkSession.sparkContext.broadcast(place_table(profiles))

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [nearest(t.as_py(), spread.value) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([lang for lang, _ in found], pa.string()),
                    pa.array([score for _, score in found], pa.float64()),
                ],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return rows.select("doc_id", "held_out", "text").mapInArrow(
        predicted, "doc_id long, held_out boolean, lang_pred string, score double"
    )
