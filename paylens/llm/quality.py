"""Quality classifier: regularised quadratic discriminant over document statistics.

Each document gives a short vector of transformed statistics of its whole text. Per class, the mean and
a covariance shrunk towards the pooled one and towards a multiple of the identity describe the
labelled rows; the score compares the two log-densities, taken through Cholesky factors that are made
once. Learning sees sums only, so every labelled row counts and the driver gets a fixed number of rows.
"""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from paylens.llm.common import stored

FEATURES = (
    "word_length", "upper", "digits", "symbols", "shouts", "stops", "spaces", "wide",
    "distinct_words", "top_word", "same_next", "distinct_lines", "squeezed", "long_words",
)
SIZE = len(FEATURES)
# A text counts as if it had so many more bytes and words of plain prose, so that a few words do not look
# extreme; of those bytes the shares below are upper case, digits and so on.
PROSE_BYTES, PROSE_WORDS = 60, 10
# How far a class's covariance goes towards the pooled one, and the result towards the identity.
TO_POOLED = 0.2
TO_IDENTITY = 0.05
# Learning adds features as whole numbers of this fraction, a chunk of rows at a time in 64 bits: sums are exact,
# so the model is the same however rows are dealt to tasks.
STEPS, CHUNK = 1 << 18, 8192
# Documents scored at least this high pass as good.
KEEP_FROM = 0.3
# Of five remainders of crc32(doc_id), the one that is never learned from.
FOLDS, HELD_OUT = 5, 0

_GROUPS = tuple(
    (np.frombuffer(chars, dtype=np.uint8), prose)
    for chars, prose in (
        (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.03),
        (b"0123456789", 0.0),
        (b"#$%&*|<>{}[]=@\\~^_/+", 0.0),
        (b"!?", 0.0),
        (b".,;:", 0.03),
        (b" \t\n\r\v\f", 0.16),
        (bytes(range(128, 256)), 0.02),
    )
)


def statistics(data: bytes) -> np.ndarray:
    """Transformed statistics of one UTF-8 text; the empty text has a vector as well."""
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    size = len(data) + PROSE_BYTES
    words = data.split()
    n = len(words) + PROSE_WORDS
    lines = data.split(b"\n")
    seen = Counter(words)
    same = sum(map(bytes.__eq__, words, words[1:]))
    squeezed = len(zstandard.ZstdCompressor(level=1).compress(data))
    return np.array(
        [
            np.log((sum(map(len, words)) + 5 * PROSE_WORDS) / n),
            *(np.sqrt((counts[group].sum() + PROSE_BYTES * prose) / size) for group, prose in _GROUPS),
            # Distinct words grow with about this power of a text's words.
            np.log(len(seen) + PROSE_WORDS) - 0.8 * np.log(n),
            np.sqrt((max(seen.values(), default=0) + 1) / n),
            np.sqrt(same / n),
            (len(set(lines)) + 2) / (len(lines) + 2),
            np.log((squeezed + 0.4 * PROSE_BYTES) / size),
            np.sqrt(sum(len(w) > 12 for w in words) / n),
        ]
    )


@F.arrow_udf(ArrayType(DoubleType()))
def features(texts: pa.Array) -> pa.Array:
    """The vector of each text; null counts as empty."""
    rows = [statistics(d.as_py() or b"") for d in texts.cast(pa.binary())]
    return pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))


@dataclass(frozen=True)
class Model:
    """Per class (0, 1) the share of rows, the mean and the Cholesky factor; none without both classes.

    The factors' inverses are worked out once. A row's score does not depend on the rows beside it.
    """

    prior: float
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    means: tuple[np.ndarray, np.ndarray] | None = None
    factors: tuple[np.ndarray, np.ndarray] | None = None

    @cached_property
    def inverses(self) -> list[np.ndarray]:
        return [np.linalg.solve(factor, np.eye(SIZE)) for factor in self.factors]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 of each row."""
        if self.means is None:
            return np.full(len(x), self.prior)
        z = (x - self.centre) / self.scale
        logs = []
        for mean, factor, inverse in zip(self.means, self.factors, self.inverses):
            away = np.zeros((SIZE, len(x)))
            for place, values in enumerate((z - mean).T):
                away += np.outer(inverse[:, place], values)
            logs.append(-0.5 * (away**2).sum(axis=0) - np.log(np.diag(factor)).sum())
        odds = logs[1] - logs[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def model_of(moments: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Model:
    """Fits from count, sum and sum of outer products per class.

    With rows of one class only, every document gets the share of class 1; without any row, one half.
    """
    counts = {k: m[0] for k, m in moments.items()}
    total = sum(counts.values())
    if min(counts.get(0, 0), counts.get(1, 0)) == 0:
        return Model(counts.get(1, 0) / total if total else 0.5)
    centre = sum(m[1] for m in moments.values()) / total
    spread = sum(m[2] for m in moments.values()) / total - np.outer(centre, centre)
    scale = np.sqrt(np.maximum(np.diag(spread), 1e-12))
    means, within = [], []
    for k in (0, 1):
        n, sums, outer = moments[k]
        mean = sums / n
        means.append((mean - centre) / scale)
        within.append((outer / n - np.outer(mean, mean)) / np.outer(scale, scale))
    pooled = sum(counts[k] * within[k] for k in (0, 1)) / total
    factors = []
    for own in within:
        mixed = (1 - TO_POOLED) * own + TO_POOLED * pooled
        level = max(np.trace(mixed) / SIZE, 1e-6)
        factors.append(np.linalg.cholesky((1 - TO_IDENTITY) * mixed + TO_IDENTITY * level * np.eye(SIZE)))
    return Model(counts[1] / total, centre, scale, tuple(means), tuple(factors))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class, the exact sums of ones, of values and of products that a task has read, in steps."""
    totals = {k: np.zeros(1 + SIZE + SIZE * SIZE, dtype=object) for k in (0, 1)}
    for batch in batches:
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)
        steps = np.rint(x * STEPS).astype(np.int64)
        label = batch.column(1).to_numpy(zero_copy_only=False)
        for k, total in totals.items():
            own = steps[label == k]
            for first in range(0, len(own), CHUNK):
                part = own[first : first + CHUNK]
                total += np.concatenate(([len(part)], part.sum(axis=0), (part.T @ part).ravel())).astype(object)
    for k, total in totals.items():
        places = np.arange(len(total))
        values = pa.array([Decimal(v) for v in total], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(total), k)), pa.array(places), values], ["label", "place", "value"]
        )


def train(learned: DataFrame) -> Model:
    """A model from all rows of `features` and `label` (0 or 1)."""
    sums = learned.select("features", F.col("label").cast("long")).mapInArrow(
        _sums, "label long, place long, value decimal(38,0)"
    )
    found = sums.groupBy("label", "place").agg(F.sum("value").alias("value")).collect()
    moments = {}
    for k in (0, 1):
        values = np.zeros(1 + SIZE + SIZE * SIZE)
        for r in found:
            if r.label == k:
                values[r.place] = float(r.value)
        sums, products = values[1 : 1 + SIZE] / STEPS, values[1 + SIZE :] / STEPS**2
        moments[k] = (values[0], sums, products.reshape(SIZE, SIZE))
    return model_of(moments)


def held_out(doc_id, folds: int = FOLDS, fold: int = HELD_OUT):
    """Whether an id is kept from learning; a null id is."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(True))


def _learned(rows: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels.where("quality IN (0, 1)").select(
        F.col("doc_id").cast("long").alias("_labelled"), F.col("quality").cast("int").alias("label")
    )
    return (
        rows.where(~F.col("held_out"))
        .join(known, F.col("doc_id") == F.col("_labelled"))
        .select("features", "label")
    )


def scorer(model: Model):
    """An Arrow function from feature vectors to scores."""

    @F.arrow_udf(DoubleType())
    def score(vectors: pa.Array) -> pa.Array:
        x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)
        return pa.array(model.scores(x), pa.float64())

    return score


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`doc_id`, `held_out`, `score` and `predicted` (1 from `KEEP_FROM` up) of every document.

    Takes `doc_id` and `text` of documents and `doc_id` and `quality` of labels. A null text counts as
    empty, equal rows get equal scores, labels of unknown or null documents and null labels teach
    nothing, and several labels of a document all count. Long texts count whole, and other columns are not read,
    whatever their names. No document gives no row.
    """
    rows = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            held_out("doc_id").alias("held_out"),
            features("text").alias("features"),
        ),
        "features",
    )
    score = scorer(train(_learned(rows, labels)))
    scored = rows.select("doc_id", "held_out", score("features").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= KEEP_FROM).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier passes, with all their columns. Learns as `score_documents`."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out("doc_id").alias("held_out"),
        features("text").alias("features"),
    )
    score = scorer(train(_learned(rows, labels)))
    return docs.where(score(features(docs["text"])) >= KEEP_FROM)
