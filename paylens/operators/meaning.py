"""An encoder that knows the corpus: words of like use get like vectors, however they are spelt.

How often two words stand near each other in a text, against what chance would give (positive pointwise mutual
information), is a symmetric matrix with a row for each word. Its leading eigenvectors come from a randomised
decomposition: products with a few random vectors span its range, a few more products turn them towards the leading
ones, and a matrix as wide as these is all that the driver sees. Words are rows of tables throughout, in no task all
together; each product is a join on the word and a sum by the other.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from paylens.sources.tables import written

# Words that stand at most so far apart in a text meet.
WINDOW = 5
DIMS = 32
# Random vectors beyond the wanted ones, and products that turn them.
SPARE = 10
TURNS = 3
# A word must occur so often; the most frequent words that an encoder takes along, and their bytes.
LEAST = 2
VOCABULARY = 100_000
# Weight of a word of share p in a text: s / (s + p).
SMOOTH = 1e-3
# Entries of the matrix that are summed in one group.
_ENTRIES = 500_000


def co_occurrences(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """`word, other, n`: how often two different places within the window hold these words, in either order.

    Takes `search_text`. Every text gives a row for each of its places, so long texts cost by their length.
    """
    words = F.filter(F.split("search_text", " "), lambda w: w != "")

    def near(i: Column) -> Column:
        before = F.slice("words", F.greatest(i - window + 1, F.lit(1)), F.least(i, F.lit(window)))
        return F.concat(before, F.slice("words", i + 2, F.lit(window)))

    met = F.transform(
        "words", lambda w, i: F.transform(near(i), lambda o: F.struct(w.alias("word"), o.alias("other")))
    )
    pairs = texts.select(words.alias("words")).select(F.inline(F.flatten(met)))
    return pairs.groupBy("word", "other").agg(F.count(F.lit(1)).alias("n"))


def associations(pairs: DataFrame, least: int = LEAST) -> DataFrame:
    """`word, other, weight`: positive pointwise mutual information of words with `least` neighbours or more."""
    pairs = written(pairs, "pairs")
    sums = written(pairs.groupBy("word").agg(F.sum("n").alias("s")).where(F.col("s") >= least), "words")
    total = sums.agg(F.sum("s")).first()[0] or 1
    other = sums.select(F.col("word").alias("other"), F.col("s").alias("t"))
    weight = F.log(F.col("n") * F.lit(float(total)) / (F.col("s").cast("double") * F.col("t")))
    rated = pairs.join(sums, "word").join(other, "other").select("word", "other", weight.alias("weight"))
    return rated.where(F.col("weight") > 0)


def _random_rows(words: list[str], width: int) -> np.ndarray:
    return np.array([np.random.default_rng(xxhash.xxh64_intdigest(w.encode(), 5)).standard_normal(width) for w in words])


def _summed(width: int, random: bool):
    def summed(group: pa.Table) -> pa.Table:
        """Sums of weight times the other word's vector, by word."""
        words, place = np.unique(np.array(group.column("word").to_pylist(), dtype=object), return_inverse=True)
        if random:
            others, at = np.unique(np.array(group.column("other").to_pylist(), dtype=object), return_inverse=True)
            vectors = _random_rows(others.tolist(), width)[at]
        else:
            vectors = group.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, width)
        out = np.zeros((len(words), width))
        np.add.at(out, place, vectors * group.column("weight").to_numpy()[:, None])
        return pa.table({"word": pa.array(words, pa.string()), "vector": pa.array(list(out), pa.list_(pa.float64()))})

    return summed


def _by_group(rows: DataFrame, groups: int) -> DataFrame:
    return rows.groupBy(F.pmod(F.xxhash64("word"), F.lit(groups)).alias("group"))


def _product(weights: DataFrame, vectors: DataFrame | None, width: int, groups: int) -> DataFrame:
    """The matrix times the vectors of all words, random ones if none are given."""
    rows = weights
    if vectors is not None:
        rows = weights.join(vectors.withColumnRenamed("word", "other"), "other").select("word", "weight", "vector")
    summed = _summed(width, vectors is None)
    return written(_by_group(rows, groups).applyInArrow(summed, "word string, vector array<double>"), "product")


def _crossed(vectors: DataFrame, width: int, other: str = "vector") -> np.ndarray:
    """The sum over all words of one vector times another, a square matrix."""

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            a, b = (batch.column(i).flatten().to_numpy().reshape(-1, width) for i in (0, 1))
            total += a.T @ b
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "v"])

    parts = vectors.select(F.col("vector").alias("a"), F.col(other).alias("b"))
    rows = parts.mapInArrow(crossed, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at")
    return np.array([r.v for r in rows.collect()]).reshape(width, width)


def _turned(vectors: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Every word's vector times a small matrix."""
    rows, columns = matrix.shape

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("vector").flatten().to_numpy().reshape(-1, rows) @ matrix
            found = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, columns), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("word"), found], ["word", "vector"])

    return written(vectors.mapInArrow(turned, "word string, vector array<double>"), "turned")


def _orthogonal(vectors: DataFrame, width: int) -> tuple[DataFrame, int]:
    """The same span in orthonormal columns, fewer where it is flat."""
    values, basis = np.linalg.eigh(_crossed(vectors, width))
    kept = values > values[-1] * 1e-12
    return _turned(vectors, basis[:, kept] / np.sqrt(values[kept])), int(kept.sum())


def word_vectors(weights: DataFrame, dims: int = DIMS, turns: int = TURNS) -> DataFrame:
    """`word, vector`: each word's place along the leading eigenvectors, by the root of their values.

    Fewer than `dims` numbers where the matrix has no more; no association gives no row. A word's row of the
    matrix, as long as there are words that it meets, is summed in one group; there are as many groups as the matrix
    needs. The driver sees matrices `dims` + `SPARE` wide.
    """
    weights = written(weights, "weights")
    width, groups = dims + SPARE, 1 + weights.count() // _ENTRIES
    found = _product(weights, None, width, groups)
    if found.isEmpty():
        return found
    for _ in range(turns):
        found, width = _orthogonal(found, width)
        found = _product(weights, found, width, groups)
    basis, kept = _orthogonal(found, width)
    image = _product(weights, basis, kept, groups).withColumnRenamed("vector", "image")
    both = basis.join(image, "word", "left")
    zero = F.array_repeat(F.lit(0.0), kept)
    small = _crossed(both.withColumn("image", F.coalesce("image", zero)), kept, "image")
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-np.abs(values))[:dims]
    return _turned(basis, turn[:, order] * np.sqrt(np.abs(values[order])))


def corpus_encoder(texts: DataFrame, dims: int = DIMS, vocabulary: int = VOCABULARY):
    """An encoder learned from `search_text`s, for `operators.encode`: the weighted mean of the words' vectors.

    It takes along the `vocabulary` most frequent words with a vector, which are broadcast; other words count for
    nothing, and a text without a known word has a null vector.
    """
    texts = written(texts.select("search_text"), "texts")
    vectors = word_vectors(associations(co_occurrences(texts)), dims)
    words = texts.select(F.explode(F.split("search_text", " ")).alias("word")).where("word <> ''")
    counts = written(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 1
    kept = counts.join(vectors, "word").orderBy(F.desc("n"), "word").limit(vocabulary)
    told = kept.select("word", "n", F.col("vector").cast("array<float>").alias("vector")).toArrow()
    share = told["n"].to_numpy() / total
    weighted = [
        (np.array(v, dtype=np.float32) * (SMOOTH / (SMOOTH + p))) for v, p in zip(told["vector"].to_pylist(), share)
    ]
    places = {w: i for i, w in enumerate(told["word"].to_pylist())}
    shared = texts.sparkSession.sparkContext.broadcast((places, np.array(weighted)))

    @F.arrow_udf(ArrayType(FloatType()))
    def encode(batch: pa.Array) -> pa.Array:
        (known, rows), out = shared.value, []
        for text in batch.to_pylist():
            own = [known[w] for w in (text or "").split(" ") if w in known]
            out.append(rows[own].mean(axis=0) if own else None)
        return pa.array(out, pa.list_(pa.float32()))

    def encoder(text: Column) -> Column:
        return encode(text)

    return encoder
