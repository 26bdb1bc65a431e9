"""Benchmark decontamination: short test items inside long documents.

An item is contained in a document when at least `CONTAINMENT` of its distinct five-word shingles occur
there. Items are cut into partitions by how many shingles they have. A partition whose largest item has
n shingles keeps the (n - ceil(CONTAINMENT * n) + 1) smallest shingle hashes of each item as its MinHash
sketch. A document that holds the required part of an item misses too few shingles to miss the whole
sketch, so looking up sketches finds every contained item however long the document is; an exact count
of shared shingles then decides. DataFrame functions only.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.llm.common import fresh, let, stored

SHINGLE = 5
CONTAINMENT = 0.8


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits of a text; a null text has none."""
    cut = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(cut, lambda w: w != "")


def _runs(word_array: Column, of_run) -> Column:
    """`of_run` of every run of five words; of all words where they are one to four."""

    def body(w: Column) -> Column:
        n = F.size(w)
        places = F.when(n >= SHINGLE, F.sequence(F.lit(1), n - SHINGLE + 1)).when(n > 0, F.array(F.lit(1)))
        return F.transform(F.coalesce(places, F.array().cast("array<int>")), lambda i: of_run(F.slice(w, i, F.lit(SHINGLE))))

    return let(word_array, body)


def shingles(word_array: Column) -> Column:
    """All runs of five words, space-joined; one to four words are one shingle, none are none."""
    return _runs(word_array, lambda run: F.array_join(run, " "))


def shingle_hashes(word_array: Column) -> Column:
    """Hashes of the runs that `shingles` joins, without joining them."""
    return _runs(word_array, F.xxhash64)


def _needed(n: Column) -> Column:
    """The fewest shared shingles that count, of n; tenths keep it exact."""
    return F.ceil(n * round(CONTAINMENT * 10) / F.lit(10)).cast("int")


def item_shingles(benchmark: DataFrame) -> DataFrame:
    """One row per class of items with equal shingles: `item_id` (the smallest), `shingles`, `n`.

    Items without a word are left out, as nothing can contain them.
    """
    rows = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("words")
    )
    sets = rows.select("item_id", F.array_sort(F.array_distinct(shingles(F.col("words")))).alias("shingles"))
    return (
        sets.where(F.size("shingles") > 0)
        .groupBy("shingles")
        .agg(F.min("item_id").alias("item_id"))
        .select("item_id", "shingles", F.size("shingles").alias("n"))
    )


def sketches(items: DataFrame) -> DataFrame:
    """`item_id` and each hash of its MinHash sketch, sized by the largest item of its size partition.

    Size partitions are powers of two.
    """
    largest = (F.pow(F.lit(2), F.length(F.bin("n"))) - 1).cast("int")
    kept = (largest - _needed(largest) + 1).cast("int")
    hashes = F.array_sort(F.transform("shingles", lambda s: F.xxhash64(F.split(s, " "))))
    return items.select("item_id", F.explode(F.slice(hashes, F.lit(1), kept)).alias("hash"))


def _matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`doc_id`, `copy` (the hash of the text), `item_id`, `n` and `shared`."""
    items = stored(item_shingles(benchmark), "items")
    probes = stored(sketches(items), "sketches")
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("copy"),
        words(F.col("text")).alias("words"),
    )
    hashed = texts.select("doc_id", "copy", F.explode(shingle_hashes(F.col("words"))).alias("hash"))
    candidates = hashed.join(probes, "hash").select("doc_id", "copy").distinct()
    found = stored(candidates.select(F.col("doc_id").alias("id"), F.col("copy").alias("of")), "candidates")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("copy") == F.col("of"))
    own = texts.join(found, same, "left_semi").select(
        "doc_id", "copy", F.explode(F.array_distinct(shingles(F.col("words")))).alias("shingle")
    )
    wanted = items.select("item_id", "n", F.explode("shingles").alias("shingle"))
    return (
        own.join(wanted, "shingle")
        .groupBy("doc_id", "copy", "item_id", "n")
        .agg(F.count_distinct("shingle").alias("shared"))
        .where(F.col("shared") >= _needed(F.col("n")))
    )


def contained_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Which documents contain which items: `doc_id`, `item_id`, `n_shingles`, `shared`, `containment`.

    Takes `doc_id` and `text` of documents, `item_id` and `text` of the benchmark. Items with equal
    shingles are one class, named by its smallest id. A text of one to four words is one shingle, so
    that such an item is found in documents of just these words. Null and empty texts contain nothing
    and are contained in nothing; of rows that share a `doc_id` the fullest counts, null ids together.
    No item or no document gives no row.
    """
    return (
        _matches(docs, benchmark)
        .groupBy("doc_id", "item_id", F.col("n").alias("n_shingles"))
        .agg(F.max("shared").alias("shared"))
        .withColumn("containment", F.col("shared") / F.col("n_shingles"))
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that contain no item, with all their columns.

    Rows are told apart by id and text, so of rows that share an id only those with an item go. Null and
    empty texts stay; see `contained_items`.
    """
    own_id, own_copy = fresh(docs, "_id"), fresh(docs, "_of")
    found = _matches(docs, benchmark).select(F.col("doc_id").alias(own_id), F.col("copy").alias(own_copy)).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64("text") == F.col(own_copy))
    return docs.join(stored(found, "contaminated"), same, "left_anti")


# The same pairs in SQL, by counting shared shingles of every document and item.
ORACLE = r"""
WITH texts AS (
  SELECT doc_id AS id, text, 'd' AS kind FROM documents UNION ALL SELECT item_id, text, 'i' FROM benchmark
),
cut AS (
  SELECT id, kind, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w
  FROM texts
),
sets AS (
  SELECT id, kind, list_sort(list_distinct(CASE
    WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s
  FROM cut
),
items AS (SELECT min(id) AS item_id, s, len(s) AS n FROM sets WHERE kind = 'i' AND len(s) > 0 GROUP BY s),
wanted AS (SELECT item_id, n, unnest(s) AS g FROM items),
had AS (SELECT DISTINCT id, unnest(s) AS g FROM sets WHERE kind = 'd')
SELECT id AS doc_id, item_id, n AS n_shingles, count(*) AS shared, count(*) / n AS containment
FROM had JOIN wanted USING (g) GROUP BY id, item_id, n HAVING count(*) * 10 >= 8 * n
"""
