"""Collocations: phrases whose words meet far more often than chance, counted in counting quotient filters.

A word's id is a hash of its language and itself; words that would share one get ids of their own, so a phrase
packs its ids without loss. An invertible permutation spreads the packed phrase: the first id is mixed with the
others. Its leading bits name a shard, the next ones are the quotient, and all the rest is the remainder, kept
whole. A filter holds the lengths of the runs of each quotient, the remainders in order and a counter of as
many bytes as it needs; from them the phrases come back exactly. Tasks count what they read into one
filter for each shard, and the filters of a shard, each in order, are merged.

Every phrase of `LEAST` occurrences consists of words and of pairs with as many. So words are counted first,
then pairs of frequent words, then longer phrases of frequent pairs. What is frequent is told to the tasks as a
bitmap of at most 2^`BITMAP_BITS` places; a phrase that it lets through by chance is counted, and dropped for
its count.
"""

import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paylens.llm.common import stored

LONGEST = 5
LEAST = 100
FIRST = 2000
UNKNOWN = "und"
# Bits of a word's hash; ids above are of words that share one. A lane of a packed phrase has one bit more.
ID_BITS = 47
LANE_BITS = ID_BITS + 1
LANE_BYTES = 6
_LANE = np.uint64((1 << LANE_BITS) - 1)
# Words that share a hash: about (different words)^2 / 2^48, so this many need over 10^10 different words.
SHARED = 1 << 20
BITMAP_BITS = 29
_SLICE_BITS = 17
# Positions and different words that a task holds before it writes its filters.
HELD = 1 << 20
HELD_WORDS = 1 << 18
SHARD_BYTES = 16 << 20
MOST_SHARD_BITS = 16

# A-Z to lower case, a tab to a space, and what ends a piece to a line break.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else 32 if c == 9 else 10 if c in b".,;:!?" or 10 <= c <= 13 else c for c in range(256)
)
_WORDS_SCHEMA = "lang string, word string, id long, n long"
_FILTERS_SCHEMA = "m int, shard int, entries long, filter binary"
_FILTERS = pa.schema([("m", pa.int32()), ("shard", pa.int32()), ("entries", pa.int64()), ("filter", pa.binary())])
_PHRASES_SCHEMA = "ids array<long>, f long"
_PHRASES = pa.schema([("ids", pa.list_(pa.int64())), ("f", pa.int64())])


def pieces(text: str | None) -> Iterator[list[bytes]]:
    """The words of each piece of a text; a null text is empty."""
    for piece in (text or "").encode().translate(_TABLE).split(b"\n"):
        words = piece.split()
        if words:
            yield words


def word_hash(lang: bytes, word: bytes, bits: int = ID_BITS) -> int:
    return xxhash.xxh64_intdigest(word, xxhash.xxh64_intdigest(lang)) >> (64 - bits)


# Permutation and places -------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers, invertibly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _mixed(number: int) -> int:
    """`_mix` of one number."""
    whole = (1 << 64) - 1
    number = (number ^ (number >> 30)) * 0xBF58476D1CE4E5B9 & whole
    number = (number ^ (number >> 27)) * 0x94D049BB133111EB & whole
    return number ^ (number >> 31)


def permuted(lanes: list[np.ndarray]) -> np.ndarray:
    """The first lane of packed phrases, mixed with the others. Applied to its result it gives the first lane."""
    mixed = np.zeros(len(lanes[0]), dtype=np.uint64)
    for lane in reversed(lanes[1:]):
        mixed = _mix(mixed ^ lane)
    return lanes[0] ^ (mixed & _LANE)


class Bitmap:
    """Places of frequent words or pairs among 2^`bits`."""

    def __init__(self, bits: int, data: bytes):
        self.bits, self.data = bits, np.frombuffer(data, np.uint8)

    def holds(self, lanes: list[np.ndarray]) -> np.ndarray:
        at = places(lanes, self.bits)
        return (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def holds_word(self, own: int) -> bool:
        at = _mixed(own) >> (64 - self.bits)
        return bool(self.data[at >> 3] >> (at & 7) & 1)


def places(lanes: list[np.ndarray], bits: int) -> np.ndarray:
    """The place of each phrase in a bitmap of 2^`bits`."""
    return (_mix(permuted(lanes)) >> np.uint64(64 - bits)).astype(np.int64)


# Filters ----------------------------------------------------------------------------------------------


def _varints(values: np.ndarray) -> bytes:
    """Numbers as groups of seven bits, the last group of each below 128."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), dtype=np.int64)
    for bits in range(7, 64, 7):
        sizes += values >> np.uint64(bits) > 0
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    for k in range(int(sizes.max(initial=0))):
        own = sizes > k
        group = (values[own] >> np.uint64(7 * k)) & np.uint64(127)
        more = (sizes[own] > k + 1).astype(np.uint8) << 7
        out[ends[own] - sizes[own] + k] = group.astype(np.uint8) | more
    return out.tobytes()


def _read_varints(data: np.ndarray) -> np.ndarray:
    if len(data) == 0:
        return np.empty(0, dtype=np.int64)
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate(([0], ends[:-1] + 1))
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    groups = (data & 127).astype(np.uint64) << (np.uint64(7) * place.astype(np.uint64))
    return np.add.reduceat(groups, starts).astype(np.int64)


def _in_bytes(values: np.ndarray, size: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def _from_bytes(data: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((len(data) // size if size else 0, 8), dtype=np.uint8)
    out[:, :size] = data.reshape(-1, size) if size else 0
    return out.view("<u8").ravel().astype(np.uint64)


def encode_filter(lanes: list[np.ndarray], counts: np.ndarray, shard_bits: int) -> bytes:
    """A filter of permuted phrases of one shard, in order of their lanes, with their counts."""
    n = len(counts)
    quotient_bits = max(0, min(n.bit_length() - 1, LANE_BITS - shard_bits))
    remainder_bits = LANE_BITS - shard_bits - quotient_bits
    inside = lanes[0] & np.uint64((1 << (LANE_BITS - shard_bits)) - 1)
    quotients = (inside >> np.uint64(remainder_bits)).astype(np.int64)
    runs = _varints(np.bincount(quotients, minlength=1 << quotient_bits))
    remainders = inside & np.uint64((1 << remainder_bits) - 1)
    parts = [_in_bytes(remainders, -(-remainder_bits // 8)), *(_in_bytes(lane, LANE_BYTES) for lane in lanes[1:])]
    head = struct.pack("<QBBI", n, len(lanes), quotient_bits, len(runs))
    return b"".join([head, runs, *parts, _varints(counts)])


def decode_filter(data: bytes, shard: int, shard_bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The permuted phrases of a filter and their counts, in order."""
    n, m, quotient_bits, size = struct.unpack_from("<QBBI", data)
    at = struct.calcsize("<QBBI")
    body = np.frombuffer(data, np.uint8)
    runs = _read_varints(body[at : at + size])
    at += size
    remainder_bits = LANE_BITS - shard_bits - quotient_bits
    width = -(-remainder_bits // 8)
    remainders = _from_bytes(body[at : at + n * width], width) if width else np.zeros(n, dtype=np.uint64)
    at += n * width
    rest = []
    for _ in range(m - 1):
        rest.append(_from_bytes(body[at : at + n * LANE_BYTES], LANE_BYTES))
        at += n * LANE_BYTES
    quotients = np.repeat(np.arange(1 << quotient_bits, dtype=np.uint64), runs)
    first = quotients << np.uint64(remainder_bits) | remainders
    if shard_bits:
        first |= np.uint64(shard) << np.uint64(LANE_BITS - shard_bits)
    return [first, *rest], _read_varints(body[at:])


def _summed(lanes: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Phrases in order, each once."""
    order = np.lexsort(lanes[::-1])
    lanes, counts = [lane[order] for lane in lanes], counts[order]
    new = np.zeros(len(counts), dtype=bool)
    new[:1] = True
    for lane in lanes:
        new[1:] |= lane[1:] != lane[:-1]
    first = np.flatnonzero(new)
    return [lane[first] for lane in lanes], np.add.reduceat(counts, first) if len(first) else counts


def merge_filters(filters: list[bytes], shard: int, shard_bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The phrases of filters of a shard, in order, with the sums of their counts."""
    decoded = [decode_filter(f, shard, shard_bits) for f in filters]
    lanes = [np.concatenate(own) for own in zip(*(d[0] for d in decoded))]
    return _summed(lanes, np.concatenate([d[1] for d in decoded]))


def shard_filters(lanes: list[np.ndarray], counts: np.ndarray, shard_bits: int) -> Iterator[tuple[int, int, bytes]]:
    """Shard, entries and filter of different phrases, for each shard that has some."""
    if len(counts) == 0:
        return
    lanes, counts = _summed([permuted(lanes), *lanes[1:]], counts)
    shards = (lanes[0] >> np.uint64(LANE_BITS - shard_bits)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate(([True], shards[1:] != shards[:-1], [True])))
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(shards[a]), int(b - a), encode_filter([lane[a:b] for lane in lanes], counts[a:b], shard_bits)


# Counting ---------------------------------------------------------------------------------------------


def _counted_words(bits: int):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        different = 0

        def told() -> Iterator[pa.RecordBatch]:
            for lang, own in counts.items():
                name = lang.encode()
                words = list(own)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(words), pa.string()),
                        pa.array(words, pa.binary()).cast(pa.string()),
                        pa.array([word_hash(name, w, bits) for w in words], pa.int64()),
                        pa.array(list(own.values()), pa.int64()),
                    ],
                    ["lang", "word", "id", "n"],
                )
            counts.clear()

        for batch in batches:
            for lang, text in zip(*(batch.column(i) for i in (0, 1))):
                own = counts.setdefault(lang.as_py(), Counter())
                different -= len(own)
                for words in pieces(text.as_py()):
                    own.update(words)
                different += len(own)
                if different >= HELD_WORDS:
                    yield from told()
                    different = 0
        yield from told()

    return counted


class _Ids(dict):
    """Numbers of a language's words within a task, from 1; 0 for those that are not frequent."""

    def __init__(self, lang: str, known: list[int], shared: dict, words: Bitmap, bits: int):
        self.lang, self.name, self.known, self.shared = lang, lang.encode(), known, shared
        self.words, self.bits = words, bits

    def __missing__(self, word: bytes) -> int:
        own = self.shared.get((self.lang, word))
        if own is None:
            own = word_hash(self.name, word, self.bits)
        number = 0
        if self.words.holds_word(own):
            number = len(self.known)
            self.known.append(own)
        self[word] = number
        return number


def _ranked(keys: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks of the keys that are `ok` (-1 elsewhere), a position of each different one, and their counts."""
    at = np.flatnonzero(ok)
    _, first, inverse, counts = np.unique(keys[at], return_index=True, return_inverse=True, return_counts=True)
    ranks = np.full(len(keys), -1, dtype=np.int64)
    ranks[at] = inverse
    return ranks, at[first], counts


def _counted_phrases(shared: Broadcast, words: Broadcast, pairs: Broadcast | None, shard_bits: int, bits: int):
    """Filters of the pairs of frequent words, or, given the frequent pairs, of the longer phrases of these."""

    def count(numbers: list[int], known: list[int]) -> Iterator[pa.RecordBatch]:
        at, ids = np.array(numbers, dtype=np.int64), np.array(known, dtype=np.uint64)
        rows: list[tuple] = []

        def add(m: int, first: np.ndarray, counts: np.ndarray) -> None:
            lanes = [ids[at[first + j]] for j in range(m)]
            rows.extend((m, *own) for own in shard_filters(lanes, counts, shard_bits))

        # Rank of the phrase of m words that starts at a position, from that of m - 1 and the next word.
        known_from = at[:-1] * len(ids) + at[1:]
        ranks, first, counts = _ranked(known_from, (at[:-1] > 0) & (at[1:] > 0))
        if pairs is None:
            add(2, first, counts)
        else:
            frequent = Bitmap(*pairs.value).holds([ids[at[first]], ids[at[first + 1]]])
            good = (ranks >= 0) & np.concatenate((frequent, [False]))[ranks]
            whole = good
            for m in range(3, LONGEST + 1):
                whole = whole[:-1] & good[m - 2 :]
                ranks, first, counts = _ranked(ranks[: len(whole)] * len(ids) + at[m - 1 :], whole)
                add(m, first, counts)
        if rows:
            columns = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FILTERS)], schema=_FILTERS)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, known, langs, different = [0], [0], {}, 0
        frequent = Bitmap(*words.value)
        for batch in batches:
            for lang, text in zip(*(batch.column(i) for i in (0, 1))):
                name = lang.as_py()
                own = langs.get(name)
                if own is None:
                    own = langs[name] = _Ids(name, known, shared.value, frequent, bits)
                different -= len(own)
                for part in pieces(text.as_py()):
                    numbers.extend(map(own.__getitem__, part))
                    numbers.append(0)
                different += len(own)
                if len(numbers) >= HELD or different >= HELD_WORDS:
                    yield from count(numbers, known)
                    numbers, known, langs, different = [0], [0], {}, 0
        yield from count(numbers, known)

    return counted


def _merged(shard_bits: int, least: int):
    def merged(group: pa.Table) -> pa.Table:
        """The frequent phrases of a shard."""
        shard = group.column("shard")[0].as_py()
        lanes, counts = merge_filters([f.as_py() for f in group.column("filter")], shard, shard_bits)
        kept = counts >= least
        lanes = [lane[kept] for lane in lanes]
        ids = np.stack([permuted(lanes), *lanes[1:]], axis=1).astype(np.int64)
        offsets = np.arange(0, ids.size + 1, len(lanes))
        phrases = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.ravel(), pa.int64()))
        return pa.Table.from_arrays([phrases, pa.array(counts[kept], pa.int64())], schema=_PHRASES)

    return merged


def _bitmap(phrases: DataFrame, m: int) -> tuple[int, bytes]:
    """Where frequent phrases of m words lie, as `Bitmap` takes it. The driver sees it, at most 2^`BITMAP_BITS` bits."""
    bits = max(_SLICE_BITS, min(BITMAP_BITS, (16 * max(1, phrases.count())).bit_length()))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids").flatten().to_numpy().astype(np.uint64).reshape(-1, m)
            at = places([np.ascontiguousarray(ids[:, j]) for j in range(m)], bits)
            columns = [pa.array(at >> _SLICE_BITS, pa.int32()), pa.array(at & ((1 << _SLICE_BITS) - 1), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["slice", "place"])

    def drawn(group: pa.Table) -> pa.Table:
        own = np.zeros(1 << _SLICE_BITS, dtype=np.uint8)
        own[group.column("place").to_numpy()] = 1
        data = np.packbits(own, bitorder="little").tobytes()
        return pa.table({"slice": pa.array([group.column("slice")[0].as_py()], pa.int32()), "data": [data]})

    slices = phrases.select("ids").mapInArrow(placed, "slice int, place int").distinct()
    data = bytearray(1 << (bits - 3))
    size = 1 << (_SLICE_BITS - 3)
    for row in slices.groupBy("slice").applyInArrow(drawn, "slice int, data binary").toLocalIterator():
        data[row.slice * size : (row.slice + 1) * size] = row.data
    return bits, bytes(data)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text")
    )


def _frequent_words(words: DataFrame, least: int, bits: int) -> tuple[DataFrame, dict]:
    """Frequent words with an id that no other word has, and the words whose hash is not their id."""
    spark = words.sparkSession
    shared = words.groupBy("id").agg(F.count(F.lit(1)).alias("words"), F.max("f").alias("most"))
    shared = shared.where((F.col("words") > 1) & (F.col("most") >= least)).select("id")
    told = words.join(shared, "id", "left_semi").select("lang", "word").limit(SHARED + 1).collect()
    if len(told) > SHARED:
        raise ValueError("too many words share a hash: raise ID_BITS")
    own_ids = {key: (1 << bits) + k for k, key in enumerate(sorted((r.lang, r.word) for r in told))}
    given = spark.createDataFrame([(*key, own) for key, own in own_ids.items()], "lang string, word string, own long")
    frequent = words.where(F.col("f") >= least).join(F.broadcast(given), ["lang", "word"], "left")
    frequent = frequent.select("lang", "word", F.coalesce("own", "id").alias("id"), "f")
    return stored(frequent, "frequent"), {(lang, word.encode()): own for (lang, word), own in own_ids.items()}


def phrase_counts(
    docs: DataFrame, least: int = LEAST, bits: int = ID_BITS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All phrases of 1 to 5 words with `least` occurrences or more (`ids`, `f`), their words (`lang, word, id,
    f`) and the occurrences of all words by language (`lang, n`)."""
    spark: SparkSession = docs.sparkSession
    texts = _texts(docs)
    counted = texts.mapInArrow(_counted_words(bits), _WORDS_SCHEMA)
    words = stored(counted.groupBy("lang", "word").agg(F.min("id").alias("id"), F.sum("n").alias("f")), "words")
    totals = stored(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    frequent, own_ids = _frequent_words(words, least, bits)
    single = frequent.select(F.array("id").alias("ids"), "f")

    # Filters together hold an entry for each position at most.
    entry = 2 * LANE_BYTES + 1
    size = (totals.agg(F.sum("n")).first()[0] or 0) * entry
    shard_bits = min(MOST_SHARD_BITS, max(0, (size // SHARD_BYTES).bit_length()))
    shared = spark.sparkContext.broadcast(own_ids)
    word_places = spark.sparkContext.broadcast(_bitmap(single, 1))

    def frequent_phrases(pairs: Broadcast | None, name: str) -> DataFrame:
        filters = texts.mapInArrow(_counted_phrases(shared, word_places, pairs, shard_bits, bits), _FILTERS_SCHEMA)
        merged = filters.groupBy("m", "shard").applyInArrow(_merged(shard_bits, least), _PHRASES_SCHEMA)
        return stored(merged, name)

    two = frequent_phrases(None, "pairs")
    longer = frequent_phrases(spark.sparkContext.broadcast(_bitmap(two, 2)), "longer")
    return stored(single.unionByName(two).unionByName(longer), "phrases"), frequent, totals


def _part(start: Column | int, length: Column | int) -> Column:
    return F.slice("ids", F.lit(start) if isinstance(start, int) else start, F.lit(length) if isinstance(length, int) else length)


def collocations(docs: DataFrame, least: int = LEAST, first: int = FIRST, bits: int = ID_BITS) -> DataFrame:
    """The `first` strongest collocations of each language: `lang, rank` (from 1), `phrase, a, l, r, n, score`.

    Takes `lang` (null: `und`) and `text` (null: empty). Candidates are phrases of two to five words within a
    piece with a >= `least` occurrences. Of all cuts into a first part, l times there, and a rest, r times
    there, the one with the lowest score floor(1000 a n / (l r)) counts, ties to the shortest first part; n are
    all words of the language. A candidate goes if a longer one holds it and occurs as often. Ties go to the
    larger a, then to the lesser phrase by its bytes. Rows that repeat count each, whatever their ids; long
    texts and words count whole; no document, or none with a frequent phrase, gives no row. Other columns are
    not read, whatever their names.
    """
    phrases, words, totals = phrase_counts(docs, least, bits)
    candidates = phrases.where(F.size("ids") > 1).select("ids", F.col("f").alias("a"))
    size = F.size("ids")
    cuts = candidates.select("ids", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "ids", "a", "k", _part(1, F.col("k")).alias("left"), _part(F.col("k") + 1, size - F.col("k")).alias("right")
    )
    lefts = phrases.select(F.col("ids").alias("left"), F.col("f").alias("l"))
    rights = phrases.select(F.col("ids").alias("right"), F.col("f").alias("r"))
    langs = words.join(totals, "lang").select(F.col("id").alias("of"), "lang", "n")
    rated = cuts.join(lefts, "left").join(rights, "right").join(langs, F.get("ids", F.lit(0)) == F.col("of"))
    exact = {c: F.col(c).cast("decimal(18,0)") for c in ("a", "n", "l", "r")}
    rated = rated.withColumn("above", F.lit(1000).cast("decimal(4,0)") * (exact["a"] * exact["n"]))
    rated = rated.withColumn("below", exact["l"] * exact["r"]).withColumn("score", F.expr("above div below"))
    best = rated.groupBy("ids", "a", "lang", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))

    m = F.col("m")
    inner = (
        candidates.where(size > 2)
        .select("ids", "a", F.explode(F.sequence(F.lit(2), size - 1)).alias("m"))
        .select("a", F.explode(F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: _part(i, m))).alias("inner"))
        .groupBy("inner")
        .agg(F.max("a").alias("most"))
    )
    kept = best.join(inner, F.col("ids") == F.col("inner"), "left").where("most IS NULL OR most < a")
    kept = stored(kept.select("ids", "a", "lang", "n", "best.score", "best.l", "best.r"), "kept")
    spelled = (
        kept.select("ids", F.posexplode("ids").alias("at", "id"))
        .join(words.select("id", "word"), "id")
        .groupBy("ids")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    )
    strongest = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        kept.join(spelled, "ids")
        .withColumn("rank", F.row_number().over(strongest).cast("long"))
        .where(F.col("rank") <= first)
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )


# The same rows in SQL, by counting all phrases.
ORACLE = r"""
WITH cut AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
said AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM cut),
totals AS (SELECT lang, sum(len(w)) AS n FROM said GROUP BY lang),
grams AS (
  SELECT lang, w[i:i + m - 1] AS g
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM said CROSS JOIN range(1, 6) AS sizes(m))
),
phrases AS (SELECT lang, g, count(*) AS f FROM grams GROUP BY lang, g HAVING count(*) >= 100),
cuts AS (SELECT lang, g, f AS a, unnest(range(1, len(g))) AS k FROM phrases WHERE len(g) > 1),
rated AS (
  SELECT c.lang, c.g, a, x.f AS l, y.f AS r, n,
         (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score, k
  FROM cuts c JOIN phrases x ON x.lang = c.lang AND x.g = c.g[1:k]
  JOIN phrases y ON y.lang = c.lang AND y.g = c.g[k + 1:len(c.g)] JOIN totals t ON t.lang = c.lang
),
best AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (
  SELECT lang, g[i:i + m - 1] AS g, max(f) AS most
  FROM (SELECT lang, g, f, m, unnest(range(1, len(g) - m + 2)) AS i
        FROM phrases CROSS JOIN range(2, 5) AS sizes(m) WHERE m < len(g))
  GROUP BY ALL
)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM (
  SELECT b.*, array_to_string(b.g, ' ') AS phrase,
         row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, array_to_string(b.g, ' ')) AS rank
  FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.g = b.g WHERE most IS NULL OR most < a
)
WHERE rank <= 2000
"""
