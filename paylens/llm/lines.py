"""Line deduplication through deletion neighbourhoods.

Lines are sequences of words. A line goes when an earlier line, by document id and line number, has the
same words, or differs in one word added, left out or changed; for the latter it must have at least
`EDIT_WORDS` words. Two such lines share a variant: the words without one of them, or one line's words
and the other's without one. So variants are hashed, equal ones meet in a group, and the earliest line
of the group is all that the others need; no pairs are listed. As either the first or the second half
of two such lines is equal, only lines that share a half with another one emit variants, and only those
that leave out a word of the other half. The words of a line and of the earlier one it is said to
repeat are compared in the end. DataFrame functions only.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.llm.common import fresh, let, likely_in, quoted, running, stored

# Words that a line must have to be matched with one edit.
EDIT_WORDS = 8


def line_words(line: Column) -> Column:
    """The words of a line, cut at ASCII white space."""
    return F.array_remove(F.split(line, r"[\x20\x09-\x0D]+"), "")


def _contents(docs: DataFrame) -> DataFrame:
    """Lines with words: `doc_id`, `copy` (the hash of the text), `line` (from 0) and `content`.

    Texts are hashed before their lines become rows, so that no line carries its text. The filter goes by the
    content, as one by the words would have them worked out twice.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), "text")
    contents = F.split(F.coalesce("text", F.lit("")), "\n")
    lines = texts.select("doc_id", "copy", F.posexplode(contents).alias("line", "content"))
    return lines.where(F.col("content").rlike(r"[^\x20\x09-\x0D]"))


def _halves(n: Column, words: Column) -> list[Column]:
    """Hashes of the first and second half, as a line of n words and as one of n - 1 and one more."""
    out = []
    for m in (n, n - 1):
        first, last = F.floor(m / 2).cast("int"), F.ceil(m / 2).cast("int")
        whole = m >= EDIT_WORDS
        out.append(F.when(whole, F.xxhash64(m, F.lit("first"), F.slice(words, F.lit(1), first))))
        out.append(F.when(whole, F.xxhash64(m, F.lit("last"), F.slice(words, n - last + 1, last))))
    return out


def _hashed(docs: DataFrame) -> DataFrame:
    """Lines as hashes: `a` and `b` of all words, `n` words, and `halves`."""
    n, words = F.size("words"), F.col("words")
    return _contents(docs).select("doc_id", "copy", "line", line_words(F.col("content")).alias("words")).select(
        "doc_id",
        "copy",
        "line",
        F.xxhash64("words").alias("a"),
        F.xxhash64(F.lit(1), "words").alias("b"),
        n.alias("n"),
        F.array(*_halves(n, words)).alias("halves"),
    )


def _xor(x: Column, y: Column) -> Column:
    return x.bitwiseXOR(y)


def _xor_all(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), _xor)


def _variants(lines: DataFrame) -> DataFrame:
    """Keys under which a line meets others, with `side`: 0 meets 0, 1 (whole) meets 2 (one word less).
    Only words are left out that the line's `ROLES` ask for.

    With g(w, j) the hash of word w at place j, a sequence is the XOR of its g. Leaving out word i moves
    the later words down by one: all g(w, j - 1), with those before i put back, without word i itself.
    """
    def rests(words: Column) -> Column:
        here = F.transform(words, lambda w, j: F.xxhash64(w, j))
        down = F.transform(words, lambda w, j: F.xxhash64(w, j - 1))
        return let(here, lambda h: let(down, lambda d: let(back(h, d), lambda put: all_rests(h, d, put))))

    def back(here: Column, down: Column) -> Column:
        return running(F.zip_with(here, down, _xor), F.lit(0).cast("long"), _xor)

    def all_rests(here: Column, down: Column, put_back: Column) -> Column:
        def without(total: Column) -> Column:
            left = F.zip_with(down, put_back, lambda own, before: _xor(_xor(total, own), before))
            return F.transform(left, lambda rest, i: F.struct(i.alias("i"), rest.alias("rest")))

        return F.struct(_xor_all(here).alias("whole"), let(_xor_all(down), without).alias("rests"))

    n, half = F.col("n"), F.floor(F.col("n") / 2)
    rows = lines.select("first", "n", *ROLES, rests(F.col("words")).alias("hashed"))
    changes = F.filter(
        "hashed.rests",
        lambda r: (F.col("changed_late") & (r["i"] >= half)) | (F.col("changed_early") & (r["i"] < half)),
    )
    late, early = F.floor((n - 1) / 2), n - F.ceil((n - 1) / 2)
    leaves = F.filter(
        "hashed.rests",
        lambda r: (F.col("longer_late") & (r["i"] >= late)) | (F.col("longer_early") & (r["i"] < early)),
    )
    key = lambda *parts, side: F.struct(F.xxhash64(*parts).alias("key"), F.lit(side).alias("side"))
    changed = F.transform(changes, lambda r: key(n, r["i"], r["rest"], side=0))
    shorter = F.transform(F.array_distinct(F.transform(leaves, lambda r: r["rest"])), lambda r: key(n - 1, r, side=2))
    whole = F.filter(F.array(key(n, F.col("hashed.whole"), side=1)), lambda _: F.col("whole"))
    return rows.select("first", F.inline(F.concat(changed, shorter, whole)))


def _one_edit(long: Column, short: Column) -> Column:
    """Whether two different sequences, the first no shorter, differ by one word."""
    n, m = F.size(long), F.size(short)
    at = F.array_position(F.transform(F.arrays_zip(long.alias("x"), short.alias("y")), lambda z: z["x"].eqNullSafe(z["y"])), F.lit(False))
    at = at.cast("int")
    rest = F.slice(long, at + 1, F.greatest(n - at, F.lit(0)))
    same = F.slice(short, at + 1, F.greatest(m - at, F.lit(0)))
    moved = F.slice(short, at, F.greatest(m - at + 1, F.lit(0)))
    return F.when(n == m, rest == same).when(n == m + 1, rest == moved).otherwise(False)


# What a line has with others: an equal half, the other of which may have a word changed; an equal half
# with a line one word shorter; or one with a line one word longer.
ROLES = ("changed_late", "changed_early", "longer_late", "longer_early", "whole")


def _roles(lines: DataFrame) -> DataFrame:
    """Lines (by `a`) that share a half with another line, and what for."""
    halves = lines.select("a", F.posexplode("halves").alias("role", "half")).where("half IS NOT NULL")
    own = F.col("role") < 2
    shared = (
        halves.groupBy("half")
        .agg(
            F.min(F.when(own, F.col("a"))).alias("least"),
            F.max(F.when(own, F.col("a"))).alias("most"),
            F.bool_or(~own).alias("longer"),
        )
        .select("half", (F.col("least") != F.col("most")).alias("equal"), F.col("longer"), "least")
        .where("equal OR (least IS NOT NULL AND longer)")
        .select("half", "equal", "longer")
    )
    # Both sides grow with the lines, so they are sorted and merged at every size.
    met = halves.join(stored(shared, "shared").hint("merge"), "half")
    flags = (
        (F.col("role") == 0) & F.col("equal"),
        (F.col("role") == 1) & F.col("equal"),
        (F.col("role") == 2) & F.col("longer"),
        (F.col("role") == 3) & F.col("longer"),
        own & F.col("longer"),
    )
    found = met.groupBy("a").agg(*[F.bool_or(f).alias(name) for f, name in zip(flags, ROLES)])
    return found.where(" OR ".join(ROLES))


def _near(docs: DataFrame, lines: DataFrame, distinct: DataFrame) -> DataFrame:
    """Lines that an earlier one differs from by one word: `a`, `b`, their `first` place and `of`, the
    earlier one's."""
    some = distinct.join(stored(_roles(lines), "roles"), "a")
    some = stored(some.select("a", "b", "n", "first", *ROLES, "first.*"), "some")
    # The lines move, and are cut into words, only where a place is asked for: bitmaps tell that, and a merge
    # join makes sure.
    texts = likely_in(_contents(docs), some, ["doc_id", "copy", "line"]).withColumnRenamed("doc_id", "id")
    places = some.hint("merge")
    same = (
        texts["id"].eqNullSafe(places["doc_id"])
        & (texts["copy"] == places["copy"])
        & (texts["line"] == places["line"])
    )
    lines = texts.join(places, same).select("a", "b", "n", "first", *ROLES, "content").dropDuplicates(["a", "b"])
    lines = stored(lines.withColumn("words", line_words(F.col("content"))).drop("content"), "words")
    keys = stored(_variants(lines), "variants")
    of_side = [F.min(F.when(F.col("side") == s, F.col("first"))).alias(f"first_{s}") for s in (0, 1, 2)]
    groups = keys.groupBy("key").agg(*of_side, F.count(F.lit(1)).alias("members"))
    groups = stored(groups.where("members > 1").drop("members"), "groups")
    met = keys.join(groups, "key").withColumn(
        "of",
        F.when(F.col("side") == 0, F.col("first_0")).when(F.col("side") == 1, F.col("first_2")).otherwise(F.col("first_1")),
    )
    earliest = met.where("of < first").groupBy("first").agg(F.min("of").alias("of"))
    earliest = stored(earliest, "earliest").withColumn("of_hash", F.xxhash64("of"))
    own = lines.select("a", "b", "first", F.col("words").alias("own"))
    other = lines.select(
        F.xxhash64("first").alias("of_hash"), F.col("first").alias("of_first"), F.col("words").alias("other")
    )
    pairs = earliest.join(own, "first").join(other, "of_hash").where("of <=> of_first")
    longer = F.size("own") >= F.size("other")
    verified = _one_edit(
        F.when(longer, F.col("own")).otherwise(F.col("other")), F.when(longer, F.col("other")).otherwise(F.col("own"))
    )
    return pairs.where(verified).select("a", "b", "first", "of")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """The lines to leave out: `doc_id`, `copy` (the hash of the text), `line` (from 0), the place
    `of_doc_id`, `of_line` of the earliest line that each repeats, and `edits` between them (0 or 1).

    Takes `doc_id` and `text`. Lines without a word never repeat anything. Documents go by id, null
    first, and those of one id by the hash of the text; rows equal in both are one document, none of
    which repeats the other. A line with an earlier one at one edit gives that one's place, else the
    first line of equal words. Null and empty texts have no line; no document gives no row.
    """
    lines = stored(_hashed(docs), "lines")
    place = F.struct("doc_id", "copy", "line")
    distinct = stored(
        lines.groupBy("a", "b", "n").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("rows")), "distinct"
    )
    near = _near(docs, lines, distinct)
    several = distinct.where(F.col("rows") > 1).select("a", "b", "first", F.lit(None).alias("of"))
    again = stored(
        near.unionByName(several).groupBy("a", "b").agg(F.any_value("first").alias("first"), F.max("of").alias("of")),
        "again",
    )
    found = lines.select("doc_id", "copy", "line", "a", "b").join(again.hint("merge"), ["a", "b"])
    found = found.where(F.col("of").isNotNull() | ~place.eqNullSafe(F.col("first")))
    kept = F.coalesce("of", "first")
    return found.select(
        "doc_id",
        "copy",
        "line",
        kept["doc_id"].alias("of_doc_id"),
        kept["line"].alias("of_line"),
        F.when(F.col("of").isNull(), 0).otherwise(1).alias("edits"),
    )


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents without their repeated lines; every document stays, with all its columns.

    A text of which nothing is left is empty; a null text stays null. Other columns may have any name. See
    `repeated_lines`.
    """
    own_id, own_copy, gone = (fresh(docs, name) for name in ("_id", "_copy", "_lines"))
    found = stored(
        repeated_lines(docs)
        .groupBy(F.col("doc_id").alias(own_id), F.col("copy").alias(own_copy))
        .agg(F.collect_set("line").alias(gone)),
        "found",
    )
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64("text") == F.col(own_copy))
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(gone, i))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    columns = [text.alias("text") if name == "text" else c for name, c in zip(docs.columns, quoted(docs))]
    return docs.join(found, same, "left").select(*columns)


# The same rows in SQL, by joining all variants as texts.
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i - 1 AS line, list_filter(string_split_regex(l, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i
        FROM documents)
),
kinds AS (
  SELECT words, len(words) AS n, min({'d': doc_id, 'l': line}) AS f FROM lines WHERE len(words) > 0 GROUP BY words
),
variants AS (
  SELECT f, n, i, list_concat(words[1:i - 1], words[i + 1:n]) AS rest
  FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM kinds WHERE n >= 8)
),
near AS (
  SELECT x.f, y.f AS g FROM variants x JOIN variants y ON x.i = y.i AND x.n = y.n AND x.rest = y.rest
  UNION ALL SELECT x.f, y.f FROM variants x JOIN kinds y ON y.n >= 8 AND x.rest = y.words
  UNION ALL SELECT y.f, x.f FROM variants x JOIN kinds y ON y.n >= 8 AND x.rest = y.words
),
earlier AS (SELECT f, min(g) AS g FROM near WHERE g < f GROUP BY f)
SELECT doc_id, line, coalesce(g, k.f).d AS of_doc_id, coalesce(g, k.f).l AS of_line, (g IS NOT NULL)::INT AS edits
FROM lines JOIN kinds k USING (words) LEFT JOIN earlier e ON e.f = k.f
WHERE g IS NOT NULL OR doc_id <> k.f.d OR line <> k.f.l
"""
