"""Personal data: fixed patterns, and terms that the corpus shows to reveal them.

Each kind of personal data, and each single datum, is a protected entity c. Over all sentences of the corpus, the information
that a term t gives about c is PMI(c, t) = log2(p(c, t) / (p(c) p(t))), and what there is to know is
IC(c) = -log2 p(c). A term that gives IC(c) / `ALPHA` or more, and this not by chance, discloses c. It is replaced by a more
general term (its first letters, or its digits blanked) where that one discloses nothing, and removed
otherwise. DataFrame functions only.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.llm.common import let, running, stored

# Fixed patterns, by kind in this order. Each takes possessively what it could not give back anyway, and
# a run of characters is tried once, from its start or from where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for a kind to be looked for.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
KINDS = tuple(PATTERNS)
TERM = "term"
# A term that gives a kind's information content divided by this is disclosing.
ALPHA = 1.2
# Contexts (different data of a kind, or different sentences around a datum) of which fewer show nothing.
LEAST_CONTEXTS = 2
# Bound on the chance that any term of no relation to an entity is taken to disclose it.
CHANCE = 0.01
# Letters of a word that its general form keeps.
STEM = 3
_WORD = r"[^\p{L}\p{N}]+"
_SENTENCE = r"(?<=[.!?])\s+|\n"
# What every sentence with personal data has.
_MAY_HOLD = r"[@+]|[0-9]"


def _small_parts(match: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

    return F.forall(F.split(match, r"\."), small)


def _luhn(match: Column) -> Column:
    digits = F.split(F.reverse(F.translate(match, " -", "")), "")
    values = F.transform(F.filter(digits, lambda d: d != ""), lambda d: d.cast("int"))

    def checked(v: Column) -> Column:
        doubled = F.transform(v, lambda d, i: F.when(i % 2 == 0, d).when(d < 5, 2 * d).otherwise(2 * d - 9))
        total = F.aggregate(doubled, F.lit(0), lambda x, y: x + y)
        return F.size(v).between(16, 19) & (total % 10 == 0)

    return let(values, checked)


def _phone_digits(match: Column) -> Column:
    return F.length(F.regexp_replace(match, "[^0-9]", "")).between(8, 15)


VALID = {"email": lambda match: F.lit(True), "ip": _small_parts, "card": _luhn, "phone": _phone_digits}


def _places(text: Column, pattern: Column) -> Column:
    """Every match of a pattern with its `start` and `end` in code points."""
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")

    def placed(found: Column) -> Column:
        gaps = F.split(text, pattern)
        lengths = F.zip_with(
            F.slice(gaps, F.lit(1), F.size(found)),
            found,
            lambda gap, match: F.struct(F.length(gap).alias("gap"), (F.length(gap) + F.length(match)).alias("both")),
        )

        def summed(pairs: Column) -> Column:
            starts = running(F.transform(pairs, lambda p: p["both"]), F.lit(0), lambda x, y: x + y)
            at = F.zip_with(starts, pairs, lambda s, p: s + p["gap"])
            return F.zip_with(
                at, found, lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("found"))
            )

        return let(lengths, summed)

    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    return let(matches, lambda found: F.when(F.size(found) == 0, none).otherwise(placed(found)))


def base_spans(text: Column, kind: str) -> Column:
    """Valid matches of one kind: leftmost, not overlapping, as structs of `start`, `end` and `found`."""
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")
    valid = F.filter(_places(text, F.lit(PATTERNS[kind])), lambda m: VALID[kind](m["found"]))
    hint = HINTS[kind]
    return valid if hint is None else F.when(text.contains(hint), valid).otherwise(none)


def with_base_spans(docs: DataFrame) -> DataFrame:
    """`doc_id`, `copy` (the hash of the text), `text` (null: empty) and one array of spans per kind."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    kinds = [base_spans(F.col("text"), kind).alias(kind) for kind in KINDS]
    return rows.select("doc_id", F.xxhash64("text").alias("copy"), "text", *kinds)


def general(word: Column) -> Column:
    """The general form of a word: digits blanked where it has some, else its first letters."""
    return F.when(word.rlike("[0-9]"), F.regexp_replace(word, "[0-9]", "0")).otherwise(
        F.concat(F.substring(word, 1, STEM), F.lit("*"))
    )


def _words(sentence: Column) -> Column:
    cut = F.split(F.lower(sentence), _WORD)
    return F.array_distinct(F.filter(cut, lambda w: F.length(w) > 1))


def _terms(sentence: Column) -> Column:
    """The distinct words of a sentence and their general forms, told apart by a mark."""
    return let(
        _words(sentence),
        lambda words: F.array_union(
            F.transform(words, lambda w: F.concat(F.lit("="), w)),
            F.transform(words, lambda w: F.concat(F.lit("~"), general(w))),
        ),
    )


def _sentences(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.explode(F.split(text, _SENTENCE)).alias("sentence")).where("sentence <> ''")


def _holding(sentences: DataFrame) -> DataFrame:
    """Sentences with personal data: their kinds, each with a hash of the data and those of each datum, and
    their words without it, with a hash of these as the context."""

    def held(kind: str) -> Column:
        def named(spans: Column) -> Column:
            data = F.xxhash64(F.transform(spans, lambda s: s["found"]))
            each = F.array_distinct(F.transform(spans, lambda s: F.xxhash64(_plain(s["found"], kind))))
            return F.when(F.size(spans) > 0, F.struct(F.lit(kind).alias("kind"), data.alias("data"), each.alias("each")))

        return let(base_spans(F.col("sentence"), kind), named)

    kinds = F.array(*map(held, KINDS))
    kept = sentences.where(F.col("sentence").rlike(_MAY_HOLD)).select(
        "sentence", F.array_compact(kinds).alias("kinds")
    )
    kept = kept.where(F.size("kinds") > 0).select("kinds", _terms(_masked(F.col("sentence"))).alias("terms"))
    return kept.withColumn("context", F.xxhash64("terms"))


def _masked(sentence: Column) -> Column:
    """A sentence with a space in place of all that looks like personal data."""
    bare = sentence
    for pattern in PATTERNS.values():
        bare = F.regexp_replace(bare, pattern, " ")
    return F.when(sentence.rlike(_MAY_HOLD), bare).otherwise(sentence)


def _plain(found: Column, kind: str) -> Column:
    """A datum however it is written."""
    return F.regexp_replace(found, "[^0-9]", "") if kind in ("card", "phone") else F.lower(found)


def _met(pairs: DataFrame) -> DataFrame:
    """Per `term`, `kind` and `entity` the sentences with both and the different contexts among these."""
    return (
        pairs.groupBy("term", "kind", "entity", "context")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("term", "kind", "entity")
        .agg(F.sum("n").alias("both"), F.count(F.lit(1)).alias("contexts"))
    )


def _by_chance(tests: int) -> Column:
    """Whether a term may have met its entity by chance: Chernoff's bound on the binomial tail, for so many
    tests. Sentences with both count once a context, those with the term alone each time."""
    k, p = F.col("contexts").cast("double"), F.col("share")
    n = k + F.greatest(F.col("alone") - F.col("both"), F.lit(0))
    q = k / n
    without = F.when(q < 1, (1 - q) * F.log((1 - q) / F.greatest(1 - p, F.lit(1e-12)))).otherwise(0.0)
    return (q <= p) | (n * (q * F.log(q / p) + without) < F.log(F.lit(max(1, tests) / CHANCE)))


def disclosing_terms(docs: DataFrame) -> DataFrame:
    """Terms that reveal a kind of personal data, one row each, with what stands for them.

    Columns `term`, `kind` (the one revealed most, itself or a datum of it), `pmi`, `content` (that kind's information content)
    and `instead` (the general form, or null where that discloses as well). Counted over the sentences
    of all documents, for each kind and for each datum. Copies teach nothing: of a kind the different data
    count, of a datum the sentences that differ without it; see `_by_chance`. Entities that a term reveals alike go
    by the name of their kind, the last one; null and empty texts have no sentence, and no document gives no row.
    """
    sentences = _sentences(docs)
    holding = stored(_holding(sentences), "holding")
    of_kind = holding.select(F.inline("kinds"), "terms").select(
        "kind", F.lit(0).cast("long").alias("entity"), F.col("data").alias("context"), "terms"
    )
    single = holding.select(F.inline("kinds"), "terms", "context").select(
        "kind", F.explode("each").alias("entity"), "context", "terms"
    )
    # A datum in one context only cannot meet a term in two.
    again = single.groupBy("kind", "entity").agg(F.min("context").alias("low"), F.max("context").alias("high"))
    again = stored(again.where("low <> high").select("kind", "entity"), "again")
    single = single.join(again, ["kind", "entity"])
    total = float(max(1, sentences.count()))
    levels = []
    for name, rows in (("kind", of_kind), ("datum", single)):
        met = stored(_met(rows.select("kind", "entity", "context", F.explode("terms").alias("term"))), f"met_{name}")
        share = (F.count(F.lit(1)) / F.lit(total)).alias("share")
        shares = stored(rows.groupBy("kind", "entity").agg(share), f"shares_{name}")
        shares = F.broadcast(shares) if name == "kind" else shares
        levels.append((met.where(F.col("contexts") >= LEAST_CONTEXTS), shares, met.count()))
    asked = stored(levels[0][0].select("term").union(levels[1][0].select("term")).distinct(), "asked")
    # The same words as beside personal data, so that a term is alone at least as often as with any.
    counted = (
        sentences.select(F.explode(_terms(_masked(F.col("sentence")))).alias("term"))
        .join(asked, "term", "left_semi")
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("alone"))
    )
    counted = stored(counted, "counted")

    def rate(met: DataFrame, shares: DataFrame, tests: int) -> DataFrame:
        return (
            met.join(counted, "term")
            .join(shares, ["kind", "entity"])
            .withColumn("pmi", F.log2(F.col("both") / (F.col("alone") * F.col("share"))))
            .withColumn("content", -F.log2("share"))
            .where((F.col("pmi") >= F.col("content") / ALPHA) & ~_by_chance(tests))
            .select("term", "kind", "pmi", "content")
        )

    rated = rate(*levels[0]).union(rate(*levels[1]))
    rated = stored(rated.select("term", "kind", "pmi", "content"), "rated")
    best = rated.groupBy("term").agg(F.max(F.struct("pmi", "kind", "content")).alias("best"))
    marked = F.substring("term", 2, 1 << 30)
    words = best.where(F.col("term").startswith("=")).select(
        marked.alias("term"), "best.kind", "best.pmi", "best.content", general(marked).alias("form")
    )
    forms = best.where(F.col("term").startswith("~")).select(marked.alias("revealing"))
    return words.join(forms, F.col("form") == F.col("revealing"), "left").select(
        "term", "kind", "pmi", "content", F.when(F.col("revealing").isNull(), F.col("form")).alias("instead")
    )


def _term_pattern(terms: Column) -> Column:
    quoted = F.array_join(F.array_sort(terms), "|")
    return F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), quoted, F.lit(r")(?![\p{L}\p{N}])"))


def find_spans(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Personal data and disclosing terms of every document, as arrays of spans.

    Takes `doc_id` and `text`; gives `doc_id`, `copy`, `text`, one array per kind, and `term` with the
    spans of disclosing terms that overlap no other; each span has `start`, `end` (code points, end
    exclusive) and `found`. `instead` maps the terms of the document to what stands for them (null:
    nothing). A null text is empty; equal rows have equal spans; long texts are searched whole; no document gives no
    row. Other columns are not read, whatever their names. `terms` are those of `disclosing_terms` over these
    documents unless given.
    """
    terms = stored(disclosing_terms(docs), "terms") if terms is None else terms
    rows = docs.select(
        F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")
    )
    hits = (
        rows.select("id", F.xxhash64("text").alias("of"), F.explode(_words(F.col("text"))).alias("term"))
        .join(terms.select("term", "instead"), "term")
        .groupBy("id", "of")
        .agg(F.map_from_entries(F.collect_set(F.struct("term", "instead"))).alias("instead"))
    )
    hits = stored(hits, "hits")
    found = with_base_spans(docs)
    joined = found.join(hits, found["doc_id"].eqNullSafe(hits["id"]) & (found["copy"] == hits["of"]), "left")
    base = F.concat(*KINDS)
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")
    places = _places(F.col("text"), _term_pattern(F.map_keys("instead")))
    apart = let(
        base,
        lambda spans: F.filter(
            places, lambda t: ~F.exists(spans, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))
        ),
    )
    return joined.select(
        "doc_id",
        "copy",
        "text",
        *KINDS,
        F.when(F.col("instead").isNull(), none).otherwise(apart).alias(TERM),
        "instead",
    )


def spans_text(kinds: tuple[str, ...]) -> Column:
    """`kind:start:end` of all spans by kind as listed, then start, comma-joined."""

    def named(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    return F.array_join(F.concat(*map(named, kinds)), ",")


def span_digests(docs: DataFrame) -> DataFrame:
    """Per document the number of spans per kind, a hash of those of the fixed kinds, and all of them."""
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in (*KINDS, TERM)]
    return find_spans(docs).select(
        "doc_id", *counts, F.sha2(spans_text(KINDS), 256).alias("base_sha256"), spans_text((*KINDS, TERM)).alias("spans")
    )


def sanitised(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """`doc_id` and `text` of every document, with personal data and disclosing terms replaced.

    Data of a kind becomes its name in brackets, a term its general form or nothing. Overlapping spans
    become one, under the name of the first. See `find_spans` for the rest.
    """

    def spans(kind: str, label) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"], s["end"], label(s).alias("label")))

    marks = [spans(k, lambda s, k=k: F.lit(f"[{k.upper()}]")) for k in KINDS]
    marks.append(spans(TERM, lambda s: F.coalesce(F.get(F.map_values(F.map_filter("instead", lambda k, v: k == F.lower(s["found"]))), F.lit(0)), F.lit(""))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        done = F.when(s["start"] >= acc["at"], F.concat(acc["done"], before, s["label"])).otherwise(acc["done"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), done.alias("done"))

    rest = lambda acc: F.concat(acc["done"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    text = F.aggregate(F.array_sort(F.concat(*marks)), start, step, rest)
    return find_spans(docs, terms).select("doc_id", text.alias("text"))
