"""Routing questions to templates by BM25 over descriptions of the templates.

An inverted index holds, for every term of the descriptions, its weight in each template. Terms are the
beginnings of words, since Estonian inflects their ends, and pairs of neighbouring ones. A question's score
for a template is the sum of the weights of its different terms; below a threshold no template fits.
Descriptions are settings, a few sentences for each template, so the index is small: its size is
checked, and routing is a projection over the questions without a join or shuffle. Weights are whole
thousandths, so scores do not depend on the order of adding.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.fixed_values import TEMPLATE_IDS
from paylens.functions.text import normalise

# Letters of a word that make a term, and the shortest word that counts.
STEM, SHORTEST = 5, 3
# Words that say nothing about what is asked for.
STOP_WORDS = (
    "aga", "alates", "ega", "eur", "euro", "eurot", "ehk", "enne", "ette", "igal", "ilma", "juba", "jaoks",
    "kaasa", "kas", "kes", "kokku", "kuhu", "kui", "kuid", "kuni", "kus", "kust", "kuu", "kuul", "kuus", "kõik",
    "mida", "midagi", "millal", "mille", "millele", "milline", "millised", "mind", "minu", "mis", "miks", "mul",
    "mulle", "mult", "need", "näita", "oled", "olen", "oli", "olid", "olnud", "palun", "pärast", "see", "seda", "seal",
    "selle", "sest", "siis", "siin", "sel", "tee", "too", "vahemikus", "vahel", "veel", "välja", "üks", "aasta",
    "aastal", "eelmise", "eelmisel", "eelmine", "jooksul", "läheb", "mitu", "ole", "olema", "ning", "või",
)
# How soon a repeated term stops to count, and how far a long description is held against it.
SATURATION, BY_LENGTH = 1.2, 0.75
# Scores, in thousandths, from which a template fits.
FITS_FROM = 1000
MOST_TERMS = 20_000

DESCRIPTIONS = {
    TEMPLATE_IDS["top_transactions"]: (
        "Suurimad kulutused ja kõige kallimad ostud. Kõige suurem väljaminek, suurim makse, suurimad tehingud, "
        "kuhu läks kõige rohkem raha, kalleim ost. Väikseimad ja odavaimad ostud, kõige väiksem makse. "
        "Tehingute edetabel, top kümme."
    ),
    TEMPLATE_IDS["recurring_payments"]: (
        "Korduvad maksed ja regulaarsed arved. Püsimaksed, tellimused, kuumaksed, igakuised maksed, iga kuu sama "
        "saaja, samale kaupmehele mitu korda, raha läheb regulaarselt, liikmemaks, abonement, korduvalt makstud."
    ),
    TEMPLATE_IDS["duplicate_payments"]: (
        "Topeltmaksed ja kahekordsed maksed. Sama arve on makstud kaks korda, sama päev ja sama summa samale "
        "saajale, dubleeritud tehing, topelt võetud raha, ekslikult teist korda tasutud."
    ),
    TEMPLATE_IDS["frequent_small_payments"]: (
        "Sagedased väikesed maksed. Palju väikseid oste, mikromaksed, väike summa, kohvikud ja kioskid, sageli alla "
        "mingi summa, pisikulud, tihti väikesed ostud, näksid, peenraha, väiksed kulutused kogunevad."
    ),
    TEMPLATE_IDS["price_rise"]: (
        "Püsimakse hinnatõus. Teenus on läinud kallimaks, hind on tõusnud, tellimus on kallinenud, teenusepakkuja "
        "tõstis hinda, hinnamuutus, püsikulu kasvas, hind kasvas protsenti, kuutasu suurenes, hinnad kerkisid."
    ),
}


@dataclass(frozen=True)
class TermIndex:
    """Templates in the order that decides ties, and the weights of each term by template."""

    templates: tuple[str, ...]
    weights: dict[str, dict[str, int]]


def terms(text: Column) -> Column:
    """All terms of a text, repeats included: stems in order, then pairs of neighbours. Null for a null text."""
    words = F.filter(
        F.split(normalise(text), " "), lambda w: (F.length(w) >= SHORTEST) & ~w.isin(*STOP_WORDS)
    )
    stems = F.transform(words, lambda w: F.substring(w, 1, STEM))

    def with_pairs(s: Column) -> Column:
        seconds = F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0)))
        return F.concat(s, F.transform(seconds, lambda w, i: F.concat_ws("_", F.get(s, i), w)))

    # One value in an array: lambdas then use it without working it out again.
    return F.get(F.transform(F.array(stems), with_pairs), F.lit(0))


def postings(descriptions: DataFrame) -> DataFrame:
    """`term`, `template_id` and `weight` (long, thousandths of BM25) of `template_id` and `text`.

    Several descriptions of a template count as one. A null template or text teaches nothing.
    """
    said = descriptions.where("template_id IS NOT NULL").select("template_id", F.explode(terms(F.col("text"))).alias("term"))
    counts = said.groupBy("template_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    lengths = said.groupBy("template_id").agg(F.count(F.lit(1)).alias("size"))
    whole = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean"))
    spread = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    tf, df, n = (F.col(c).cast("double") for c in ("tf", "df", "n"))
    rarity = F.log(1 + (n - df + 0.5) / (df + 0.5))
    held = SATURATION * (1 - BY_LENGTH + BY_LENGTH * F.col("size") / F.col("mean"))
    weight = F.floor(1000 * (rarity * (tf * (SATURATION + 1) / (tf + held))))
    # `whole` is one row.
    joined = counts.join(lengths, "template_id").join(spread, "term").join(F.broadcast(whole))
    return joined.select("term", "template_id", weight.alias("weight"))


def term_index(descriptions: DataFrame) -> TermIndex:
    """The index of descriptions, `template_id` in the order of the ids; at most `MOST_TERMS` postings."""
    rows = postings(descriptions).limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"the descriptions have more than {MOST_TERMS} terms")
    weights: dict[str, dict[str, int]] = {}
    for r in rows:
        weights.setdefault(r.term, {})[r.template_id] = r.weight
    return TermIndex(tuple(sorted({r.template_id for r in rows})), weights)


def default_index(spark: SparkSession) -> TermIndex:
    """The index of the five templates' descriptions."""
    return term_index(spark.createDataFrame(list(DESCRIPTIONS.items()), "template_id string, text string"))


def scored_template(text: Column, index: TermIndex, fits_from: int = FITS_FROM) -> Column:
    """A struct of `score` and `template`: the best of a text, the first id on a tie, a null template below
    `fits_from`. A term counts once, however often it is said. A null text or an empty index scores 0."""
    nothing = F.struct(F.lit(0).cast("long").alias("score"), F.lit(None).cast("string").alias("template"))
    if not index.weights:
        return nothing

    def total(hits: Column, template: str) -> Column:
        own = [F.lit(x) for t, w in index.weights.items() if template in w for x in (t, w[template])]
        weight = F.create_map(*own)
        zero = F.lit(0).cast("long")
        return F.aggregate(hits, zero, lambda s, t: s + F.coalesce(F.try_element_at(weight, t).cast("long"), zero))

    def best(hits: Column) -> Column:
        scores = [
            F.struct(total(hits, template).alias("score"), F.lit(-place).alias("place"), F.lit(template).alias("template"))
            for place, template in enumerate(index.templates)
        ]
        return F.array_max(F.array(*scores))

    known = F.array(*[F.lit(t) for t in index.weights])
    found = F.get(F.transform(F.array(F.array_intersect(terms(text), known)), best), F.lit(0))
    fitting = F.get(
        F.transform(
            F.array(found),
            lambda b: F.struct(
                F.coalesce(b["score"], F.lit(0)).cast("long").alias("score"),
                F.when(b["score"] >= fits_from, b["template"]).alias("template"),
            ),
        ),
        F.lit(0),
    )
    return F.when(text.isNull(), nothing).otherwise(fitting)


def route_by_score(questions: DataFrame, index: TermIndex, fits_from: int = FITS_FROM) -> DataFrame:
    """`question_id`, `template_id` and `score` of each question in `question_id, text`.

    One row for each row given: repeated ids and texts stay, a null or empty text scores 0 and has no template,
    and other columns are not read. No question gives no row.
    """
    scored = questions.select("question_id", scored_template(F.col("text"), index, fits_from).alias("best"))
    return scored.select("question_id", F.col("best.template").alias("template_id"), F.col("best.score").alias("score"))
