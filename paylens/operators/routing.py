"""Routing questions to templates by keywords, and reading parameters out of their text.

A rule-based stand-in for a language model: one projection over the question table, no join and no
shuffle, since keywords, periods and months are fixed lists.
"""

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.fixed_values import (
    MONTH_ENDINGS,
    MONTH_STEMS,
    PERIOD_NAMES,
    SEARCH_LETTERS,
    SMALLEST_FIRST_KEYWORDS,
    TEMPLATE_KEYWORDS,
)
from paylens.functions.dates import named_periods, parse_iso_date
from paylens.functions.text import normalise
from paylens.operators.scored import TermIndex, scored_template

_NUMBER = r"([0-9]+(?:[.,][0-9]+)?)"
LIMIT_PATTERN = r"([0-9]{1,9}) (?:kõige )?(?:suurim|kallim|kalleim|väikseim|odavaim)"
AMOUNT_PATTERN = rf"(?:alla|kuni) {_NUMBER} ?(?:€|eur)"
PERCENT_PATTERN = rf"{_NUMBER} ?(?:%|prots)"
COUNT_PATTERN = r"(?:vähemalt|üle) ([0-9]{1,9}) korda"
MONTH_PATTERN = (
    f"(?:^|[^{SEARCH_LETTERS}])({'|'.join(MONTH_STEMS)}){MONTH_ENDINGS}"
    f"(?: ([0-9]{{4}}))?(?:[^{SEARCH_LETTERS}]|$)"
)


def _mentions(words: Column, beginnings: tuple[str, ...]) -> list[Column]:
    """Per beginning of a word or phrase, whether it occurs in space-padded words."""
    return [F.contains(words, F.lit(f" {b}")) for b in beginnings]


def _any(conditions: list[Column]) -> Column:
    found = conditions[0]
    for condition in conditions[1:]:
        found = found | condition
    return found


def _keyword_template(words: Column) -> Column:
    """Template with most keywords, null without any; the earlier in the list on a tie."""
    scores = []
    for place, (template, keywords) in enumerate(TEMPLATE_KEYWORDS.items()):
        score = sum((c.cast("int") for c in _mentions(words, keywords)), F.lit(0))
        scores.append(F.struct(score.alias("score"), F.lit(-place).alias("place"),
                               F.lit(template).alias("template")))
    best = F.array_max(F.array(*scores))
    return F.get(F.transform(F.array(best), lambda b: F.when(b["score"] > 0, b["template"])), F.lit(0))


def _extract(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _bounds(first: Column, last: Column) -> Column:
    return F.struct(first.alias("date_from"), last.alias("date_to"))


def _iso_dates(text: Column) -> Column:
    """All valid ISO dates in the text, in order."""
    shaped = F.regexp_extract_all(text, F.lit("([0-9]{4}-[0-9]{2}-[0-9]{2})"))
    return F.filter(F.transform(shaped, parse_iso_date), lambda d: d.isNotNull())


def _mentioned_dates(found: Column) -> Column:
    """First two valid dates; a single one stands for that day."""
    return F.when(F.size(found) > 0, _bounds(found[0], F.coalesce(F.get(found, F.lit(1)), found[0])))


def _mentioned_period(words: Column, today: Column) -> Column:
    """The first named period of the list that is mentioned."""
    found = [
        F.when(_any(_mentions(words, PERIOD_NAMES[name])), _bounds(*bounds))
        for name, bounds in named_periods(today).items()
    ]
    return F.coalesce(*found)


def _month_number(text: Column) -> Column:
    """Number of the first month mentioned by name; 0 if none is."""
    stems = F.array(*[F.lit(m) for m in MONTH_STEMS])
    return F.array_position(stems, F.regexp_extract(text, MONTH_PATTERN, 1)).cast("int")


def _mentioned_month(number: Column, text: Column, today: Column) -> Column:
    """That month in the year that follows its name, or else in this year."""
    year = F.coalesce(_extract(text, MONTH_PATTERN, 2), F.year(today).cast("string")).cast("int")
    first = F.make_date(F.greatest(year, F.lit(1)), number, F.lit(1))
    return F.when(number > 0, _bounds(first, F.last_day(first)))


def route_questions(
    questions: DataFrame, today: date, bounds: tuple[date, date], index: TermIndex | None = None
) -> DataFrame:
    """Template, dates and raw parameters of each question in `question_id, text`.

    The template goes by keywords, or, given an index of descriptions, by BM25 score.

    Dates come from ISO dates in the text, else a named period, else a month name, else the bounds of
    the dataset. Other parameters are the text found, or null. No keyword, or too low a score, gives a null template.
    """
    words = F.concat(F.lit(" "), normalise(F.col("text")), F.lit(" "))
    day = F.lit(today)
    text = F.col("lowered")
    # Step by step: what a later step uses more than once is computed once.
    prepared = questions.select(
        "question_id", F.lower("text").alias("lowered"), words.alias("words")
    ).select(
        "*",
        (_keyword_template(F.col("words")) if index is None else scored_template(text, index)["template"])
        .alias("template_id"),
        _iso_dates(text).alias("days"),
        _month_number(text).alias("month"),
    )
    words = F.col("words")
    dates = F.coalesce(
        _mentioned_dates(F.col("days")),
        _mentioned_period(words, day),
        _mentioned_month(F.col("month"), text, day),
        _bounds(F.lit(bounds[0]), F.lit(bounds[1])),
    )
    routed = prepared.select(
        "question_id",
        "template_id",
        dates.alias("dates"),
        F.when(_any(_mentions(words, SMALLEST_FIRST_KEYWORDS)), F.lit("ASC")).alias("direction"),
        _extract(text, LIMIT_PATTERN).alias("limit"),
        F.translate(_extract(text, AMOUNT_PATTERN), ",", ".").alias("max_amount"),
        _extract(text, COUNT_PATTERN).alias("min_count"),
        F.translate(_extract(text, PERCENT_PATTERN), ",", ".").alias("min_change_pct"),
    )
    return routed.select(
        "question_id", "template_id", "dates.date_from", "dates.date_to", "direction", "limit",
        "max_amount", "min_count", "min_change_pct",
    )


def routed_params(routed: DataFrame) -> DataFrame:
    """Routed questions in the shape of parsed replies, ready for the parameter check."""
    params = F.create_map(
        F.lit("alates_kuupaev"), F.col("date_from").cast("string"),
        F.lit("kuni_kuupaev"), F.col("date_to").cast("string"),
        F.lit("suund"), F.col("direction"),
        F.lit("limit"), F.col("limit"),
        F.lit("summa_lavi"), F.col("max_amount"),
        F.lit("min_kordusi"), F.col("min_count"),
        F.lit("muutus_lavi_pct"), F.col("min_change_pct"),
    )
    problem = F.when(F.col("template_id").isNull(), F.lit("no template fits"))
    return routed.select(
        "question_id", "template_id", params.alias("params"), problem.alias("problem")
    )
