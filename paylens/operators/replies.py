"""Classifier replies: finding the JSON, and checking parameters against their specs."""

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.fixed_values import (
    PARAM_NAMES,
    PARAM_SPECS,
    REPLY_PARAMS_KEY,
    REPLY_TEMPLATE_KEY,
    TEMPLATE_IDS,
)
from paylens.functions.dates import parse_iso_date
from paylens.functions.text import strip

_FLOAT = r"^[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?$"


def _text_at(json: Column, path: str) -> Column:
    """A member as text; true and false as 1 and 0, which is what they count as in numbers."""
    text = F.try_variant_get(json, path, "string")
    # Only the two words can be flags, so the type is looked up for them alone.
    flag = text.isin("true", "false") & (
        F.schema_of_variant(F.try_variant_get(json, path, "variant")) == "BOOLEAN"
    )
    return F.when(flag, (text == "true").cast("int").cast("string")).otherwise(text)


def _is_empty(kind: Column, text: Column) -> Column:
    """Missing, null, false, zero, or an empty text, list or object."""
    number = ~kind.isin("STRING", "BOOLEAN") & (text.try_cast("double") == 0)
    return (
        text.isNull()
        | (kind == "VOID")
        | text.isin("", "[]", "{}")
        | ((kind == "BOOLEAN") & (text == "0"))
        | F.coalesce(number, F.lit(False))
    )


def parse_replies(replies: DataFrame) -> DataFrame:
    """`question_id, template_id, params, problem` of each reply in `question_id, reply`.

    The JSON runs from the first `{` to the last `}`, so code fences and words around it do no harm.
    `params` maps the known parameter names to their text, null if missing; other names are ignored.
    A row with a `problem` has a null template.
    """
    block = F.nullif(F.regexp_extract("reply", r"(?s)\{.*\}", 0), F.lit(""))
    found = replies.select("question_id", block.alias("block")).withColumn(
        "json", F.try_parse_json("block")
    )

    json = F.col("json")
    template_path, params_path = f"$.{REPLY_TEMPLATE_KEY}", f"$.{REPLY_PARAMS_KEY}"
    read = found.select(
        "question_id",
        "block",
        json.isNotNull().alias("parsed"),
        _text_at(json, template_path).alias("template"),
        F.schema_of_variant(F.try_variant_get(json, template_path, "variant")).alias("kind"),
        _text_at(json, params_path).alias("params_text"),
        F.schema_of_variant(F.try_variant_get(json, params_path, "variant")).alias("params_kind"),
        F.create_map(
            *[x for p in PARAM_NAMES for x in (F.lit(p), _text_at(json, f"{params_path}.{p}"))]
        ).alias("params"),
    )

    template, kind = F.col("template"), F.col("kind")
    is_object = F.col("params_kind").startswith("OBJECT")
    problem = (
        F.when(F.col("block").isNull(), F.lit("no JSON object"))
        .when(~F.col("parsed"), F.lit("JSON does not parse"))
        .when(_is_empty(kind, template), F.lit("no template fits"))
        .when((kind != "STRING") | ~template.isin(*TEMPLATE_IDS.values()), F.lit("unknown template"))
        .when(
            ~is_object & ~_is_empty(F.col("params_kind"), F.col("params_text")),
            F.lit("parameters are not an object"),
        )
    )
    return read.withColumn("problem", problem).select(
        "question_id",
        F.when(F.col("problem").isNull(), template).alias("template_id"),
        "params",
        "problem",
    )


def _spec_map() -> Column:
    """Template -> its parameter specs."""
    by_template: dict[str, list[Column]] = {}
    names = ("param", "type", "default", "least", "greatest")
    for template, *values, allowed in PARAM_SPECS:
        fields = [F.lit(v).cast("string").alias(n) for n, v in zip(names, values)]
        choices = F.array(*[F.lit(c) for c in allowed or ()]).cast("array<string>")
        by_template.setdefault(template, []).append(F.struct(*fields, choices.alias("allowed")))
    return F.create_map(*[x for t, specs in by_template.items() for x in (F.lit(t), F.array(*specs))])


def validate_params(parsed: DataFrame, bounds: tuple[date, date]) -> DataFrame:
    """One row per reply and parameter of its template: `value` if it passes, else `error`.

    A missing number or choice takes its default, a missing date the bound of the dataset. Numbers
    are read as floats and, where whole ones are wanted, cut off after the point. Replies without a
    template give no rows.
    """
    rows = parsed.select(
        "question_id", "template_id", "params",
        F.explode(F.try_element_at(_spec_map(), F.col("template_id"))).alias("spec"),
    ).select(
        "question_id", "template_id", "spec.*",
        F.try_element_at("params", F.col("spec.param")).alias("raw"),
    )
    kind, raw = F.col("type"), F.col("raw")

    given = strip(F.coalesce(raw, F.col("default")))
    number = F.translate(F.when(given.rlike(_FLOAT), given), "_", "").try_cast("double")
    in_range = number.between(F.col("least").cast("double"), F.col("greatest").cast("double"))
    number_error = F.when(number.isNull(), F.lit("not a number")).when(
        ~in_range, F.lit("out of range")
    )
    number_text = F.when(kind == "int", number.try_cast("bigint").cast("string")).otherwise(
        number.cast("string")
    )

    day = strip(raw)
    day_error = (
        F.when(raw.isNull(), F.lit(None))
        .when(~day.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.lit("not a date"))
        .when(parse_iso_date(day).isNull(), F.lit("no such day"))
        .when(day < F.col("least"), F.lit("out of range"))
        .when(day > F.col("greatest"), F.lit("out of range"))
    )
    bound = F.when(F.col("param") == "alates_kuupaev", F.lit(bounds[0].isoformat())).otherwise(
        F.lit(bounds[1].isoformat())
    )
    choice_error = F.when(~F.array_contains("allowed", given), F.lit("not allowed"))

    error = F.when(kind == "date", day_error).when(kind == "choice", choice_error).otherwise(
        number_error
    )
    value = F.when(kind == "date", F.coalesce(day, bound)).when(kind == "choice", given).otherwise(
        number_text
    )
    return rows.withColumn("error", error).select(
        "question_id", "template_id", "param",
        F.when(F.col("error").isNull(), value).alias("value"), "error",
    )
