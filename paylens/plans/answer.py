"""From a question to a result."""

from datetime import date

from pyspark.sql import DataFrame, SparkSession

from paylens.fixed_values import PARAM_NAMES, TEMPLATE_IDS
from paylens.operators.payments import QUERIES
from paylens.operators.periods import dataset_bounds
from paylens.operators.replies import parse_replies, validate_params
from paylens.operators.routing import route_questions, routed_params
from paylens.operators.scored import TermIndex

_CONVERT = {
    "date_from": date.fromisoformat,
    "date_to": date.fromisoformat,
    "direction": str,
    "limit": int,
    "max_amount": float,
    "min_count": int,
    "min_change_pct": float,
}


def run_template(transactions: DataFrame, template_id: str, params: dict[str, str]) -> DataFrame:
    """Result of a template, its checked parameters given as in a reply (names and texts)."""
    names = {reply: ours for ours, reply in TEMPLATE_IDS.items()}
    if template_id not in names:
        raise ValueError(f"no such template: {template_id!r}")
    query, make = QUERIES[names[template_id]]
    typed = {PARAM_NAMES[p]: _CONVERT[PARAM_NAMES[p]](v) for p, v in params.items()}
    return query(transactions, make(**typed))


def _answer(transactions: DataFrame, parsed: DataFrame, bounds) -> tuple[str, DataFrame]:
    reply = parsed.first()
    if reply.problem is not None:
        raise ValueError(reply.problem)
    checked = validate_params(parsed, bounds).collect()
    errors = {r.param: r.error for r in checked if r.error is not None}
    if errors:
        raise ValueError(f"parameters do not pass: {errors}")
    params = {r.param: r.value for r in checked}
    return reply.template_id, run_template(transactions, reply.template_id, params)


def answer_question(
    spark: SparkSession, transactions: DataFrame, question: str, today: date, index: TermIndex | None = None
) -> tuple[str, DataFrame]:
    """Template and result of one question, routed by keywords, or by scores where an index is given."""
    bounds = dataset_bounds(transactions)
    questions = spark.createDataFrame([("q", question)], "question_id string, text string")
    return _answer(transactions, routed_params(route_questions(questions, today, bounds, index)), bounds)


def answer_reply(spark: SparkSession, transactions: DataFrame, reply: str) -> tuple[str, DataFrame]:
    """Template and result of one classifier reply."""
    bounds = dataset_bounds(transactions)
    replies = spark.createDataFrame([("q", reply)], "question_id string, reply string")
    return _answer(transactions, parse_replies(replies), bounds)
