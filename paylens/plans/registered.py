"""Every operator run over the benchmark tables, whole."""

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.functions.letters import encode_letters, letter_profile
from paylens.functions.text import normalise, search_text
from paylens.operators import facts, levels, payments, present, similar
from paylens.operators.cells import build_cells, nearest_in_cells
from paylens.operators.encode import batch_encoder, build_vectors, encode_rows
from paylens.operators.filters import by_id, by_ids, capped, detail, searchable
from paylens.operators.periods import dataset_bounds, dataset_period, relative_periods
from paylens.operators.replies import parse_replies, validate_params
from paylens.operators.routing import route_questions, routed_params
from paylens.operators.scored import default_index, route_by_score
from paylens.operators.vectors import nearest
from paylens.plans.fixtures import GAPS, NAMES, QUESTIONS, RAW_STATEMENTS, REPLIES, SOURCES, from_tables, view
from paylens.plans.prepare import build_index, fill_search_text, load_statements
from paylens.session import scratch_path
from paylens.sources.buckets import read_vectors, upsert_buckets
from paylens.sources.loads import load_files, loaded_rows
from paylens.sources.months import read_by_month, stored_period, write_by_month
from paylens.sources.statements import (
    check_statements,
    duplicate_ids,
    rejected_rows,
    valid_rows,
)
from paylens.sources.tables import (
    blank_text_audit,
    new_version_path,
    point_table,
    upsert_vectors,
    write_if_absent,
    written,
)

Query = Callable[[SparkSession, str], DataFrame]

# The day from which relative periods in questions are seen.
TODAY = date(1998, 5, 20)
FROM, TO = date(1996, 1, 1), date(1999, 12, 31)

# Shows a model in batches; elsewhere `letter_profile` gives the same without Python.
LETTER_ENCODER = batch_encoder(lambda: encode_letters, batch_size=512)


def _spread(rows: DataFrame) -> DataFrame:
    """Rows of fewer splits than there are cores, dealt out before work that is heavy per row."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def _on(view_name: str, query, *args) -> Query:
    return lambda spark, sf_dir: query(view(spark, sf_dir, view_name), *args)


def _with_text(transactions: DataFrame) -> DataFrame:
    return transactions.withColumn(
        "search_text", search_text(F.col("counterparty"), F.col("description"))
    )


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = from_tables(
        spark, sf_dir, "SELECT CAST(doc_id AS STRING) AS tx_id, text AS search_text FROM documents"
    )
    # Generated, since a filter on a derived column would work it out a second time.
    return _spread(texts).select("tx_id", F.explode(F.array(normalise(F.col("search_text")))).alias("search_text"))


def _document_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_rows(searchable(_documents(spark, sf_dir)), letter_profile)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_tables(spark, sf_dir, "SELECT CAST(vec_id AS STRING) AS tx_id, embedding FROM embeddings")


def _letters(vectors: DataFrame) -> DataFrame:
    """Vectors as rows of (id, place, weight). The outer form keeps Spark from adding a filter on the
    length of the vector, which would compute it twice."""
    return vectors.select("tx_id", F.posexplode_outer("embedding").alias("place", "weight")).select(
        "tx_id", "place", F.round(F.col("weight").cast("double"), 6).alias("weight")
    )


def normalize_documents(spark, sf_dir):
    return _documents(spark, sf_dir).select("tx_id", "search_text")


def _gaps(spark, sf_dir):
    """Orders of which some have no search text: null, empty, or nothing but digits."""
    orders = from_tables(spark, sf_dir, GAPS)
    return orders.withColumn("search_text", normalise(F.col("description")))


def blank_texts(spark, sf_dir):
    return blank_text_audit(_gaps(spark, sf_dir))


def blank_names(spark, sf_dir):
    """Which names can't be searched by."""
    return similar.name_problems(from_tables(spark, sf_dir, NAMES))


def capped_recurring(spark, sf_dir):
    """The rows that a caller with the cap is shown."""
    return capped(_recurring(spark, sf_dir))


def order_by_key(spark, sf_dir):
    """Point lookup."""
    return detail(by_id(view(spark, sf_dir, "tx_orders"), "7"))


def _filled_table(spark, sf_dir) -> tuple[str, str]:
    """A table of orders without search texts, written unless there, then filled: its name and folder."""
    base = scratch_path(spark, "filled")
    table, path = "filled_" + base[-32:], new_version_path(base)
    orders = view(spark, sf_dir, "tx_orders").withColumn("search_text", F.lit(None).cast("string"))
    write_if_absent(orders, path)
    write_if_absent(orders.where("false"), path)  # something is there, so this writes nothing
    point_table(spark, table, path)
    fill_search_text(spark, table, base)
    return table, base


def filled_texts(spark, sf_dir):
    """What a table without search texts holds once they are filled in."""
    table, _ = _filled_table(spark, sf_dir)
    found = spark.table(table).select("tx_id", "search_text")
    spark.sql(f"DROP TABLE {table}")
    return found


def index_vectors(spark, sf_dir):
    """The vector table built from a transactions table."""
    table, base = _filled_table(spark, sf_dir)
    build_index(spark, table, f"{table}_vectors", base, letter_profile)
    found = spark.table(f"{table}_vectors")
    spark.sql(f"DROP VIEW {table}_vectors")
    spark.sql(f"DROP TABLE {table}")
    return _letters(found)


def searchable_texts(spark, sf_dir):
    return searchable(_with_text(view(spark, sf_dir, "tx_parts")))


def raw_statements(spark, sf_dir):
    return _spread(from_tables(spark, sf_dir, RAW_STATEMENTS))


def statement_valid(spark, sf_dir):
    return valid_rows(check_statements(raw_statements(spark, sf_dir))).drop("search_text")


def statement_rejects(spark, sf_dir):
    rejects = rejected_rows(check_statements(raw_statements(spark, sf_dir)))
    return rejects.withColumn("errors", F.array_join("errors", "; "))


def _statement_files(spark, sf_dir) -> list[str]:
    """Statement files written from the rows, in two orders of columns and one without an optional column, with line
    breaks in quoted fields: their folders."""
    files = scratch_path(spark, "statements")
    raw = raw_statements(spark, sf_dir)
    part = F.pmod(F.xxhash64("TEHINGU_ID", "SELGITUS"), F.lit(3))
    bare = F.col("VIITENUMBER").isNull()
    orders = (raw.columns, raw.columns[::-1], [c for c in raw.columns if c != "VIITENUMBER"])
    for n, columns in enumerate(orders):
        own = raw.where(part == 2).where(bare) if n == 2 else raw.where((part == n) | ((part == 2) & ~bare & F.lit(n == 0)))
        own.select(*columns).write.csv(
            f"{files}/{n}", sep=";", header=True, quote='"', escape='"', quoteAll=True
        )
    return [f"{files}/{n}" for n in range(3)]


def statement_load(spark, sf_dir):
    """Statement files read back, checked, written and read as a table."""
    files, base = _statement_files(spark, sf_dir), scratch_path(spark, "tables")
    table = "loaded_" + base[-32:]
    report = load_statements(spark, files, base, table, strict=False, with_search_text=True)
    spark.sql(f"DROP TABLE {table}")
    return spark.read.parquet(report.path)


def statement_reload(spark, sf_dir):
    """The table after a load of some files and another of all, which reads only the others."""
    files, base = _statement_files(spark, sf_dir), scratch_path(spark, "loads")
    load_files(spark, files[:2], base, strict=False)
    load_files(spark, files, base, strict=False)
    return loaded_rows(spark, base)


def _by_month(spark, sf_dir, name) -> str:
    path = scratch_path(spark, "months")
    write_by_month(view(spark, sf_dir, name), path)
    return path


def period_by_month(spark, sf_dir):
    return stored_period(spark, _by_month(spark, sf_dir, "tx_supply"))


def recurring_by_month(spark, sf_dir):
    table = read_by_month(spark, _by_month(spark, sf_dir, "tx_orders"))
    return payments.recurring_payments(table, payments.RecurringPayments(FROM, TO))


def _merged_levels(name, query):
    """A query from the states of three parts of a table, each worked out and written by itself."""

    def run(spark, sf_dir):
        transactions = view(spark, sf_dir, name)
        part = F.pmod(F.xxhash64("tx_id"), F.lit(3))
        states = [written(levels.levels(transactions.where(part == k)), "levels") for k in range(3)]
        rows = sum(state.count() for state in states)
        return query(levels.merged(states[0].unionByName(states[1]).unionByName(states[2]), rows))

    return run


def letter_vectors(spark, sf_dir):
    return _letters(_document_vectors(spark, sf_dir))


def encoded_texts(spark, sf_dir):
    """Part texts, each different text encoded once."""
    return _letters(build_vectors(_with_text(view(spark, sf_dir, "tx_parts")), LETTER_ENCODER))


def vector_upsert(spark, sf_dir):
    """Vectors of part texts, replaced by those of documents with the same id."""
    old = encode_rows(searchable(_with_text(view(spark, sf_dir, "tx_parts"))), letter_profile)
    # Read twice, for its ids and its vectors.
    new = written(_document_vectors(spark, sf_dir), "document_vectors")
    return _letters(upsert_vectors(old, new))


def bucketed_upsert(spark, sf_dir):
    """The same, in a table of buckets: part texts, then all documents, then one document again."""
    path = scratch_path(spark, "buckets")
    upsert_buckets(encode_rows(searchable(_with_text(view(spark, sf_dir, "tx_parts"))), letter_profile), path)
    new = written(_document_vectors(spark, sf_dir), "document_vectors")
    upsert_buckets(new, path)
    upsert_buckets(new.orderBy("tx_id").limit(1), path)
    return _letters(read_vectors(spark, path))


def knn_cosine_top20(spark, sf_dir):
    """Each vector's neighbours among all others."""
    vectors = _vectors(spark, sf_dir)
    queries = vectors.withColumnRenamed("tx_id", "query_id")
    return nearest(queries, vectors, exclude_self=True)


def knn_names(spark, sf_dir):
    """Documents nearest to each different part text."""
    texts = _with_text(view(spark, sf_dir, "tx_parts")).select("search_text").distinct()
    queries = texts.select(
        F.col("search_text").alias("query_id"), letter_profile(F.col("search_text")).alias("embedding")
    )
    return nearest(queries, _document_vectors(spark, sf_dir))


def _normalised_documents(spark, sf_dir):
    """Documents' vectors, each worked out once."""
    return written(_document_vectors(spark, sf_dir).where("embedding IS NOT NULL"), "document_vectors")


def knn_cells_top20(spark, sf_dir):
    """Each document's neighbours among all others, through cells."""
    vectors = _normalised_documents(spark, sf_dir)
    queries = vectors.withColumnRenamed("tx_id", "query_id")
    return nearest_in_cells(queries, build_cells(vectors), exclude_self=True)


def _similar_top(spark, sf_dir):
    """Follow-up on the largest of the orders that have a stored vector: neighbours by these."""
    orders = view(spark, sf_dir, "tx_orders")
    stored = _vectors(spark, sf_dir)
    top = payments.top_transactions(by_ids(orders, stored), payments.TopTransactions(limit=50))
    return similar.similar_to_result(
        "suurimad_kulutused", top, stored, orders, letter_profile
    ), orders


def similar_by_id(spark, sf_dir):
    return _similar_top(spark, sf_dir)[0]


def similarity_facts(spark, sf_dir):
    found, orders = _similar_top(spark, sf_dir)
    return facts.similarity_facts(found, detail(orders).withColumnRenamed("tx_id", "query_id"))


def shared_words(spark, sf_dir):
    found, orders = _similar_top(spark, sf_dir)
    return facts.shared_words(found, detail(orders).withColumnRenamed("tx_id", "query_id"))


def similar_by_name(spark, sf_dir):
    """Follow-up on recurring part names."""
    parts = _with_text(view(spark, sf_dir, "tx_parts"))
    result = payments.recurring_payments(parts)
    vectors = build_vectors(parts, letter_profile, distinct=False)
    return similar.similar_to_result("korduvad_maksed", result, vectors, parts, letter_profile)


def unsearchable_ids(spark, sf_dir):
    """Which of many ids are no orders, or those of orders without a search text."""
    return similar.source_problems(from_tables(spark, sf_dir, SOURCES), _gaps(spark, sf_dir))


def rows_by_id(spark, sf_dir):
    """Orders whose id has a stored vector."""
    return detail(by_ids(view(spark, sf_dir, "tx_orders"), _vectors(spark, sf_dir)))


def amount_bounds(spark, sf_dir):
    return payments.amount_bounds(view(spark, sf_dir, "tx_price")).select(
        "tx_id", "booking_date", "counterparty", "amount", "min_amount", "max_amount"
    )


def _recurring(spark, sf_dir):
    return payments.recurring_payments(view(spark, sf_dir, "tx_orders"))


def _top(spark, sf_dir):
    return payments.top_transactions(
        view(spark, sf_dir, "tx_orders"), payments.TopTransactions(limit=50)
    )


def _price_rise(spark, sf_dir):
    return payments.price_rise(view(spark, sf_dir, "tx_price"))


def result_facts(spark, sf_dir):
    return facts.result_overview(_recurring(spark, sf_dir))


def result_standouts(spark, sf_dir):
    return facts.standouts(
        _recurring(spark, sf_dir), payments.order_columns("recurring_payments")
    )


def outlying_totals(spark, sf_dir):
    """Counterparties whose total stands out among those with recurring payments."""
    found = facts.outliers(payments.recurring_payments(view(spark, sf_dir, "tx_supply")), "total_amount", 2.0)
    return found.select("counterparty", "total_amount", F.round("distance", 6).alias("distance"))


def outlying_amounts(spark, sf_dir):
    """Single orders whose amount stands out."""
    found = facts.outliers(view(spark, sf_dir, "tx_orders"), "amount", 2.0)
    return found.select("tx_id", "amount", F.round("distance", 6).alias("distance"))


def repeated_counterparties(spark, sf_dir):
    """Counterparties on three or more of the duplicate payments."""
    return facts.repeated_counterparties(
        payments.duplicate_payments(view(spark, sf_dir, "tx_supply"))
    )


def display_top(spark, sf_dir):
    return present.display_rows(
        _top(spark, sf_dir), payments.order_columns("top_transactions_desc")
    )


def display_recurring(spark, sf_dir):
    return present.display_rows(
        _recurring(spark, sf_dir), payments.order_columns("recurring_payments")
    )


def display_price_rise(spark, sf_dir):
    return present.display_rows(_price_rise(spark, sf_dir), payments.order_columns("price_rise"))


def chosen_row(spark, sf_dir):
    return present.row_at(
        _recurring(spark, sf_dir), payments.order_columns("recurring_payments"), 7
    )


def result_json(spark, sf_dir):
    return present.rows_as_json(_recurring(spark, sf_dir))


def periods_of_days(spark, sf_dir):
    """Named periods as seen from every day with an order."""
    days = from_tables(spark, sf_dir, "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders")
    return relative_periods(days)


def _routed(spark, sf_dir):
    bounds = dataset_bounds(view(spark, sf_dir, "tx_orders"))
    return route_questions(_spread(from_tables(spark, sf_dir, QUESTIONS)), TODAY, bounds), bounds


def routed_questions(spark, sf_dir):
    return _routed(spark, sf_dir)[0]


def questions_by_score(spark, sf_dir):
    """Every question and turn against the inverted index of the templates' descriptions."""
    return route_by_score(_spread(from_tables(spark, sf_dir, QUESTIONS)), default_index(spark))


def routed_question_params(spark, sf_dir):
    routed, bounds = _routed(spark, sf_dir)
    return validate_params(routed_params(routed), bounds)


def parsed_replies(spark, sf_dir):
    parsed = parse_replies(_spread(from_tables(spark, sf_dir, REPLIES)))
    names = ("alates_kuupaev", "kuni_kuupaev", "suund", "limit", "summa_lavi", "min_kordusi",
             "muutus_lavi_pct")
    return parsed.select(
        "question_id", "template_id", "problem", *[F.col("params")[n].alias(n) for n in names]
    )


def reply_params(spark, sf_dir):
    bounds = dataset_bounds(view(spark, sf_dir, "tx_orders"))
    return validate_params(parse_replies(_spread(from_tables(spark, sf_dir, REPLIES))), bounds)


QUERIES: dict[str, Query] = {
    "top_transactions_desc": _on("tx_orders", payments.top_transactions),
    "top_transactions_asc": _on(
        "tx_orders", payments.top_transactions, payments.TopTransactions(FROM, TO, "ASC", 50)
    ),
    "recurring_payments": _recurring,
    "recurring_payments_period": _on(
        "tx_orders", payments.recurring_payments, payments.RecurringPayments(FROM, TO)
    ),
    "duplicate_payments": _on("tx_supply", payments.duplicate_payments),
    "frequent_small_payments": _on("tx_events", payments.frequent_small_payments),
    "frequent_small_payments_wide": _on(
        "tx_events",
        payments.frequent_small_payments,
        payments.FrequentSmallPayments(max_amount=99.999, min_count=2),
    ),
    "price_rise": _price_rise,
    "price_rise_9pct": _on(
        "tx_price", payments.price_rise, payments.PriceRise(FROM, TO, 4, 9.0)
    ),
    "amount_bounds": amount_bounds,
    "dataset_period": _on("tx_supply", dataset_period),
    "relative_periods": periods_of_days,
    "normalize_documents": normalize_documents,
    "row_cap": capped_recurring,
    "row_by_id": order_by_key,
    "blank_text_audit": blank_texts,
    "name_problems": blank_names,
    "filled_texts": filled_texts,
    "index_vectors": index_vectors,
    "searchable_texts": searchable_texts,
    "validate_statement_valid": statement_valid,
    "validate_statement_rejects": statement_rejects,
    "statement_load": statement_load,
    "statement_reload": statement_reload,
    "period_by_month": period_by_month,
    "recurring_by_month": recurring_by_month,
    "recurring_merged": _merged_levels("tx_orders", levels.recurring_payments),
    "duplicates_merged": _merged_levels("tx_supply", levels.duplicate_payments),
    "frequent_small_merged": _merged_levels("tx_events", levels.frequent_small_payments),
    "price_rise_merged": _merged_levels("tx_price", levels.price_rise),
    "duplicate_ids": _on("tx_supply", duplicate_ids),
    "letter_vectors": letter_vectors,
    "encoded_texts": encoded_texts,
    "vector_upsert": vector_upsert,
    "bucketed_upsert": bucketed_upsert,
    "knn_cosine_top20": knn_cosine_top20,
    "knn_cells_top20": knn_cells_top20,
    "knn_texts_top20": knn_names,
    "similar_by_id": similar_by_id,
    "similar_by_name": similar_by_name,
    "unsearchable_ids": unsearchable_ids,
    "rows_by_id": rows_by_id,
    "similarity_facts": similarity_facts,
    "shared_words": shared_words,
    "result_facts": result_facts,
    "result_standouts": result_standouts,
    "outlying_totals": outlying_totals,
    "outlying_amounts": outlying_amounts,
    "repeated_counterparties": repeated_counterparties,
    "display_top": display_top,
    "display_recurring": display_recurring,
    "display_price_rise": display_price_rise,
    "chosen_row": chosen_row,
    "result_json": result_json,
    "route_questions": routed_questions,
    "route_question_params": routed_question_params,
    "route_by_score": questions_by_score,
    "parse_replies": parsed_replies,
    "validate_params": reply_params,
}
