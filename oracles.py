"""The registered queries as SQL over the same tables, for checking."""

from paylens.fixed_values import (
    MONTH_STEMS,
    PARAM_NAMES,
    PARAM_SPECS,
    PERIOD_NAMES,
    SEARCH_LETTERS,
    SMALLEST_FIRST_KEYWORDS,
    TEMPLATE_IDS,
    TEMPLATE_KEYWORDS,
    WHITE_SPACE,
)
from paylens.operators.routing import (
    AMOUNT_PATTERN,
    COUNT_PATTERN,
    LIMIT_PATTERN,
    MONTH_PATTERN,
    PERCENT_PATTERN,
)
from paylens.plans.fixtures import GAPS, NAMES, QUESTIONS, RAW_STATEMENTS, REPLIES, VIEWS
from paylens.plans.registered import FROM, TODAY, TO

_WS = " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE)
_ALL = ("1900-01-01", "2099-12-31")
_SOME = (FROM.isoformat(), TO.isoformat())


def _tx(view: str) -> str:
    return f"tx AS ({VIEWS[view]})"


def _between(period) -> str:
    return f"booking_date BETWEEN DATE '{period[0]}' AND DATE '{period[1]}'"


def _norm(x: str) -> str:
    return f"array_to_string(regexp_extract_all(lower({x}), '[{SEARCH_LETTERS}]+'), ' ')"


def _strip(x: str) -> str:
    return f"nullif(trim({x}, {_WS}), '')"


def _top(direction: str, limit: int, period=_ALL) -> str:
    return (
        f"SELECT tx_id, booking_date, counterparty, amount, description FROM tx "
        f"WHERE {_between(period)} ORDER BY amount {direction}, tx_id LIMIT {limit}"
    )


def _recurring(period=_ALL) -> str:
    return f"""
        SELECT counterparty, count(*) AS n, min(amount) AS min_amount, max(amount) AS max_amount,
               round(avg(amount), 2) AS avg_amount, round(sum(amount), 2) AS total_amount,
               concat(min(booking_date), ' .. ', max(booking_date)) AS date_span
        FROM tx WHERE {_between(period)}
        GROUP BY counterparty HAVING count(*) >= 2"""


_DUPLICATES = f"""
    SELECT booking_date, counterparty, amount, count(*) AS n FROM tx WHERE {_between(_ALL)}
    GROUP BY booking_date, counterparty, amount HAVING count(*) >= 2"""


def _small(max_amount, min_count) -> str:
    return f"""
        SELECT counterparty, count(*) AS n, round(sum(amount), 2) AS total_amount,
               round(avg(amount), 2) AS avg_amount
        FROM tx WHERE amount <= {max_amount} AND {_between(_ALL)}
        GROUP BY counterparty HAVING count(*) >= {min_count}"""


def _price_rise(min_count=3, pct=5.0, period=_ALL) -> str:
    """From how often each price was charged; its cheapest and dearest are looked up there."""
    return f"""
        SELECT * FROM (WITH charged AS (
            SELECT counterparty, amount AS price, count(*) AS times, min(booking_date) AS since,
                   max(booking_date) AS until
            FROM tx WHERE {_between(period)} GROUP BY ALL),
        summary AS (
            SELECT counterparty, CAST(sum(times) AS BIGINT) AS n, min(price) AS cheap, max(price) AS dear,
                   concat(min(since), ' .. ', max(until)) AS date_span
            FROM charged GROUP BY counterparty),
        steady AS (
            SELECT counterparty FROM tx WHERE {_between(period)}
            GROUP BY counterparty HAVING stddev_samp(amount) <= 0.4 * avg(amount))
        SELECT s.counterparty, n, cheap AS old_amount, dear AS new_amount,
               round((dear - cheap) / cheap * 100, 1) AS change_pct, date_span
        FROM summary s SEMI JOIN steady USING (counterparty)
        JOIN charged a ON a.counterparty = s.counterparty AND a.price = cheap
        JOIN charged b ON b.counterparty = s.counterparty AND b.price = dear
        WHERE a.times >= 2 AND b.times >= 2 AND n >= {min_count}
          AND dear BETWEEN cheap * (1 + {pct} / 100.0) AND cheap * 1.8
          AND dear <> cheap * (1 + {pct} / 100.0))"""


# Statements

_FIELDS = f"""
    raw AS ({RAW_STATEMENTS.replace('`', '"')}),
    fields AS (
        SELECT *, {_strip('TEHINGU_ID')} AS tx_id, {_strip('"KUUPÄEV"')} AS day_text,
               {_strip('SAAJA_MAKSJA_KONTO')} AS counterparty_account,
               {_strip('SAAJA_MAKSJA_NIMI')} AS counterparty, {_strip('SUMMA')} AS amount_text,
               {_strip('VIITENUMBER')} AS reference_no, {_strip('SELGITUS')} AS description,
               {_strip('VALUUTA')} AS currency
        FROM raw),
    typed AS (
        SELECT *, CAST(try_strptime(day_text, '%d.%m.%Y') AS DATE) AS booking_date,
               TRY_CAST(replace(replace(amount_text, ',', '.'), '_', '') AS DECIMAL(18,2)) AS amount
        FROM fields),
    checked AS (
        SELECT *, concat_ws('; ',
            CASE WHEN tx_id IS NULL THEN 'TEHINGU_ID missing' END,
            CASE WHEN day_text IS NULL THEN 'KUUPÄEV missing' END,
            CASE WHEN counterparty IS NULL THEN 'SAAJA_MAKSJA_NIMI missing' END,
            CASE WHEN amount_text IS NULL THEN 'SUMMA missing' END,
            CASE WHEN description IS NULL THEN 'SELGITUS missing' END,
            CASE WHEN currency IS NULL THEN 'VALUUTA missing' END,
            CASE WHEN day_text IS NOT NULL AND booking_date IS NULL THEN 'KUUPÄEV invalid' END,
            CASE WHEN amount_text IS NOT NULL AND amount IS NULL THEN 'SUMMA invalid' END) AS errors
        FROM typed)"""
_VALID = """SELECT tx_id, booking_date, counterparty_account, counterparty, amount, reference_no,
    description, currency"""

# Vectors


def _letters(text: str) -> str:
    """Letter profile of a text as a list of floats."""
    counts = ", ".join(f"length({text}) - length(replace({text}, '{c}', ''))" for c in SEARCH_LETTERS)
    return f"[{counts}]"


def _profiles(rows: str) -> str:
    """`tx_id, embedding` of rows `tx_id, search_text`, texts without letters left out."""
    return f"""
        SELECT tx_id, list_transform(c, lambda x: CAST(x / norm AS FLOAT)) AS embedding
        FROM (SELECT tx_id, c, sqrt(CAST(list_sum(list_transform(c, lambda x: x * x)) AS DOUBLE)) AS norm
              FROM (SELECT tx_id, {_letters('search_text')} AS c FROM ({rows})
                    WHERE search_text IS NOT NULL AND trim(search_text) != ''))
        WHERE norm > 0"""


_PARTS = f"SELECT *, {_norm("counterparty || ' ' || description")} AS search_text FROM ({VIEWS['tx_parts']})"
_PART_TEXTS = f"SELECT tx_id, search_text FROM ({_PARTS})"
_DOCUMENTS = f"SELECT CAST(doc_id AS STRING) AS tx_id, {_norm('text')} AS search_text FROM documents"
_ORDER_TEXTS = f"SELECT tx_id, {_norm("counterparty || ' ' || description")} AS search_text"
_VECTORS = "SELECT CAST(vec_id AS STRING) AS tx_id, embedding FROM embeddings"
_LETTER_ROWS = """
    SELECT tx_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS place,
           round(CAST(unnest(embedding) AS DOUBLE), 6) AS weight FROM vectors"""


def _nearest(exclude_self: bool) -> str:
    """From `queries(query_id, embedding)` and `vectors(tx_id, embedding)`."""
    condition = "query_id <> tx_id" if exclude_self else "true"
    return f"""
        pairs AS (
            SELECT query_id, tx_id,
                   greatest(round(1 - list_cosine_similarity(
                       CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9), 0.0) AS distance
            FROM queries q JOIN vectors v ON {condition}),
        neighbours AS (
            SELECT query_id, tx_id, distance,
                   CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, tx_id) AS INTEGER)
                       AS rank
            FROM pairs QUALIFY rank <= 20)"""


_HYDRATED = """
    SELECT query_id, rank, distance, tx_id, booking_date, counterparty, amount, description
    FROM neighbours JOIN tx USING (tx_id)"""
_SIMILAR_TOP = f"""
    {_tx('tx_orders')}, vectors AS ({_VECTORS}),
    top AS (SELECT tx_id FROM tx WHERE tx_id IN (SELECT tx_id FROM vectors) ORDER BY amount DESC, tx_id LIMIT 50),
    queries AS (SELECT tx_id AS query_id, embedding FROM vectors WHERE tx_id IN (SELECT tx_id FROM top)),
    {_nearest(True)}, found AS ({_HYDRATED}),
    shared AS (
        SELECT f.*, s.counterparty AS source_counterparty,
               list_filter(list_intersect(
                   list_distinct(string_split({_norm("f.counterparty || ' ' || f.description")}, ' ')),
                   list_distinct(string_split({_norm("s.counterparty || ' ' || s.description")}, ' '))),
                   lambda w: w <> '') AS words
        FROM found f JOIN tx s ON f.query_id = s.tx_id)"""

# Display


def _money(x: str) -> str:
    return f"coalesce(replace(CAST(CAST({x} AS DECIMAL(38,2)) AS VARCHAR), '.', ',') || ' €', '')"


def _percent(x: str) -> str:
    return f"coalesce(replace(CAST(CAST({x} AS DECIMAL(38,1)) AS VARCHAR), '.', ',') || ' %', '')"


def _display(cells: str, order: str, result: str) -> str:
    return f"""
        SELECT CAST(row_number() OVER (ORDER BY {order}) AS VARCHAR) AS "#", {cells} FROM ({result})"""


# Routing


def _any(words: str, beginnings) -> str:
    return "(" + " OR ".join(f"contains({words}, ' {b}')" for b in beginnings) + ")"


def _route() -> str:
    scores, best = [], []
    for i, keywords in enumerate(TEMPLATE_KEYWORDS.values()):
        terms = " + ".join(f"CAST(contains(words, ' {k}') AS INTEGER)" for k in keywords)
        scores.append(f"{terms} AS s{i}")
    top = "greatest(" + ", ".join(f"s{i}" for i in range(len(TEMPLATE_KEYWORDS))) + ")"
    for i, template in enumerate(TEMPLATE_KEYWORDS):
        best.append(f"WHEN s{i} = {top} THEN '{template}'")
    t = f"DATE '{TODAY.isoformat()}'"
    week, month, year = (f"CAST(date_trunc('{u}', {t}) AS DATE)" for u in ("week", "month", "year"))
    bounds = [
        (t, t), (f"{t} - 1", f"{t} - 1"), (week, t), (f"{week} - 7", f"{week} - 1"), (month, t),
        (f"CAST({month} - INTERVAL 1 MONTH AS DATE)", f"{month} - 1"), (year, t),
        (f"CAST({year} - INTERVAL 1 YEAR AS DATE)", f"{year} - 1"),
    ]
    period = [
        " ".join(
            f"WHEN {_any('words', names)} THEN {b[side]}" for names, b in zip(PERIOD_NAMES.values(), bounds)
        )
        for side in (0, 1)
    ]
    stems = ", ".join(f"'{m}'" for m in MONTH_STEMS)
    return f"""
        asked AS (SELECT question_id, text AS original, lower(text) AS text, ' ' || {_norm('text')} || ' ' AS words
                  FROM ({QUESTIONS})),
        scored AS (
            SELECT *, {', '.join(scores)},
                   list_filter(list_transform(
                       regexp_extract_all(text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'),
                       lambda d: TRY_CAST(d AS DATE)), lambda d: d IS NOT NULL) AS days,
                   list_position([{stems}], regexp_extract(text, '{MONTH_PATTERN}', 1)) AS month_no,
                   nullif(regexp_extract(text, '{MONTH_PATTERN}', 2), '') AS month_year
            FROM asked),
        dated AS (
            SELECT *, CASE WHEN month_no > 0 THEN make_date(
                CAST(coalesce(month_year, '{TODAY.year}') AS BIGINT), month_no, 1) END AS month_first
            FROM scored),
        bounds AS (SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b
                   FROM orders JOIN customer ON o_custkey = c_custkey),
        routed AS (
            SELECT question_id, CASE WHEN {top} = 0 THEN NULL {' '.join(best)} END AS template_id,
                   CASE WHEN len(days) > 0 THEN days[1] {period[0]}
                        WHEN month_first IS NOT NULL THEN month_first ELSE a END AS date_from,
                   CASE WHEN len(days) > 0 THEN coalesce(days[2], days[1]) {period[1]}
                        WHEN month_first IS NOT NULL THEN last_day(month_first) ELSE b END AS date_to,
                   CASE WHEN {_any('words', SMALLEST_FIRST_KEYWORDS)} THEN 'ASC' END AS direction,
                   nullif(regexp_extract(text, '{LIMIT_PATTERN}', 1), '') AS "limit",
                   replace(nullif(regexp_extract(text, '{AMOUNT_PATTERN}', 1), ''), ',', '.') AS max_amount,
                   nullif(regexp_extract(text, '{COUNT_PATTERN}', 1), '') AS min_count,
                   replace(nullif(regexp_extract(text, '{PERCENT_PATTERN}', 1), ''), ',', '.')
                       AS min_change_pct
            FROM dated, bounds)"""


def _parsed() -> str:
    params = ", ".join(
        f"CASE json_type(j, '$.parameetrid.{p}') WHEN 'BOOLEAN' THEN "
        f"CAST(CAST(json_extract_string(j, '$.parameetrid.{p}') = 'true' AS INTEGER) AS VARCHAR) "
        f"ELSE json_extract_string(j, '$.parameetrid.{p}') END AS {_quoted(p)}"
        for p in PARAM_NAMES
    )
    known = ", ".join(f"'{t}'" for t in TEMPLATE_IDS.values())
    return f"""
        blocks AS (SELECT question_id, nullif(regexp_extract(reply, '(?s)\\{{.*\\}}'), '') AS block
                   FROM ({REPLIES})),
        jsons AS (SELECT *, CASE WHEN json_valid(block) THEN CAST(block AS JSON) END AS j FROM blocks),
        read AS (
            SELECT question_id, CASE
                WHEN block IS NULL THEN 'no JSON object'
                WHEN j IS NULL THEN 'JSON does not parse'
                WHEN coalesce(json_type(j, '$.malli_id'), 'NULL') = 'NULL'
                  OR json_extract_string(j, '$.malli_id') = '' OR CAST(j->'malli_id' AS VARCHAR) = '0'
                    THEN 'no template fits'
                WHEN json_extract_string(j, '$.malli_id') NOT IN ({known}) THEN 'unknown template'
                WHEN coalesce(json_type(j, '$.parameetrid'), 'NULL') NOT IN ('NULL', 'OBJECT')
                    THEN 'parameters are not an object' END AS problem,
                json_extract_string(j, '$.malli_id') AS template, {params}
            FROM jsons),
        parsed AS (
            SELECT question_id, CASE WHEN problem IS NULL THEN template END AS template_id, problem,
                   {', '.join(_quoted(p) for p in PARAM_NAMES)}
            FROM read)"""


def _quoted(name: str) -> str:
    return f'"{name}"'


def _sql_text(value) -> str:
    return "NULL" if value is None else f"'{value}'"


def _validated(parsed: str, bounds: str) -> str:
    """From `parsed(question_id, template_id, <parameters>)` and `bounds(a, b)`."""
    specs = ", ".join(
        f"({', '.join(_sql_text(v) for v in values)}, "
        f"{_sql_text(','.join(allowed)) if allowed else 'NULL'})"
        for *values, allowed in PARAM_SPECS
    )
    raw = " ".join(f"WHEN '{p}' THEN {_quoted(p)}" for p in PARAM_NAMES)
    return f"""
        specs(template_id, param, type, dflt, least, greatest_, allowed) AS (VALUES {specs}),
        given AS (
            SELECT question_id, p.template_id, param, type, least, greatest_, allowed,
                   CASE param {raw} END AS raw, {bounds}
            FROM {parsed} p JOIN specs s ON p.template_id = s.template_id),
        filled AS (
            SELECT g.*, trim(coalesce(raw, dflt), {_WS}) AS text
            FROM given g JOIN specs s USING (template_id, param)),
        numbers AS (
            SELECT *, CASE WHEN type IN ('int', 'float') THEN TRY_CAST(text AS DOUBLE) END AS number
            FROM filled),
        errors AS (
            SELECT *, CASE
                WHEN type = 'date' AND raw IS NULL THEN NULL
                WHEN type = 'date' AND NOT regexp_full_match(text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')
                    THEN 'not a date'
                WHEN type = 'date' AND TRY_CAST(text AS DATE) IS NULL THEN 'no such day'
                WHEN type = 'date' AND (text < least OR text > greatest_) THEN 'out of range'
                WHEN type = 'choice' AND NOT list_contains(string_split(allowed, ','), text)
                    THEN 'not allowed'
                WHEN type IN ('int', 'float') AND number IS NULL THEN 'not a number'
                WHEN type IN ('int', 'float') AND NOT number
                     BETWEEN CAST(least AS DOUBLE) AND CAST(greatest_ AS DOUBLE) THEN 'out of range'
                END AS error
            FROM numbers)
        SELECT question_id, template_id, param, error, CASE WHEN error IS NULL THEN
            CASE WHEN type = 'date' THEN coalesce(text, CASE param WHEN 'alates_kuupaev'
                     THEN CAST(a AS VARCHAR) ELSE CAST(b AS VARCHAR) END)
                 WHEN type = 'choice' THEN text
                 WHEN type = 'int' THEN CAST(CAST(trunc(number) AS BIGINT) AS VARCHAR)
                 ELSE CAST(number AS VARCHAR) END END AS value
        FROM errors"""


_ORDER_BOUNDS = (
    "(SELECT CAST(min(o_orderdate) AS DATE) FROM orders) AS a, "
    "(SELECT CAST(max(o_orderdate) AS DATE) FROM orders) AS b"
)


def _periods() -> str:
    week, month, year = (f"CAST(date_trunc('{u}', day) AS DATE)" for u in ("week", "month", "year"))
    bounds = (
        ("day", "day"), ("day - 1", "day - 1"), (week, "day"), (f"{week} - 7", f"{week} - 1"),
        (month, "day"), (f"CAST({month} - INTERVAL 1 MONTH AS DATE)", f"{month} - 1"), (year, "day"),
        (f"CAST({year} - INTERVAL 1 YEAR AS DATE)", f"{year} - 1"),
    )
    days = "(SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)"
    return " UNION ALL ".join(
        f"SELECT day, '{name}' AS period, {a} AS date_from, {b} AS date_to FROM {days}"
        for name, (a, b) in zip(PERIOD_NAMES, bounds)
    )


ORACLES: dict[str, str] = {
    "top_transactions_desc": f"WITH {_tx('tx_orders')} {_top('DESC', 10)}",
    "top_transactions_asc": f"WITH {_tx('tx_orders')} {_top('ASC', 50, _SOME)}",
    "recurring_payments": f"WITH {_tx('tx_orders')} {_recurring()}",
    "row_cap": f"WITH {_tx('tx_orders')} {_recurring()} ORDER BY n DESC, counterparty LIMIT 1000",
    "row_by_id": f"""WITH {_tx('tx_orders')}
        SELECT tx_id, booking_date, counterparty, amount, description FROM tx WHERE tx_id = '7'""",
    "name_problems": f"""SELECT DISTINCT counterparty,
            CASE WHEN {_strip('counterparty')} IS NULL THEN 'empty name' ELSE 'nothing left of the name' END AS problem
        FROM ({NAMES}) WHERE coalesce({_norm('counterparty')}, '') = ''""",
    "recurring_payments_period": f"WITH {_tx('tx_orders')} {_recurring(_SOME)}",
    "duplicate_payments": f"WITH {_tx('tx_supply')} {_DUPLICATES}",
    "frequent_small_payments": f"WITH {_tx('tx_events')} {_small(15.0, 5)}",
    "frequent_small_payments_wide": f"WITH {_tx('tx_events')} {_small(99.999, 2)}",
    "price_rise": f"WITH {_tx('tx_price')} {_price_rise()}",
    "price_rise_9pct": f"WITH {_tx('tx_price')} {_price_rise(4, 9.0, _SOME)}",
    "amount_bounds": f"""WITH {_tx('tx_price')}
        SELECT tx_id, booking_date, counterparty, amount,
               min(amount) OVER (PARTITION BY counterparty) AS min_amount,
               max(amount) OVER (PARTITION BY counterparty) AS max_amount FROM tx""",
    "dataset_period": f"""WITH {_tx('tx_supply')}
        SELECT min(booking_date) AS date_from, max(booking_date) AS date_to FROM tx""",
    "relative_periods": _periods(),
    "normalize_documents": _DOCUMENTS,
    "blank_text_audit": f"""SELECT count(*) AS blank_rows FROM ({GAPS})
        WHERE coalesce({_norm('description')}, '') = ''""",
    "filled_texts": f"WITH {_tx('tx_orders')} {_ORDER_TEXTS} FROM tx",
    "index_vectors": f"WITH {_tx('tx_orders')}, vectors AS ({_profiles(f'{_ORDER_TEXTS} FROM tx')}) {_LETTER_ROWS}",
    "searchable_texts": f"""SELECT tx_id, search_text FROM ({_PARTS})
        WHERE search_text IS NOT NULL AND trim(search_text) != ''""",
    "validate_statement_valid": f"WITH {_FIELDS} {_VALID} FROM checked WHERE errors = ''",
    "validate_statement_rejects": f"""WITH {_FIELDS}
        SELECT TEHINGU_ID AS tx_id, "KUUPÄEV" AS booking_date,
               SAAJA_MAKSJA_KONTO AS counterparty_account, SAAJA_MAKSJA_NIMI AS counterparty,
               SUMMA AS amount, VIITENUMBER AS reference_no, SELGITUS AS description,
               VALUUTA AS currency, errors FROM checked WHERE errors <> ''""",
    "statement_load": f"""WITH {_FIELDS}
        {_VALID}, {_norm("counterparty || ' ' || description")} AS search_text
        FROM checked WHERE errors = ''""",
    "duplicate_ids": f"""WITH {_tx('tx_supply')}
        SELECT tx_id, count(*) AS n FROM tx GROUP BY tx_id HAVING count(*) > 1""",
    "letter_vectors": f"WITH vectors AS ({_profiles(_DOCUMENTS)}) {_LETTER_ROWS}",
    "encoded_texts": f"WITH vectors AS ({_profiles(_PART_TEXTS)}) {_LETTER_ROWS}",
    "vector_upsert": f"""WITH old AS ({_profiles(_PART_TEXTS)}), new AS ({_profiles(_DOCUMENTS)}),
        vectors AS (SELECT * FROM new UNION ALL
                    SELECT * FROM old WHERE tx_id NOT IN (SELECT tx_id FROM new)) {_LETTER_ROWS}""",
    "bucketed_upsert": f"""WITH old AS ({_profiles(_PART_TEXTS)}), new AS ({_profiles(_DOCUMENTS)}),
        vectors AS (SELECT * FROM new UNION ALL
                    SELECT * FROM old WHERE tx_id NOT IN (SELECT tx_id FROM new)) {_LETTER_ROWS}""",
    "knn_cells_top20": f"""WITH vectors AS ({_profiles(_DOCUMENTS)}),
        queries AS (SELECT tx_id AS query_id, embedding FROM vectors), {_nearest(True)}
        SELECT query_id, tx_id, rank, distance FROM neighbours""",
    "knn_cosine_top20": f"""WITH vectors AS ({_VECTORS}),
        queries AS (SELECT tx_id AS query_id, embedding FROM vectors), {_nearest(True)}
        SELECT query_id, tx_id, rank, distance FROM neighbours""",
    "knn_texts_top20": f"""WITH texts AS (SELECT DISTINCT search_text FROM ({_PART_TEXTS})),
        queries AS (SELECT tx_id AS query_id, embedding FROM
            ({_profiles('SELECT search_text AS tx_id, search_text FROM texts')})),
        vectors AS ({_profiles(_DOCUMENTS)}), {_nearest(False)}
        SELECT query_id, tx_id, rank, distance FROM neighbours""",
    "similar_by_id": f"""WITH {_SIMILAR_TOP} SELECT * FROM found""",
    "similar_by_name": f"""WITH tx AS ({_PARTS}), names AS (SELECT DISTINCT counterparty FROM ({_recurring()})),
        queries AS (SELECT tx_id AS query_id, embedding FROM ({_profiles(
            f"SELECT counterparty AS tx_id, {_norm('counterparty')} AS search_text FROM names")})),
        vectors AS ({_profiles('SELECT tx_id, search_text FROM tx')}), {_nearest(False)} {_HYDRATED}""",
    "unsearchable_ids": """
        SELECT CAST(o_orderkey AS STRING) AS tx_id, 'no search text' AS problem
        FROM orders WHERE o_orderkey % 7 IN (0, 1, 2)
        UNION ALL SELECT concat('part ', p_partkey), 'no such transaction' FROM part""",
    "rows_by_id": f"""WITH {_tx('tx_orders')}
        SELECT tx_id, booking_date, counterparty, amount, description FROM tx
        WHERE tx_id IN (SELECT tx_id FROM ({_VECTORS}))""",
    "similarity_facts": f"""WITH {_SIMILAR_TOP}
        SELECT query_id, count(*) AS n,
               count(*) FILTER (counterparty = source_counterparty) AS n_same_counterparty,
               count(*) FILTER (len(words) > 0) AS n_sharing_words,
               min(amount) AS min_amount, max(amount) AS max_amount FROM shared GROUP BY query_id""",
    "shared_words": f"""WITH {_SIMILAR_TOP}
        SELECT query_id, word, count(*) AS n
        FROM (SELECT query_id, unnest(words) AS word FROM shared) GROUP BY query_id, word""",
    "result_facts": f"""WITH {_tx('tx_orders')}, result AS ({_recurring()})
        SELECT count(*) AS n_rows, min(CAST(split_part(date_span, ' .. ', 1) AS DATE)) AS date_from,
               max(CAST(split_part(date_span, ' .. ', 2) AS DATE)) AS date_to FROM result""",
    "result_standouts": f"""WITH {_tx('tx_orders')}, result AS ({_recurring()})
        SELECT *, CAST(row_number() OVER (ORDER BY n DESC, counterparty) AS INTEGER) AS place
        FROM result QUALIFY place <= 3""",
    "repeated_counterparties": f"""WITH {_tx('tx_supply')}, result AS ({_DUPLICATES})
        SELECT counterparty, count(*) AS n FROM result GROUP BY counterparty HAVING count(*) >= 3""",
    "display_top": f"WITH {_tx('tx_orders')} " + _display(
        f"CAST(booking_date AS VARCHAR) AS booking_date, counterparty, {_money('amount')} AS amount, "
        "description", "amount DESC, tx_id", _top("DESC", 50)),
    "display_recurring": f"WITH {_tx('tx_orders')} " + _display(
        "counterparty, CAST(n AS VARCHAR) AS n, " + ", ".join(
            f"{_money(c)} AS {c}" for c in ("min_amount", "max_amount", "avg_amount", "total_amount"))
        + ", date_span", "n DESC, counterparty", _recurring()),
    "display_price_rise": f"WITH {_tx('tx_price')} " + _display(
        f"counterparty, CAST(n AS VARCHAR) AS n, {_money('old_amount')} AS old_amount, "
        f"{_money('new_amount')} AS new_amount, {_percent('change_pct')} AS change_pct, date_span",
        "change_pct DESC, counterparty", _price_rise()),
    "chosen_row": f"""WITH {_tx('tx_orders')}, result AS ({_recurring()})
        SELECT *, row_number() OVER (ORDER BY n DESC, counterparty) AS "#"
        FROM result QUALIFY "#" = 7""",
    "result_json": f"""WITH {_tx('tx_orders')}, result AS ({_recurring()})
        SELECT CAST(to_json({{'counterparty': counterparty, 'n': n,
            'min_amount': CAST(min_amount AS VARCHAR), 'max_amount': CAST(max_amount AS VARCHAR),
            'avg_amount': avg_amount, 'total_amount': CAST(total_amount AS VARCHAR),
            'date_span': date_span}}) AS VARCHAR) AS json FROM result""",
    "route_questions": f"WITH {_route()} SELECT * FROM routed",
    "route_question_params": f"""WITH {_route()},
        parsed AS (SELECT question_id, template_id, CAST(date_from AS VARCHAR) AS alates_kuupaev,
            CAST(date_to AS VARCHAR) AS kuni_kuupaev, direction AS suund, "limit",
            max_amount AS summa_lavi, min_count AS min_kordusi, min_change_pct AS muutus_lavi_pct
            FROM routed),
        {_validated('parsed', _ORDER_BOUNDS)}""",
    "parse_replies": f"WITH {_parsed()} SELECT * FROM parsed",
    "validate_params": f"WITH {_parsed()}, {_validated('parsed', _ORDER_BOUNDS)}",
}



def _outliers(key: str, column: str, result: str) -> str:
    return f"""WITH {result}, centre AS (SELECT median(CAST({column} AS DOUBLE)) AS m FROM result),
        spread AS (SELECT m, median(abs(CAST({column} AS DOUBLE) - m)) * 1.4826 AS s FROM result, centre GROUP BY m)
        SELECT {key}, {column}, round((CAST({column} AS DOUBLE) - m) / s, 6) AS distance
        FROM result, spread WHERE abs((CAST({column} AS DOUBLE) - m) / s) >= 2"""


ORACLES["outlying_totals"] = _outliers(
    "counterparty", "total_amount", f"""tx AS ({VIEWS['tx_supply']}), result AS (
        SELECT counterparty, CAST(sum(amount) AS DECIMAL(38,2)) AS total_amount
        FROM tx GROUP BY counterparty HAVING count(*) >= 2)"""
)
ORACLES["outlying_amounts"] = _outliers("tx_id", "amount", f"result AS ({VIEWS['tx_orders']})")

# The same results reached another way.
for _name, _same in (
    ("statement_reload", "statement_load"),
    ("period_by_month", "dataset_period"),
    ("recurring_by_month", "recurring_payments_period"),
    ("recurring_merged", "recurring_payments"),
    ("duplicates_merged", "duplicate_payments"),
    ("frequent_small_merged", "frequent_small_payments"),
    ("price_rise_merged", "price_rise"),
):
    ORACLES[_name] = ORACLES[_same]

# Routing by score: descriptions, letters and words that say nothing stand here once more, and weights are
# summed by joins.
_SCORED = """
    told(template_id, text) AS (VALUES
        ('suurimad_kulutused',
         'Suurimad kulutused ja kõige kallimad ostud. Kõige suurem väljaminek, suurim makse, suurimad tehingud, kuhu läks kõige rohkem raha, kalleim ost. Väikseimad ja odavaimad ostud, kõige väiksem makse. Tehingute edetabel, top kümme.'),
        ('korduvad_maksed',
         'Korduvad maksed ja regulaarsed arved. Püsimaksed, tellimused, kuumaksed, igakuised maksed, iga kuu sama saaja, samale kaupmehele mitu korda, raha läheb regulaarselt, liikmemaks, abonement, korduvalt makstud.'),
        ('topeltmaksed',
         'Topeltmaksed ja kahekordsed maksed. Sama arve on makstud kaks korda, sama päev ja sama summa samale saajale, dubleeritud tehing, topelt võetud raha, ekslikult teist korda tasutud.'),
        ('sagedased_vaikesed_maksed',
         'Sagedased väikesed maksed. Palju väikseid oste, mikromaksed, väike summa, kohvikud ja kioskid, sageli alla mingi summa, pisikulud, tihti väikesed ostud, näksid, peenraha, väiksed kulutused kogunevad.'),
        ('pusimakse_hinnatous',
         'Püsimakse hinnatõus. Teenus on läinud kallimaks, hind on tõusnud, tellimus on kallinenud, teenusepakkuja tõstis hinda, hinnamuutus, püsikulu kasvas, hind kasvas protsenti, kuutasu suurenes, hinnad kerkisid.')),
    said AS (
        SELECT key, list_transform(list_filter(regexp_extract_all(lower(text), '[a-zäöõüšž]+'),
                   lambda w: length(w) >= 3 AND NOT list_contains(regexp_extract_all('
        aga alates ega eur euro eurot ehk enne ette igal ilma juba jaoks kaasa kas kes kokku kuhu kui kuid kuni kus
        kust kuu kuul kuus kõik mida midagi millal mille millele milline millised mind minu mis miks mul mulle mult
        need näita oled olen oli olid olnud palun pärast see seda seal selle sest siis siin sel tee too vahemikus
        vahel veel välja üks aasta aastal eelmise eelmisel eelmine jooksul läheb mitu ole olema ning või', '[a-zäöõüšž]+'), w)),
                   lambda w: left(w, 5)) AS s
        FROM (SELECT template_id AS key, text FROM told UNION ALL SELECT 'q ' || question_id, text FROM asked)),
    terms AS (
        SELECT key, unnest(list_concat(s, list_transform(range(1, len(s)), lambda i: s[i] || '_' || s[i + 1]))) AS term
        FROM said),
    tf AS (SELECT key, term, count(*) AS tf FROM terms WHERE key IN (SELECT template_id FROM told) GROUP BY ALL),
    sizes AS (SELECT key, sum(tf) AS size FROM tf GROUP BY key),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    weights AS (
        SELECT term, key AS template_id, CAST(floor(1000 * (
            ln(1 + ((SELECT count(*) FROM sizes)::DOUBLE - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))
            * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size
               / (SELECT avg(size) FROM sizes)))))) AS BIGINT) AS weight
        FROM tf JOIN sizes USING (key) JOIN df USING (term)),
    totals AS (
        SELECT key, template_id, sum(weight) AS score
        FROM (SELECT DISTINCT key, term FROM terms) JOIN weights USING (term) GROUP BY ALL),
    best AS (SELECT * FROM totals QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, template_id) = 1)"""

ORACLES["route_by_score"] = f"""WITH asked AS ({QUESTIONS}), {_SCORED}
    SELECT question_id, CASE WHEN score >= 1000 THEN template_id END AS template_id,
           CAST(coalesce(score, 0) AS BIGINT) AS score
    FROM asked LEFT JOIN best ON key = 'q ' || question_id"""
