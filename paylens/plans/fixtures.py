"""Transactions as seen in the benchmark tables.

Each view is plain SQL that Spark and the checking database both read. It gives `tx_id,
booking_date, counterparty, amount, description, currency`.
"""

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "conversations",
)

VIEWS = {
    # One row per order; ids are unique.
    "tx_orders": """
        SELECT CAST(o_orderkey AS STRING) AS tx_id, CAST(o_orderdate AS DATE) AS booking_date,
               c_name AS counterparty, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
               concat(c_mktsegment, ' ', o_orderpriority) AS description, 'EUR' AS currency
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    # Same day, supplier and quantity may repeat; so may ids.
    "tx_supply": """
        SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS tx_id,
               CAST(l_shipdate AS DATE) AS booking_date, s_name AS counterparty,
               CAST(l_quantity AS DECIMAL(18,2)) AS amount, p_name AS description,
               'EUR' AS currency
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey""",
    # Many small amounts per counterparty.
    "tx_events": """
        SELECT CAST(event_id AS STRING) AS tx_id, CAST(ts AS DATE) AS booking_date,
               concat('user ', CAST(user_id AS STRING)) AS counterparty,
               CAST(value AS DECIMAL(18,2)) AS amount, event_type AS description,
               'EUR' AS currency
        FROM events""",
    # A few price levels per counterparty; ids may repeat.
    "tx_price": """
        SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS tx_id,
               CAST(l_shipdate AS DATE) AS booking_date,
               concat('Part ', CAST(l_partkey AS STRING)) AS counterparty,
               CAST(100 * (1 + l_discount) AS DECIMAL(18,2)) AS amount,
               'subscription' AS description, 'EUR' AS currency
        FROM lineitem""",
    # Few names, few texts; ids are unique.
    "tx_parts": """
        SELECT CAST(p_partkey AS STRING) AS tx_id, DATE '2024-01-01' AS booking_date,
               p_name AS counterparty, CAST(p_retailprice AS DECIMAL(18,2)) AS amount,
               concat(p_type, ' ', p_brand) AS description, 'EUR' AS currency
        FROM part""",
}


def from_tables(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Result of a query over the benchmark tables it names."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(sql)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return from_tables(spark, sf_dir, VIEWS[name])


# Statement rows as text, with the faults real files have: one fault per kind of row.
RAW_STATEMENTS = """
    SELECT CASE WHEN o_orderkey % 41 = 0 THEN '  ' ELSE concat(chr(160), CAST(o_orderkey AS STRING), ' ')
           END AS TEHINGU_ID,
           CASE WHEN o_orderkey % 37 = 0 THEN '31.02.2024'
                WHEN o_orderkey % 31 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING)
                WHEN o_orderkey % 29 = 0 THEN chr(9)
                ELSE concat(CAST(day(o_orderdate) AS STRING), '.', CAST(month(o_orderdate) AS STRING),
                            '.', CAST(year(o_orderdate) AS STRING))
           END AS `KUUPÄEV`,
           CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE concat('EE', CAST(o_custkey AS STRING), chr(28))
           END AS SAAJA_MAKSJA_KONTO,
           CASE WHEN o_orderkey % 43 = 0 THEN chr(160) ELSE concat(c_name, '; "', c_mktsegment, '"')
           END AS SAAJA_MAKSJA_NIMI,
           CASE WHEN o_orderkey % 47 = 0 THEN 'sada'
                WHEN o_orderkey % 53 = 0 THEN '1.234,56'
                WHEN o_orderkey % 59 = 0 THEN '1e3'
                WHEN o_orderkey % 61 = 0 THEN 'NaN'
                WHEN o_orderkey % 67 = 0 THEN '1_000'
                WHEN o_orderkey % 71 = 0 THEN '99999999999999999999'
                WHEN o_orderkey % 2 = 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)
                ELSE replace(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING), '.', ',')
           END AS SUMMA,
           CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(o_custkey * 10 AS STRING) END AS VIITENUMBER,
           concat(o_orderpriority, chr(10), 'tellimus ', o_orderstatus) AS SELGITUS,
           CASE WHEN o_orderkey % 73 = 0 THEN CAST(NULL AS STRING) ELSE 'EUR' END AS VALUUTA
    FROM orders JOIN customer ON o_custkey = c_custkey"""

# All turns of conversations as they are, and questions asked about every order.
QUESTIONS = """
    SELECT concat('turn ', CAST(conv_id AS STRING), '/', CAST(turn AS STRING)) AS question_id, text
    FROM conversations
    UNION ALL
    SELECT concat('order ', CAST(o_orderkey AS STRING)) AS question_id,
           CASE CAST(o_orderkey % 12 AS INT)
           WHEN 0 THEN concat('Näita ', CAST(o_custkey AS STRING), ' suurimat väljaminekut vahemikus ',
                              CAST(CAST(o_orderdate AS DATE) AS STRING), ' kuni 2000-12-31?')
           WHEN 1 THEN concat('Millised regulaarsed arved laekusid 1994-01-01 kuni ',
                              CAST(CAST(o_orderdate AS DATE) AS STRING), '.')
           WHEN 2 THEN concat('Kontrolli, kas midagi läks topelt: ',
                              CAST(CAST(o_orderdate AS DATE) AS STRING), '?')
           WHEN 3 THEN concat('Kioskid, kuhu läks alla ', CAST(o_custkey AS STRING),
                              ',50 euro korraga, eelmisel kuul')
           WHEN 4 THEN concat('Kes tõstis hinda rohkem kui ', CAST(o_custkey AS STRING),
                              '% sel aastal?')
           WHEN 5 THEN concat('Kümme odavaimat ostu, ', CAST(o_orderkey AS STRING), ' väikseimat, mai ',
                              CAST(year(o_orderdate) AS STRING))
           WHEN 6 THEN concat('Korduvad maksed detsembris, tellimus ', CAST(o_orderkey AS STRING))
           WHEN 7 THEN concat('Kus käisin sageli kohvikus, vähemalt ', CAST(o_custkey AS STRING),
                              ' korda, eelmise nädala jooksul')
           WHEN 8 THEN concat('Kas maksin eile topelt? Summa ', CAST(o_totalprice AS STRING))
           WHEN 9 THEN concat('TOP ', CAST(o_custkey AS STRING), ' kõige rohkem 2024-02-30 ja ',
                              CAST(CAST(o_orderdate AS DATE) AS STRING))
           WHEN 10 THEN concat('Milline on ilm, tellimus ', CAST(o_orderkey AS STRING), '?')
           ELSE concat('Kas hind kasvas juunist 1997 või septembrist? ', o_orderpriority)
           END AS text
    FROM orders"""

# Replies about every order: right ones, bare, fenced, broken, unknown, with odd parameters.
REPLIES = """
    SELECT CAST(o_orderkey AS STRING) AS question_id,
           CASE CAST(o_orderkey % 15 AS INT)
           WHEN 0 THEN concat('{"malli_id": "suurimad_kulutused", "parameetrid": {"limit": ',
                              CAST(o_custkey AS STRING), ', "suund": "ASC"}}')
           WHEN 1 THEN concat('```json', chr(10), '{"malli_id": "korduvad_maksed", "parameetrid": ',
                              '{"alates_kuupaev": "', CAST(CAST(o_orderdate AS DATE) AS STRING),
                              '"}}', chr(10), '```')
           WHEN 2 THEN '{"malli_id": null, "parameetrid": {}}'
           WHEN 3 THEN concat('Vastus: {"malli_id": "topeltmaksed", "parameetrid": {"kuni_kuupaev": "',
                              CAST(year(o_orderdate) AS STRING), '-02-30"}} Palun!')
           WHEN 4 THEN concat('{"malli_id": "sagedased_vaikesed_maksed", "parameetrid": ',
                              '{"summa_lavi": "', CAST(o_custkey AS STRING), '.5", "min_kordusi": ',
                              CAST(o_orderkey % 130 AS STRING), '.9, "muu": [1, 2]}}')
           WHEN 5 THEN concat('{"malli_id": "pusimakse_hinnatous", "parameetrid": {"muutus_lavi_pct": ',
                              CAST(o_custkey AS STRING), ', "min_kordusi": true}}')
           WHEN 6 THEN concat('{"malli_id": "muu", "parameetrid": {"limit": ',
                              CAST(o_orderkey AS STRING), '}}')
           WHEN 7 THEN concat('JSON puudub, tellimus ', CAST(o_orderkey AS STRING))
           WHEN 8 THEN concat('{"malli_id": "suurimad_kulutused", ', CAST(o_orderkey AS STRING))
           WHEN 9 THEN concat('{"malli_id": "suurimad_kulutused", tellimus ',
                              CAST(o_orderkey AS STRING), '}')
           WHEN 10 THEN '{"malli_id": "korduvad_maksed", "parameetrid": ["limit"]}'
           WHEN 11 THEN concat('{"malli_id": "suurimad_kulutused", "parameetrid": {"limit": "',
                               o_orderpriority, '", "suund": "', o_orderstatus,
                               '", "alates_kuupaev": "1899-12-31", "kuni_kuupaev": "homme"}}')
           WHEN 12 THEN '{"malli_id": "suurimad_kulutused", "parameetrid": null}'
           WHEN 13 THEN concat('{"malli_id": "suurimad_kulutused", "parameetrid": {"limit": " ',
                               CAST(o_custkey % 60 AS STRING), ' ", "suund": null, ',
                               '"kuni_kuupaev": " ', CAST(CAST(o_orderdate AS DATE) AS STRING), ' "}}')
           ELSE concat('{"malli_id": ', CAST(o_orderkey AS STRING), '}')
           END AS reply
    FROM orders"""

# Orders of which some have no words: null, empty, digits only.
GAPS = """
    SELECT CAST(o_orderkey AS STRING) AS tx_id,
           CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN CAST(o_custkey AS STRING) WHEN 1 THEN ''
           WHEN 2 THEN CAST(NULL AS STRING) ELSE o_orderpriority END AS description
    FROM orders"""

# Ids to search by: all orders, and parts, which are no transactions.
SOURCES = """
    SELECT CAST(o_orderkey AS STRING) AS tx_id FROM orders
    UNION ALL SELECT concat('part ', CAST(p_partkey AS STRING)) AS tx_id FROM part"""

# Names of which some are empty or hold no letter.
NAMES = """
    SELECT CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN '  ' WHEN 1 THEN CAST(c_custkey AS STRING)
           WHEN 2 THEN CAST(NULL AS STRING) ELSE c_name END AS counterparty
    FROM customer"""
