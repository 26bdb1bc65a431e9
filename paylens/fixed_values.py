"""They must be exactly these for results to agree.

File headers, reply keys, template ids, parameter names, bounds and defaults, letters, period names.
"""

from datetime import date

# Statement file: header -> column, and which fields must be filled.
STATEMENT_HEADERS = {
    "TEHINGU_ID": "tx_id",
    "KUUPÄEV": "booking_date",
    "SAAJA_MAKSJA_KONTO": "counterparty_account",
    "SAAJA_MAKSJA_NIMI": "counterparty",
    "SUMMA": "amount",
    "VIITENUMBER": "reference_no",
    "SELGITUS": "description",
    "VALUUTA": "currency",
}
REQUIRED_HEADERS = ("TEHINGU_ID", "KUUPÄEV", "SAAJA_MAKSJA_NIMI", "SUMMA", "SELGITUS", "VALUUTA")

# Every character Python calls white space: stripped from both ends of a field.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Letters that stay in a search text.
SEARCH_LETTERS = "abcdefghijklmnopqrstuvwxyzäöõüšž"

# Rows a query may give, and neighbours a similarity search gives.
ROW_CAP = 1000
NEIGHBOURS = 20

# Price rise: the dearest price may be this many times the cheapest; the amounts may vary this much.
PRICE_RISE_MAX_RATIO = "1.8"
PRICE_RISE_MAX_VARIATION = 0.4

# Reply of the question classifier.
REPLY_TEMPLATE_KEY = "malli_id"
REPLY_PARAMS_KEY = "parameetrid"

TEMPLATE_IDS = {
    "top_transactions": "suurimad_kulutused",
    "recurring_payments": "korduvad_maksed",
    "duplicate_payments": "topeltmaksed",
    "frequent_small_payments": "sagedased_vaikesed_maksed",
    "price_rise": "pusimakse_hinnatous",
}

# Reply parameter name -> ours.
PARAM_NAMES = {
    "alates_kuupaev": "date_from",
    "kuni_kuupaev": "date_to",
    "suund": "direction",
    "limit": "limit",
    "summa_lavi": "max_amount",
    "min_kordusi": "min_count",
    "muutus_lavi_pct": "min_change_pct",
}

DATE_MIN = date(1900, 1, 1)
DATE_MAX = date(2099, 12, 31)

# template, parameter, type, default, least, greatest, allowed
PARAM_SPECS = (
    ("suurimad_kulutused", "alates_kuupaev", "date", None, "1900-01-01", "2099-12-31", None),
    ("suurimad_kulutused", "kuni_kuupaev", "date", None, "1900-01-01", "2099-12-31", None),
    ("suurimad_kulutused", "suund", "choice", "DESC", None, None, ("DESC", "ASC")),
    ("suurimad_kulutused", "limit", "int", "10", "1", "50", None),
    ("korduvad_maksed", "alates_kuupaev", "date", None, "1900-01-01", "2099-12-31", None),
    ("korduvad_maksed", "kuni_kuupaev", "date", None, "1900-01-01", "2099-12-31", None),
    ("topeltmaksed", "alates_kuupaev", "date", None, "1900-01-01", "2099-12-31", None),
    ("topeltmaksed", "kuni_kuupaev", "date", None, "1900-01-01", "2099-12-31", None),
    ("sagedased_vaikesed_maksed", "alates_kuupaev", "date", None, "1900-01-01", "2099-12-31", None),
    ("sagedased_vaikesed_maksed", "kuni_kuupaev", "date", None, "1900-01-01", "2099-12-31", None),
    ("sagedased_vaikesed_maksed", "summa_lavi", "float", "15.0", "0.01", "9999999.99", None),
    ("sagedased_vaikesed_maksed", "min_kordusi", "int", "5", "2", "100", None),
    ("pusimakse_hinnatous", "alates_kuupaev", "date", None, "1900-01-01", "2099-12-31", None),
    ("pusimakse_hinnatous", "kuni_kuupaev", "date", None, "1900-01-01", "2099-12-31", None),
    ("pusimakse_hinnatous", "min_kordusi", "int", "3", "2", "50", None),
    ("pusimakse_hinnatous", "muutus_lavi_pct", "float", "5.0", "1.0", "2000.0", None),
)

# Beginnings of words and phrases that point at a template, in normalised question text.
TEMPLATE_KEYWORDS = {
    "suurimad_kulutused": (
        "suurim", "kallim ", "kalleim", "kõige rohkem", "väikseim", "odavaim", "kõige vähem", "top ",
    ),
    "korduvad_maksed": (
        "korduva", "regulaarse", "püsimaksed", "tellimused", "kuumakse", "sama kaupme",
    ),
    "topeltmaksed": (
        "topelt", "dubleeritud", "kaks korda", "sama päev", "sama summa", "kahekord",
    ),
    "sagedased_vaikesed_maksed": (
        "väike summa", "väikse summa", "sageli", "mikromakse", "palju väikse", "kohvik", "kiosk",
    ),
    "pusimakse_hinnatous": (
        "hinnatõus", "kallinemi", "kallinenud", "kallimaks", "püsimakse muutus", "püsikulu",
        "hind kasvas", "tõstis hinda", "tõusnud", "tõstnud",
    ),
}
SMALLEST_FIRST_KEYWORDS = ("väikseim", "odavaim", "kõige vähem")

# Period names, each with the beginnings of words it may take in a question.
PERIOD_NAMES = {
    "täna": ("täna", "tänas"),
    "eile": ("eile",),
    "see nädal": ("see nädal", "sel nädalal", "selle nädala"),
    "eelmine nädal": ("eelmine nädal", "eelmise nädala", "eelmisel nädalal"),
    "see kuu": ("see kuu", "sel kuul", "selle kuu"),
    "eelmine kuu": ("eelmine kuu", "eelmise kuu", "eelmisel kuul"),
    "see aasta": ("see aasta", "sel aastal", "selle aasta"),
    "eelmine aasta": ("eelmine aasta", "eelmise aasta", "eelmisel aastal"),
}

# Month names by number, as stems that every case form begins with.
MONTH_STEMS = (
    "jaanuar", "veebruar", "märts", "aprill", "mai", "juuni", "juuli", "august", "septemb",
    "oktoob", "novemb", "detsemb",
)
# What may follow a month stem within the word: the rest of the name, then a case ending.
MONTH_ENDINGS = "(?:er|ri|i)?(?:s|st|l|ni|ks|kuu|kuus|kuust)?"
