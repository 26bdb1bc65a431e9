"""Text: field stripping, the search-text normaliser, blank tests."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from paylens.fixed_values import SEARCH_LETTERS, WHITE_SPACE

# The kept letters as the inside of a character class, the plain ones as a range.
_LETTERS = SEARCH_LETTERS.replace("abcdefghijklmnopqrstuvwxyz", "a-z")


def strip(text: Column) -> Column:
    """Without white space (Unicode's, control separators too) at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def strip_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def is_blank(text: Column) -> Column:
    """Null, empty or only spaces."""
    return text.isNull() | (F.trim(text) == "")


def has_text(text: Column) -> Column:
    """Neither null nor blank; null counts as false. The text is looked at once, since a filter on a
    derived text carries the derivation with it."""
    return F.trim(text) != ""


def normalise(text: Column) -> Column:
    """Lower-case words of the kept letters, one space apart.

    A run of anything else, spaces included, becomes one space, so a single pass is enough; a lone
    space already is one and is not matched. `İ` is put down to `i` first: the JVM would add a
    combining dot, which would then split the word.
    """
    lowered = F.lower(F.replace(text, F.lit("İ"), F.lit("i")))
    return F.trim(F.regexp_replace(lowered, f"[^{_LETTERS} ][^{_LETTERS}]*| [^{_LETTERS}]+", " "))


def search_text(counterparty: Column, description: Column) -> Column:
    """What a transaction is searched by; null if either part is."""
    return normalise(F.concat(counterparty, F.lit(" "), description))
