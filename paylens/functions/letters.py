"""Letter profile: a small stand-in for a language-model encoder.

A text becomes the counts of its 32 kept letters, scaled to unit length. It tells spelling likeness,
not meaning.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from paylens.fixed_values import SEARCH_LETTERS


# The kept letters' code points, all below `_CODES`.
_LETTER_CODES = np.array([ord(c) for c in SEARCH_LETTERS])
_CODES = 1 << 9


def _letter_counts(text: str) -> np.ndarray:
    """How often each kept letter occurs, all of them in one pass."""
    codes = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype="<u2")
    return np.bincount(codes[codes < _CODES], minlength=_CODES)[_LETTER_CODES]


def encode_letters(texts: list[str]) -> np.ndarray:
    """As a batch encoder (`list[str] -> ndarray`); zeros for a text without letters."""
    counts = np.array([_letter_counts(t) for t in texts], dtype=np.float64)
    counts = counts.reshape(len(texts), len(SEARCH_LETTERS))
    norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    return np.divide(counts, norms, out=np.zeros_like(counts), where=norms > 0).astype(np.float32)


@F.arrow_udf(ArrayType(FloatType()))
def _profiles(texts: pa.Array) -> pa.Array:
    found = encode_letters([t or "" for t in texts.to_pylist()])
    return pa.array([row if row.any() else None for row in found], pa.list_(pa.float32()))


def letter_profile(text: Column) -> Column:
    """As a column; null for a text without letters. Counted batch by batch, a text at a time."""
    return _profiles(text)
