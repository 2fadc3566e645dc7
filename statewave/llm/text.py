"""Word rules shared by the operators: words are runs of anything but ASCII white space."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: For Python: A-Z to a-z and nothing else.
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def plain(rows: DataFrame, known: tuple[str, ...] = COLUMNS) -> DataFrame:
    """The same columns under names that clash with nothing: all but the known ones get new names."""
    return rows.toDF(*[c if c in known else f"extra{i}" for i, c in enumerate(rows.columns)])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, whatever number of times the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def count_words(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.size(words(text)).cast("long")


def doc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``: the split into learning and held-out rows."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)
