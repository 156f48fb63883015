"""Column helpers over strings and term lists (all JVM built-ins)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column | str, min_len: int = 2) -> Column:
    """Lower-case whitespace tokens of at least ``min_len`` characters, in order."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(r"\S{%d,}" % min_len), F.lit(0))


def upper_letters(text: Column | str) -> Column:
    """Upper case letter by letter, as DuckDB's ``upper``: ß is ẞ, and a letter whose upper case is several letters stays."""
    letters = F.split(F.translate(col(text), "ß", "ẞ"), "")
    return F.array_join(F.transform(letters, lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)), "")


def squeeze(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(text), r"\s+", " "))


def stable_id(source_file: Column | str, question: Column | str) -> Column:
    """Row key: first 16 hex digits of the hash over the file name and the question's key part."""
    key = F.concat(col(source_file), F.lit("::"), F.substring(col(question), 1, 120))
    return F.substring(F.sha2(key, 256), 1, 16)


#: What a signature drops. The short form (80 characters) keeps accented letters, the long one (120) plain ones and Han.
SIGNATURE_DROPS = {80: r"[^\p{L}\p{N}_]+", 120: r"[^A-Za-z0-9_\x{4e00}-\x{9fff}]+"}


def signature(question: Column | str, length: int = 120) -> Column:
    return F.substring(F.regexp_replace(F.lower(col(question)), SIGNATURE_DROPS[length], ""), 1, length)


def int_range(lo: Column, hi: Column) -> Column:
    """``lo..hi`` as an array, empty when ``hi < lo`` (plain ``sequence`` would count down)."""
    return F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
