"""Column functions on text: tokens, stop words, measures, patterns. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def words(text: Column) -> Column:
    """Runs of letters and digits of any script in the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays taken as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def normal_key(name: Column) -> Column:
    """Lower case, signs to blanks, blanks joined, a plural s dropped from words of over three letters."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "), " +", " "))
    return F.regexp_replace(plain, r"([a-z]{3,})s\b", "$1")


def first_number(text: Column) -> Column:
    """The first number of a text as a double, a decimal comma counting as a point."""
    return F.try_to_number(F.regexp_replace(F.nullif(F.regexp_extract(text, r"([0-9]+(?:[.,][0-9]+)?)", 1), F.lit("")), ",", "."), F.lit("999999999999.999999")).cast("double")


#: Patterns of personal data, in the order in which they apply.
PII = (
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("IP", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"),
    ("PHONE", r"\+?[0-9][0-9 ()-]{7,}[0-9]"),
)


def redact(text: Column) -> Column:
    for name, pattern in PII:
        text = F.regexp_replace(text, pattern, f"[{name}]")
    return text
