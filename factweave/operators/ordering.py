"""Orders of axis values and revisions, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEMVER = r"^[vV]?([0-9]+)\.([0-9]+)(?:\.([0-9]+))?$"
YEAR = r"^((?:19|20)[0-9]{2})$"
YEAR_PACK = r"^((?:19|20)[0-9]{2})(?: ?(?:FPS|SP|R)([0-9]+))?$"
NUMERIC = r"^-?[0-9]+(\.[0-9]+)?$"
# Roman numerals, ordinal words and editions, in their order.
ROMAN = "I II III IV V VI VII VIII IX X XI XII".split()
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth".split()
EDITIONS = "basic standard professional premium enterprise ultimate".split()
#: Strategies in the order in which they are tried.
STRATEGIES = ("semver", "year", "year_pack", "numeric", "roman", "ordinal", "edition")


def place_in(value: Column, words: list[str]) -> Column:
    place = F.array_position(F.array(*map(F.lit, words)), value)
    return F.when(place > 0, place.cast("double"))


def keys(value: Column) -> dict[str, Column]:
    """By strategy, the number by which a value is ordered; null where the value isn't of that kind."""
    part = lambda pattern, i: F.coalesce(F.regexp_extract(value, pattern, i).try_cast("double"), F.lit(0.0))
    return {
        "semver": F.when(value.rlike(SEMVER), part(SEMVER, 1) * 1e12 + part(SEMVER, 2) * 1e6 + part(SEMVER, 3)),
        "year": F.when(value.rlike(YEAR), part(YEAR, 1)),
        "year_pack": F.when(value.rlike(YEAR_PACK), part(YEAR_PACK, 1) * 1000 + part(YEAR_PACK, 2)),
        "numeric": F.when(value.rlike(NUMERIC), value.try_cast("double")),
        "roman": place_in(F.upper(value), ROMAN),
        "ordinal": place_in(F.lower(value), ORDINALS),
        "edition": place_in(F.lower(value), EDITIONS),
    }


def infer_order(values: DataFrame, axis: str, value: str) -> DataFrame:
    """values has one row for each axis and value. Adds strategy (the first that fits all values of the axis, else unknown), confidence and key.

    An axis of one value has no order. An unknown order is never invented: its key is null.
    """
    trimmed = F.trim(F.col(value))
    own = values.select(axis, value, *[k.alias(name) for name, k in keys(trimmed).items()])
    fits = own.groupBy(axis).agg(F.count("*").alias("n"), *[(F.count(name) == F.count("*")).alias(f"all_{name}") for name in STRATEGIES])
    strategy = F.when(F.col("n") < 2, "unknown")
    for name in STRATEGIES:
        strategy = strategy.when(F.col(f"all_{name}"), name)
    known = fits.select(axis, strategy.otherwise("unknown").alias("strategy"))
    key = F.coalesce(*[F.when(F.col("strategy") == name, F.col(name)) for name in STRATEGIES])
    sure = F.when(F.col("strategy") == "unknown", "UNKNOWN").when(F.col("strategy").isin("roman", "ordinal", "edition"), "INFERRED").otherwise("CERTAIN")
    return own.join(known, axis).select(axis, value, "strategy", sure.alias("confidence"), key.alias("key"))


def family(key: Column) -> Column:
    """A regulatory key without its revision: one last capital letter after a digit."""
    return F.when(F.trim(key).rlike("^.*[0-9][A-Z]$"), F.regexp_extract(F.trim(key), "^(.*[0-9])([A-Z])$", 1)).otherwise(F.trim(key))


def revision(key: Column) -> Column:
    """The revision letter; empty for the first issue, which comes before A."""
    return F.regexp_extract(F.trim(key), "^(.*[0-9])([A-Z])$", 2)
