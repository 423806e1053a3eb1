"""Identifiers, lineages and numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: rank letters of a lineage and the columns they fill
RANKS = {"d": "domain", "p": "phylum", "c": "class", "o": "order", "f": "family", "g": "genus", "s": "species"}
#: fixed values: patterns of genome identifiers
CATALOGUE_ID = "(MGYG[0-9]{9}(?:[.][0-9]+)?)"
ORIGINAL_ID = "(GUT_GENOME[0-9]{6,9})"
#: texts that a tab-separated table uses for a missing value
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)


def lineage_rank(lineage: Column, letter: str) -> Column:
    """Value of a rank in ``d__..;p__..;..``; the last of several wins, an absent one is ''."""
    found = F.regexp_extract_all(F.coalesce(lineage, F.lit("")), F.lit(f"(?:^|;)\\s*{letter}__([^;]*)"), F.lit(1))
    return F.trim(F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("")))


def version_stripped(identifier: Column) -> Column:
    """An identifier without its trailing ``.number``."""
    return F.regexp_replace(F.trim(identifier), "[.][0-9]+$", "")


def genome_alias(token: Column) -> Column:
    """The catalogue identifier in a token, else the original one, else null."""
    first = lambda pattern: F.nullif(F.regexp_extract(token, pattern, 1), F.lit(""))
    return F.coalesce(first(CATALOGUE_ID), first(ORIGINAL_ID))


def all_aliases(line: Column) -> Column:
    """Every identifier in a line, from left to right."""
    return F.regexp_extract_all(line, F.lit(f"{CATALOGUE_ID[:-1]}|{ORIGINAL_ID[1:]}"), F.lit(1))


def number(text: Column) -> Column:
    """A double; null where the text is no number or not a number."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value), value)


def share(part: Column, whole: Column) -> Column:
    """part / whole; null where the whole is 0."""
    return part / F.nullif(whole, F.lit(0))


def clipped(value: Column) -> Column:
    """Value within 0 and 1; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def missing_as_null(text: Column) -> Column:
    return F.when(~text.isin(*MISSING), text)
