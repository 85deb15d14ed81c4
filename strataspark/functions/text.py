"""Numbers, keys and fingerprints out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_NUMBERS = ("", "-", "na", "n/a", "nan", "none", "null")


def european_float(c: Column) -> Column:
    """Number of a text that may have a decimal comma; null for what says there is none, and for other text."""
    flat = F.regexp_replace(F.trim(c), r"\s", "")
    commas = F.length(flat) - F.length(F.replace(flat, F.lit(","), F.lit("")))
    dotted = F.when((commas == 1) & ~flat.contains("."), F.replace(flat, F.lit(","), F.lit("."))).otherwise(flat)
    return F.when(F.lower(flat).isin(*NOT_NUMBERS), None).otherwise(dotted).try_cast("double")


def looks_numeric(c: Column) -> Column:
    return european_float(c).isNotNull()


def header_key(c: Column) -> Column:
    """Header in lower case, letters and digits only."""
    return F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]", "")


def file_stem(c: Column) -> Column:
    """File name without folders and its last extension, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"^.*[/\\]", ""), r"\.[^.]*$", ""))


def certificate_number(c: Column) -> Column:
    """First number of a printed token: minus variants, letters beside digits that stand for them, decimal commas; nothing behind a plus-minus sign."""
    head = F.regexp_replace(c, "(±|\\+/-).*$", "")
    plain = F.translate(F.translate(head, "−–—", "---"), ",", ".")
    fixed = F.regexp_replace(plain, r"(?<=[\d.])[Oo]|[Oo](?=[\d.])", "0")
    fixed = F.regexp_replace(fixed, r"(?<=[\d.])[lI]|[lI](?=[\d.])", "1")
    return F.regexp_extract(fixed, r"-?\d+(?:\.\d+)?", 0).try_cast("double")


def fingerprint(*columns: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the columns as one JSON object, in the given order."""
    return F.substring(F.sha1(F.to_json(F.struct(*columns))), 1, 16)


def degrees_of(dms: Column, reference: Column) -> Column:
    """Degrees of an array of degrees, minutes and seconds; south and west are negative."""
    value = F.get(dms, F.lit(0)) + F.get(dms, F.lit(1)) / 60 + F.get(dms, F.lit(2)) / 3600
    return F.when(F.upper(reference).isin("S", "W"), -value).otherwise(value)


def finite(c: Column) -> Column:
    """Not-a-number and the infinities as null."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
