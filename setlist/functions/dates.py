"""Partial dates kept as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Confidence of a year by the precision of its date.
CONFIDENCE = {"day": 0.8, "month": 0.7, "year": 0.6}


def precision(date: Column) -> Column:
    return F.when(date.rlike(r"^\d{4}-\d{2}-\d{2}$"), "day").when(date.rlike(r"^\d{4}-\d{2}$"), "month").when(date.rlike(r"^\d{4}$"), "year")


def year_of(date: Column) -> Column:
    """The leading four digits, whatever follows them."""
    return F.nullif(F.regexp_extract(date, r"^(\d{4})", 1), F.lit("")).cast("int")


def confidence(date: Column) -> Column:
    p = precision(date)
    out = F.lit(None).cast("double")
    for name, value in CONFIDENCE.items():
        out = F.when(p == name, F.lit(value)).otherwise(out)
    return out


def sort_key(date: Column) -> Column:
    """Earliest first; at equal numbers the more precise date first."""
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(date, r"^\d{4}-(\d{2})(?:-(\d{2}))?$", k), F.lit("")).cast("int"), F.lit(99))
    rank = F.when(precision(date) == "day", 0).when(precision(date) == "month", 1).when(precision(date) == "year", 2).otherwise(3)
    return F.when(year_of(date).isNotNull(), F.struct(year_of(date).alias("y"), part(1).alias("m"), part(2).alias("d"), rank.alias("r")))


def lenient_int(text: Column) -> Column:
    """A whole number with blanks around it, else null (P25)."""
    return F.expr("cast(null as int)") if text is None else F.when(F.trim(text).rlike(r"^[+-]?\d{1,9}$"), F.trim(text).cast("int"))


def lenient_number(text: Column) -> Column:
    """The number a text starts with, a comma allowed for the point."""
    return F.nullif(F.replace(F.trim(F.regexp_extract(text, r"^\s*(-?\d+([.,]\d+)?)", 1)), F.lit(","), F.lit(".")), F.lit("")).cast("double")


def effective_year(manual: Column, suggested: Column) -> Column:
    """A manual year wins over a suggested one."""
    return F.coalesce(lenient_int(manual), lenient_int(suggested))


def tagged_note(manual: Column, suggested: Column, note: Column, reason: Column) -> Column:
    """The note, marked ``[AI]`` with its reason where the suggested year was taken."""
    used = lenient_int(manual).isNull() & lenient_int(suggested).isNotNull()
    mark = F.concat_ws(" ", F.lit("[AI]"), F.nullif(F.trim(reason), F.lit("")))
    return F.nullif(F.concat_ws(" | ", F.when(used, mark), F.nullif(F.trim(note), F.lit(""))), F.lit(""))
