"""Identity keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the version that starts every hashed identity.
IDENTITY_VERSION = "v2.1"


def norm(x: Column) -> Column:
    """Trimmed of Unicode white space; blank is null."""
    return F.nullif(F.regexp_replace(x.cast("string"), r"(?U)^\s+|\s+$", ""), F.lit(""))


def missing(x: Column) -> Column:
    """Null, blank or NaN text."""
    return norm(x).isNull() | (F.lower(norm(x)) == "nan")


def norm_list(x: Column) -> Column:
    """Trimmed, without blanks, first occurrences in order."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(x, F.array().cast("array<string>")), norm), lambda v: v.isNotNull()))


def feature_signature(x: Column) -> Column:
    """Sorted names of the featured artists."""
    return F.array_sort(norm_list(x))


def json_scalar(x: Column) -> Column:
    """One JSON value; null becomes ``null``."""
    whole = F.to_json(F.array(x))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def json_tuple(*parts: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def editorial_key(artist: Column, base: Column, featured: Column) -> Column:
    """``[artist, base title, featured artists]`` as compact JSON."""
    return json_tuple(json_scalar(norm(artist)), json_scalar(F.coalesce(base, F.lit(""))), F.to_json(feature_signature(featured)))


def guardrail_key(artist: Column, base: Column, featured: Column) -> Column:
    """The editorial key where artist and title are known, else null."""
    return F.when(norm(artist).isNotNull() & norm(base).isNotNull(), editorial_key(artist, base, featured))


def song_key(artist: Column, isrc: Column, base: Column, featured: Column) -> Column:
    """By ISRC where there is one, else by the editorial parts."""
    return F.when(norm(isrc).isNotNull(), json_tuple(json_scalar(norm(artist)), json_scalar(F.upper(norm(isrc))))).otherwise(editorial_key(artist, base, featured))


def song_id(key: Column, version: str = IDENTITY_VERSION) -> Column:
    """SHA-1 of the versioned key."""
    return F.sha1(F.concat(F.lit(f"{version}|"), key))
