"""Human corrections as an event log over the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import norm
from ..functions.text import REISSUE

#: An artist needs this many songs, and a year this much later than the median.
MEDIAN_MIN_SONGS = 3
MEDIAN_LATE_YEARS = 6


def latest_events(events: DataFrame, key: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """Last event per key (A14, A15). ``order`` is ascending; a null time counts as last."""
    ranked = F.struct(*[x for i, c in enumerate(order) for x in (c.isNull().alias(f"n{i}"), c.alias(f"o{i}"))])
    return events.groupBy(*key).agg(F.max_by(F.struct(*keep), ranked).alias("row")).select(*key, "row.*")


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows replace those of the same key; columns are united."""
    return existing.join(incoming, key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def overlay(base: DataFrame, overrides: DataFrame, key: str, column: str, override: str) -> DataFrame:
    """``base`` with ``<column>_final``: the override, else the value."""
    return base.join(overrides.select(key, override), key, "left").withColumn(f"{column}_final", F.coalesce(override, column))


def changed_rows(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New states that differ from the current one in any column, null-safe; a blank cell clears
    a value (P26, J15, U10)."""
    prior = old.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    return new.join(prior, key, "left").where(differs).select(key, *columns)


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def late_versus_median(songs: DataFrame, artist: str, year: str, min_songs: int = MEDIAN_MIN_SONGS, late: int = MEDIAN_LATE_YEARS) -> DataFrame:
    """``songs`` with the artist's median year and whether theirs is late (A08, W06). The median
    is aggregated per artist and joined back."""
    medians = songs.where(F.col(year).isNotNull()).groupBy(artist).agg(F.count(F.lit(1)).alias("n_songs"), F.median(year).alias("median_year"))
    flag = (F.col("n_songs") >= min_songs) & (F.col(year) - F.col("median_year") >= late)
    return songs.join(medians, artist, "left").withColumn("late_vs_median", F.coalesce(flag, F.lit(False)))


def reissue(album_folded: Column) -> Column:
    """Whether a folded album name looks like a reissue."""
    return album_folded.rlike(REISSUE)


def match_flag(year: Column, found: Column) -> Column:
    """``same``, ``diff`` or empty where nothing was found."""
    return F.when(found.isNull(), "").when(found == year, "same").otherwise("diff")


def suspect_reasons(reissue_flag: Column, late: Column, match: Column) -> Column:
    """Reasons in a fixed order, joined by semicolons."""
    return F.concat_ws(";", F.when(reissue_flag, "reissue_album"), F.when(late, "late_vs_artist"), F.when(match == "diff", "lookup_mismatch"))


def resolve_artists(*sources: tuple[str, str]) -> tuple[Column, Column]:
    """First value that is not missing, and the name of its source."""
    value = F.coalesce(*[norm(F.col(c)) for c, _ in sources])
    name = F.lit(None).cast("string")
    for c, label in reversed(sources):
        name = F.when(norm(F.col(c)).isNotNull(), label).otherwise(name)
    return value, name


def cache_misses(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Distinct keys that the cache lacks; a cached null counts as known."""
    return wanted.select(key).where(F.col(key).isNotNull()).distinct().join(cache.select(key), key, "left_anti")


def top_counts(df: DataFrame, column: str, size: int = 5) -> DataFrame:
    """Most frequent values as JSON, by count and then by value."""
    top = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(size)
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "value", "n")))
    return top.agg(F.to_json(F.transform(pairs, lambda p: F.struct(p["value"].alias("value"), p["n"].alias("n")))).alias("top_json"))
