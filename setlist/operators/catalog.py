"""From playlist items to instances, tracks and their quality counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import missing


def track_payload() -> Column:
    """The item's ``track`` object, or ``item``."""
    return F.coalesce(F.col("track"), F.col("item"))


def reject_reason(track: Column, item_local: Column) -> Column:
    """First reason that holds, null for a usable track."""
    absent = F.coalesce(F.trim(track["id"]) == "", F.lit(True))
    other = F.coalesce(track["type"] != "track", F.lit(False)) | F.coalesce(track["episode"], F.lit(False))
    local = F.coalesce(track["is_local"], item_local, F.lit(False))
    return F.when(track.isNull(), "null").when(other, "non_track").when(local, "local").when(absent, "null")


def flatten_items(items: DataFrame) -> DataFrame:
    """Nested items to the track columns (P06-P08). ``items``: ``owner_id, ordinal, added_at,
    is_local`` and the structs ``track`` and ``item``."""
    t = track_payload()
    ids, names = F.transform(t["artists"], lambda a: a["id"]), F.transform(t["artists"], lambda a: a["name"])
    return items.select(
        "owner_id",
        "ordinal",
        "added_at",
        reject_reason(t, F.col("is_local")).alias("reason"),
        t["id"].alias("track_id"),
        t["name"].alias("track_name"),
        F.try_element_at(ids, F.lit(1)).alias("primary_artist_id"),
        F.try_element_at(names, F.lit(1)).alias("primary_artist_name"),
        F.slice(ids, 2, F.greatest(F.size(ids), F.lit(1))).alias("secondary_artist_ids"),
        F.slice(names, 2, F.greatest(F.size(names), F.lit(1))).alias("secondary_artist_names"),
        t["album"]["id"].alias("album_id"),
        t["album"]["name"].alias("album_name"),
        t["album"]["release_date"].alias("release_date"),
        t["external_ids"]["isrc"].alias("isrc"),
        t["external_urls"]["spotify"].alias("track_url"),
        t["duration_ms"].alias("duration_ms"),
        t["popularity"].alias("popularity"),
        t["explicit"].alias("explicit"),
    )


def earliest_instances(items: DataFrame, order: list[str], keep: list[str]) -> DataFrame:
    """One row per owner and track: the earliest ``added_at`` as text, nulls last, then the first
    by ``order`` (A01). A partial aggregation; no sort of the items."""
    key = F.struct(F.col("added_at").isNull().alias("late"), "added_at", *order)
    kept = ["added_at", *keep]
    return items.groupBy("owner_id", "track_id").agg(F.min(F.struct(key.alias("key"), F.struct(*kept).alias("row"))).alias("k")).select("owner_id", "track_id", *[f"k.row.{c}" for c in kept])


def first_occurrences(items: DataFrame, order: list[str], keep: list[str]) -> DataFrame:
    """One row per track: first owner, then first by ``order``."""
    key, kept = F.struct("owner_id", *order), ["owner_id", *keep]
    return items.groupBy("track_id").agg(F.min(F.struct(key.alias("key"), F.struct(*kept).alias("row"))).alias("k")).select("track_id", *[f"k.row.{c}" for c in kept])


def instance_counts(items: DataFrame) -> DataFrame:
    """Funnel counts per owner; ``reason`` is null for usable items."""
    usable = F.col("reason").isNull()
    n = lambda c: F.count_if(c).cast("long")
    return items.groupBy("owner_id").agg(
        F.count(F.lit(1)).alias("items_total"),
        n(F.col("reason") == "null").alias("skipped_null"),
        n(F.col("reason") == "non_track").alias("skipped_non_track"),
        n(F.col("reason") == "local").alias("skipped_local"),
        n(usable).alias("valid_items"),
        F.count_distinct(F.when(usable, F.col("track_id"))).alias("unique_tracks"),
        (n(usable) - F.count_distinct(F.when(usable, F.col("track_id")))).alias("dedup_removed"),
    )


#: Percentages are rounded half up from the decimal form, as ``round`` of Spark does it.
def missing_share(df: DataFrame, columns: list[str]) -> DataFrame:
    """Row count and percentage of missing values per column; 0 for an empty table."""
    share = lambda c: F.coalesce(F.round(F.avg(missing(F.col(c)).cast("int")) * 100, 2), F.lit(0.0)).alias(f"{c}_missing_pct")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[share(c) for c in columns])


def owners_per_track(instances: DataFrame) -> DataFrame:
    """Distinct owners of each track, sorted."""
    return instances.groupBy("track_id").agg(F.array_sort(F.collect_set("owner_id")).alias("owner_ids")).withColumn("owners_count", F.size("owner_ids").cast("long"))


def of_instances(tracks: DataFrame, instances: DataFrame) -> DataFrame:
    """Tracks that some owner has."""
    return tracks.join(instances.select("track_id"), "track_id", "left_semi")


def instance_order() -> list[Column]:
    """By owner, then by time of adding, unknown last, then by track."""
    return [F.col("owner_id"), F.col("added_at").asc_nulls_last(), F.col("track_id")]
