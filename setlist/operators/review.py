"""What people review and how their answers come back: the template, its import as events, audits
and the quality row of the candidates (A17, A31, A32, J02, J06-J08, O11, O12, P10, P20, P21, P25, U09-U11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, keys, text
from ..functions.text import REISSUE
from . import curation

#: Columns that a review can change.
EDITABLE = ["year_override", "artists_display_override", "title_display_override", "note"]


def first_values(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """One row per key with its first value, in ``order``, that is not missing; keys that are missing
    go (A32)."""
    k, v = keys.norm(F.col(key)), keys.norm(F.col(value))
    rows = df.select(k.alias(key), v.alias(value), F.struct(*order).alias("__at")).where(F.col(key).isNotNull() & F.col(value).isNotNull())
    return rows.groupBy(key).agg(F.min_by(value, "__at").alias(value))


def dedupe_key(values: Column) -> Column:
    """A list as JSON of its items that are not missing, in order and with repeats; null if there are
    none (F26)."""
    kept = F.filter(F.transform(values, keys.norm), lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.to_json(kept))


def song_curation(events: DataFrame, version: str = keys.IDENTITY_VERSION) -> DataFrame:
    """Overrides of songs under the current identity, cleaned (P10, P25)."""
    songs = events.where((F.col("entity_type") == "song") & (F.col("identity_version") == version))
    return songs.select(
        F.col("entity_id").alias("song_id"),
        dates.lenient_int(F.col("year_override").cast("string")).alias("year_override"),
        keys.norm(F.col("artists_display_override")).alias("artists_display_override"),
        keys.norm(F.col("title_display_override")).alias("title_display_override"),
        keys.norm(F.col("note")).alias("note"),
        *[c for c in ("updated_at", "run_id", "seq") if c in events.columns],
    )


def current_state(current: DataFrame, history: DataFrame, version: str = keys.IDENTITY_VERSION) -> DataFrame:
    """The last event of each song in the current table and the history together; a time that cannot be
    read counts as the latest, then run and place in the run decide (A14, U01, U11)."""
    both = song_curation(current.unionByName(history, allowMissingColumns=True), version)
    order = [F.try_to_timestamp(F.col("updated_at")), F.coalesce("run_id", F.lit("")), F.coalesce("seq", F.lit(-1))]
    return curation.latest_events(both, ["song_id"], order, [*EDITABLE, "updated_at", "run_id"])


def require_years(review: DataFrame, columns: list[str]) -> None:
    """Raise, naming songs, where a year cell is neither blank nor a whole number (P25)."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | (keys.norm(F.col(c)).isNotNull() & dates.lenient_int(F.col(c)).isNull())
    rows = review.where(bad).select("song_id", *columns).limit(5).collect()
    if rows:
        raise ValueError(f"not a year: {[tuple(r) for r in rows]}")


def review_state(review: DataFrame) -> DataFrame:
    """What the sheet says of each song: a manual year wins over a suggested one, whose use the note
    tells; a blank cell clears (P24)."""
    manual, suggested = F.col("year_override"), F.col("ai_year")
    return review.select(
        "song_id",
        dates.effective_year(manual, suggested).alias("year_override"),
        keys.norm(F.col("artists_display_override")).alias("artists_display_override"),
        keys.norm(F.col("title_display_override")).alias("title_display_override"),
        dates.tagged_note(manual, suggested, F.col("note"), F.col("ai_note")).alias("note"),
    )


def events_of(review: DataFrame, current: DataFrame, run_id: str, now: str, version: str = keys.IDENTITY_VERSION) -> DataFrame:
    """An event for every song whose reviewed state differs from the current one.
    A song without a current row differs if any cell says something."""
    changed = curation.changed_rows(current, review_state(review), "song_id", EDITABLE)
    return changed.select(
        F.lit("song").alias("entity_type"),
        F.col("song_id").alias("entity_id"),
        F.lit(version).alias("identity_version"),
        "year_override",
        "artists_display_override",
        "title_display_override",
        F.lit(now).alias("updated_at"),
        F.lit(run_id).alias("run_id"),
        "note",
    )


def with_curation(candidates: DataFrame, songs_curated: DataFrame, columns: list[str]) -> DataFrame:
    """Candidates with the curated songs' display columns."""
    return candidates.join(songs_curated.select("song_id", "winner_track_id", *columns), ["song_id", "winner_track_id"], "left")


def earliest_year(recordings: Column) -> Column:
    """The smallest leading year of the ``first-release-date`` of nested recordings."""
    found = F.transform(recordings, lambda r: dates.year_of(F.trim(r["first_release_date"])))
    return F.array_min(F.filter(found, lambda y: y.isNotNull()))


def template(candidates: DataFrame, owners: DataFrame, owner_names: DataFrame, albums: DataFrame, isrcs: DataFrame, found_years: DataFrame, track_url: str) -> DataFrame:
    """The sheet that people review.

    ``candidates``: ``song_id, winner_track_id, primary_artist_name, secondary_artist_names, title_display,
    title_display_override, artists_display_override, year_candidate, year_final, note``. Look-ups: ``song_id, owner_ids``;
    ``owner_id, owner_name``; ``track_id, album_name``; ``song_id, isrc``; ``isrc, found_year``. All are left joins."""
    named = owners.select("song_id", F.posexplode("owner_ids").alias("pos", "owner_id")).join(owner_names, "owner_id", "left")
    labels = named.groupBy("song_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("owner_name", "owner_id").alias("label")))).alias("l"))
    labels = labels.select("song_id", F.array_join(F.transform("l", lambda x: x["label"]), ", ").alias("owners"))
    rows = candidates.join(labels, "song_id", "left").join(albums.withColumnRenamed("track_id", "winner_track_id"), "winner_track_id", "left")
    rows = rows.join(isrcs.join(found_years, "isrc").select("song_id", "found_year"), "song_id", "left")
    shown = text.artists_display(F.col("primary_artist_name"), F.col("secondary_artist_names"))
    # titles, albums and artists recur: each distinct one is worked on once
    for column, name, out in (("title_display", "title_display", "__shown"), ("album_name", "fold_case", "album_folded"), ("primary_artist_name", "fold_case", "artist_folded")):
        rows = text.mapped(rows, column, name, out)
    rows = rows.withColumns({"title_display_current": F.coalesce("__shown", "title_display"), "artists_display_current": shown, "artist_folded": F.trim("artist_folded")})
    rows = curation.late_versus_median(rows, "artist_folded", "year_candidate")
    match = F.when(F.col("found_year").isNull() | F.col("year_candidate").isNull(), "").otherwise(curation.match_flag(F.col("year_candidate"), F.col("found_year")))
    reissued = F.coalesce(F.col("album_folded").rlike(REISSUE), F.lit(False))
    reason = curation.suspect_reasons(reissued, F.col("late_vs_median"), match)
    return rows.select(
        "song_id",
        "winner_track_id",
        F.concat(F.lit(track_url), F.col("winner_track_id").cast("string")).alias("track_url"),
        F.coalesce(keys.norm(F.col("title_display_override")), "title_display_current").alias("title_display"),
        F.coalesce(keys.norm(F.col("artists_display_override")), "artists_display_current").alias("artists_display"),
        F.nullif(F.array_join(keys.norm_list(F.col("secondary_artist_names")), " | "), F.lit("")).alias("secondary_artist_names"),
        "album_name",
        "owners",
        "year_candidate",
        "year_final",
        F.col("found_year").alias("mb_first_release_year"),
        match.alias("mb_match"),
        (reason != "").alias("year_suspect"),
        reason.alias("suspect_reason"),
        "note",
    )


def audit(songs: DataFrame, years: DataFrame, candidates: DataFrame) -> DataFrame:
    """Audit flags of every song (J02, J07, O12, P20). ``candidates``: ``song_id, selection_phase``."""
    marks = candidates.select("song_id", "selection_phase", F.lit(True).alias("in_candidates"))
    rows = songs.join(years.select("song_id", "winner_track_id", "year_final", "precision"), ["song_id", "winner_track_id"], "left").join(marks, "song_id", "left")
    rows = text.mapped(rows, "title_display", "title_parts", "__parts")
    count = lambda c: F.size(keys.norm_list(F.col(c))).cast("long")
    return rows.select(
        "song_id",
        F.array_join(keys.norm_list(F.col("secondary_artist_names")), " | ").alias("secondary_artist_names"),
        count("track_ids_merged").alias("merged_track_count"),
        F.coalesce("in_candidates", F.lit(False)).alias("in_candidates"),
        "selection_phase",
        "year_final",
        (count("secondary_artist_names") > 0).alias("has_secondary_artists"),
        (count("track_ids_merged") > 1).alias("has_merge"),
        F.coalesce("__parts.had_suffix", F.lit(False)).alias("title_has_collapsible_tag"),
        F.coalesce(F.col("precision") == "year", F.lit(True)).alias("year_precision_low"),
        keys.missing(F.col("isrc")).alias("missing_isrc"),
    )


def candidate_quality(pool: DataFrame, chosen: DataFrame, run_id: str, current_year: int) -> DataFrame:
    """One row on the candidates of a run (A17). ``pool``: ``year_final, excluded_by_max_year_rule`` of
    all songs; ``chosen``: ``year_final, owner_ids, primary_artist_name`` of the candidates. All three
    tops come from one pass over counted values."""
    base = pool.agg(
        F.count(F.lit(1)).alias("songs_input"),
        F.count("year_final").alias("songs_with_year"),
        F.count_if(F.col("year_final").isNull()).cast("long").alias("songs_missing_year"),
        F.max("year_final").alias("max_year"),
        F.count_if("excluded_by_max_year_rule").cast("long").alias("excluded_by_max_year_rule"),
    )
    final = chosen.agg(F.count_distinct("year_final").alias("distinct_years_in_candidates"), F.count(F.lit(1)).alias("candidates_final"))
    artist = F.coalesce(keys.norm(F.col("primary_artist_name")), F.lit("__missing_artist__"))

    def top(values: DataFrame, name: str) -> DataFrame:
        best = values.where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(5)
        pairs = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "value", "n"))), lambda p: F.to_json(F.create_map(p["value"], p["n"])))
        return best.agg(F.concat(F.lit("["), F.array_join(pairs, ","), F.lit("]")).alias(name))

    tops = [
        top(chosen.select(F.col("year_final").cast("string").alias("value")), "top_year_counts"),
        top(chosen.select(F.explode("owner_ids").alias("value")), "top_owner_counts"),
        top(chosen.select(artist.alias("value")), "top_artist_counts"),
    ]
    out = base.crossJoin(F.broadcast(final))
    for t in tops:  # one row each
        out = out.crossJoin(F.broadcast(t))
    return out.select(F.lit(run_id).alias("run_id"), F.lit(current_year).alias("current_year"), *out.columns)
