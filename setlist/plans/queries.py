"""Registered queries over the driver's tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, keys, text
from ..operators import catalog, curation, identity, ledger, playback, review, selection
from ..operators import registry as reg
from ..operators import report as rep
from ..sources import positions
from ..streaming import frames, scans, timers
from .adapters import ORDER, PREFIX, items, registry, songs, sql, table, tracks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def joined(c: str):
    return F.array_join(c, "|").alias(c)


# ---------------------------------------------------------------- catalog


@query(sql("items", select="select owner_id, track_id, added_at, l_orderkey, l_linenumber from (select *, row_number() over (partition by owner_id, track_id order by added_at, l_orderkey, l_linenumber, l_suppkey) rn from items) where rn = 1"))
def instances_earliest(spark, sf):
    return catalog.earliest_instances(items(spark, sf), ORDER, ["l_orderkey", "l_linenumber"])


@query(sql("items", select="""select owner_id, count(*) items_total, count(*) filter (reason = 'null') skipped_null, count(*) filter (reason = 'non_track') skipped_non_track, count(*) filter (reason = 'local') skipped_local,
  count(*) filter (reason is null) valid_items, count(distinct case when reason is null then track_id end) unique_tracks, count(*) filter (reason is null) - count(distinct case when reason is null then track_id end) dedup_removed from items group by 1"""))
def instances_qc(spark, sf):
    return catalog.instance_counts(items(spark, sf))


@query(sql("items", select="select track_id, owner_id, l_orderkey, l_linenumber from (select *, row_number() over (partition by track_id order by owner_id, l_orderkey, l_linenumber, l_suppkey) rn from items) where rn = 1"))
def tracks_first_occurrence(spark, sf):
    return catalog.first_occurrences(items(spark, sf), ORDER, ["l_orderkey", "l_linenumber"])


@query("""select count(*) n_rows, round(avg(case when quality is null then 1 else 0 end) * 100, 2) quality_missing_pct, round(avg(case when toxic is null then 1 else 0 end) * 100, 2) toxic_missing_pct
  from documents left join labels using (doc_id)""")
def missing_pct(spark, sf):
    both = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return catalog.missing_share(both, ["quality", "toxic"])


@query(sql("tracks", select="select track_id, owners_count, array_to_string(owner_ids, '|') owner_ids from own"))
def owners_per_track(spark, sf):
    return catalog.owners_per_track(items(spark, sf)).select("track_id", "owners_count", joined("owner_ids"))


@query(sql("items", select="select distinct owner_id, track_id, p_name as track_name from items join part on p_partkey = track_id"))
def instance_tracks(spark, sf):
    """Distinct pairs that have a track."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("track_id"), F.col("p_name").alias("track_name"))
    return items(spark, sf).select("owner_id", "track_id").distinct().join(part, "track_id")


@query("select p_partkey track_id, p_name track_name from part where p_partkey in (select l_partkey from lineitem where l_quantity > 49)")
def tracks_of_instances(spark, sf):
    """Tracks that some item of fifty pieces has."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("track_id"), F.col("p_name").alias("track_name"))
    return catalog.of_instances(part, items(spark, sf).where("l_quantity > 49"))


@query(sql("items", select="select owner_id, track_id, added_at, l_orderkey, l_linenumber, row_number() over (order by owner_id, added_at, track_id, l_orderkey, l_linenumber, l_suppkey, l_quantity) - 1 + 10 seq from items"))
def dense_order(spark, sf):
    """Places of all items in the order of their owners, from 10 on."""
    rows = items(spark, sf).drop("reason")
    return positions.dense(rows, ["owner_id", "added_at", "track_id", *ORDER], "seq", 10).select("owner_id", "track_id", "added_at", "l_orderkey", "l_linenumber", "seq")


# ---------------------------------------------------------------- identity


@query(sql("songs", select="select song_id, winner_track_id, row_number() over (order by owners_count desc, popularity desc, had_suffix, track_id) - 1 place from songs"))
def component_places(spark, sf):
    """Songs in the order of their winners."""
    return identity.component_order(tracks(spark, sf))


@query("""select p_partkey as track_id, concat('["', p_brand, '","', p_name, '",["', p_type, '"]]') as editorial_key, sha1(concat('v2.1|["', p_brand, '","', upper(p_name), '"]')) isrc_id,
  sha1(concat('v2.1|["', p_brand, '","', p_name, '",["', p_type, '"]]')) fallback_id from part""")
def song_key_sha1(spark, sf):
    p = table(spark, sf, "part")
    none, kind = F.lit(None).cast("string"), F.array(F.col("p_type"), F.lit(" "), F.col("p_type"))
    return p.select(
        F.col("p_partkey").alias("track_id"),
        keys.editorial_key(F.col("p_brand"), F.col("p_name"), kind).alias("editorial_key"),
        keys.song_id(keys.song_key(F.col("p_brand"), F.col("p_name"), F.col("p_name"), kind)).alias("isrc_id"),
        keys.song_id(keys.song_key(F.col("p_brand"), none, F.col("p_name"), kind)).alias("fallback_id"),
    )


@query(sql("songs", select="select song_id, winner_track_id, n_variants, owners_count, popularity from songs"))
def winner_per_song(spark, sf):
    return identity.winners(tracks(spark, sf))


@query(sql("songs", select=""", a as (select song_id, count(*) n, max(owners_count) o from tracks group by 1), b as (select t.*, n from tracks t join a using (song_id) where owners_count = o),
  c as (select song_id, max(popularity) p, count(*) n_o from b group by 1), d as (select song_id, any_value(n) n, any_value(n_o) n_o, count(*) n_p, count(*) filter (not had_suffix) n_plain from b join c using (song_id) where popularity = p group by 1)
  select song_id, case when n = 1 then 'single_variant' when n_o = 1 then 'owners_count' when n_p = 1 then 'owners_count>popularity' when (case when n_plain > 0 then n_plain else n_p end) = 1 then 'owners_count>popularity>title_without_collapsible_suffix' else 'owners_count>popularity>title_without_collapsible_suffix>track_id' end winner_rule_path from d""").replace("\n, a as", ", a as"))
def winner_rule_path(spark, sf):
    return identity.winner_rule(tracks(spark, sf))


@query(sql("tracks", select="""select artist, track_id, duration_ms, cast(sum(gap) over (partition by artist order by duration_ms, track_id rows unbounded preceding) as bigint) island from
  (select *, case when duration_ms - lag(duration_ms) over (partition by artist order by duration_ms, track_id) > 8000 then 1 else 0 end gap from tracks)"""))
def duration_islands(spark, sf):
    rows = tracks(spark, sf).select("artist", "track_id", "duration_ms")
    return identity.islands(rows, ["artist"], "duration_ms", ["track_id"])


@query(sql("songs", select="""select song_id, max(track_id) filter (rn = 1) winner_track_id, coalesce(first(variant order by order_idx) filter (variant is not null), cast(max(track_id) filter (rn = 1) as varchar)) title,
  concat_ws('|', max(track_id) filter (rn = 1), string_agg(cast(track_id as varchar), '|' order by order_idx) filter (rn > 1)) merged_track_ids,
  array_to_string(list_sort(list_distinct(flatten(list(owner_ids)))), '|') owner_ids, min(release_date) release_date, arg_min(track_id, (release_date, track_id)) filter (release_date is not null) release_track_id from ranked group by 1"""))
def song_rollup(spark, sf):
    out = identity.rollup(tracks(spark, sf), "order_idx", "variant")
    return out.select("song_id", "winner_track_id", "title", joined("merged_track_ids"), joined("owner_ids"), "release_date", "release_track_id")


@query(sql("songs", select="select cast(sum(n_variants) as bigint) tracks, count(*) songs, count(*) filter (n_variants > 1) merged_songs, cast(sum(n_variants - 1) as bigint) merges from songs"))
def merge_stats(spark, sf):
    return identity.merge_stats(identity.winners(tracks(spark, sf)))


PARTIAL = "case o_orderkey % 5 when 0 then strftime(o_orderdate, '%Y') when 1 then strftime(o_orderdate, '%Y-%m') when 2 then strftime(o_orderdate, '%Y-%m-%d') when 3 then strftime(o_orderdate, '%Y/%m') else 'abcd' end"


def partial_dates(spark, sf) -> DataFrame:
    d = lambda f: F.date_format("o_orderdate", f)
    k = F.col("o_orderkey") % 5
    return table(spark, sf, "orders").select("o_orderkey", F.when(k == 0, d("yyyy")).when(k == 1, d("yyyy-MM")).when(k == 2, d("yyyy-MM-dd")).when(k == 3, d("yyyy/MM")).otherwise("abcd").alias("date"))


@query(f"""with d as (select o_orderkey, {PARTIAL} as date from orders) select o_orderkey, cast(nullif(regexp_extract(date, '^(\\d{{4}})', 1), '') as int) as year,
  case length(date) when 10 then 'day' when 7 then case when date like '%-%' then 'month' end when 4 then case when date <> 'abcd' then 'year' end end as precision,
  case length(date) when 10 then 0.8::double when 7 then case when date like '%-%' then 0.7::double end when 4 then case when date <> 'abcd' then 0.6::double end end as confidence from d""")
def year_precision(spark, sf):
    d = partial_dates(spark, sf)
    return d.select("o_orderkey", dates.year_of(F.col("date")).alias("year"), dates.precision(F.col("date")).alias("precision"), dates.confidence(F.col("date")).alias("confidence"))


# ---------------------------------------------------------------- curation


@query("select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) rn from events) where rn = 1")
def curation_latest(spark, sf):
    return curation.latest_events(table(spark, sf, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], ["event_id", "value"])


@query("""select p_partkey, p_name, cast(null as int) p_size from part where p_partkey not in (select 2 * p_partkey from part) union all select 2 * p_partkey, cast(null as varchar), p_size from part""")
def upsert_catalog(spark, sf):
    p = table(spark, sf, "part")
    return curation.upsert(p.select("p_partkey", "p_name"), p.select((F.col("p_partkey") * 2).alias("p_partkey"), "p_size"), ["p_partkey"])


OVERRIDES = """overrides as (select user_id as winner_track_id, 1900 + cast(floor(value) as int) % 100 as year_override from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events where event_type = 'click') where rn = 1)"""


def overrides(spark, sf) -> DataFrame:
    clicks = table(spark, sf, "events").where("event_type = 'click'")
    last = curation.latest_events(clicks, ["user_id"], [F.col("ts"), F.col("event_id")], ["value"])
    return last.select(F.col("user_id").alias("winner_track_id"), (1900 + F.floor("value").cast("int") % 100).cast("int").alias("year_override"))


@query(sql("songs", select=f", {OVERRIDES} select song_id, year, year_override, coalesce(year_override, year) year_final from songs left join overrides using (winner_track_id)"))
def overlay_years(spark, sf):
    s = songs(spark, sf).select("song_id", "winner_track_id", "year")
    return curation.overlay(s, overrides(spark, sf), "winner_track_id", "year", "year_override").drop("winner_track_id")


@query(sql("songs", select=f""", {OVERRIDES}, old as (select winner_track_id, year_override, 'x' as note from overrides), new as (select winner_track_id, case when winner_track_id % 3 = 0 then null else year_override end year_override, case when winner_track_id % 2 = 0 then 'x' end as note from overrides)
  select new.winner_track_id, new.year_override, new.note from new left join old using (winner_track_id) where new.year_override is distinct from old.year_override or new.note is distinct from old.note"""))
def override_diff(spark, sf):
    old = overrides(spark, sf).withColumn("note", F.lit("x"))
    k = F.col("winner_track_id")
    new = old.select("winner_track_id", F.when(k % 3 != 0, F.col("year_override")).alias("year_override"), F.when(k % 2 == 0, "x").alias("note"))
    return curation.changed_rows(old, new, "winner_track_id", ["year_override", "note"])


@query(sql("songs", select=f", {OVERRIDES} select count(*) n_songs, count(year_override) n_year_overrides from songs left join overrides using (winner_track_id)"))
def override_counts(spark, sf):
    """A18."""
    s = songs(spark, sf).join(overrides(spark, sf), "winner_track_id", "left")
    return s.agg(F.count(F.lit(1)).alias("n_songs"), F.count("year_override").alias("n_year_overrides"))


SIZES = "select p_partkey as song, p_name as artist, p_size as year from part"


@query(f"""with s as ({SIZES}), m as (select artist, count(*) n_songs, median(year) median_year from s group by 1)
  select song, artist, year, n_songs, cast(median_year as double) median_year, n_songs >= 3 and year - median_year >= 6 as late_vs_median from s join m using (artist)""")
def late_vs_median(spark, sf):
    s = table(spark, sf, "part").select(F.col("p_partkey").alias("song"), F.col("p_name").alias("artist"), F.col("p_size").alias("year"))
    return curation.late_versus_median(s, "artist", "year")


#: Album endings for the suspect rules, by size modulo 6.
ENDINGS = [" (Deluxe Edition)", " En Vivo", " Greatest Hits", "", " Olive", " Remastered 2009"]
ALBUM = "lower(concat(p_type, case p_size % 6 " + " ".join(f"when {i} then '{e}'" for i, e in enumerate(ENDINGS)) + " end))"


def albums(spark, sf) -> DataFrame:
    end = F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (F.col("p_size") % 6 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", "p_size", "p_name", F.lower(F.concat("p_type", end)).alias("album"))


REISSUED = f"regexp_matches({ALBUM}, '{text.REISSUE}')"


@query(f"select p_partkey, {ALBUM} album, {REISSUED} reissue_album from part")
def reissue_flag(spark, sf):
    return albums(spark, sf).select("p_partkey", "album", curation.reissue(F.col("album")).alias("reissue_album"))


@query(f"""with f as (select p_partkey, {REISSUED} a, p_size >= 40 b, case when p_size % 4 = 0 then '' when p_size % 4 = 1 then 'same' else 'diff' end mb_match from part), r as (select *, concat_ws(';', case when a then 'reissue_album' end, case when b then 'late_vs_artist' end, case when mb_match = 'diff' then 'lookup_mismatch' end) reason from f)
  select p_partkey, mb_match, reason, reason <> '' year_suspect from r""")
def suspect_reasons(spark, sf):
    k = F.col("p_size") % 4
    found = F.when(k == 1, F.col("p_size")).when(k > 1, F.col("p_size") + 1)
    rows = albums(spark, sf).withColumn("mb_match", curation.match_flag(F.col("p_size"), found))
    rows = rows.withColumn("reason", curation.suspect_reasons(curation.reissue(F.col("album")), F.col("p_size") >= 40, F.col("mb_match")))
    return rows.select("p_partkey", "mb_match", "reason", (F.col("reason") != "").alias("year_suspect"))


@query("select doc_id from documents where doc_id not in (select doc_id from labels) group by 1")
def enrichment_misses(spark, sf):
    return curation.cache_misses(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("select user_id, event_type, count(*) n from events group by 1, 2 having count(*) > 1")
def duplicate_keys(spark, sf):
    return curation.duplicate_keys(table(spark, sf, "events"), ["user_id", "event_type"])


@query("""select to_json(list({'value': event_type, 'n': n} order by n desc, event_type)) top_json from (select event_type, count(*) n from events group by 1 order by n desc, event_type limit 3)""")
def top_counts_json(spark, sf):
    return curation.top_counts(table(spark, sf, "events"), "event_type", 3)


@query("""select event_id, case when event_id % 3 = 0 then cast(value as int) when event_id % 3 = 1 then null else 1950 + cast(event_id % 60 as int) end effective_year,
  case when event_id % 3 = 2 then case when event_id % 2 = 0 then '[AI] why | seen' else '[AI] why' end else case when event_id % 2 = 0 then 'seen' end end note from (select event_id, floor(value) as value from events)""")
def effective_year(spark, sf):
    k = F.col("event_id")
    e = table(spark, sf, "events").select("event_id", F.when(k % 3 == 0, F.concat(F.lit(" "), F.floor("value").cast("string"), F.lit(" "))).when(k % 3 == 1, "19x5").otherwise("").alias("manual"), F.when(k % 3 != 1, (1950 + k % 60).cast("string")).alias("ai"), F.when(k % 2 == 0, "seen").alias("old"))
    return e.select("event_id", dates.effective_year(F.col("manual"), F.col("ai")).alias("effective_year"), dates.tagged_note(F.col("manual"), F.col("ai"), F.col("old"), F.lit("why")).alias("note"))


#: Songs for review and audits: titles with endings, guests, a missing code, a date's precision.
TITLE = "concat(p_name, case p_partkey % 4 when 0 then ' (Live)' when 1 then ' - Remastered 2009' when 2 then ' [Exit]' else '' end)"
REVIEWED = f"""r as (select p_partkey, cast(p_partkey as varchar) song_id, p_brand artist, {TITLE} title, case when p_size % 3 = 0 then [p_type, p_type] when p_size % 3 = 1 then [' '] else [] end guests, case when p_size % 2 = 0 then [p_partkey, p_partkey + 1] else [p_partkey] end merged,
  case p_size % 4 when 0 then null when 1 then ' ' else concat('X', p_partkey % 50) end isrc, 1990 + p_size % 30 as year_candidate, case p_size % 4 when 0 then 'year' when 1 then 'day' when 2 then 'month' end as precision from part)"""


def reviewed(spark, sf) -> DataFrame:
    n, k = F.col("p_size"), F.col("p_partkey")
    none = F.array().cast("array<string>")
    end = F.element_at(F.array(F.lit(" (Live)"), F.lit(" - Remastered 2009"), F.lit(" [Exit]"), F.lit("")), (k % 4 + 1).cast("int"))
    return table(spark, sf, "part").select(
        k.cast("string").alias("song_id"),
        k.alias("winner_track_id"),
        F.col("p_brand").alias("primary_artist_name"),
        F.concat("p_name", end).alias("title_display"),
        F.when(n % 3 == 0, F.array("p_type", "p_type")).when(n % 3 == 1, F.array(F.lit(" "))).otherwise(none).alias("secondary_artist_names"),
        F.when(n % 2 == 0, F.array(k, k + 1)).otherwise(F.array(k)).cast("array<string>").alias("track_ids_merged"),
        F.when(n % 4 == 1, " ").when(n % 4 > 1, F.concat(F.lit("X"), (k % 50).cast("string"))).alias("isrc"),
        (n % 30 + 1990).alias("year_candidate"),
        F.when(n % 4 == 0, "year").when(n % 4 == 1, "day").when(n % 4 == 2, "month").alias("precision"),
        n.alias("p_size"),
        F.col("p_type").alias("album_name"),
    )


@query(f"""with {REVIEWED} select song_id, case when len(guests) = 2 then guests[1] else '' end secondary_artist_names, cast(len(merged) as bigint) merged_track_count, p_partkey % 5 = 0 in_candidates, case when p_partkey % 5 = 0 then 'phase1' end selection_phase,
  case when p_partkey % 6 <> 0 then year_candidate end year_final, len(guests) = 2 has_secondary_artists, len(merged) > 1 has_merge, p_partkey % 4 in (0, 1) title_has_collapsible_tag,
  case when p_partkey % 6 = 0 then true else coalesce(precision = 'year', true) end year_precision_low, coalesce(trim(isrc), '') = '' missing_isrc from r""")
def audit_songs(spark, sf):
    """Songs without a row of years, candidates marked."""
    r = reviewed(spark, sf)
    k = F.col("winner_track_id")
    years = r.where(k % 6 != 0).select("song_id", "winner_track_id", F.col("year_candidate").alias("year_final"), "precision")
    marks = r.where(k % 5 == 0).select("song_id", F.lit("phase1").alias("selection_phase"))
    return review.audit(r.drop("precision"), years, marks)


@query(f"""with {REVIEWED}, o as (select p_partkey, string_agg(coalesce(case when n_nationkey % 3 > 0 then n_name end, cast(n_nationkey as varchar)), ', ' order by n_nationkey) owners from part join nation on n_nationkey in (p_partkey % 25, (p_partkey + 1) % 25) group by 1),
  m as (select *, 1990 + try_cast(substr(isrc, 2) as int) % 30 as mb from r left join o using (p_partkey)), med as (select artist, count(*) n, median(year_candidate) md from r group by 1),
  f as (select m.*, case when isrc like 'X%' and try_cast(substr(isrc, 2) as int) % 7 > 0 then mb end mbk, n >= 3 and year_candidate - md >= 6 late, regexp_matches(lower(p_type), '{text.REISSUE}') reissued from (select m.*, p_type from m join part using (p_partkey)) m join med using (artist)),
  g as (select *, case when mbk is null then '' when mbk = year_candidate then 'same' else 'diff' end mb_match from f), h as (select *, concat_ws(';', case when reissued then 'reissue_album' end, case when late then 'late_vs_artist' end, case when mb_match = 'diff' then 'lookup_mismatch' end) reason from g)
  select song_id, p_partkey winner_track_id, concat('https://tracks.example/', p_partkey) track_url, case when p_partkey % 11 = 0 then concat('T', p_partkey) end title_override, case when p_partkey % 13 = 0 then concat('A', p_partkey) when len(guests) = 2 then concat(artist, ' feat. ', guests[1]) else artist end artists_display,
  case when len(guests) = 2 then guests[1] end secondary_artist_names, p_type album_name, owners, cast(year_candidate as int) year_candidate, cast(year_candidate as int) year_final, cast(mbk as int) mb_first_release_year, mb_match, reason <> '' year_suspect, reason suspect_reason, case when p_partkey % 2 = 0 then 'seen' end note from h""")
def review_template(spark, sf):
    """Look-ups of owners, names, albums, codes and found years."""
    r = reviewed(spark, sf)
    k = F.col("winner_track_id")
    rows = r.select(
        "song_id", "winner_track_id", "primary_artist_name", "secondary_artist_names", "title_display", F.when(k % 11 == 0, F.concat(F.lit("T"), k.cast("string"))).alias("title_display_override"),
        F.when(k % 13 == 0, F.concat(F.lit("A"), k.cast("string"))).alias("artists_display_override"), "year_candidate", F.col("year_candidate").alias("year_final"), F.when(k % 2 == 0, "seen").alias("note"),
    )
    two = F.array_sort(F.array(k % 25, (k + 1) % 25))
    owners = r.select("song_id", F.transform(two, lambda x: x.cast("string")).alias("owner_ids"))
    nation = table(spark, sf, "nation")
    names = nation.select(F.col("n_nationkey").cast("string").alias("owner_id"), F.when(F.col("n_nationkey") % 3 > 0, F.col("n_name")).alias("owner_name"))
    number = F.substring("isrc", 2, 9).cast("int")
    years = r.where("isrc like 'X%'").select("isrc").distinct().select("isrc", F.when(number % 7 > 0, number % 30 + 1990).alias("found_year"))
    out = review.template(rows, owners, names, r.select(k.alias("track_id"), "album_name"), r.where("isrc like 'X%'").select("song_id", "isrc"), years, "https://tracks.example/")
    # the title without an override is text that SQL cannot form; base_title and title_display cover it
    return out.withColumn("title_override", F.when(k % 11 == 0, F.col("title_display"))).drop("title_display")


@query("""with e as (select event_id, cast(user_id as varchar) song_id, value, event_type, ts from events), s as (select song_id, case when event_id % 3 = 0 then cast(floor(value) as int) + 1900 when event_id % 3 = 1 then null else 1950 end as y, case when event_id % 2 = 0 then 'kept' end t,
  case when event_id % 3 = 2 then case when event_id % 5 = 0 then '[AI] why' else '[AI]' end end n from (select *, row_number() over (partition by song_id order by event_id) rn from e) where rn = 1),
  c as (select song_id, 1950 as y, 'kept' t, cast(null as varchar) n from e where cast(song_id as int) % 2 = 0 group by 1)
  select 'song' entity_type, s.song_id entity_id, 'v2.1' identity_version, s.y year_override, cast(null as varchar) artists_display_override, s.t title_display_override, '2024-01-01' updated_at, 'run1' run_id, s.n note from s left join c using (song_id)
  where s.y is distinct from c.y or s.t is distinct from c.t or s.n is distinct from c.n""")
def review_events(spark, sf):
    """Each user's first event as a sheet's row against a current state of every second."""
    e = table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("song_id")).agg(F.min_by(F.struct("event_id", "value"), "event_id").alias("e")).select("song_id", "e.*")
    k = F.col("event_id")
    sheet = e.select(
        "song_id", F.when(k % 3 == 0, F.concat(F.lit(" "), (F.floor("value") + 1900).cast("string"))).when(k % 3 == 1, "x").otherwise("").alias("year_override"), F.when(k % 3 == 2, "1950").alias("ai_year"),
        F.lit(" ").alias("artists_display_override"), F.when(k % 2 == 0, " kept ").otherwise("").alias("title_display_override"), F.lit("").alias("note"), F.when(k % 5 == 0, "why").alias("ai_note"),
    )
    none = F.lit(None).cast("string")
    current = e.where("cast(song_id as int) % 2 = 0").select("song_id", F.lit(1950).alias("year_override"), none.alias("artists_display_override"), F.lit("kept").alias("title_display_override"), none.alias("note"))
    return review.events_of(sheet, current, "run1", "2024-01-01")


@query("""with e as (select cast(user_id as varchar) song_id, event_type, event_id, cast(floor(value) as int) y, strftime(ts, '%Y-%m-%d %H:%M:%S') t_at from events), a as (select *, event_id % 10 = 0 bad from e where event_type <> 'view'),
  b as (select *, row_number() over (partition by song_id order by bad desc, case when bad then null else t_at end desc nulls first, event_type desc, event_id desc) rn from a)
  select song_id, y year_override, case when bad then 'unknown' else t_at end updated_at, event_type run_id from b where rn = 1""")
def curation_state(spark, sf):
    """Events of songs in a current table and a history, some with times that cannot be read."""
    at = F.when(F.col("event_id") % 10 == 0, "unknown").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    none = F.lit(None).cast("string")
    kind = F.when(F.col("event_type") == "view", "artist").otherwise("song")
    e = table(spark, sf, "events").select(kind.alias("entity_type"), F.col("user_id").cast("string").alias("entity_id"), F.lit("v2.1").alias("identity_version"), F.floor("value").cast("int").alias("year_override"), none.alias("artists_display_override"), none.alias("title_display_override"), none.alias("note"), at.alias("updated_at"), F.col("event_type").alias("run_id"), F.col("event_id").alias("seq"))
    stale = e.withColumn("identity_version", F.lit("v1"))
    half = F.col("seq") % 2 == 0
    out = review.current_state(e.where(half), e.where(~half).unionByName(stale))
    return out.select("song_id", "year_override", "updated_at", "run_id")


@query(sql("songs", select="""select 'r1' run_id, 2001 current_year, count(*) songs_input, count(year) songs_with_year, count(*) filter (year is null) songs_missing_year, max(year) max_year,
  count(*) filter (year = (select max(year) from songs) and (select max(year) from songs) = 2001) excluded_by_max_year_rule, (select count(distinct year) from songs where popularity > 20) distinct_years_in_candidates, (select count(*) from songs where popularity > 20) candidates_final,
  (select concat('[', string_agg(concat('{"', y, '":', n, '}'), ',' order by n desc, y), ']') from (select cast(year as varchar) y, count(*) n from songs where popularity > 20 and year is not null group by 1 order by n desc, y limit 5)) top_year_counts,
  (select concat('[', string_agg(concat('{"', y, '":', n, '}'), ',' order by n desc, y), ']') from (select y, count(*) n from (select unnest(owner_ids) y from songs where popularity > 20) group by 1 order by n desc, y limit 5)) top_owner_counts,
  (select concat('[', string_agg(concat('{"', y, '":', n, '}'), ',' order by n desc, y), ']') from (select case when popularity % 9 = 0 then '__missing_artist__' else artist end y, count(*) n from songs where popularity > 20 group by 1 order by n desc, y limit 5)) top_artist_counts from songs"""))
def candidate_quality(spark, sf):
    """A17, with the popular songs for candidates."""
    s = songs(spark, sf)
    flagged = selection.max_year_flag(s.select(F.col("year").alias("year_final")), "year_final", 2001).withColumnRenamed("exclude_max_year", "excluded_by_max_year_rule")
    chosen = s.where("popularity > 20").select(F.col("year").alias("year_final"), "owner_ids", F.when(F.col("popularity") % 9 == 0, " ").otherwise(F.col("artist")).alias("primary_artist_name"))
    return review.candidate_quality(flagged, chosen, "r1", 2001)


@query("""select doc_id, min(y) as earliest from (select doc_id, cast(nullif(regexp_extract(trim(d), '^([0-9]{4})', 1), '') as int) y from (select doc_id, unnest([concat(1950 + doc_id % 60, '-05'), concat(' ', 1990 - doc_id % 40), 'n/a', cast(n_chars as varchar)]) d from documents)) group by 1""")
def earliest_release(spark, sf):
    """The smallest year among nested recordings."""
    k = F.col("doc_id")
    dates_of = F.array(F.concat((k % 60 + 1950).cast("string"), F.lit("-05")), F.concat(F.lit(" "), (F.lit(1990) - k % 40).cast("string")), F.lit("n/a"), F.col("n_chars").cast("string"), F.lit(None).cast("string"))
    d = table(spark, sf, "documents").select("doc_id", F.transform(dates_of, lambda x: F.struct(x.alias("first_release_date"))).alias("recordings"))
    return d.select("doc_id", review.earliest_year(F.col("recordings")).alias("earliest"))


@query("""select user_id, v as event_type from (select cast(user_id as varchar) user_id, event_type v, row_number() over (partition by user_id order by ts, event_id) rn from events where event_id % 4 <> 0) where rn = 1""")
def first_known(spark, sf):
    """The first value of each user that is not blank."""
    e = table(spark, sf, "events").select("user_id", F.when(F.col("event_id") % 4 == 0, "  ").otherwise(F.col("event_type")).alias("event_type"), "ts", "event_id")
    return review.first_values(e, "user_id", "event_type", ["ts", "event_id"])


@query("""select p_partkey, case p_size % 3 when 0 then concat('["', p_name, '","', p_type, '","', p_name, '"]') when 1 then null else concat('["', p_brand, '"]') end dedupe_key from part""")
def dedupe_keys(spark, sf):
    """F26."""
    n = F.col("p_size") % 3
    listed = F.when(n == 0, F.array("p_name", F.lit(" "), "p_type", "p_name")).when(n == 1, F.array(F.lit(""), F.lit(None).cast("string"))).otherwise(F.array(F.concat(F.lit(" "), "p_brand")))
    return table(spark, sf, "part").select("p_partkey", review.dedupe_key(listed).alias("dedupe_key"))


@query(sql("songs", select="""select track_id, case when n_variants > 1 then null when popularity % 2 = 0 then 'remix_title' when popularity % 3 = 0 then 'song_key_unique_isrc' else 'song_key_unique_fallback' end no_merge_reason from ranked"""))
def no_merge_reasons(spark, sf):
    """A10."""
    t = tracks(spark, sf)
    p = F.col("popularity")
    n = t.groupBy("song_id").agg(F.count(F.lit(1)).alias("n"))
    kind = F.when(p % 3 == 0, "isrc_first").otherwise("fallback")
    return t.join(n, "song_id").select("track_id", identity.no_merge_reason(F.col("n"), p % 2 == 0, kind).alias("no_merge_reason"))


# ---------------------------------------------------------------- pool and deck


@query("select o_orderkey, cast(year(o_orderdate) as int) as year, year(o_orderdate) = (select max(year(o_orderdate)) from orders) and (select max(year(o_orderdate)) from orders) = 2001 exclude_max_year from orders")
def max_year_rule(spark, sf):
    return selection.max_year_flag(table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year")), "year", 2001)


ACTIVE = ["AUTOMOBILE", "BUILDING", "MACHINERY"]


def pool_rows(spark, sf) -> DataFrame:
    s = songs(spark, sf).withColumn("guardrail", keys.guardrail_key(F.col("artist"), F.col("track_name"), F.array().cast("array<string>")))
    years = s.select("song_id", F.col("year").alias("year_final"))
    return selection.pool(s.drop("year"), years, ACTIVE, 2001)


@query(sql("songs", select="""select song_id, winner_track_id, year year_final, array_to_string(list_filter(owner_ids, lambda o: o in ('AUTOMOBILE', 'BUILDING', 'MACHINERY')), '|') owner_ids, concat('["', artist, '","', track_name, '",[]]') guardrail from songs
  where year is not null and not (year = (select max(year) from songs) and (select max(year) from songs) = 2001) and len(list_filter(owner_ids, lambda o: o in ('AUTOMOBILE', 'BUILDING', 'MACHINERY'))) > 0"""))
def pool(spark, sf):
    return pool_rows(spark, sf).select("song_id", "winner_track_id", "year_final", joined("owner_ids"), "guardrail")


@query(sql("songs", select="select song_id, round(owners_count - 0.35::double * (popularity % 4) - 0.2::double * (popularity % 5) - 0.05::double * (popularity % 7) + 0.2::double * (popularity % 2) - 0.1::double * (popularity % 3), 6) score from songs"))
def candidate_score(spark, sf):
    p = F.col("popularity")
    return songs(spark, sf).select("song_id", F.round(selection.score(F.col("owners_count"), p % 4, p % 5, p % 7, p % 2, p % 3), 6).alias("score"))


@query(sql("songs", select=f"""select song_id, winner_track_id, year year_final, case when popularity % 3 <> 0 then artist end artist, case when popularity % 3 <> 0 then track_name end track_name from songs
  where year is not null and not (year = (select max(year) from songs) and (select max(year) from songs) = 2001) and len(list_filter(owner_ids, lambda o: o in ('AUTOMOBILE', 'BUILDING', 'MACHINERY'))) > 0"""))
def candidates_shown(spark, sf):
    """Candidates with what curated songs show; a third of them has no curated row for the same winner."""
    shown = songs(spark, sf).withColumn("winner_track_id", F.when(F.col("popularity") % 3 != 0, F.col("winner_track_id")).otherwise(-F.col("winner_track_id") - 1))
    return review.with_curation(pool_rows(spark, sf).select("song_id", "winner_track_id", "year_final"), shown, ["artist", "track_name"])


@query()
def greedy_candidates(spark, sf):
    s = pool_rows(spark, sf).withColumnRenamed("artist", "primary_artist_name")
    return selection.greedy_candidates(s, 400)


def deck_parts(spark, sf) -> tuple[DataFrame, DataFrame, dict]:
    rows = pool_rows(spark, sf).withColumnsRenamed({"artist": "artist_key", "album": "album_id"})
    # the deck that is built on: the first, whose players are the owners
    first = registry(spark, sf).where(F.col("expansion_anchor").isin([f"{o}0" for o in ACTIVE]) & (F.col("printed_status") == "printed"))
    locked = first.select("song_id", F.regexp_replace("expansion_anchor", "0$", "").alias("expansion_anchor"), "year")
    return rows, locked, {o: 60 for o in ACTIVE}


@query()
def greedy_deck(spark, sf):
    rows, locked, targets = deck_parts(spark, sf)
    return selection.greedy_deck(rows, locked, targets, artist_cap=6, album_cap=20)


# ---------------------------------------------------------------- registry


@query(sql("registry", select="select r.song_id, r.card_id from registry r left join (select distinct case when track_id % 10 = 0 or (track_id - track_id % 3) % 30 = 0 then concat('x', song_id) else song_id end song_id from tracks) c using (song_id) where c.song_id is null"))
def registry_drift(spark, sf):
    """Of ten songs one has another identity in all its tracks; of the rest, some have it in one track and stay."""
    n = F.col("track_id")
    changed = (n % 10 == 0) | ((n - n % 3) % 30 == 0)
    kept = tracks(spark, sf).select(F.when(changed, F.concat(F.lit("x"), "song_id")).otherwise(F.col("song_id")).alias("song_id"))
    return reg.drift(registry(spark, sf), kept).select("song_id", "card_id")


@query(sql("registry", select=""", bad as (select *, case when number = 3 then 'lost' else printed_status end st, case when number = 5 then concat('x', card_id) when number = 7 then replace(card_id, '_007', '_008') else card_id end ci, case when number = 9 then 'NOBODY' else owners end ow,
    case when number = 11 then 'NOBODY' else expansion_anchor end ea, case when number in (13, 14) then concat('twice', expansion_anchor) else song_id end si from registry)
  select 'bad_status' as rule, count(*) filter (st not in ('printed', 'pending')) n_rows from bad union all select 'bad_card_id', count(*) filter (not regexp_full_match(ci, '[A-Z]+_[A-Z0-9]+_[0-9]{3}')) from bad
  union all select 'anchor_mismatch', count(*) filter (regexp_full_match(ci, '[A-Z]+_[A-Z0-9]+_[0-9]{3}') and split_part(ci, '_', 2) <> ea) from bad union all select 'anchor_not_owner', count(*) filter (not list_contains(string_split(ow, '|'), ea)) from bad
  union all select 'duplicate_song_id', cast(coalesce(sum(n), 0) as bigint) from (select si, count(*) n from bad group by 1 having count(*) > 1) union all select 'duplicate_card_id', cast(coalesce(sum(n), 0) as bigint) from (select ci, count(*) n from bad group by 1 having count(*) > 1)"""))
def registry_invariants(spark, sf):
    n = F.col("number")
    bad = registry(spark, sf).withColumns({
        "printed_status": F.when(n == 3, "lost").otherwise(F.col("printed_status")),
        "card_id": F.when(n == 5, F.concat(F.lit("x"), "card_id")).when(n == 7, F.replace(F.col("card_id"), F.lit("_007"), F.lit("_008"))).otherwise(F.col("card_id")),
        "owners": F.when(n == 9, "NOBODY").otherwise(F.col("owners")),
        "song_id": F.when(n.isin(13, 14), F.concat(F.lit("twice"), "expansion_anchor")).otherwise(F.col("song_id")),
        "expansion_anchor": F.when(n == 11, "NOBODY").otherwise(F.col("expansion_anchor")),
    })
    return reg.violations(bad)


@query(sql("registry", select="select expansion_anchor, cast(max(number) + 1 as int) next_number from registry group by 1"))
def next_card_number(spark, sf):
    return reg.next_numbers(registry(spark, sf))


@query(sql("registry", select="select card_id, case when printed_status = 'pending' and version = 'v2' then 'printed' else printed_status end printed_status, case when printed_status = 'pending' and version = 'v2' then '2024-01-01T00:00:00' end printed_at from registry"))
def mark_printed(spark, sf):
    return reg.mark_printed(registry(spark, sf), "v2", "2024-01-01T00:00:00").select("card_id", "printed_status", "printed_at")


@query(sql("registry", select="select card_id, song_id from registry where printed_status <> 'pending'"))
def delete_pending(spark, sf):
    return reg.delete_pending(registry(spark, sf)).select("card_id", "song_id")


@query(sql("registry", select="select card_id, 'song_id' clash from (select *, case when number % 3 = 0 then concat('x', card_id) else card_id end ci from registry) where number % 2 = 0 and ci = card_id union all select concat('x', card_id), 'song_id' from registry where number % 2 = 0 and number % 3 = 0 union all select card_id, 'card_id' from registry where number % 3 <> 0"))
def append_check(spark, sf):
    """Rows of which some repeat a song, some a card."""
    r = registry(spark, sf)
    n = F.col("number")
    new = r.withColumns({"song_id": F.when(n % 2 == 1, F.concat(F.lit("x"), "song_id")).otherwise(F.col("song_id")), "card_id": F.when(n % 3 == 0, F.concat(F.lit("x"), "card_id")).otherwise(F.col("card_id"))})
    return reg.overlap(r, new)


@query(sql("registry", select="select count(*) filter (printed_status = 'pending' and version = 'v2' and number % 5 <> 0) n_printed, count(*) filter (number % 5 = 0) n_deleted from registry"))
def update_counts(spark, sf):
    """What an update and a clean-up have changed."""
    r = registry(spark, sf)
    return reg.change_counts(r, reg.mark_printed(r, "v2", "2024-01-01T00:00:00").where("number % 5 <> 0"))


@query(sql("registry", select="select card_id, song_id from registry where number % 7 = 0 order by 1"))
def altered_rows(spark, sf):
    """Registered rows that a later version no longer has as they were."""
    r = registry(spark, sf).select("card_id", "song_id", "number")
    later = r.withColumn("song_id", F.when(F.col("number") % 7 == 0, F.concat(F.lit("x"), "song_id")).otherwise(F.col("song_id")))
    return reg.altered(r, later).select("card_id", "song_id")


@query(sql("registry", select="select card_id, song_id from registry where not (printed_status = 'pending' and version = 'v1')"))
def delete_pending_version(spark, sf):
    """U08, of one version."""
    return reg.delete_pending(registry(spark, sf), "v1").select("card_id", "song_id")


BLOCK = 64
_LEDGER = """, numbered as (select card_id, song_id, printed_status, row_number() over (order by expansion_anchor, number, card_id) - 1 seq from registry)"""
_DIGEST = "sha256(string_agg(sha256(concat(card_id, chr(31), song_id)), '' order by seq)) digest"


def ledger_rows(spark, sf) -> DataFrame:
    """The registry's cards with their places in it."""
    return positions.dense(registry(spark, sf).select("expansion_anchor", "number", "card_id", "song_id"), ["expansion_anchor", "number"])


@query(sql("registry", select=f"{_LEDGER} select cast(seq // {BLOCK} as bigint) block, count(*) n, {_DIGEST} from numbered group by 1").replace("\n, numbered", ", numbered"))
def ledger_blocks(spark, sf):
    """What proves blocks of the registry unchanged and in order."""
    return ledger.digests(ledger_rows(spark, sf), ["card_id", "song_id"], BLOCK)


@query(sql("registry", select=f"""{_LEDGER}, moved as (select card_id, case when seq % {4 * BLOCK} = 5 then concat('x', song_id) else song_id end song_id, case when seq % {6 * BLOCK} = 1 then seq + 1 when seq % {6 * BLOCK} = 2 then seq - 1 else seq end seq from numbered where seq < (select count(*) from numbered) - {BLOCK} // 2),
  a as (select cast(seq // {BLOCK} as bigint) block, {_DIGEST} from numbered group by 1), b as (select cast(seq // {BLOCK} as bigint) block, {_DIGEST} from moved group by 1)
  select block, case when b.digest is null then 'missing' else 'changed' end why from a left join b using (block) where a.digest is distinct from b.digest""").replace("\n, numbered", ", numbered"))
def ledger_findings(spark, sf):
    """Blocks of a registry in which rows were altered, swapped with their neighbour, or lost at the end."""
    rows = ledger_rows(spark, sf)
    seq, n = F.col("seq"), rows.count()
    moved = rows.where(seq < n - BLOCK // 2).withColumns({
        "song_id": F.when(seq % (4 * BLOCK) == 5, F.concat(F.lit("x"), "song_id")).otherwise(F.col("song_id")),
        "seq": F.when(seq % (6 * BLOCK) == 1, seq + 1).when(seq % (6 * BLOCK) == 2, seq - 1).otherwise(seq),
    })
    blocks = lambda df: ledger.digests(df, ["card_id", "song_id"], BLOCK)
    return ledger.findings(blocks(rows), blocks(moved), ["block"])


@query(sql("registry", select="select 'full_deck' job, card_id, expansion_anchor from registry union all select concat('expansion_', expansion_anchor), card_id, expansion_anchor from registry"))
def print_jobs(spark, sf):
    """The full deck and each expansion."""
    return reg.print_jobs(registry(spark, sf), "both").select("job", "card_id", "expansion_anchor")


@query(sql("registry", select="select card_id, true is_new from registry where number % 4 = 0"))
def print_new_only(spark, sf):
    """The run's own cards."""
    r = registry(spark, sf)
    return reg.printable(r, r.where("number % 4 = 0"), "new-only").select("card_id", "is_new")


@query(sql("registry", select="select expansion_anchor, printed_status, count(*) cards from registry group by grouping sets ((expansion_anchor, printed_status), (expansion_anchor), (printed_status), ())"))
def registry_show(spark, sf):
    """A23, O05."""
    return reg.show(registry(spark, sf))


@query(sql("registry", select="select card_id, number % 4 = 0 is_new from registry"))
def print_scope(spark, sf):
    """All cards, those of the run marked."""
    r = registry(spark, sf)
    return reg.printable(r, r.where("number % 4 = 0"), "all").select("card_id", "is_new")


@query(sql("registry", select="""select cast(number as int) selection_rank, card_id, expansion_anchor, false is_new, song_id, winner_track_id, concat('https://tracks.example/', winner_track_id) track_url, printf('g%02d', (number - 1) % 12 + 1) front_bg_id,
  title title_display, artists artists_display_resolved, year year_final, owners, concat('(', array_to_string(owner_ids, ', '), ')') owners_display from registry"""))
def reprint_cards(spark, sf):
    """O07."""
    return reg.reprint(registry(spark, sf))


@query(sql("registry", select="""select card_id, expansion_anchor, title, concat('DECK_', expansion_anchor, '_', lpad(cast(row_number() over (partition by expansion_anchor order by song_id) + top as varchar), 3, '0')) new_card_id,
  printf('g%02d', (row_number() over (partition by expansion_anchor order by song_id) + top - 1) % 12 + 1) bg, concat('(', array_to_string(owner_ids, ', '), ')') owners_display, concat('https://tracks.example/', winner_track_id) track_url
  from registry left join (select expansion_anchor, max(number) top from registry where number % 2 = 1 group by 1) using (expansion_anchor) where number % 2 = 0"""))
def cards_packaged(spark, sf):
    """Every second card as new, numbered on from the others."""
    r = registry(spark, sf)
    cards = reg.numbered(r.where("number % 2 = 0").drop("number"), r.where("number % 2 = 1"), ["song_id"])
    return cards.select(
        "card_id",
        "expansion_anchor",
        "title",
        text.card_id(PREFIX, F.col("expansion_anchor"), F.col("number")).alias("new_card_id"),
        F.format_string("g%02d", ((F.col("number") - 1) % 12 + 1).cast("int")).alias("bg"),
        text.owners_footer(F.col("owner_ids")).alias("owners_display"),
        F.concat(F.lit(reg.TRACK_URL), F.col("winner_track_id").cast("string")).alias("track_url"),
    )


# ---------------------------------------------------------------- report


@query(sql("registry", select="""select expansion_anchor, card_id, (number - 1) // 12 sheet, (number - 1) % 12 front_slot, (number - 1) % 12 back_match, ((number - 1) % 12) // 3 * 3 + 2 - (number - 1) % 3 back_flip_long, (3 - ((number - 1) % 12) // 3) * 3 + (number - 1) % 3 back_flip_short from registry"""))
def sheet_plan(spark, sf):
    return rep.sheet_plan(registry(spark, sf), ["number"])


@query(sql("registry", select=""", j as (select 'full_deck' job, expansion_anchor, card_id, number from registry union all select concat('expansion_', expansion_anchor), expansion_anchor, card_id, number from registry),
  p as (select *, row_number() over (partition by job order by expansion_anchor, number) - 1 place from j) select job, expansion_anchor, card_id, place // 12 sheet, place % 12 front_slot, place % 12 back_match, (place % 12) // 3 * 3 + 2 - place % 3 back_flip_long, (3 - (place % 12) // 3) * 3 + place % 3 back_flip_short from p""").replace("\n, j as", ", j as"))
def job_plan(spark, sf):
    """Sheets of the full deck and of each expansion."""
    jobs = reg.print_jobs(registry(spark, sf).withColumn("selection_rank", F.col("number")), "both")
    return rep.job_plan(jobs, reg.print_order(jobs))


@query(sql("registry", select="select count(*) cards, count(distinct year) as years, min(year) min_year, max(year) max_year, count(*) filter (printed_status = 'printed') printed, count(*) filter (printed_status = 'pending') pending, count(*) filter (number % 4 = 0) as new from registry"))
def kpis(spark, sf):
    r = registry(spark, sf)
    return rep.kpis(reg.is_new(r, r.where("number % 4 = 0")))


@query("""with d as (select cast(year(o_orderdate) as int) as year from orders), b as (select year // 5 * 5 low, count(*) cards from d group by 1) select cast(low as int) low, concat(low, '–', lpad(cast((low + 4) % 100 as varchar), 2, '0')) label, cards from b""")
def year_histogram(spark, sf):
    return rep.year_histogram(table(spark, sf, "orders").select(F.year("o_orderdate").alias("year")), 5)


@query(sql("registry", select="select owner_id, count(*) cards from (select unnest(owner_ids) owner_id from registry) group by 1"))
def owner_appearances(spark, sf):
    return rep.owner_appearances(registry(spark, sf))


@query(sql("items", select="select owners, count(*) cards from (select track_id, array_to_string(list_sort(list(distinct owner_id)), '+') owners from items group by 1) group by 1"))
def owner_combos(spark, sf):
    return rep.owner_combinations(catalog.owners_per_track(items(spark, sf)))


@query(sql("items", select="with c as (select owners, count(*) cards from (select l_suppkey, l_quantity, array_to_string(list_sort(list(distinct owner_id)), '+') owners from items group by 1, 2) group by 1) select owners, cards, greatest((select count(*) from c) - 20, 0) not_shown from c order by cards desc, owners limit 20").replace("from items join", "from items join").replace("\nwith c as", ", c as"))
def owner_combos_shown(spark, sf):
    """The twenty most frequent sets of owners, and how many sets are not shown."""
    rows = items(spark, sf).groupBy("l_suppkey", "l_quantity").agg(F.collect_set("owner_id").alias("owner_ids"))
    return rep.owner_combinations(rows, 20)


@query(sql("registry", select="select artists artist, count(*) cards from registry group by 1 order by cards desc, artist limit 10"))
def top_artists(spark, sf):
    shown = registry(spark, sf).withColumn("display", text.artists_display(F.col("artists"), F.array("album")))
    return rep.top_artists(shown, text.primary_artist(F.col("display")))


@query(sql("registry", select="select a expansion_anchor, coalesce(n, 0) cards from (select expansion_anchor a from registry union select concat(c_mktsegment, 'X') from customer) left join (select expansion_anchor a, count(*) n from registry group by 1) using (a)"))
def expansion_counts(spark, sf):
    known = table(spark, sf, "customer").select(F.concat("c_mktsegment", F.lit("X")).alias("expansion_anchor")).distinct()
    return rep.expansion_counts(registry(spark, sf), known)


@query("""select n_name owner_id, case when n_nationkey % 3 = 0 then '#000000' else (['#00E5FF', '#FF3D71', '#FFD166', '#7CFC00', '#B388FF', '#FF8C42', '#4DD599', '#FF6FD8'])[(row_number() over (order by n_name) - 1) % 8 + 1] end colour from nation""")
def palette(spark, sf):
    return rep.owner_colours(table(spark, sf, "nation").select(F.col("n_name").alias("owner_id"), F.when(F.col("n_nationkey") % 3 == 0, "#000000").alias("colour")))


@query(sql("registry", select="select card_id, title, year, row_number() over (order by year, card_id) place from registry where (contains(lower(title), 'ri') or contains(lower(artists), 'ri')) and year >= 1995 and year <= 1996 order by place limit 20"))
def report_filter_sort(spark, sf):
    hit = registry(spark, sf).where(rep.matches("RI", ["title", "artists"], 1995, 1996))
    from pyspark.sql.window import Window

    top = hit.orderBy(*rep.sort_order("year", "card_id")).limit(20)
    return top.select("card_id", "title", "year", F.row_number().over(Window.orderBy("year", "card_id")).cast("long").alias("place"))


@query(sql("registry", select="""select expansion_anchor, to_json(list({'card_id': card_id, 'title': title, 'year': year} order by card_id)) cards_json from registry group by 1"""))
def report_payload(spark, sf):
    return rep.payload(registry(spark, sf), ["card_id", "title", "year"])


@query(sql("registry", select="""select 'meta' part, '' as key, '{"version":"v1"}' json union all select 'expansion', expansion_anchor, concat('{"cards":', count(*), ',"printed":', count(*) filter (printed_status = 'printed'), ',"min_year":', min(year), ',"max_year":', max(year), '}') from registry group by 2
  union all select 'owner', o, concat('{"cards":', count(*), '}') from (select unnest(owner_ids) o from registry) group by 2 union all select 'cards', expansion_anchor, to_json(list({'card_id': card_id, 'year': year} order by card_id)) from registry group by 2"""))
def report_document(spark, sf):
    """X09."""
    return rep.document(registry(spark, sf), ["card_id", "year"], {"version": "v1"})


# ---------------------------------------------------------------- text


TRACK22 = "lpad(cast(page_id as varchar), 22, 'A')"
SCANNED = f"""case page_id % 6 when 0 then concat('spotify:track:', {TRACK22}) when 1 then concat(' ', {TRACK22}, ' ') when 2 then concat('https://open.spotify.com/intl-es/track/', {TRACK22}, '?si=1') when 3 then concat('https://open.spotify.com/track/', {TRACK22}) when 4 then url else concat('https://other.example/track/', {TRACK22}) end"""


@query(f"""with s as (select page_id, {TRACK22} as track_id, trim({SCANNED}) t from pages) select page_id, track_id,
  nullif(coalesce(nullif(regexp_extract(t, '^spotify:track:([A-Za-z0-9]{{22}})$', 1), ''), nullif(regexp_extract(t, '^([A-Za-z0-9]{{22}})$', 1), ''), regexp_extract(t, '^https?://open[.]spotify[.]com/(?:[A-Za-z-]+/)?track/([A-Za-z0-9]{{22}})/?(?:[?#].*)?$', 1)), '') resolved from s""")
def resolve_payload(spark, sf):
    """what a scanned code says."""
    ident = F.lpad(F.col("page_id").cast("string"), 22, "A")
    k = F.col("page_id") % 6
    c = lambda *x: F.concat(*[y if not isinstance(y, str) else F.lit(y) for y in x])
    scanned = F.when(k == 0, c("spotify:track:", ident)).when(k == 1, c(" ", ident, " ")).when(k == 2, c("https://open.spotify.com/intl-es/track/", ident, "?si=1")).when(k == 3, c("https://open.spotify.com/track/", ident)).when(k == 4, F.col("url")).otherwise(c("https://other.example/track/", ident))
    return table(spark, sf, "pages").select("page_id", ident.alias("track_id"), text.track_id_of(scanned, "open.spotify.com").alias("resolved"))


@query("""select p_partkey, concat(p_brand, ' feat. ', p_name, ' | ', p_type) display, concat_ws(',', p_brand, p_name, p_type) names, p_brand as primary_artist, case when p_size % 2 = 0 then p_name else p_brand end resolved, case when p_size % 2 = 0 then 'override' else 'raw' end source from part""")
def artist_display(spark, sf):
    p = table(spark, sf, "part").withColumn("ov", F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("  "))
    shown = text.artists_display(F.col("p_brand"), F.array(F.col("p_name"), F.lit(" "), F.col("p_type"), F.col("p_name")))
    messy = F.concat(F.col("p_brand"), F.lit("  Ft. "), F.col("p_name"), F.lit(" ,  "), F.col("p_type"))
    value, source = curation.resolve_artists(("ov", "override"), ("p_brand", "raw"))
    return p.select("p_partkey", shown.alias("display"), F.array_join(text.split_artists(messy), ",").alias("names"), text.primary_artist(shown).alias("primary_artist"), value.alias("resolved"), source.alias("source"))


@query("""select p_partkey, concat_ws('|', p_name, p_type) listed, case when p_name < p_type then concat_ws('|', p_name, p_type) else concat_ws('|', p_type, p_name) end signature, 2::bigint as n from part""")
def list_normalize(spark, sf):
    raw = F.array(F.concat(F.lit(" "), "p_name"), F.lit(None).cast("string"), F.lit(" "), F.col("p_type"), F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(keys.norm_list(raw), "|").alias("listed"), F.array_join(keys.feature_signature(raw), "|").alias("signature"), F.size(keys.norm_list(raw)).cast("long").alias("n"))


def titles(spark, sf) -> DataFrame:
    """Distinct messy titles: every line of the documents."""
    return table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("title")).distinct()


@query()
def title_display(spark, sf):
    return titles(spark, sf).select("title", text.udfs()["title_display"]("title").alias("shown"))


@query()
def base_title(spark, sf):
    end = F.element_at(F.array(*[F.lit(e) for e in (" (Live)", " - Remastered 2009", " [Radio Edit]", ": Acoustic", " (Club Remix)", "")]), (F.pmod(F.xxhash64("title"), F.lit(6)) + 1).cast("int"))
    t = titles(spark, sf).select(F.concat("title", end).alias("title"))
    return t.withColumn("p", text.udfs()["title_parts"]("title")).select("title", "p.base", "p.had_suffix", "p.remix", F.array_join("p.protected", "|").alias("protected"))


# ---------------------------------------------------------------- device operators


HOUR_MS = 3_600_000


def millis(df: DataFrame) -> DataFrame:
    return df.withColumn("ms", F.expr("unix_millis(cast(ts as timestamp))"))


@query()
def scan_debounce(spark, sf):
    """R01, at the scale of hours."""
    e = millis(table(spark, sf, "events")).withColumn("code", F.when(F.col("value") < 20, "a").otherwise("b"))
    return scans.debounce(e, "user_id", "code", "ms", ["event_id"], hold=HOUR_MS, stale=12 * HOUR_MS, cooldown=3 * HOUR_MS)


@query("""with e as (select user_id, event_id, epoch_us(ts) // 1000 ms, event_type in ('view', 'click') playing from events), s as (select *, case when playing then coalesce(lead(ms) over w - ms, 0) else 0 end span from e window w as (partition by user_id order by ms, event_id)),
  r as (select *, coalesce(sum(span) over (partition by user_id order by ms, event_id rows between unbounded preceding and 1 preceding), 0) b from s)
  select user_id, cast(least(sum(span), 86400000) as bigint) played, cast(min(case when b < 86400000 and b + span >= 86400000 then ms + 86400000 - b end) as bigint) time_up from r group by 1""")
def listening_budget(spark, sf):
    e = millis(table(spark, sf, "events")).withColumn("playing", F.col("event_type").isin("view", "click"))
    return scans.listening(e, "user_id", "ms", "playing", ["event_id"], budget=24 * HOUR_MS)


@query("select user_id, event_type, max(value) as value from events where value >= 5 group by 1, 2")
def largest_code(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", F.col("event_id").cast("string").alias("code"), "value")
    return scans.largest_per_frame(e, ["user_id", "event_type"], "code", "value", 5.0).select("user_id", "event_type", "value")


_CALLS = {"view": "GET devices", "click": "PUT play", "purchase": "PUT seek"}


@query("""with a as (select event_id, value, case event_type when 'view' then 'GET devices' when 'click' then 'PUT play' when 'purchase' then 'PUT seek' else 'GET player' end call,
    case event_id % 7 when 0 then 401 when 1 then 403 when 2 then 404 when 3 then 204 when 4 then 500 when 5 then 404 end status, case event_id % 5 when 0 then 'reason: premium_required' when 1 then '{"no active DEVICE"}' else '' end body, event_id % 2 = 0 signed from events)
  select event_id, case when status is null then 'network' when status = 401 and signed then 'api_error' when status = 401 then 'login_required'
    when (call, status) in (('GET devices', 404), ('GET player', 204), ('PUT seek', 404), ('PUT play', 403), ('PUT play', 404)) or (status = 404 and event_id % 5 = 1) then 'no_device' when event_id % 5 = 0 then 'premium_required' else 'api_error' end as state,
    cast(case when floor(value * 1000) > 19000 then 19000 else greatest(floor(value * 1000), 0) end as bigint) seek_ms from a""")
def playback_rules(spark, sf):
    """States by the answers of calls, seek positions within a track of twenty seconds."""
    e, i = table(spark, sf, "events"), F.col("event_id")
    call = F.lit("GET player")
    for kind, name in _CALLS.items():
        call = F.when(F.col("event_type") == kind, name).otherwise(call)
    status = F.when(i % 7 == 0, 401).when(i % 7 == 1, 403).when(i % 7 == 2, 404).when(i % 7 == 3, 204).when(i % 7 == 4, 500).when(i % 7 == 5, 404)
    body = F.when(i % 5 == 0, "reason: premium_required").when(i % 5 == 1, '{"no active DEVICE"}').otherwise("")
    return e.select("event_id", playback.error_state(call, status, body, i % 2 == 0).alias("state"), playback.seek_position(F.floor(F.col("value") * 1000), F.lit(20_000)).alias("seek_ms"))


@query("""with s as (select p_partkey, p_size * 20.0::double vw, 800.0::double vh, 640.0::double iw, 480.0::double ih from part), g as (select *, greatest(vw / iw, vh / ih) sc, vw * 0.78::double * 0.47::double half from s)
  select p_partkey, round(greatest(0, least(1, 0.5::double - half / sc / iw)), 6) as left_side, round(greatest(0, least(1, 0.5::double + half / sc / ih)), 6) as bottom_side from g""")
def viewfinder_region(spark, sf):
    """S30."""
    p = table(spark, sf, "part").select("p_partkey", scans.viewfinder_region(F.col("p_size") * 20.0, F.lit(800.0), F.lit(640.0), F.lit(480.0)).alias("r"))
    return p.select("p_partkey", F.round("r.left", 6).alias("left_side"), F.round("r.bottom", 6).alias("bottom_side"))


@query("select user_id, coalesce(min(event_id) filter (event_type = 'purchase'), min(event_id)) device from events group by 1")
def device_choice(spark, sf):
    """The first active device, else the first."""
    e = table(spark, sf, "events").withColumnRenamed("event_id", "device")
    return playback.choose_device(e, "user_id", "device", F.col("event_type") == "purchase", [])


@query("""with d as (select user_id, event_type, max(event_id) top from events where value >= 12 group by 1, 2) select e.event_id, d.top is not null known, d.top card_id from events e left join d on e.user_id = d.user_id and e.event_type = d.event_type""")
def scan_lookup(spark, sf):
    """Scans with the last card of their track, or none."""
    e = table(spark, sf, "events").withColumn("track_id", F.concat_ws("-", F.col("user_id").cast("string"), "event_type"))
    deck = e.where("value >= 12").select("track_id", F.col("event_id").alias("card_id"))
    return scans.lookup(e.select("event_id", "track_id"), deck).select("event_id", "known", "card_id")


@query("""select user_id, slot, event_id from (select user_id, epoch_us(ts) // 1000 // 86400000 slot, event_id, row_number() over (partition by user_id, epoch_us(ts) // 1000 // 86400000 order by ts desc, event_id desc) rn from events) where rn = 1""")
def latest_frames(spark, sf):
    """R06, at the scale of days."""
    e = millis(table(spark, sf, "events")).select("user_id", "event_id", "ms")
    return scans.keep_latest(e, "user_id", "ms", ["event_id"], 24 * HOUR_MS).select("user_id", F.floor(F.col("ms") / (24 * HOUR_MS)).alias("slot"), "event_id")


def _link_sql(watchdog: int, grace: int, select: str) -> str:
    """The connection's rules, one event of each user a step: st, tr, tries, since and bl after it, and whether it had hung before."""
    what = "case event_type when 'view' then concat('connect:', cast(cast(floor(value) as bigint) % 3 as varchar)) when 'click' then 'connected' when 'purchase' then 'failed' else 'stop' end"
    hung = f"st = 'CONNECTING' and t - since >= {watchdog}"
    return f"""with recursive e as (select user_id, epoch_us(ts) // 1000 t, {what} ev, event_id from events),
  n as (select *, row_number() over (partition by user_id order by t, {{order}}) i from e),
  s as (select user_id, 0::bigint i, 0::bigint t, '' ev, 'IDLE' st, '' tr, 0 tries, 0::bigint since, false bl, null::bigint hung_at from (select distinct user_id from e)
    union all select user_id, i, t, ev, case when ev like 'connect:%' then case when bl2 or st1 = 'CONNECTING' then st1 when tries2 >= {scans.ATTEMPTS} then 'FAILED' else 'CONNECTING' end when ev = 'connected' then 'CONNECTED' when ev = 'failed' then 'FAILED'
        when not (st1 = 'CONNECTING' and t - since < {grace}) and st1 not in ('HUNG', 'FAILED') then 'IDLE' else st1 end,
      tr2, case when starts then tries2 + 1 else tries2 end, case when starts then t else since end, case when ev like 'connect:%' and not bl2 and st1 <> 'CONNECTING' and tries2 >= {scans.ATTEMPTS} then true else bl2 end, hung_at
    from (select *, ev like 'connect:%' and not bl2 and st1 <> 'CONNECTING' and tries2 < {scans.ATTEMPTS} starts from (select *, case when fresh then 0 else tries end tries2, case when fresh then false else bl1 end bl2, case when ev like 'connect:%' then split_part(ev, ':', 2) else tr end tr2 from
      (select s.user_id, n.i, n.t, n.ev, s.tr, s.tries, s.since, case when {hung.replace("t -", "n.t -")} then 'HUNG' else st end st1, bl or ({hung.replace("t -", "n.t -")} and tries >= {scans.ATTEMPTS}) bl1, case when {hung.replace("t -", "n.t -")} then since + {watchdog} end hung_at,
        n.ev like 'connect:%' and split_part(n.ev, ':', 2) <> s.tr fresh from s join n on n.user_id = s.user_id and n.i = s.i + 1)))) {select}"""


def connection_events(spark, sf) -> DataFrame:
    t = F.col("event_type")
    event = F.when(t == "view", F.concat(F.lit("connect:"), (F.floor("value") % 3).cast("string"))).when(t == "click", "connected").when(t == "purchase", "failed").otherwise("stop")
    return millis(table(spark, sf, "events")).withColumn("what", event)


@query(_link_sql(2 * HOUR_MS, 5 * HOUR_MS, "select user_id, ev what, t ms, st state from s where i > 0").format(order="event_id"))
def connection_states(spark, sf):
    """R03, at the scale of hours: the state after each event."""
    return scans.connections(connection_events(spark, sf), "user_id", "what", "ms", ["event_id"], watchdog=2 * HOUR_MS, grace=5 * HOUR_MS)


@query(_link_sql(2 * HOUR_MS, scans.GRACE_MS, f"""select cast(user_id as varchar) k, t, ev as event, st state from s where i > 0 union all select cast(user_id as varchar), hung_at, 'timer', 'HUNG' from s where hung_at is not null
  union all select cast(user_id as varchar), since + {2 * HOUR_MS}, 'timer', 'HUNG' from (select *, row_number() over (partition by user_id order by i desc) r from s) where r = 1 and st = 'CONNECTING' and since + {2 * HOUR_MS} <= (select max(t) from e)""").format(order="ev"))
def connection_watch(spark, sf):
    """States and hangs, with the timer's rows, as known at the last event of all."""
    events = connection_events(spark, sf)
    return timers.walk(events, "user_id", "what", "ms", "connection", 2 * HOUR_MS, events.agg(F.max("ms")).first()[0] or 0)


@query("""with e as (select user_id, epoch_us(ts) // 1000 t, case when event_type in ('view', 'click') then 'playing' when event_type = 'purchase' then 'reset' else 'paused' end ev from events),
  g as (select *, row_number() over (partition by user_id order by t, ev) i, count(*) filter (ev = 'reset') over (partition by user_id order by t, ev rows unbounded preceding) card from e),
  s as (select *, case when ev = 'playing' then coalesce(lead(t) over (partition by user_id order by i), (select max(t) from e)) - t else 0 end span from g),
  r as (select *, coalesce(sum(span) over (partition by user_id, card order by i rows between unbounded preceding and 1 preceding), 0) b from s)
  select cast(user_id as varchar) k, cast(min(t + 86400000 - b) as bigint) t, 'timer' as event, 'TIME_UP' state from r where b < 86400000 and b + span >= 86400000 group by user_id, card""")
def listening_watch(spark, sf):
    """R02, at the scale of a day: when each card's time was up, with the timer's rows."""
    t = F.col("event_type")
    events = millis(table(spark, sf, "events")).withColumn("what", F.when(t.isin("view", "click"), "playing").when(t == "purchase", "reset").otherwise("paused"))
    return timers.walk(events, "user_id", "what", "ms", "listening", 24 * HOUR_MS, events.agg(F.max("ms")).first()[0] or 0)


def viewfinder() -> F.Column:
    return scans.viewfinder_region(F.lit(1080.0), F.lit(1920.0), F.lit(720.0), F.lit(1280.0))


_HALF = "(1080.0::double * 0.78 * (0.5 - 0.03) / 1.5)"


@query(f"""with d as (select user_id, event_id, event_type code, value area, ts, (event_id % 100) / 100.0::double x, (user_id % 50) / 50.0::double y from events),
  i as (select *, epoch_us(ts) // 86400000000 * 86400000 w from d where x between greatest(0, 0.5 - {_HALF} / 720) and least(1, 0.5 + {_HALF} / 720) and y between greatest(0, 0.5 - {_HALF} / 1280) and least(1, 0.5 + {_HALF} / 1280) and area >= 2)
  select user_id, w as window_ms, event_id, code from (select *, row_number() over (partition by user_id, w order by ts desc, event_id desc, area desc, code desc) r from i) where r = 1""")
def frames_latest(spark, sf):
    """Of each device and day the last frame whose code is in the viewfinder."""
    e = table(spark, sf, "events").select("user_id", "event_id", F.col("event_type").alias("code"), F.col("value").alias("area"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 100 / 100.0).alias("x"), (F.col("user_id") % 50 / 50.0).alias("y"))
    seen = frames.candidates(e, viewfinder(), "x", "y", "area", 2.0)
    last = frames.latest(seen, "user_id", "ts", "event_id", "code", "area", "1 day")
    return last.select("user_id", F.unix_millis("window_start").alias("window_ms"), "event_id", "code")


@query("""select owner_id, track_id, added_at, l_orderkey, l_linenumber, place from (select *, row_number() over (partition by owner_id order by added_at nulls last, track_id) place from (select owner_id, track_id, added_at, l_orderkey, l_linenumber, row_number() over (partition by owner_id, track_id order by added_at, l_orderkey, l_linenumber, l_suppkey) rn from items) where rn = 1)""".replace("select owner_id", "with " + sql("items", select="").removeprefix("with ") + " select owner_id", 1))
def instances_sorted(spark, sf):
    """Each owner's instances with their place in the report's order."""
    rows = catalog.earliest_instances(items(spark, sf), ORDER, ["l_orderkey", "l_linenumber"])
    return positions.within(rows, "owner_id", catalog.instance_order()[1:])
