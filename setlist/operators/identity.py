"""Track variants to canonical songs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import keys
from ..functions.dates import sort_key
from ..functions.text import udfs
from ..sources.positions import dense

#: Fixed value: durations further apart than this are other recordings.
TOLERANCE_MS = 8000


def winner_key() -> Column:
    """More owners, then more popular (unknown last), then without an ending, then by id."""
    return F.struct((-F.col("owners_count")).alias("o"), (-F.coalesce(F.col("popularity"), F.lit(-1))).alias("p"), F.col("had_suffix").cast("int").alias("s"), F.col("track_id").alias("t"))


def winners(tracks: DataFrame) -> DataFrame:
    """``song_id, winner_track_id, n_variants, owners_count, popularity`` per song."""
    best = F.min(F.struct(winner_key().alias("k"), F.struct("track_id", "owners_count", "popularity").alias("row")))
    return tracks.groupBy("song_id").agg(F.count(F.lit(1)).alias("n_variants"), best.alias("b")).select("song_id", F.col("b.row.track_id").alias("winner_track_id"), "n_variants", F.col("b.row.owners_count").alias("owners_count"), F.col("b.row.popularity").alias("popularity"))


#: The levels of the winner's order, by name.
RULE = ["owners_count", "popularity", "title_without_collapsible_suffix", "track_id"]
POSTPASS = "postpass_conservative"


def winner_rule(tracks: DataFrame, postpass: Column | None = None) -> DataFrame:
    """Which level of the winner's order decided (A09, W04). One aggregation keeps the four best
    values of that order and how often each occurs; ``postpass`` marks songs of the second pass."""
    plain = F.struct((-F.col("owners_count")).alias("o"), (-F.coalesce(F.col("popularity"), F.lit(-1))).alias("p"), F.col("had_suffix").cast("int").alias("s"))
    marked = F.lit(False) if postpass is None else postpass
    levels = tracks.select("song_id", plain.alias("k"), marked.alias("post")).groupBy("song_id", "k").agg(F.count(F.lit(1)).alias("n"), F.max("post").alias("post"))
    best = levels.groupBy("song_id").agg(F.array_sort(F.collect_list(F.struct("k.o", "k.p", "k.s", "n"))).alias("all"), F.max("post").alias("post"))
    top = F.col("all")[0]
    left = lambda same: F.aggregate(F.filter("all", same), F.lit(0).cast("long"), lambda t, x: t + x["n"])
    n_all, n_o = left(lambda x: F.lit(True)), left(lambda x: x["o"] == top["o"])
    n_p, n_s = left(lambda x: (x["o"] == top["o"]) & (x["p"] == top["p"])), top["n"]
    path = lambda k: ">".join(RULE[:k])
    rule = F.when(n_all == 1, "single_variant").when(n_o == 1, path(1)).when(n_p == 1, path(2)).when(n_s == 1, path(3)).otherwise(path(4))
    return best.select("song_id", F.concat(F.when(F.col("post"), f"{POSTPASS}>").otherwise(""), rule).alias("winner_rule_path"))


def no_merge_reason(variants: Column, remix: Column, match_type: Column) -> Column:
    """Why a track stayed alone; null where it was merged (A10)."""
    return F.when(variants > 1, F.lit(None)).when(remix, "remix_title").when(match_type == "isrc_first", "song_key_unique_isrc").otherwise("song_key_unique_fallback")


def islands(groups: DataFrame, key: list[str], duration: str, order: list[str], tolerance: int = TOLERANCE_MS) -> DataFrame:
    """Transitive merge of groups whose durations are within ``tolerance`` of each other: on a
    line the closure of that relation is gaps and islands, one sort per key (J10, W05)."""
    w = Window.partitionBy(*key).orderBy(duration, *order)
    gap = F.when(F.col(duration) - F.lag(duration).over(w) > tolerance, 1).otherwise(0)
    return groups.withColumn("gap", gap).withColumn("island", F.sum("gap").over(w).cast("long")).drop("gap")


def rollup(tracks: DataFrame, order: str = "track_id", title: str = "track_name") -> DataFrame:
    """Song rows: merged ids with the winner first and then in the original ``order``, the first title
    in that order that is not missing (else the winner's id), owners together, earliest date (A11, A12)."""
    member = F.struct(winner_key().alias("k"), F.col("track_id").alias("id"))
    dated = F.struct(sort_key(F.col("release_date")).alias("k"), F.struct("release_date", "track_id").alias("row"))
    place = F.struct(F.col(order).alias("at"), F.col("track_id").alias("id"))
    songs = tracks.groupBy("song_id").agg(
        F.transform(F.array_sort(F.collect_list(place)), lambda x: x["id"]).alias("ids"),
        F.min(member).alias("best"),
        F.min(F.when(keys.norm(F.col(title)).isNotNull(), F.struct(place.alias("at"), keys.norm(F.col(title)).alias("title")))).alias("named"),
        F.min(F.when(sort_key(F.col("release_date")).isNotNull(), dated)).alias("first"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("owner_ids")))).alias("owner_ids"),
    )
    winner = F.col("best.id")
    return songs.select(
        "song_id",
        winner.alias("winner_track_id"),
        F.coalesce("named.title", winner.cast("string")).alias("title"),
        F.concat(F.array(winner), F.filter("ids", lambda i: i != winner)).alias("merged_track_ids"),
        "owner_ids",
        F.col("first.row.release_date").alias("release_date"),
        F.col("first.row.track_id").alias("release_track_id"),
    )


def component_order(tracks: DataFrame) -> DataFrame:
    """``song_id, winner_track_id, place``: songs in the order of their winners, from 0 (W08). The sort is by range, and
    places come from counts of its partitions."""
    best = F.min(F.struct(winner_key().alias("k"), F.col("track_id").alias("id"))).alias("b")
    songs = tracks.groupBy("song_id").agg(best).select("song_id", F.col("b.id").alias("winner_track_id"), F.col("b.k").alias("k"))
    return dense(songs, ["k"], "place").drop("k")


def merge_stats(songs: DataFrame) -> DataFrame:
    """Tracks, songs, merged songs and merges."""
    return songs.agg(F.sum("n_variants").alias("tracks"), F.count(F.lit(1)).alias("songs"), F.count_if(F.col("n_variants") > 1).cast("long").alias("merged_songs"), F.sum(F.col("n_variants") - 1).alias("merges"))


def postpass_merges(identified: DataFrame) -> DataFrame:
    """Groups that the second pass merged away."""
    groups = identified.where(F.col("match_type") == POSTPASS).groupBy("song_id").agg(F.count_distinct("group_id").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("postpass_group_merges"))


def song_groups(tracks: DataFrame) -> DataFrame:
    """``tracks`` with ``base, had_suffix, remix, protected, group_id, match_type`` from their
    titles and ISRCs. Titles are parsed once per distinct title."""
    titles = tracks.select("track_name").distinct().withColumn("p", udfs()["title_parts"]("track_name")).select("track_name", "p.*")
    both = tracks.join(titles.withColumnRenamed("track_name", "__t"), F.col("track_name").eqNullSafe(F.col("__t")), "left").drop("__t")
    artist = F.coalesce(keys.norm(F.col("primary_artist_id")), keys.norm(F.col("primary_artist_name")))
    key = keys.song_key(artist, F.col("isrc"), F.col("base"), F.col("secondary_artist_names"))
    return both.withColumns({
        "artist_key": artist,
        "match_type": F.when(keys.norm(F.col("isrc")).isNotNull(), "isrc_first").otherwise("fallback"),
        "editorial_key": keys.editorial_key(artist, F.col("base"), F.col("secondary_artist_names")),
        "group_id": keys.song_id(key),
    })


def merge_groups(tracks: DataFrame, tolerance: int = TOLERANCE_MS) -> DataFrame:
    """``group_id, song_id, match_type`` after the conservative second pass.

    A group stands where its winner stands. Groups of one editorial key whose durations chain
    within ``tolerance`` become one song, unless a member is a remix or a protected version."""
    head = F.min(F.struct(winner_key().alias("k"), F.struct("editorial_key", "duration_ms", "match_type").alias("row")))
    groups = tracks.groupBy("group_id").agg(head.alias("h"), F.max("remix").alias("remix"), F.max(F.size("protected") > 0).alias("protected")).select("group_id", "h.row.*", "remix", "protected")
    may = ~F.col("remix") & ~F.col("protected") & F.col("duration_ms").isNotNull()
    placed = islands(groups.where(may), ["editorial_key"], "duration_ms", ["group_id"], tolerance)
    sizes = placed.groupBy("editorial_key", "island").agg(F.count(F.lit(1)).alias("n"))
    merged = placed.join(sizes.where("n > 1"), ["editorial_key", "island"]).select("group_id", keys.song_id(F.concat(F.lit("postpass_conservative|"), "editorial_key")).alias("merged_id"))
    return groups.join(merged, "group_id", "left").select("group_id", F.coalesce("merged_id", "group_id").alias("song_id"), F.when(F.col("merged_id").isNotNull(), "postpass_conservative").otherwise(F.col("match_type")).alias("match_type"))


def identify(tracks: DataFrame) -> DataFrame:
    """Every track with its song: ``song_id, match_type, winner_track_id`` and, for songs of the
    second pass, the earliest date of all members, else the winner's."""
    grouped = song_groups(tracks)
    named = grouped.drop("match_type").join(merge_groups(grouped), "group_id")
    best = named.groupBy("song_id").agg(
        F.min(F.struct(winner_key().alias("k"), F.struct("track_id", "release_date").alias("row"))).alias("b"),
        F.min(F.when(sort_key(F.col("release_date")).isNotNull(), F.struct(sort_key(F.col("release_date")).alias("k"), F.col("release_date")))).alias("first"),
        F.count(F.lit(1)).alias("n_variants"),
    )
    joined = named.join(best, "song_id")
    late = F.coalesce(F.col("first.release_date"), F.col("b.row.release_date"))
    return joined.withColumns({
        "winner_track_id": F.col("b.row.track_id"),
        "song_release_date": F.when(F.col("match_type") == "postpass_conservative", late).otherwise(F.col("b.row.release_date")),
    }).drop("b", "first")


def colliding_songs(identified: DataFrame) -> DataFrame:
    """Songs of the second pass that several separate islands share: the id hashes the key alone."""
    two = identified.where("match_type = 'postpass_conservative'").select("song_id", "group_id", "duration_ms").groupBy("song_id", "group_id").agg(F.min("duration_ms").alias("duration_ms"))
    return islands(two, ["song_id"], "duration_ms", ["group_id"]).groupBy("song_id").agg((F.max("island") + 1).alias("islands")).where("islands > 1")


def require_separate(identified: DataFrame) -> None:
    """Raise where recordings that are too far apart to be one share a song id."""
    bad = [r["song_id"] for r in colliding_songs(identified).limit(5).collect()]
    if bad:
        raise ValueError(f"songs of several recordings: {bad}")
