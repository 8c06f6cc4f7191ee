"""The star schema's tables in the shape of the catalog: market segments are owners, orders are
playlists, line items are playlist items, parts are tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import keys
from ..operators import catalog, identity

ORDER = ["l_orderkey", "l_linenumber", "l_suppkey"]
PREFIX = "DECK"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Playlist items; ``reason`` by the rejection rules, from a payload that lacks an id or is missing for returned
    pieces, is an episode for large quantities, and is local, by itself or by its item, for high discounts."""
    line, orders, customer = (table(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    joined = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    odd, returned, local = F.col("l_linenumber") % 2 == 1, F.col("l_returnflag") == "R", F.col("l_discount") >= 0.09
    payload = F.struct(
        F.when(returned, " ").otherwise(F.col("l_partkey").cast("string")).alias("id"),
        F.when((F.col("l_quantity") > 45) & odd, "episode").otherwise("track").alias("type"),
        (F.col("l_quantity") > 45).alias("episode"),
        F.when(odd, local).alias("is_local"),
    )
    reason = catalog.reject_reason(F.when(~(returned & odd), payload), local)
    return joined.select(F.col("c_mktsegment").alias("owner_id"), F.col("l_partkey").alias("track_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("added_at"), *ORDER, "l_quantity", reason.alias("reason"))


def tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks with owners, identity and a release date. Three parts in a row are variants of one song, named after the
    first of them, so there are as many songs as a third of the parts, however many these are."""
    part = table(spark, sf, "part")
    first = part.select(F.col("p_partkey").alias("first_key"), F.concat_ws(" ", "p_name", "p_partkey").alias("track_name"), F.col("p_brand").alias("artist"))
    base = part.join(first, F.greatest(F.lit(1), F.col("p_partkey") - F.col("p_partkey") % 3) == F.col("first_key")).select(
        F.col("p_partkey").alias("track_id"),
        "track_name",
        "artist",
        F.col("p_type").alias("album"),
        F.col("p_size").alias("popularity"),
        F.round(F.col("p_retailprice") * 1000).cast("long").alias("duration_ms"),
        (F.col("p_size") % 7 == 0).alias("had_suffix"),
        (-F.col("p_partkey")).alias("order_idx"),
        F.when(F.col("p_size") % 5 != 0, F.concat("p_name", F.lit(" v"), F.col("p_size").cast("string"))).alias("variant"),
    )
    got = items(spark, sf)
    # one aggregation of the items gives owners and dates
    owners = got.groupBy("track_id").agg(F.array_sort(F.collect_set("owner_id")).alias("owner_ids"), F.min("added_at").alias("release_date")).withColumn("owners_count", F.size("owner_ids").cast("long"))
    none = F.array().cast("array<string>")
    key = keys.song_key(F.col("artist"), F.lit(None).cast("string"), F.col("track_name"), none)
    out = base.join(owners, "track_id", "left")
    return out.select(*base.columns, F.coalesce("owner_ids", none).alias("owner_ids"), F.coalesce("owners_count", F.lit(0)).alias("owners_count"), "release_date", keys.song_id(key).alias("song_id"))


def songs(spark: SparkSession, sf: str) -> DataFrame:
    """One row per song: its winner's columns."""
    t = tracks(spark, sf)
    best = identity.winners(t).select("song_id", F.col("winner_track_id").alias("track_id"))
    return best.join(t.drop("song_id"), "track_id").withColumnRenamed("track_id", "winner_track_id").withColumn("year", F.substring("release_date", 1, 4).cast("int"))


SQL = {
    "items": """items as (select c_mktsegment owner_id, l_partkey track_id, strftime(o_orderdate, '%Y-%m-%d') added_at, l_orderkey, l_linenumber, l_suppkey, l_quantity,
      case when l_returnflag = 'R' and l_linenumber % 2 = 1 then 'null' when l_quantity > 45 then 'non_track' when l_discount >= 0.09 then 'local' when l_returnflag = 'R' then 'null' end reason
      from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey)""",
    "tracks": """own as (select track_id, list_sort(list(distinct owner_id)) owner_ids, count(distinct owner_id) owners_count, min(added_at) release_date from items group by 1),
      lead as (select p_partkey first_key, concat(p_name, ' ', p_partkey) track_name, p_brand artist from part),
      tracks as (select p_partkey track_id, track_name, artist, p_type album, p_size popularity, cast(round(p_retailprice * 1000) as bigint) duration_ms, p_size % 7 = 0 had_suffix, -p_partkey order_idx, case when p_size % 5 <> 0 then concat(p_name, ' v', p_size) end variant,
      coalesce(owner_ids, []) owner_ids, coalesce(owners_count, 0) owners_count, release_date, sha1(concat('v2.1|["', artist, '","', track_name, '",[]]')) song_id from part join lead on greatest(1, p_partkey - p_partkey % 3) = first_key left join own on p_partkey = track_id)""",
    "songs": """ranked as (select *, row_number() over (partition by song_id order by owners_count desc, popularity desc, had_suffix, track_id) rn, count(*) over (partition by song_id) n_variants from tracks),
      songs as (select *, track_id winner_track_id, cast(substr(release_date, 1, 4) as int) as year from ranked where rn = 1)""",
    "registry": """decks as (select * exclude (owner_ids), list_transform(owner_ids, lambda o: concat(o, winner_track_id // 300)) owner_ids from songs where len(owner_ids) > 0),
      anchored as (select *, owner_ids[winner_track_id % len(owner_ids) + 1] expansion_anchor from decks),
      counted as (select *, row_number() over (partition by expansion_anchor order by song_id) number from anchored),
      registry as (select song_id, winner_track_id, track_name title, artist artists, year, owner_ids, array_to_string(owner_ids, '|') owners, expansion_anchor, album,
        concat('DECK_', expansion_anchor, '_', lpad(cast(number as varchar), 3, '0')) card_id, case when number <= 20 then 'printed' else 'pending' end printed_status,
        case when number % 2 = 0 then 'v1' else 'v2' end as version, cast(null as varchar) printed_at, number from counted)""",
}


def sql(*parts: str, select: str) -> str:
    """A query over the named views."""
    chain = ["items", "tracks", "songs", "registry"]
    used = chain[: max(chain.index(p) for p in parts) + 1] if parts else []
    return ("with " + ",\n".join(SQL[p] for p in used) + "\n" if used else "") + select


def registry(spark: SparkSession, sf: str) -> DataFrame:
    """All songs as cards. Every 300 tracks make a deck with players of its own, one expansion each,
    so an expansion has some sixty cards however many songs there are; twenty of them are printed."""
    named = F.transform("owner_ids", lambda o: F.concat(o, F.floor(F.col("winner_track_id") / 300).cast("string")))
    own = songs(spark, sf).where(F.size("owner_ids") > 0).withColumn("owner_ids", named)
    own = own.withColumn("expansion_anchor", F.element_at("owner_ids", (F.col("winner_track_id") % F.size("owner_ids") + 1).cast("int")))
    place = own.withColumn("number", F.row_number().over(Window.partitionBy("expansion_anchor").orderBy("song_id")))
    return place.select(
        "song_id",
        "winner_track_id",
        F.col("track_name").alias("title"),
        F.col("artist").alias("artists"),
        "year",
        "owner_ids",
        F.array_join("owner_ids", "|").alias("owners"),
        "expansion_anchor",
        "album",
        F.format_string("DECK_%s_%03d", "expansion_anchor", "number").alias("card_id"),
        F.when(F.col("number") <= 20, "printed").otherwise("pending").alias("printed_status"),
        F.when(F.col("number") % 2 == 0, "v1").otherwise("v2").alias("version"),
        F.lit(None).cast("string").alias("printed_at"),
        "number",
    )
