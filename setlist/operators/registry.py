"""The append-only registry of cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import owners_footer, owners_split

#: Fixed value: the form of a card id.
CARD_ID = r"^[A-Z]+_([A-Z0-9]+)_(\d{3})$"
#: Where a card's code leads; the caller's to set.
TRACK_URL = "https://tracks.example/"


def card_number(card: Column) -> Column:
    return F.nullif(F.regexp_extract(card, CARD_ID, 2), F.lit("")).cast("int")


def next_numbers(registry: DataFrame) -> DataFrame:
    """Next free number per expansion."""
    return registry.groupBy("expansion_anchor").agg((F.coalesce(F.max(card_number(F.col("card_id"))), F.lit(0)) + 1).alias("next_number"))


def numbered(cards: DataFrame, registry: DataFrame, order: list[str]) -> DataFrame:
    """New cards numbered on from the registry, per expansion."""
    w = Window.partitionBy("expansion_anchor").orderBy(*order)
    return cards.join(next_numbers(registry), "expansion_anchor", "left").withColumn("number", F.coalesce("next_number", F.lit(1)) - 1 + F.row_number().over(w)).drop("next_number")


def mark_printed(registry: DataFrame, version: str | None, now: str) -> DataFrame:
    """Pending cards (of one version) become printed."""
    hit = F.col("printed_status") == "pending"
    if version is not None:
        hit &= F.col("version") == version
    return registry.withColumns({"printed_at": F.when(hit, F.lit(now)).otherwise(F.col("printed_at")), "printed_status": F.when(hit, "printed").otherwise(F.col("printed_status"))})


def delete_pending(registry: DataFrame, version: str | None = None) -> DataFrame:
    """What stays when pending cards (of one version) are dropped."""
    hit = F.col("printed_status").eqNullSafe(F.lit("pending"))
    if version is not None:
        hit &= F.col("version").eqNullSafe(F.lit(version))
    return registry.where(~hit)


def overlap(registry: DataFrame, new: DataFrame) -> DataFrame:
    """New rows whose song or card is registered already."""
    songs = new.join(registry.select("song_id"), "song_id", "left_semi").select("card_id", F.lit("song_id").alias("clash"))
    return songs.union(new.join(registry.select("card_id"), "card_id", "left_semi").select("card_id", F.lit("card_id").alias("clash")))


def append(registry: DataFrame, new: DataFrame) -> DataFrame:
    """Registry rows unchanged, then the new ones; raises on a clash or a changed row."""
    if not (clash := overlap(registry, new)).isEmpty():
        raise ValueError(f"already registered: {[tuple(r) for r in clash.limit(5).collect()]}")
    out = registry.unionByName(new, allowMissingColumns=True)
    if not altered(registry, out).isEmpty():
        raise ValueError("registered rows have changed")
    return out


def altered(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that an append-only table no longer has as they were."""
    return before.exceptAll(after.select(before.columns))


def change_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many cards an update has printed or a clean-up has deleted."""
    old = before.select("card_id", F.col("printed_status").alias("was"))
    both = old.join(after.select("card_id", "printed_status", F.lit(True).alias("there")), "card_id", "left")
    return both.agg(F.count_if((F.col("was") != "printed") & (F.col("printed_status") == "printed")).cast("long").alias("n_printed"), F.count_if(F.col("there").isNull()).cast("long").alias("n_deleted"))


def show(registry: DataFrame) -> DataFrame:
    """Cards per expansion and status, with totals of each and of all as null keys."""
    return registry.groupingSets([["expansion_anchor", "printed_status"], ["expansion_anchor"], ["printed_status"], []], "expansion_anchor", "printed_status").agg(F.count(F.lit(1)).alias("cards"))


def printable(registry: DataFrame, new: DataFrame, scope: str) -> DataFrame:
    """Cards to print: the run's own, or every card with what is new marked."""
    if scope not in ("new-only", "all"):
        raise ValueError(f"unknown print scope: {scope}")
    marked = is_new(registry, new)
    return marked.where("is_new") if scope == "new-only" else marked


def is_new(cards: DataFrame, new: DataFrame) -> DataFrame:
    """``cards`` with a mark on those of the run."""
    ids = new.select("card_id", F.lit(True).alias("is_new")).distinct()
    return cards.drop("is_new").join(ids, "card_id", "left").withColumn("is_new", F.coalesce("is_new", F.lit(False)))


def reprint(registry: DataFrame, backgrounds: int = 12) -> DataFrame:
    """Card rows from the registry alone, for full reprints."""
    number = F.regexp_extract("card_id", r"_(\d+)$", 1).cast("int")
    url = F.concat(F.lit(TRACK_URL), F.col("winner_track_id").cast("string"))
    return registry.select(
        number.alias("selection_rank"),
        "card_id",
        "expansion_anchor",
        F.lit(False).alias("is_new"),
        "song_id",
        "winner_track_id",
        url.alias("track_url"),
        F.format_string("g%02d", ((number - 1) % backgrounds + 1).cast("int")).alias("front_bg_id"),
        F.col("title").alias("title_display"),
        F.col("artists").alias("artists_display_resolved"),
        F.col("year").alias("year_final"),
        "owners",
        owners_footer(owners_split(F.col("owners"))).alias("owners_display"),
    )


def print_jobs(cards: DataFrame, split: str) -> DataFrame:
    """``cards`` with the ``job`` that prints them: the full deck, one per expansion, or both, in which case each card
    comes twice (O06)."""
    jobs = {"combined": [F.lit("full_deck")], "per-expansion": [F.concat(F.lit("expansion_"), "expansion_anchor")]}
    jobs["both"] = jobs["combined"] + jobs["per-expansion"]
    if split not in jobs:
        raise ValueError(f"unknown split: {split}")
    return cards.select(F.explode(F.array(*jobs[split])).alias("job"), "*")


def print_order(cards: DataFrame) -> list[Column]:
    """By expansion, then by rank."""
    return [F.col("expansion_anchor"), F.col("selection_rank")]


def drift(registry: DataFrame, catalog: DataFrame) -> DataFrame:
    """Registered songs that the catalog no longer has."""
    return registry.join(catalog.select("song_id").distinct(), "song_id", "left_anti")


def violations(registry: DataFrame) -> DataFrame:
    """Rule and number of rows that break it, for every rule (A35). The registry is read once: each
    row becomes its broken rules, song and card, and two aggregations count them."""
    owner = F.upper(F.col("expansion_anchor"))
    valid = F.coalesce(F.col("card_id").rlike(CARD_ID), F.lit(False))
    rules = {
        "bad_status": ~F.coalesce(F.col("printed_status").isin("pending", "printed"), F.lit(False)),
        "bad_card_id": ~valid,
        "anchor_mismatch": valid & (F.regexp_extract("card_id", CARD_ID, 1) != owner),
        "anchor_not_owner": ~F.coalesce(F.array_contains(F.split("owners", "[|]"), F.col("expansion_anchor")), F.lit(False)),
    }
    twice = {"duplicate_song_id": "song_id", "duplicate_card_id": "card_id"}
    marks = [F.struct(F.lit(n).alias("rule"), F.lit(None).cast("string").alias("value"), c.cast("int").alias("hit")) for n, c in rules.items()]
    marks += [F.struct(F.lit(n).alias("rule"), F.col(c).cast("string").alias("value"), F.lit(1).alias("hit")) for n, c in twice.items()]
    each = registry.select(F.inline(F.array(*marks))).groupBy("rule", "value").agg(F.sum("hit").alias("n"))
    counted = F.when(~F.col("rule").isin(*twice) | (F.col("n") > 1), F.col("n")).otherwise(0)
    found = each.groupBy("rule").agg(F.sum(counted).alias("n_rows"))
    every = registry.sparkSession.createDataFrame([(n,) for n in [*rules, *twice]], "rule string")
    return every.join(F.broadcast(found), "rule", "left").select("rule", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def require_valid(registry: DataFrame) -> None:
    """Raise if any rule is broken."""
    bad = [tuple(r) for r in violations(registry).where("n_rows > 0").collect()]
    if bad:
        raise ValueError(f"registry is not valid: {bad}")
