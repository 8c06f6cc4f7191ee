"""Aggregates of the deck report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import positions

#: Colours for owners without one, in the order of their ids.
PALETTE = ["#00E5FF", "#FF3D71", "#FFD166", "#7CFC00", "#B388FF", "#FF8C42", "#4DD599", "#FF6FD8"]
#: Fixed value: cards on a sheet, four rows of three.
PER_SHEET, PER_ROW = 12, 3


def kpis(cards: DataFrame) -> DataFrame:
    """One row of headline counts (A24); ``new`` needs the mark ``is_new``."""
    n = lambda c: F.count_if(c).cast("long")
    return cards.agg(
        F.count(F.lit(1)).alias("cards"),
        F.count_distinct("year").alias("years"),
        F.min("year").alias("min_year"),
        F.max("year").alias("max_year"),
        n(F.col("printed_status") == "printed").alias("printed"),
        n(F.col("printed_status") == "pending").alias("pending"),
        n(F.col("is_new") if "is_new" in cards.columns else F.lit(False)).alias("new"),
    )


def year_histogram(cards: DataFrame, width: int) -> DataFrame:
    """Cards per bin of years, labelled ``1990``, ``1990–94`` or ``1998–2002``."""
    low = (F.floor(F.col("year") / width) * width).cast("int")
    high = F.col("low") + width - 1
    short = F.concat(F.col("low").cast("string"), F.lit("–"), F.lpad((high % 100).cast("string"), 2, "0"))
    label = F.when(F.lit(width == 1), F.col("low").cast("string")).when(F.floor(F.col("low") / 100) == F.floor(high / 100), short).otherwise(F.concat_ws("–", F.col("low").cast("string"), high.cast("string")))
    return cards.where("year is not null").groupBy(low.alias("low")).agg(F.count(F.lit(1)).alias("cards")).select("low", label.alias("label"), "cards")


def owner_appearances(cards: DataFrame) -> DataFrame:
    """Cards per owner."""
    return cards.select(F.explode("owner_ids").alias("owner_id")).groupBy("owner_id").agg(F.count(F.lit(1)).alias("cards"))


def owner_combinations(cards: DataFrame, size: int | None = None) -> DataFrame:
    """Cards per exact set of owners; of the ``size`` most frequent, each with how many sets are not
    shown (A27)."""
    combos = cards.groupBy(F.array_join(F.array_sort(F.array_distinct("owner_ids")), "+").alias("owners")).agg(F.count(F.lit(1)).alias("cards"))
    if size is None:
        return combos
    total = combos.agg(F.count(F.lit(1)).alias("n"))
    top = combos.orderBy(F.desc("cards"), "owners").limit(size)
    return top.crossJoin(F.broadcast(total)).select("owners", "cards", F.greatest(F.col("n") - size, F.lit(0)).alias("not_shown"))


def top_artists(cards: DataFrame, artist: Column, size: int = 10) -> DataFrame:
    """Most frequent primary artists."""
    return cards.groupBy(artist.alias("artist")).agg(F.count(F.lit(1)).alias("cards")).orderBy(F.desc("cards"), "artist").limit(size)


def expansion_counts(cards: DataFrame, expansions: DataFrame) -> DataFrame:
    """Cards per expansion, those without a card too."""
    ids = cards.select("expansion_anchor").union(expansions.select("expansion_anchor")).distinct()
    counts = cards.groupBy("expansion_anchor").agg(F.count(F.lit(1)).alias("cards"))
    return ids.join(counts, "expansion_anchor", "left").select("expansion_anchor", F.coalesce("cards", F.lit(0)).alias("cards"))


def owner_colours(owners: DataFrame) -> DataFrame:
    """A colour per owner: its own, else from the palette by its place among the ids (A30). One
    row per owner of the config: a small table."""
    place = F.row_number().over(Window.orderBy("owner_id")) - 1
    return owners.withColumn("place", place).select("owner_id", F.coalesce("colour", F.element_at(F.array(*[F.lit(c) for c in PALETTE]), (F.col("place") % len(PALETTE) + 1).cast("int"))).alias("colour"))


def matches(text: str, columns: list[str], low: int | None, high: int | None) -> Column:
    """Rows that show ``text`` in any column and whose year is in range."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())), F.lit(False))
    year = F.lit(True)
    if low is not None:
        year = year & (F.col("year") >= low)
    if high is not None:
        year = year & (F.col("year") <= high)
    return hit & F.coalesce(year, F.lit(False))


def sort_order(column: str, tie: str, descending: bool = False) -> list[Column]:
    """Numbers by value before other text without case, ties by place."""
    number, text = F.expr(f"try_cast({column} as double)"), F.lower(F.col(column).cast("string"))
    keys = [number, text, F.col(tie)]
    return [k.desc_nulls_last() if descending else k.asc_nulls_last() for k in keys]


def slots(cards: DataFrame, keep: list[str]) -> DataFrame:
    """Sheet, front slot and the three back slots of each card by its ``place`` in what is printed."""
    place = F.col("place")
    slot, row, col = place % PER_SHEET, F.floor(place % PER_SHEET / PER_ROW), place % PER_ROW
    rows = PER_SHEET // PER_ROW
    return cards.select(
        *keep,
        F.floor(place / PER_SHEET).cast("long").alias("sheet"),
        slot.cast("long").alias("front_slot"),
        slot.cast("long").alias("back_match"),
        (row * PER_ROW + (PER_ROW - 1 - col)).cast("long").alias("back_flip_long"),
        ((rows - 1 - row) * PER_ROW + col).cast("long").alias("back_flip_short"),
    )


def sheet_plan(cards: DataFrame, order: list[str]) -> DataFrame:
    """The slots of each expansion's cards, printed by themselves: places come from the order within an expansion, so no
    window spans the deck."""
    place = F.row_number().over(Window.partitionBy("expansion_anchor").orderBy(*order)) - 1
    return slots(cards.withColumn("place", place), ["expansion_anchor", "card_id"])


def job_plan(jobs: DataFrame, order: list[Column]) -> DataFrame:
    """The slots of all cards of each print ``job``, a whole deck or an expansion."""
    return slots(positions.within(jobs, "job", order, "place", 0), ["job", "expansion_anchor", "card_id"])


def payload(cards: DataFrame, fields: list[str]) -> DataFrame:
    """One JSON text per expansion with its cards."""
    return cards.groupBy("expansion_anchor").agg(F.to_json(F.array_sort(F.collect_list(F.struct(*fields)))).alias("cards_json"))


def document(cards: DataFrame, fields: list[str], meta: dict[str, str]) -> DataFrame:
    """The report's parts as rows ``part, key, json``: one of ``meta``, one per expansion with its
    counts, one per owner with its colour's place, one per expansion's cards (X09). The report's writer
    strings them together; nothing of the cards is gathered in one row but an expansion's own."""
    own = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in meta.items()]))
    head = cards.sparkSession.range(1).select(F.lit("meta").alias("part"), F.lit("").alias("key"), own.alias("json"))
    counts = cards.groupBy("expansion_anchor").agg(F.count(F.lit(1)).alias("cards"), F.count_if(F.col("printed_status") == "printed").cast("long").alias("printed"), F.min("year").alias("min_year"), F.max("year").alias("max_year"))
    sets = counts.select(F.lit("expansion"), "expansion_anchor", F.to_json(F.struct("cards", "printed", "min_year", "max_year")))
    owners = owner_appearances(cards).select(F.lit("owner"), "owner_id", F.to_json(F.struct("cards")))
    rows = payload(cards, fields).select(F.lit("cards"), "expansion_anchor", "cards_json")
    return head.union(sets).union(owners).union(rows)
