"""Greedy selectors.

Each pick changes the counts that the next pick is judged by, so picking is one sequence. What it
works on is bounded, though. Songs that agree in everything a pick looks at form a class and leave
it in a fixed order, so Spark first ranks each class and keeps as many of its songs as there are
picks. Songs of one year and set of owners form a group, in which a pick looks at artist, album and
order only: an earlier song that no pick has touched is always taken first. Spark keeps the songs of
a group that picks can reach, so the number of artists and albums does not matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import cut

#: Candidates wanted, and the weights of the score.
TARGET = 400
W_YEAR, W_AVERAGE, W_LARGEST, W_NEW, W_ARTIST = 0.35, 0.20, 0.05, 0.20, 0.10
#: Cards of one artist and of one album per expansion, size of an expansion.
ARTIST_CAP, ALBUM_CAP, EXPANSION_SIZE = 3, 2, 60
NO_YEAR = 10_000


def score(owners: Column, year_count: Column, average: Column, largest: Column, new: Column, artist_count: Column) -> Column:
    """A candidate's score from the counts so far."""
    return owners - F.lit(W_YEAR) * year_count - F.lit(W_AVERAGE) * average - F.lit(W_LARGEST) * largest + F.lit(W_NEW) * new - F.lit(W_ARTIST) * artist_count


def max_year_flag(years: DataFrame, year: str, as_of_year: int) -> DataFrame:
    """Marks rows of the newest year, only if that is the current one."""
    top = years.agg(F.max(year).alias("__top"))
    return years.crossJoin(F.broadcast(top)).withColumn("exclude_max_year", F.coalesce((F.col("__top") == as_of_year) & (F.col(year) == F.col("__top")), F.lit(False))).drop("__top")


def pool(songs: DataFrame, years: DataFrame, active: list[str], as_of_year: int) -> DataFrame:
    """Songs with their final year and active owners."""
    joined = songs.join(max_year_flag(years, "year_final", as_of_year), "song_id", "left")
    owned = joined.withColumn("owner_ids", F.filter("owner_ids", lambda o: o.isin(active)))
    return owned.where(F.col("year_final").isNotNull() & ~F.coalesce("exclude_max_year", F.lit(False)) & (F.size("owner_ids") > 0)).drop("exclude_max_year")


def _first_of_each(df: DataFrame, classes: list[str], order: list[Column], size: int, rank: str = "__r") -> DataFrame:
    """The first ``size`` songs of each class, with their place as ``rank`` if that is named. A class is an exact state of a song, but a hot one
    is still cut in parts first, so that no task sees all of it."""
    part = Window.partitionBy(*classes, F.pmod(F.xxhash64("song_id"), F.lit(64))).orderBy(*order)
    whole = Window.partitionBy(*classes).orderBy(*order)
    few = df.withColumn("__r", F.row_number().over(part)).where(F.col("__r") <= size).drop("__r")
    return few.withColumn(rank, F.row_number().over(whole)).where(F.col(rank) <= size).drop("__r")


def _reachable(df: DataFrame, keys: list[str], order: list[Column], used: int, touched: dict[str, int]) -> DataFrame:
    """Songs of each group that a pick can reach: at most ``used`` songs before one are gone, and of
    each column of ``touched`` so many values are barred or come later. With at most m songs of a
    value before it, a song is out of reach after ``used`` plus the sum of limit times m songs."""
    before = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("__r", F.row_number().over(before) - 1)
    for c in touched:
        ranked = ranked.withColumn(f"__n_{c}", F.when(F.col(c).isNotNull(), F.row_number().over(Window.partitionBy(*keys, c).orderBy(*order))).otherwise(0))
    running = before.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.lit(used).cast("long")
    for c, limit in touched.items():
        reach = reach + F.lit(limit).cast("long") * F.max(f"__n_{c}").over(running)
    return ranked.withColumn("__reach", reach).where(F.col("__r") <= F.col("__reach")).select(*df.columns)


def greedy_candidates(songs: DataFrame, target: int = TARGET) -> DataFrame:
    """``song_id, selection_rank, selection_phase`` (A19). ``songs``: ``song_id, year_final,
    owners_count, owner_ids, primary_artist_name``."""
    rows = songs.where("year_final is not null").select("song_id", F.col("year_final").cast("long").alias("year"), F.col("owners_count").cast("long").alias("owners"), F.array_sort("owner_ids").alias("owner_ids"), F.coalesce(F.trim("primary_artist_name"), F.lit("\x00")).alias("artist"))
    few = _first_of_each(rows, ["year", "owners", "owner_ids", "artist"], [F.col("song_id")], target, "place")
    # an artist's k-th song is taken when each song before it by (k, id) is taken too or its artist
    # has as many picks: fewer than ``target`` songs of the group come before it
    few = _first_of_each(few, ["year", "owners", "owner_ids"], [F.col("place"), F.col("song_id")], target).drop("place")

    def pick(table: pa.Table) -> pa.Table:
        got = list(pick_candidates(table.to_pylist(), target))
        return pa.table([pa.array([g[i] for g in got], k) for i, k in enumerate((pa.string(), pa.int64(), pa.string()))], names=["song_id", "selection_rank", "selection_phase"])

    return few.withColumn("__all", F.lit(0)).groupBy("__all").applyInArrow(pick, "song_id string, selection_rank long, selection_phase string")


class _Owners(Counter):
    """Cards per owner, and what a set of owners amounts to."""

    def measures(self, ids: tuple) -> tuple[float, int, int]:
        if not ids:
            return 0.0, 0, 0
        counts = [self[i] for i in ids]
        return sum(counts) / len(counts), max(counts), counts.count(0)


def pick_candidates(songs: list[dict], target: int) -> Iterator[tuple[str, int, str]]:
    queues: dict[tuple, list[str]] = {}
    for s in songs:
        queues.setdefault((s["year"], s["owners"], tuple(s["owner_ids"]), s["artist"]), []).append(s["song_id"])
    for q in queues.values():
        q.sort(reverse=True)
    years, artists, owners = Counter(), Counter(), _Owners()
    rank = 0

    def first(c: tuple) -> tuple:
        average, largest, new = owners.measures(c[2])
        return -c[1], average, largest, -new, artists[c[3]], queues[c][-1]

    def fill(c: tuple) -> tuple:
        average, largest, new = owners.measures(c[2])
        value = c[1] - W_YEAR * years[c[0]] - W_AVERAGE * average - W_LARGEST * largest + W_NEW * new - W_ARTIST * artists[c[3]]
        return -value, -c[1], years[c[0]], average, largest, -new, artists[c[3]], queues[c][-1]

    def take(c: tuple) -> str:
        years[c[0]] += 1
        artists[c[3]] += 1
        owners.update(c[2])
        song = queues[c].pop()
        if not queues[c]:
            del queues[c]
        return song

    by_year: dict[int, list[tuple]] = {}
    for c in queues:
        by_year.setdefault(c[0], []).append(c)
    for year in sorted(by_year):
        if rank < target:
            rank += 1
            yield take(min(by_year[year], key=first)), rank, "phase1_year_cover"
    while rank < target and queues:
        rank += 1
        yield take(min(queues, key=fill)), rank, "phase2_fill"


def greedy_deck(songs: DataFrame, locked: DataFrame, targets: dict[str, int], artist_cap: int = ARTIST_CAP, album_cap: int = ALBUM_CAP) -> DataFrame:
    """``song_id, expansion_anchor, pick_order`` of new cards (A20). ``songs``: the pool with
    ``song_id, year_final, owner_ids, artist_key, album_id, popularity, guardrail``; ``locked``:
    ``song_id, expansion_anchor, year`` of registered cards."""
    total = sum(targets.values())
    fields = ["song_id", F.col("year_final").cast("long").alias("year"), F.array_sort("owner_ids").alias("owner_ids"), "artist_key", "album_id", F.col("popularity").cast("long").alias("popularity"), "guardrail"]
    # both are looked at several times below: their plans end here
    songs, locked = cut(songs), cut(locked)
    known = songs.join(locked.select("song_id"), "song_id", "left_semi").select(*fields)
    free = songs.join(locked.select("song_id"), "song_id", "left_anti").where("year_final is not null").select(*fields)
    order = [F.col("popularity").desc_nulls_last(), F.col("song_id")]
    state = ["year", "owner_ids", "artist_key", "album_id"]
    # a registered guardrail key blocks songs, so these must not fill a class; nor must songs under a cap of none
    blocked = known.select("guardrail").where("guardrail is not null").distinct()
    free = free.join(blocked, "guardrail", "left_anti").select(*free.columns)
    for c, cap in (("artist_key", artist_cap), ("album_id", album_cap)):
        free = free if cap > 0 else free.where(F.col(c).isNull())
    # of songs that share a guardrail key and a state only the first can ever be picked
    own = lambda c: F.coalesce(F.concat(F.lit("v"), c), F.concat(F.lit("s"), "song_id"))  # noqa: E731  (a song without a value stands alone)
    single = _first_of_each(free.withColumn("own", own("guardrail")), [*state, "own"], order, 1)
    few = _first_of_each(single, state, order, total + 1)
    # an expansion that takes a card has fewer than its target, so that many artists and albums at most
    cards, group = max(targets.values(), default=0), ["year", "owner_ids"]
    limits = {"album_id": cards // max(album_cap, 1), "guardrail": total}
    few = _reachable(few.withColumn("own", own("artist_key")), [*group, "own"], order, total, limits)
    few = few.drop("own").withColumn("part", F.pmod(F.xxhash64("song_id"), F.lit(64)))
    limits = {"artist_key": cards, **limits}
    few = _reachable(few, [*group, "part"], order, total, limits).drop("part")
    few = _reachable(few, group, order, total, limits) if total else few.limit(0)
    rows = few.withColumn("anchor", F.lit(None).cast("string")).unionByName(
        locked.select("song_id", "expansion_anchor", F.col("year").cast("long").alias("locked_year")).join(known, "song_id", "left").select("song_id", F.when(F.col("owner_ids").isNull(), F.col("locked_year")).otherwise(F.col("year")).alias("year"), "owner_ids", "artist_key", "album_id", "popularity", "guardrail", F.col("expansion_anchor").alias("anchor"))
    )

    def pick(table: pa.Table) -> pa.Table:
        all_rows = table.to_pylist()
        got = list(pick_deck([r for r in all_rows if r["anchor"] is None], [r for r in all_rows if r["anchor"] is not None], targets, artist_cap, album_cap))
        return pa.table([pa.array([g[i] for g in got], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64()))], names=["song_id", "expansion_anchor", "pick_order"])

    return rows.withColumn("__all", F.lit(0)).groupBy("__all").applyInArrow(pick, "song_id string, expansion_anchor string, pick_order long")


class _Expansion:
    def __init__(self):
        self.cards, self.years, self.artists, self.albums, self.sets, self.owners = 0, Counter(), Counter(), Counter(), Counter(), Counter()

    def add(self, anchor: str, r: dict) -> None:
        self.cards += 1
        if r["year"] is not None:
            self.years[r["year"]] += 1
        if r["owner_ids"] is None:  # registered, but no longer in the pool: only its year counts
            return
        self.artists[r["artist_key"]] += r["artist_key"] is not None
        self.albums[r["album_id"]] += r["album_id"] is not None
        self.sets[tuple(r["owner_ids"])] += 1
        self.owners.update(o for o in r["owner_ids"] if o != anchor)

    def first(self, anchor: str, group: tuple) -> tuple:
        """The part of a song's key that its year and set of owners decide."""
        year, owner_ids = group
        others = [self.owners[o] for o in owner_ids if o != anchor]
        return self.years[year] > 0, self.years[year], 1 - len(owner_ids), self.sets[owner_ids], sum(others) / len(others) if others else 0.0

    def then(self, r: dict) -> tuple:
        """The rest of its key."""
        return self.artists[r["artist_key"]], r["popularity"] is None, -(r["popularity"] or 0), r["year"] if r["year"] is not None else NO_YEAR, r["song_id"]


def pick_deck(songs: list[dict], locked: list[dict], targets: dict[str, int], artist_cap: int, album_cap: int) -> Iterator[tuple[str, str, int]]:
    """Round-robin by the largest deficit; an expansion without candidates is closed for good."""
    state = {o: _Expansion() for o in sorted(targets)}
    used = set()
    for r in locked:
        if r["guardrail"] is not None:
            used.add(r["guardrail"])
        if r["anchor"] in state:
            state[r["anchor"]].add(r["anchor"], r)
    # songs of one year and set of owners share the first part of their key, which is worked out once for all of them
    by_owner: dict[str, dict[tuple, dict[str, dict]]] = {o: {} for o in state}
    for r in songs:
        for o in r["owner_ids"]:
            if o in by_owner:
                by_owner[o].setdefault((r["year"], tuple(r["owner_ids"])), {})[r["song_id"]] = r

    def best(anchor: str) -> dict | None:
        s, groups = state[anchor], by_owner[anchor]
        fits = lambda r: (r["guardrail"] is None or r["guardrail"] not in used) and (r["artist_key"] is None or s.artists[r["artist_key"]] < artist_cap) and (r["album_id"] is None or s.albums[r["album_id"]] < album_cap)
        for _, equal in groupby(sorted((s.first(anchor, g), i, g) for i, g in enumerate(groups)), key=lambda x: x[0]):
            found = [r for _, _, g in equal for r in groups[g].values() if fits(r)]
            if found:
                return min(found, key=s.then)
        return None

    closed, order = set(), 0
    while open_ := [o for o in state if o not in closed and targets[o] > state[o].cards]:
        anchor = min(open_, key=lambda o: (state[o].cards - targets[o], o))
        r = best(anchor)
        if r is None:
            closed.add(anchor)
            continue
        state[anchor].add(anchor, r)
        if r["guardrail"] is not None:
            used.add(r["guardrail"])
        group = (r["year"], tuple(r["owner_ids"]))
        for o in r["owner_ids"]:
            left = by_owner.get(o, {}).get(group)
            if left is not None:
                left.pop(r["song_id"], None)
                if not left:
                    del by_owner[o][group]
        order += 1
        yield r["song_id"], anchor, order


def expansion_summary(picks: DataFrame, locked: DataFrame, songs: DataFrame, targets: dict[str, int]) -> DataFrame:
    """Targets, cards and distinct years per expansion."""
    wanted = picks.sparkSession.createDataFrame(sorted(targets.items()), "expansion_anchor string, target_size long")
    new = picks.join(songs.select("song_id", F.col("year_final").alias("year")), "song_id").select("expansion_anchor", "year", F.lit(1).alias("new"))
    cards = new.unionByName(locked.select("expansion_anchor", "year", F.lit(0).alias("new")))
    counted = cards.groupBy("expansion_anchor").agg(F.count_if(F.col("new") == 0).alias("locked_cards"), F.count_if(F.col("new") == 1).alias("new_cards"), F.count_distinct("year").alias("distinct_years"))
    filled = wanted.join(counted, "expansion_anchor", "left").na.fill(0)
    return filled.withColumn("total_cards", F.col("locked_cards") + F.col("new_cards")).withColumn("underfilled_by", F.greatest(F.col("target_size") - F.col("total_cards"), F.lit(0)))


def selection_violations(picks: DataFrame, locked: DataFrame, songs: DataFrame) -> DataFrame:
    """Rules after a selection and how many rows break them."""
    twice = picks.groupBy("song_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit("picked_twice").alias("rule"), "n_rows")
    again = picks.join(locked.select("song_id"), "song_id", "left_semi").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit("already_registered").alias("rule"), "n_rows")
    owned = picks.join(songs.select("song_id", "owner_ids"), "song_id", "left").where(~F.coalesce(F.array_contains("owner_ids", F.col("expansion_anchor")), F.lit(False)))
    return twice.union(again).union(owned.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit("anchor_not_owner").alias("rule"), "n_rows"))
