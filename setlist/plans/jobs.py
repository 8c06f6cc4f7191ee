"""The batch jobs: ingest, curate, build the deck, and all of them as one run (O01-O10). Clocks, ids and paths
are arguments; each job is a list of steps (:mod:`steps`) and reads only what steps before it have published."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, keys, text
from ..operators import catalog, curation, identity, registry, report, review, selection
from ..operators.ledger import Ledger
from ..sources import enrichment, playlists, runs, tables, xlsx
from ..sources.snapshots import Table
from .steps import Runner, Step

EVENT = "entity_type string, entity_id string, identity_version string, year_override int, artists_display_override string, title_display_override string, updated_at string, note string"
#: Columns of the review sheet that people and helpers fill in.
FILLED_IN = ["year_override", "ai_year", "artists_display_override", "title_display_override", "note", "ai_note"]


@dataclass(frozen=True)
class Settings:
    """What a run is about. ``sheet``: a reviewed CSV or XLSX; ``fetcher``: the import path of a year lookup."""

    run_id: str
    root: str
    store: str
    raw: str
    config: playlists.Config
    now: str
    as_of_year: int
    version: str = "v1"
    prefix: str = "DECK"
    sheet: str | None = None
    fetcher: str | None = None
    print_scope: str = "new-only"
    split: str = "combined"
    discard_pending: bool = False
    mirror: str | None = None
    style: str = ""
    script: str = ""
    candidates: int = selection.TARGET

    @property
    def out(self) -> str:
        return f"{self.root}/{self.run_id}/processed"

    @property
    def reports(self) -> str:
        return f"{self.root}/{self.run_id}/reports"


class Jobs:
    """The steps of a run, in order."""

    def __init__(self, spark: SparkSession, settings: Settings):
        self.spark, self.s = spark, settings
        self.runner = Runner(spark, f"{settings.root}/{settings.run_id}")
        self.ledger = Ledger(spark, f"{settings.store}/registry")

    def _own(self, *names: str) -> tuple[str, ...]:
        return tuple(f"{self.s.out}/{n}" for n in names)

    def _kept(self, *names: str) -> tuple[str, ...]:
        return tuple(f"{self.s.store}/{n}" for n in names)

    def _read(self, name: str, made_by: str) -> DataFrame:
        return tables.read_table(self.spark, f"{self.s.out}/{name}", made_by)

    def _publish(self, df: DataFrame, name: str) -> None:
        tables.publish(df, f"{self.s.out}/{name}")

    # ------------------------------------------------------------ ingest

    def ingest(self) -> list[Step]:
        return [
            Step("instances", self._instances, files=((self.s.raw, None),), writes=self._own("items", "instances", "qc_instances")),
            Step("identity", self._identity, reads=self._own("items", "instances"), writes=self._own("tracks", "songs")),
            Step("years", self._years, reads=self._own("songs"), writes=self._own("years")),
            Step("catalogs", self._catalogs, reads=self._own("tracks", "songs"), writes=self._kept("track_catalog", "song_catalog")),
        ]

    def _instances(self) -> None:
        """Landed playlists to usable items, instances and the funnel's counts."""
        flat = catalog.flatten_items(playlists.scan(self.spark, self.s.raw))
        usable = flat.where("reason is null")
        self._publish(usable, "items")
        self._publish(catalog.earliest_instances(usable, ["ordinal"], ["ordinal"]).orderBy(*catalog.instance_order()), "instances")
        self._publish(catalog.instance_counts(flat), "qc_instances")

    def _identity(self) -> None:
        """One row per track with its song, and one per song with its winner's columns and all owners."""
        usable, instances = self._read("items", "instances"), self._read("instances", "instances")
        keep = [c for c in usable.columns if c not in ("owner_id", "ordinal", "added_at", "reason", "track_id")]
        first = catalog.first_occurrences(usable, ["ordinal"], keep).drop("owner_id")
        tracks = catalog.of_instances(first, instances).join(catalog.owners_per_track(instances), "track_id")
        self._publish(identity.identify(tracks), "tracks")
        named = self._read("tracks", "identity")
        identity.require_separate(named)
        members = named.groupBy("song_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("owner_ids")))).alias("owner_ids"), F.array_sort(F.collect_list("track_id")).alias("track_ids_merged"))
        winner = named.where("track_id = winner_track_id").drop("owner_ids", "owners_count")
        self._publish(winner.join(members, "song_id").withColumn("owners_count", F.size("owner_ids")), "songs")

    def _years(self) -> None:
        date = F.col("song_release_date")
        songs = self._read("songs", "identity")
        self._publish(songs.select("song_id", "winner_track_id", dates.year_of(date).alias("year_candidate"), dates.precision(date).alias("precision"), dates.confidence(date).alias("confidence")), "years")

    def _catalogs(self) -> None:
        """Tracks and songs of all runs, the newest row of each."""
        for name, key, made in (("track_catalog", ["track_id"], "tracks"), ("song_catalog", ["song_id"], "songs")):
            new, path = self._read(made, "identity"), f"{self.s.store}/{name}"
            old = Table(self.spark, path)
            tables.publish(curation.upsert(old.read(), new, key) if old.version() is not None else new, path)

    # ------------------------------------------------------------ curate

    def curate(self) -> list[Step]:
        s = self.s
        steps = []
        own = f"/run_id={s.run_id}/"
        if s.sheet:
            steps += [
                Step("state-before", self._state_before, files=((f"{s.store}/curation_history", own),), writes=self._own("curation_before")),
                Step("import", self._import, reads=self._own("curation_before"), files=((s.sheet, None),), params={"sheet": s.sheet, "now": s.now}),
            ]
        steps += [
            Step("state", self._state, files=((f"{s.store}/curation_history", None),), writes=self._kept("curation_current")),
            Step("curated", self._curated, reads=self._own("songs", "years") + self._kept("curation_current"), writes=self._own("songs_curated", "years_curated", "curation_apply_qc")),
            Step("candidates", self._candidates, reads=self._own("songs_curated", "years_curated"), params={"target": s.candidates, "as_of": s.as_of_year}, writes=self._own("candidates", "candidates_qc")),
        ]
        if s.fetcher:
            steps.append(Step("lookup", self._lookup, reads=self._own("candidates"), params={"fetcher": s.fetcher}, writes=self._kept("year_cache")))
        steps += [
            Step("template", self._template, reads=self._own("candidates", "items", "songs") + self._kept("year_cache"), params={"owners": s.config.owners}, writes=self._own("review_template"), exports=(f"{s.reports}/candidates_review_template.csv", f"{s.reports}/candidates_review_template.xlsx")),
            Step("audits", self._audits, reads=self._own("songs_curated", "years_curated", "candidates"), writes=self._own("audit_songs"), exports=(f"{s.reports}/audit_songs.csv",)),
        ]
        return steps

    def _history(self, without: str | None = None) -> DataFrame:
        return runs.history(self.spark, self.s.store, EVENT, without)

    def _current(self, without: str | None = None) -> DataFrame:
        path = f"{self.s.store}/curation_current"
        held = tables.read_or_empty(self.spark, path, f"{EVENT}, run_id string")
        held = held if without is None else held.where(~F.col("run_id").eqNullSafe(F.lit(without)))
        return review.current_state(held, self._history(without))

    def _state_before(self) -> None:
        """What held before this run's own events."""
        self._publish(self._current(self.s.run_id), "curation_before")

    def _import(self) -> None:
        """The reviewed sheet as events of this run, in the sheet's order."""
        s = self.s
        if s.sheet.endswith(".xlsx"):
            self.spark.dataSource.register(xlsx.XlsxSource)
            sheet = self.spark.read.format("xlsx").option("sheet", "review_template").load(s.sheet)
        else:
            sheet = tables.read_review(self.spark, s.sheet)
        for c in FILLED_IN:
            sheet = sheet if c in sheet.columns else sheet.withColumn(c, F.lit(""))
        review.require_years(sheet, ["year_override", "ai_year"])
        place = sheet.select("song_id", F.monotonically_increasing_id().alias("at")).groupBy("song_id").agg(F.min("at").alias("at"))
        events = review.events_of(sheet, self._read("curation_before", "state-before"), s.run_id, s.now)
        ordered = events.join(place, F.col("entity_id") == F.col("song_id")).orderBy("at", "entity_id").drop("at", "song_id")
        runs.append_history(ordered, s.store, s.run_id)

    def _state(self) -> None:
        state = self._current().withColumnsRenamed({"song_id": "entity_id"}).withColumns({"entity_type": F.lit("song"), "identity_version": F.lit(keys.IDENTITY_VERSION)})
        tables.publish(state, f"{self.s.store}/curation_current")

    def _curated(self) -> None:
        """Songs and years under the latest corrections."""
        songs, years = self._read("songs", "identity"), self._read("years", "years")
        state = tables.read_table(self.spark, f"{self.s.store}/curation_current", "state").select(F.col("entity_id").alias("song_id"), *review.EDITABLE, F.col("updated_at").alias("curation_updated_at"), F.col("run_id").alias("curation_run_id"))
        titles = songs.select("track_name").distinct().withColumn("title_display_current", F.coalesce(text.udfs()["title_display"]("track_name"), "track_name"))
        rows = songs.join(state, "song_id", "left").join(titles, "track_name", "left")
        shown = text.artists_display(F.col("primary_artist_name"), F.col("secondary_artist_names"))
        rows = rows.withColumns({"artists_display_current": shown, "title": F.coalesce("title_display_override", "title_display_current"), "artists": F.coalesce("artists_display_override", shown)})
        self._publish(rows, "songs_curated")
        final = curation.overlay(years, state, "song_id", "year_candidate", "year_override").withColumnRenamed("year_candidate_final", "year_final")
        self._publish(final, "years_curated")
        count = lambda c: F.count(c).alias(f"songs_with_{c.removesuffix('_display_override').removesuffix('_override')}_override")
        self._publish(rows.agg(F.count(F.lit(1)).alias("songs_input"), *[count(c) for c in review.EDITABLE[:3]]), "curation_apply_qc")

    def _candidates(self) -> None:
        """The candidates to review, with what their songs show."""
        songs, years = self._read("songs_curated", "curated"), self._read("years_curated", "curated")
        own = ["song_id", "winner_track_id"]
        # a song without a row of years stays, without a year
        both = songs.join(years.select(*own, "year_candidate", "year_final", "precision", "confidence"), own, "left")
        flagged = selection.max_year_flag(both, "year_final", self.s.as_of_year)
        eligible = flagged.where(F.col("year_final").isNotNull() & ~F.col("exclude_max_year"))
        picked = selection.greedy_candidates(eligible, self.s.candidates)
        chosen = picked.join(both.select(*own, "year_candidate", "year_final", "owner_ids"), "song_id")
        shown = review.with_curation(chosen, songs, ["track_name", "title_display_current", "title", "artists", "primary_artist_name", "secondary_artist_names", "title_display_override", "artists_display_override", "year_override", "note"])
        self._publish(shown, "candidates")
        made = self._read("candidates", "candidates")
        quality = flagged.withColumnRenamed("exclude_max_year", "excluded_by_max_year_rule")
        self._publish(review.candidate_quality(quality, made, self.s.run_id, self.s.as_of_year), "candidates_qc")

    def _isrcs(self) -> DataFrame:
        return review.first_values(self._read("songs", "identity"), "song_id", "isrc", ["winner_track_id"])

    def _lookup(self) -> None:
        """Years of the candidates' recordings, as far as the cache lacks them."""
        wanted = self._isrcs().join(self._read("candidates", "candidates").select("song_id"), "song_id", "left_semi").select("isrc")
        enrichment.fill(self.spark, wanted, f"{self.s.store}/year_cache", "isrc", self.s.fetcher)

    def _template(self) -> None:
        """The review sheet, as a table, CSV and XLSX."""
        s = self.s
        candidates = self._read("candidates", "candidates").withColumnRenamed("track_name", "title_display")
        owners = self._read("songs", "identity").select("song_id", "owner_ids")
        names = self.spark.createDataFrame([(o["owner_id"], o.get("owner_name") or o["owner_id"]) for o in s.config.owners], "owner_id string, owner_name string")
        albums = review.first_values(self._read("items", "instances"), "track_id", "album_name", ["owner_id", "ordinal"])
        years = enrichment.cached(self.spark, f"{s.store}/year_cache", "isrc").select("isrc", F.col("year").alias("found_year"))
        sheet = review.template(candidates, owners, names, albums, self._isrcs(), years, registry.TRACK_URL)
        place = self._read("candidates", "candidates").select("song_id", "selection_rank", "year_override")
        blank = {c: F.lit(None).cast("string") for c in ("ai_year", "ai_note")}
        given = self._read("candidates", "candidates").select("song_id", "artists_display_override", "title_display_override")
        full = sheet.join(place, "song_id").join(given, "song_id").withColumns(blank).orderBy("selection_rank")
        self._publish(full, "review_template")
        made = self._read("review_template", "template").orderBy("selection_rank")
        tables.write_csv(made, f"{s.reports}/candidates_review_template.csv")
        xlsx.write_book(f"{s.reports}/candidates_review_template.xlsx", {"review_template": made})

    def _audits(self) -> None:
        songs = self._read("songs_curated", "curated").withColumn("title_display", F.col("track_name"))
        marks = self._read("candidates", "candidates").select("song_id", "selection_phase")
        self._publish(review.audit(songs, self._read("years_curated", "curated"), marks), "audit_songs")
        tables.write_csv(self._read("audit_songs", "audits"), f"{self.s.reports}/audit_songs.csv")

    # ------------------------------------------------------------ build the deck

    def build_deck(self) -> list[Step]:
        s = self.s
        steps = []
        if s.discard_pending:
            steps.append(Step("discard", self._discard, params={"run": s.run_id}))
        asked = {"config": asdict(s.config), "version": s.version, "prefix": s.prefix, "as_of": s.as_of_year, "now": s.now}
        shown = {"scope": s.print_scope, "split": s.split, "mirror": s.mirror, "style": s.style, "script": s.script}
        files = ["deck", "deck_report", "deck_new_cards.csv", "printed_registry_snapshot.csv", "expansion_summary.csv", "print_plan.csv"]
        return steps + [
            Step("select", self._select, reads=self._own("songs_curated", "years_curated"), params=asked, writes=self._own("new_cards", "expansion_summary")),
            Step("register", self._register, reads=self._own("new_cards"), params={"run": s.run_id}),
            Step("exports", self._exports, reads=self._own("new_cards", "expansion_summary") + self._kept("registry"), params=shown, exports=tuple(f"{s.reports}/{f}" for f in files)),
        ]

    def registered(self, version: int | None = None) -> DataFrame:
        if self.ledger.table.version() is None:
            return self.spark.createDataFrame([], tables.REGISTRY_SCHEMA)
        return self.ledger.read(version)

    def _discard(self) -> None:
        """Cards that were never printed leave the registry."""
        if self.ledger.table.version() is not None:
            self.ledger.reseal(registry.delete_pending(self.registered()), token=f"discard-{self.s.run_id}")

    def _select(self) -> None:
        """New cards for every owner, against the registry as it was when this run first asked."""
        s = self.s
        base = self.runner.pinned("registry", lambda: self.ledger.table.version())
        registered = self.registered(base) if base is not None else self.spark.createDataFrame([], tables.REGISTRY_SCHEMA)
        registry.require_valid(registered)
        songs = self._read("songs_curated", "curated")
        pool = selection.pool(songs, self._read("years_curated", "curated").select("song_id", "year_final"), sorted(s.config.targets()), s.as_of_year)
        pool = pool.select("song_id", "winner_track_id", "year_final", "owner_ids", "artist_key", "album_id", "popularity", "title", "artists", keys.guardrail_key(F.col("artist_key"), F.col("base"), F.col("secondary_artist_names")).alias("guardrail"))
        locked = registered.select("song_id", "expansion_anchor", "year")
        picks = selection.greedy_deck(pool, locked, s.config.targets(), s.config.artist_cap, s.config.album_cap)
        chosen = picks.join(pool, "song_id")
        cards = registry.numbered(chosen, registered, ["pick_order"]).select(
            "song_id",
            "winner_track_id",
            text.card_id(s.prefix, F.col("expansion_anchor"), F.col("number")).alias("card_id"),
            "title",
            "artists",
            F.col("year_final").alias("year"),
            F.array_join("owner_ids", "|").alias("owners"),
            "expansion_anchor",
            F.lit("pending").alias("printed_status"),
            F.lit(s.version).alias("version"),
            F.lit(keys.IDENTITY_VERSION).alias("identity_version"),
            F.lit(s.run_id).alias("run_id"),
            F.lit(s.now).alias("created_at"),
            F.lit(None).cast("string").alias("printed_at"),
            F.col("number").alias("selection_rank"),
            "pick_order",
        )
        self._publish(cards, "new_cards")
        made = self._read("new_cards", "select")
        self._publish(selection.expansion_summary(made.select("song_id", "expansion_anchor"), locked, pool, s.config.targets()), "expansion_summary")

    def _register(self) -> None:
        """The new cards behind the others; a second time it does nothing."""
        new = self._read("new_cards", "select")
        token = f"cards-{self.s.run_id}"
        if self.ledger.table.version() is None or not self.ledger.table.done(token):
            clash = registry.overlap(self.registered(), new)
            if not clash.isEmpty():
                raise ValueError(f"already registered: {[tuple(r) for r in clash.limit(5).collect()]}")
            self.ledger.append(new.drop("selection_rank", "pick_order"), ["expansion_anchor", "card_id"], token)

    def _exports(self) -> None:
        """Deck files with their mirror, report pages, tables of the new cards and the registry, and the print plan."""
        s = self.s
        new, cards = self._read("new_cards", "select"), self.registered()
        tables.export_deck(cards, f"{s.reports}/deck", s.mirror)
        marked = registry.is_new(cards, new).withColumn("owner_ids", text.owners_split(F.col("owners")))
        parts = report.document(marked, ["card_id", "title", "artists", "year", "owners", "printed_status", "version", "is_new"], {"version": s.version, "created_at": s.now})
        tables.report_pages(parts, f"Deck {s.version}", s.style, s.script).write.mode("overwrite").partitionBy("expansion_anchor").text(f"{s.reports}/deck_report")
        tables.write_csv(new, f"{s.reports}/deck_new_cards.csv")
        tables.write_csv(cards, f"{s.reports}/printed_registry_snapshot.csv")
        tables.write_csv(self._read("expansion_summary", "select"), f"{s.reports}/expansion_summary.csv")
        printable = registry.printable(registry.reprint(cards), new, s.print_scope)
        jobs = registry.print_jobs(printable, s.split)
        tables.write_csv(report.job_plan(jobs, registry.print_order(jobs)), f"{s.reports}/print_plan.csv")

    # ------------------------------------------------------------ run

    def steps(self) -> list[Step]:
        return self.ingest() + self.curate() + self.build_deck()

    def run(self, steps: list[Step] | None = None) -> list[str]:
        """All steps, or those given, that are not done yet; returns their names."""
        return self.runner.perform(self.steps() if steps is None else steps)


def filtered_report(cards: DataFrame, path: str, words: str, low: int | None = None, high: int | None = None, by: str = "card_id", descending: bool = False) -> None:
    """The report's rows that show ``words``, in its sort order, as CSV with every field quoted."""
    shown = ["card_id", "expansion_anchor", "title", "artists", "year", "owners", "printed_status", "version", "song_id"]
    rows = cards.where(report.matches(words, shown, low, high)).orderBy(*report.sort_order(by, "card_id", descending))
    tables.write_csv(rows.select(*shown), path, quote_all=True)
