import json
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from setlist.operators import identity, registry, review
from setlist.sources import enrichment, playlists, runs, tables
from setlist.sources.snapshots import Table

SHEET = "song_id string, year_override string, ai_year string, artists_display_override string, title_display_override string, note string, ai_note string"
STATE = "song_id string, year_override int, artists_display_override string, title_display_override string, note string"


def test_events_only_for_changes(spark):
    sheet = spark.createDataFrame([("a", "1990", "", "", "", "", ""), ("b", "", "", "", "T", "", ""), ("c", "", "1980", "", "", "n", "w"), ("d", "", "", "", "", "", ""), ("e", " 1970 ", "", "", "", "", "")], SHEET)
    current = spark.createDataFrame([("a", 1990, None, None, None), ("b", 1991, None, "T", None), ("e", 1970, None, None, None)], STATE)
    got = {r.entity_id: (r.year_override, r.title_display_override, r.note) for r in review.events_of(sheet, current, "r", "now").collect()}
    assert got == {"b": (None, "T", None), "c": (1980, None, "[AI] w | n")}
    review.require_years(sheet, ["year_override", "ai_year"])
    with pytest.raises(ValueError, match="zz"):
        review.require_years(sheet.union(spark.createDataFrame([("zz", "19x", "", "", "", "", "")], SHEET)), ["year_override"])


def test_state_after_history(spark, tmp_path):
    schema = "entity_type string, entity_id string, identity_version string, year_override int, artists_display_override string, title_display_override string, updated_at string, note string"
    store = str(tmp_path / "store")
    runs.bootstrap(spark, store, {"curation_current": schema + ", run_id string"})
    row = lambda i, y, at, kind="song", v="v2.1": (kind, i, v, y, None, None, at, None)
    runs.append_history(spark.createDataFrame([], schema), store, "r0")
    assert runs.history(spark, store, schema).count() == 0
    runs.append_history(spark.createDataFrame([row("a", 1, "2024-01-01T00:00:00"), row("b", 2, "2024-01-01T00:00:00"), row("x", 9, "2024-01-01T00:00:00", "artist"), row("y", 9, "2024-01-01T00:00:00", v="v1")], schema), store, "r1")
    runs.append_history(spark.createDataFrame([row("a", 3, "2023-01-01T00:00:00"), row("b", 4, "soon")], schema), store, "r2")
    runs.append_history(spark.createDataFrame([row("a", 3, "2023-01-01T00:00:00"), row("b", 4, "soon")], schema), store, "r2")  # a repeated run adds nothing
    assert runs.history(spark, store, schema).count() == 6
    current = tables.read_table(spark, f"{store}/curation_current", "bootstrap")
    got = {r.song_id: r.year_override for r in review.current_state(current, runs.history(spark, store, schema)).collect()}
    assert got == {"a": 1, "b": 4}


def test_template_and_audit_edges(spark):
    rows = spark.createDataFrame([("s", "t", None, [], None, None, None, None, None, None)], "song_id string, winner_track_id string, primary_artist_name string, secondary_artist_names array<string>, title_display string, title_display_override string, artists_display_override string, year_candidate int, year_final int, note string")
    empty = lambda schema: spark.createDataFrame([], schema)
    r = review.template(rows, empty("song_id string, owner_ids array<string>"), empty("owner_id string, owner_name string"), empty("track_id string, album_name string"), empty("song_id string, isrc string"), empty("isrc string, found_year int"), "u/").first()
    assert (r.track_url, r.title_display, r.artists_display, r.owners, r.mb_match, r.year_suspect, r.suspect_reason) == ("u/t", None, None, None, "", False, "")


CALLS: list[str] = []


def lookup(key):
    CALLS.append(key)
    if key == "bad":
        raise OSError("no route")
    return {"unknown": None, "k1": {"recordings": [{"first-release-date": "1999-02"}, {"first-release-date": " 1987"}, {}, {"first-release-date": "n/a"}]}}.get(key, {"recordings": []})


def broken(key):
    if key == "k049":
        raise KeyError("gone")
    return {"recordings": [{"first-release-date": str(1900 + int(key[1:]))}]}


def test_enrichment(spark, tmp_path):
    path = str(tmp_path / "cache")
    Table(spark, path).commit(spark.createDataFrame([("old", 1950, "1"), ("none", None, "1"), ("old", 1951, "2")], "isrc string, year int, fetched_at string"))
    wanted = spark.createDataFrame([("old",), ("none",), (" k1 ",), ("k1",), ("bad",), ("unknown",), (None,), (" ",), ("z",)], "isrc string")
    assert enrichment.fill(spark, wanted, path, "isrc", "tests.test_review.lookup", pause=0.0, flush=2) == 3
    got = {r.isrc: r.year for r in enrichment.cached(spark, path, "isrc").collect()}
    assert got == {"old": 1951, "none": None, "k1": 1987, "unknown": None, "z": None}
    assert enrichment.fill(spark, wanted.where("isrc <> 'bad'"), path, "isrc", "tests.test_review.lookup", pause=0.0) == 0
    assert enrichment.earliest_year(None) is None and enrichment.earliest_year({"recordings": None}) is None


@pytest.mark.parametrize("flush", [7, 50, 1000])
def test_what_was_fetched_stays(spark, tmp_path, flush):
    path = str(tmp_path / "cache")
    wanted = spark.createDataFrame([(f"k{i:03d}",) for i in range(60)], "isrc string")
    for _ in range(2):  # the second call asks again for the key that failed, and for none before it
        with pytest.raises(RuntimeError, match="k049"):
            enrichment.fill(spark, wanted, path, "isrc", "tests.test_review.broken", pause=0.0, flush=flush)
        rows = enrichment.cached(spark, path, "isrc")
        assert rows.count() == 49 and rows.agg(F.max("isrc")).first()[0] == "k048"
    assert Table(spark, path).read().count() == 49


def test_runs(spark, tmp_path):
    now = datetime(2024, 5, 6, 7, 8, 9)
    name = runs.run_id(now, 666)
    assert name.startswith("20240506_070809_") and name == runs.run_id(now, 666) != runs.run_id(now, 1)
    made = runs.create(spark, str(tmp_path), name)
    for seed in (666, 7):  # a run that goes on keeps its manifest
        runs.write_manifest(spark, str(tmp_path), name, "c.json", [{"owner_id": "a"}], seed, now)
    assert Path(made["raw"]).is_dir() and not Path(made["renders"]).exists()
    assert json.loads(Path(tmp_path, name, "manifest.json").read_text())["owners"] == [{"owner_id": "a"}]
    assert json.loads(Path(tmp_path, name, "params.json").read_text())["seed"] == 666
    assert runs.latest(spark, str(tmp_path)) == name and runs.latest(spark, str(tmp_path / "none")) is None


def test_playlist_counts(spark):
    items = spark.createDataFrame([("a", 1, None), ("a", None, None), ("b", None, 2)], "owner_id string, track int, item int")
    totals = spark.createDataFrame([("a", None, 7), ("b", 5, 6), ("c", None, None)], "owner_id string, tracks_total int, items_total int")
    assert sorted(tuple(r) for r in playlists.playlist_counts(items, totals).collect()) == [("a", 7, 2, 1, 1), ("b", 5, 1, 1, 0), ("c", None, 0, 0, 0)]


def test_collisions_raise(spark):
    rows = [("g1", 100_000), ("g2", 300_000)]
    far = spark.createDataFrame([("s", g, d, "postpass_conservative") for g, d in rows], "song_id string, group_id string, duration_ms int, match_type string")
    with pytest.raises(ValueError, match="s"):
        identity.require_separate(far)
    identity.require_separate(far.withColumn("duration_ms", F.col("duration_ms") % 7))
    assert identity.postpass_merges(far).first()[0] == 1


def test_rollup_keeps_the_original_order(spark):
    rows = [("s", 3, 0, None, 2, 5, False, "2000", ["a"]), ("s", 1, 1, "First", 1, 9, False, "1999-01", ["b"]), ("s", 2, 2, "Second", 1, 7, True, None, ["a"]), ("t", 9, 3, " ", 1, 1, False, None, [])]
    df = spark.createDataFrame(rows, "song_id string, track_id long, order_idx long, track_name string, owners_count long, popularity int, had_suffix boolean, release_date string, owner_ids array<string>")
    got = {r.song_id: (r.winner_track_id, r.title, r.merged_track_ids, r.owner_ids, r.release_track_id) for r in identity.rollup(df, "order_idx").collect()}
    assert got == {"s": (3, "First", [3, 1, 2], ["a", "b"], 1), "t": (9, "9", [9], [], None)}
    rule = {r.song_id: r.winner_rule_path for r in identity.winner_rule(df, F.col("song_id") == "s").collect()}
    assert rule == {"s": "postpass_conservative>owners_count", "t": "single_variant"}


def test_registry_versions(spark, tmp_path):
    path = str(tmp_path / "reg")
    one = spark.createDataFrame([("c1", "s1", "pending")], "card_id string, song_id string, printed_status string")
    tables.publish(one, path, backup="v0")
    more = registry.append(tables.read_table(spark, path, "x"), spark.createDataFrame([("c2", "s2", "pending")], one.schema))
    tables.publish(more, path, backup="v1")
    more = tables.read_table(spark, path, "x")
    assert more.count() == 2 and tables.read_backup(spark, path, "v1").count() == 1
    with pytest.raises(ValueError, match="scope"):
        registry.printable(one, one, "some")
    assert registry.printable(more, one, "new-only").count() == 1
    assert "&lt;b&gt;" in tables.report_html("{}", "<b>")
